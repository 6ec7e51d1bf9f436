"""The table of queries and the SQL each one must equal."""

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    """Register a query function under `name`, with its SQL where SQL can say it."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


def sql(*ctes, select):
    """A SELECT below named subqueries."""
    return f"WITH {', '.join(ctes)} {select}" if ctes else select
