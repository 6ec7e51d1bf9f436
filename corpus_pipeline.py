"""A corpus pipeline in five stages, each one operator of `driftgate.llm`.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a
DataFrame; all but the last return the columns of `docs`. `run` writes each stage's result to the
shared folder and reads it again, so a lost executor costs a part of one stage.
"""

from driftgate.llm import decontaminate, mixing, quality, simhash, token_files
from driftgate.session import materialize, ship

#: No SQL can say what a trained classifier keeps: the tests compare with a brute-force version.
ORACLE_SQL = None


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def classify(spark, docs, sf_dir):
    """Drop the documents that the quality classifier rejects."""
    return quality.keep_good(docs, _table(ship(spark), sf_dir, "labels"))


def drop_near_copies(spark, docs, sf_dir):
    """One document of each group of near-duplicates stays: the smallest id."""
    ship(spark)
    return simhash.keep_one(docs)


def drop_leaks(spark, docs, sf_dir):
    """Cut benchmark passages; drop documents that consist of them by more than half."""
    return decontaminate.decontaminate(docs, _table(ship(spark), sf_dir, "benchmark"))


def mix(spark, docs, sf_dir):
    """Draw the sources to their target weights; a document taken twice is there twice. The next
    stage writes in the order of ids, so the shards' order is not made."""
    ship(spark)
    return mixing.mix(docs).select(*docs.columns)


def write_tokens(spark, docs, sf_dir):
    """Token files of the mix, read back: doc_id, start, n_tokens, ids_crc32."""
    ship(spark)
    return token_files.round_trip(docs)


STAGES = [
    ("quality classifier", classify),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources", mix),
    ("token files", write_tokens),
]


def run(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
