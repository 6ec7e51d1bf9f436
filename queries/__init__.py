"""Driver queries: each operator over the test tables, next to its SQL equivalent."""
