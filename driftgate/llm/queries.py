"""The queries of the training-data operators, with SQL where SQL can say the same."""

import functools

from pyspark.sql import functions as F

from driftgate.llm import (
    decontaminate, exact_dedup, licenses, line_dedup, mixing, packing, periodic, prefix_trie,
    quality, repeats, simhash, token_files, url_reputation,
)

QUERIES, ORACLES = {}, {}


def _query(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_decontaminate", decontaminate.SQL)
def op1(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.find_leaks(
        docs, _table(spark, sf_dir, "benchmark"), keep_text=False))


@_query("op2_exact_dedup", exact_dedup.SQL)
def op2(spark, sf_dir):
    return exact_dedup.mark_copies(_table(spark, sf_dir, "documents"))


@_query("op3_repeated_passages", repeats.SQL)
def op3(spark, sf_dir):
    return repeats.remove_repeats(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@_query("op4_mix_sources")
def op4(spark, sf_dir):
    return mixing.plan_mix(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies", "shards")


@_query("op5_simhash")
def op5(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


@_query("op6_line_dedup", line_dedup.SQL)
def op6(spark, sf_dir):
    return line_dedup.digest(line_dedup.removed_lines(_table(spark, sf_dir, "documents")))


@_query("op7_token_files")
def op7(spark, sf_dir):
    return token_files.round_trip(_table(spark, sf_dir, "documents"))


@_query("op8_quality")
def op8(spark, sf_dir):
    return quality.score_documents(_table(spark, sf_dir, "documents"),
                                   _table(spark, sf_dir, "labels"))


@_query("op9_licenses", licenses.SQL)
def op9(spark, sf_dir):
    return licenses.scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_matches", "license", "dice", "licenses")


@_query("op10_url_reputation", url_reputation.SQL)
def op10(spark, sf_dir):
    """A page's outcome is the label of the document of the same number: good when of good quality
    and not toxic."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    outcomes = _table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), F.when(
            F.col("quality").isNull() | F.col("toxic").isNull(), None).otherwise(
            F.when(bad, 0).otherwise(1)).alias("good"))
    return url_reputation.filter_urls(_table(spark, sf_dir, "pages"), outcomes).select(
        "page_id", "host", "path", "rule", "verdict")


@_query("op11_pack_sequences")
def op11(spark, sf_dir):
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


@_query("op12_prefix_trie", prefix_trie.SQL)
def op12(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations")
    return prefix_trie.prefix_trie(prefix_trie.spliced(prefix_trie.conversation_paths(turns)))


@_query("op13_periodic_runs", periodic.SQL)
def op13(spark, sf_dir):
    docs = periodic.plant_runs(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return periodic.digest(periodic.find_runs(docs, keep_text=False))


def add_pipeline(pipeline):
    """Register the pipeline's run as a query."""
    QUERIES["pipeline"] = pipeline.run
    if pipeline.ORACLE_SQL is not None:
        ORACLES["pipeline"] = pipeline.ORACLE_SQL


def shipped(ship):
    """The queries, each of which first sends the package to the executors by `ship`."""
    def wrap(fn):
        @functools.wraps(fn)
        def run(spark, sf_dir):
            return fn(ship(spark), sf_dir)
        return run
    return {name: wrap(fn) for name, fn in QUERIES.items()}
