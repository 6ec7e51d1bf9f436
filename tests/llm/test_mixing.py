"""The mix against its rules, on the given documents and on made-up sources."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from driftgate.llm import mixing

SF = "/root/testdata/sf0.001"


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """Targets by source: shares by weight, stopped at `most` times the size, the excess reshared."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in stopped]
        left = total - sum(most * sizes[s] for s in stopped)
        level = left / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if weight[s] * level > most * sizes[s]}
        if not above:
            return {s: most * sizes[s] if s in stopped else weight[s] * level for s in order}
        stopped |= above


@pytest.mark.parametrize("shard_words,n", [(1 << 27, 1), (None, 64)])
def test_given_documents(spark, shard_words, n):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = {r.doc_id: (r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")))
             for r in docs.collect()}
    sizes = Counter()
    for source, size in words.values():
        sizes[source] += size
    total = sum(sizes.values())
    options = {"block_words": 512, "shard_words": shard_words or -(-total // 64)}
    plan = mixing.plan_mix(docs, **options)
    rows = plan.collect()
    targets, taken, largest = plain_targets(sizes), Counter(), Counter()
    for r in rows:
        assert (r.source, r.size) == words[r.doc_id] and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3 and len(r.shards) == r.copies
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert len(rows) == len(words)
    for source, target in targets.items():
        assert abs(taken[source] - target) <= largest[source]
    used = {s for r in rows for s in r.shards}
    assert used <= set(range(n)) and len(used) > 0.9 * n
    again = mixing.plan_mix(docs.repartition(7), **options)
    key = lambda r: (r.doc_id, r.copies, tuple(r.shards))
    assert sorted(map(key, again.collect())) == sorted(map(key, rows))
    mixed = mixing.mix(docs, **options)
    assert mixed.columns == [*docs.columns, "shard", "shard_order"]
    got = Counter((r.doc_id, r.shard) for r in mixed.select("doc_id", "shard").collect())
    assert got == Counter((r.doc_id, s) for r in rows for s in r.shards)


@pytest.mark.parametrize("log2", [0, 3, 6])
def test_split_is_exact_and_even(spark, log2):
    quotas = {i: q for i, q in enumerate([4000, 1, 0, 333, 64, 2, 917])}
    df = spark.createDataFrame(list(quotas.items()), "idx long, quota long")
    by_shard, by_source = Counter(), defaultdict(int)
    for r in mixing.split_quotas(df, log2).collect():
        by_shard[r.shard] += r.quota
        by_source[r.idx] += r.quota
    assert by_source == {i: q for i, q in quotas.items() if q}
    assert sum(by_shard.values()) == sum(quotas.values()) and len(by_shard) == 2 ** log2
    assert max(by_shard.values()) - min(by_shard.values()) <= log2 + 1


def test_edges(spark):
    schema = "doc_id string, text string, source string, shard int, Size string"
    empty = spark.createDataFrame([], schema)
    assert mixing.plan_mix(empty).count() == 0 and mixing.mix(empty).count() == 0
    rows = [("a", "x y z", "s", 1, "n"), ("a", "x y z", "s", 1, "n"), (None, None, None, 2, None),
            ("b", " \t ", None, 3, "n"), ("c", "word " * 400, "t", 4, "n")]
    docs = spark.createDataFrame(rows, schema)
    plan = mixing.plan_mix(docs)
    got = {r.doc_id: (r.size, r.source_size, r.copies) for r in plan.collect()}
    assert got["a"][:2] == (3, 6) and got["c"][0] == 400 and got[None][0] == 0
    assert {r.target for r in plan.where(F.col("source") == "s").collect()} == {18.0}
    assert got["a"][2] == 3  # the small source stops at three times its size
