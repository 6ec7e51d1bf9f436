"""Mixing sources to target weights; built-in functions only.

Targets are set by raising a common level until the weights' shares meet the caps. Each source is
cut into permuted blocks. A source's quota of blocks counts every copy that the mix takes; the
quotas are split between two halves of the output shards, and again, until each shard has its own
(a multivariate hypergeometric draw at every node: as if the node's blocks were shuffled and
dealt). Shards then take disjoint runs of each source's permuted blocks, and rows are ordered at
random inside their shard.
"""

import re

from pyspark.sql import DataFrame, Window, functions as F

from driftgate.llm.common import log2_ceil, shielded, text_or_empty
from driftgate.operators.ordering import index_rows
from driftgate.session import materialize

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
BLOCK_WORDS = 1 << 18
#: Words of an output shard, at most about: some 1 GB of text.
SHARD_WORDS = 1 << 27
SEED = 11


def word_count(column="text"):
    return F.regexp_count(text_or_empty(column), F.lit(r"[^\t-\r ]+")).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats=MAX_REPEATS) -> DataFrame:
    """From (source, source_size): idx (code point order, null last), weight, target.

    Targets share the whole size by weight. A source whose share is above `max_repeats` times
    its size stops there, and the excess is shared among the others by weight, until none is above.
    Each pass over the table of sources is one aggregate; a source that has stopped stays so.
    """
    listed = index_rows(sizes.withColumn("_null", F.col("source").isNull()), [],
                        ["_null", "source"]).drop("_null")
    weight = F.element_at(F.array(*map(F.lit, weights)),
                          (F.col("idx") % len(weights) + 1).cast("int"))
    listed = materialize(listed.withColumn("weight", weight), "sources")
    cap = max_repeats * F.col("source_size")
    total = listed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, stopped = None, -1
    while True:
        share = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap
        row = listed.agg(F.count(F.when(share, 1)), F.sum(F.when(share, cap)),
                         F.sum(F.when(~share, F.col("weight")))).first()
        if row[0] == stopped or not row[2]:
            break
        stopped, level = row[0], float(total - (row[1] or 0)) / row[2]
    level = 0.0 if level is None else level
    return listed.withColumn("target", F.least(F.col("weight") * F.lit(level),
                                               cap.cast("double")))


# A hypergeometric draw: of `total` blocks, `own` of this source, `room` go left. The weights of
# the possible counts are built outwards from the likeliest one, as far as ten deviations; each
# count replaces the one held with its share of the weight so far, so one pass draws exactly.
# `s.seed` differs per node and source.
_LOW = "greatest(0L, room - (total - own))"
_HIGH = "least(own, room)"
_MODE = f"least({_HIGH}, greatest({_LOW}, (room + 1) * (own + 1) div (total + 2)))"
_REACH = "(20L + cast(10 * sqrt(1D * room * own / greatest(1L, total)) as bigint))"
_UNIFORM = "(pmod(xxhash64({x}, salt), 1L << 52) / cast(1L << 52 as double))"
_TAKE = f"""named_struct('w', s.w * ({{ratio}}), 't', s.t + s.w,
    'x', if({_UNIFORM.format(x='x')} * (s.t + s.w) < s.w, x, s.x))"""
_UP = "1D * (own - x) * (room - x) / ((x + 1D) * (total - own - room + x + 1D))"
_DOWN = "1D * x * (total - own - room + x) / ((own - x + 1D) * (room - x + 1D))"


def _draw(total, own, room, salt):
    """SQL for one draw from the named expressions."""
    values = {"total": total, "own": own, "room": room, "salt": salt}

    def named(text):
        return re.sub(r"(?<![.\w])(total|own|room|salt)\b", lambda m: f"({values[m[1]]})", text)

    mode = named(_MODE)
    up = (f"aggregate(sequence({mode}, least({named(_HIGH)}, {mode} + {named(_REACH)})), "
          f"named_struct('w', 1D, 't', 0D, 'x', {mode}), (s, x) -> "
          f"{named(_TAKE.format(ratio=_UP))})")
    down = (f"aggregate(if({mode} > {named(_LOW)}, "
            f"sequence({mode} - 1, greatest({named(_LOW)}, {mode} - {named(_REACH)}), -1L), "
            f"cast(array() as array<bigint>)), "
            f"named_struct('w', {named(_DOWN.replace('x', f'({mode})'))}, 't', {up}.t, "
            f"'x', {up}.x), (s, x) -> {named(_TAKE.format(ratio=_DOWN))})")
    return f"{down}.x"


def split_quotas(quotas: DataFrame, shards_log2, seed=SEED) -> DataFrame:
    """(idx, quota) of all sources -> (shard, idx, quota): exact splits whose shards have equal
    totals to within one block. The table has one row per source, the tree one node per shard.
    """
    node = quotas.where("quota > 0").agg(F.array_sort(F.collect_list(F.struct(
        F.col("idx").alias("idx"), F.col("quota").cast("long").alias("q")))).alias("qs"))
    node = node.select(F.lit(0).cast("long").alias("shard"), "qs")
    for level in range(shards_log2):
        total = "aggregate(qs, 0L, (t, q) -> t + q.q)"
        x = _draw("a.total", "q.q", "a.room",
                  f"xxhash64({seed}, {level}, shard, q.idx)")
        node = node.withColumn("_total", F.expr(total)).withColumn(
            "_room", F.expr("_total div 2 + if(_total % 2 = 1 and "
                            f"pmod(xxhash64({seed}, {level}, shard), 2L) = 1, 1L, 0L)"))
        step = (f"(a, q) -> named_struct('total', a.total - q.q, "
                f"'room', a.room - {x}, 'left', array_append(a.left, {x}))")
        node = node.withColumn("_left", F.expr(
            "aggregate(qs, named_struct('total', _total, 'room', _room, "
            f"'left', cast(array() as array<bigint>)), {step}).left"))
        node = node.select(F.explode(F.expr(
            "array(named_struct('shard', shard * 2, 'qs', zip_with(qs, _left, (q, x) -> "
            "named_struct('idx', q.idx, 'q', x))), "
            "named_struct('shard', shard * 2 + 1, 'qs', zip_with(qs, _left, (q, x) -> "
            "named_struct('idx', q.idx, 'q', q.q - x))))")).alias("n")).select("n.*")
    return node.select("shard", F.explode("qs").alias("q")).select(
        "shard", F.col("q.idx").alias("idx"), F.col("q.q").alias("quota")).where("quota > 0")


def plan_mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source",
             weights=WEIGHTS, max_repeats=MAX_REPEATS, block_words=BLOCK_WORDS,
             shard_words=SHARD_WORDS, seed=SEED) -> DataFrame:
    """One row per document: the id, size, source, source_size, target, copies, shards, taken.

    `shards` has the output shard of each copy that is taken. Their number is the power of two that
    brings a shard to `shard_words` or less. Every source's copies add up to its
    target to within a part of a document. Null texts have size 0; null is a source of its own, the
    last. Rows that repeat an id are documents of their own. Reruns agree: every choice is a hash of
    the seed with the id, the size and the text's hash, never of the partitioning.
    """
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        word_count(text_col).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("_h"))
    sized = materialize(sized, "sizes")
    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")),
                             weights, max_repeats)
    sources = sources.withColumn("_blocks", F.greatest(F.lit(1).cast("long"), F.ceil(
        F.col("source_size") / F.lit(block_words)).cast("long")))
    sources = sources.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(
        F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    sources = materialize(sources.withColumn(
        "_part", F.col("target") - F.col("_whole") * F.col("source_size")), "targets")
    words = sources.agg(F.sum("target")).first()[0] or 0
    shards_log2 = log2_ceil(words / shard_words)
    rows = (sized.withColumnRenamed("source", "_source").join(
        sources, F.col("_source").eqNullSafe(F.col("source")))
        .withColumn("_block", F.pmod(F.xxhash64(F.lit(seed + 1), "_h"), F.col("_blocks"))))
    keyed = materialize(rows.drop("_source"), "blocked")

    # A source's blocks in permuted order: those before the partial target are drawn whole, the
    # one that it falls into document by document.
    blocks = keyed.groupBy("idx", "_block").agg(
        F.sum("size").alias("_words"), F.first("_part").alias("_part"),
        F.first("_whole").alias("_whole"))
    order = Window.partitionBy("idx").orderBy(
        F.xxhash64(F.lit(seed + 2), "idx", "_block"), "_block")
    blocks = blocks.withColumn("_rank", F.row_number().over(order).cast("long") - 1)
    blocks = blocks.withColumn("_before", F.sum("_words").over(order) - F.col("_words"))
    blocks = blocks.withColumn("_drawn", F.when(
        F.col("_before") + F.col("_words") <= F.col("_part"), 2).when(
        F.col("_before") < F.col("_part"), 1).otherwise(0))
    # The quota counts block copies; a block that is drawn in part counts like a whole one.
    quotas = blocks.groupBy("idx").agg(
        (F.sum("_whole") + F.count(F.when(F.col("_drawn") > 0, 1))).alias("quota"))
    blocks = materialize(blocks, "blocks")
    shares = materialize(split_quotas(quotas, shards_log2, seed), "quotas")
    by_shard = Window.partitionBy("idx").orderBy("shard")
    shares = shares.withColumn("_to", F.sum("quota").over(by_shard))
    # Slot of a block's c-th copy: c-th round over the permuted blocks of the source.
    count = Window.partitionBy("idx")
    slots = (blocks.withColumn("_n", F.count("*").over(count))
             .withColumn("_copies", F.col("_whole") + F.when(F.col("_drawn") > 0, 1).otherwise(0))
             .where("_copies > 0")
             .withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"),
                                                       F.col("_copies") - 1)))
             .withColumn("_slot", F.col("_copy") * F.col("_n") + F.col("_rank")))
    ends = shares.groupBy("idx").agg(F.array_sort(F.collect_list(
        F.struct("_to", "shard"))).alias("_ends"))
    dealt = slots.join(ends, "idx").withColumn("_shard", F.expr(
        "element_at(filter(_ends, e -> e._to > _slot), 1).shard"))
    dealt = dealt.groupBy("idx", "_block").agg(
        F.array_sort(F.collect_list(F.struct("_copy", "_shard"))).alias("_shards"),
        F.max("_drawn").alias("_drawn"), (F.first("_part") - F.first("_before")).alias("_rest"))
    dealt = materialize(dealt, "dealt")

    placed = keyed.join(dealt, ["idx", "_block"], "left")
    # One block per source is drawn in part, a bounded number of words: documents in permuted
    # order as long as they fit, then the one whose size comes nearest to the gap that is left.
    # Rows that are alike in everything go in or stay out together.
    partial = Window.partitionBy("idx").orderBy("_h", "doc_id", "size")
    source = Window.partitionBy("idx")
    some = placed.where("_drawn = 1").withColumn("_fits", F.sum("size").over(partial)
                                                 <= F.col("_rest"))
    some = some.withColumn("_gap", F.col("_rest") - F.sum(
        F.when(F.col("_fits"), F.col("size")).otherwise(0)).over(source))
    off = F.abs(F.col("size") - F.col("_gap"))
    some = some.withColumn("_off", F.when(~F.col("_fits") & (off < F.col("_gap")),
                                          F.struct(off, F.col("_h"))))
    some = materialize(some.withColumn("_in", F.col("_fits") | F.coalesce(
        F.col("_off") == F.min("_off").over(source), F.lit(False)))
        .drop("_fits", "_gap", "_off"), "partial")
    rest = placed.where("_drawn is null or _drawn != 1").withColumn(
        "_in", F.coalesce(F.col("_drawn") == 2, F.lit(False)))
    both = rest.unionByName(some.select(*rest.columns))
    copies = (F.col("_whole") + F.when(F.col("_in"), 1).otherwise(0)).cast("int")
    return both.select(
        "doc_id", "size", "source", "source_size", "target", copies.alias("copies"),
        F.when(copies == 0, F.array().cast("array<bigint>")).otherwise(
            F.slice(F.col("_shards")["_shard"], F.lit(1), copies)).alias("shards"),
        (F.col("size") * copies).alias("taken"), F.col("_h").alias("row_hash"))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", seed=SEED, **options) -> DataFrame:
    """The mixed rows: one per copy taken, all columns as they came, plus `shard` and
    `shard_order`, the random place inside the shard. Written `partitionBy("shard")` and sorted by
    `shard_order`, each shard is a local shuffle."""
    plan = plan_mix(docs, id_col, text_col, seed=seed, **options).where("copies > 0").select(
        F.col("row_hash").alias("_h"), F.col("doc_id").alias("_id"), "shards")
    plan = plan.dropDuplicates(["_h", "_id"])
    plain, back = shielded(docs, id_col, text_col)
    keyed = plain.withColumn("_h", F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)))
    taken = keyed.join(plan, (keyed["_h"] == plan["_h"])
                       & keyed[id_col].eqNullSafe(plan["_id"])).drop(plan["_h"], plan["_id"])
    taken = taken.select("*", F.posexplode("shards").alias("_copy", "shard")).drop("shards")
    return back(taken.withColumn("shard_order", F.xxhash64(F.lit(seed + 3), "_h", "_copy")),
                "shard", "shard_order")
