"""Exact duplicates with a two-pass Bloom filter; built-in functions only.

Pass one sends each row's two filter bits, nothing else, to the segment of the filter that owns
them. Bits that were set at least twice make the second filter. Pass two tests every row against
it: a row that misses a bit has no equal and passes straight through; only the others shuffle,
with a count and a minimum per text combined before the exchange.

The second filter has a fixed largest size and is the only thing that is broadcast. When the
input outgrows it, more rows count as possibly repeated and shuffle; the result stays exact.
"""

from pyspark.sql import DataFrame, functions as F

from driftgate.llm.common import log2_ceil, shielded, text_or_empty
from driftgate.session import materialize

BITS_PER_ROW = 16
MAX_FILTER_BITS = 1 << 27


def normalized(column="text"):
    """White space runs become one space; null is empty. A lone space stays as it is, so only
    other runs are replaced."""
    return F.regexp_replace(text_or_empty(column), r"[\t-\r ]{2,}|[\t-\r]", " ")


def _keyed(docs, text_col, words):
    """The digest, and the row's two bits: the filter word and a mask in it."""
    hashed = docs.withColumn("_sha", F.sha2(normalized(text_col), 256))
    hashed = hashed.withColumn("_h", F.xxhash64("_sha"))
    return (hashed.withColumn("_word", F.expr(f"pmod(shiftright(_h, 12), {words}L)"))
            .withColumn("_bits", F.expr("shiftleft(1L, cast(_h & 63 as int)) | "
                                        "shiftleft(1L, cast(shiftright(_h, 6) & 63 as int))"))
            .drop("_h"))


def _second_filter(keyed):
    """(word, mask) of the bits that two rows or more have set."""
    slots = keyed.select(F.explode(F.expr(
        "filter(sequence(0, 63), b -> bit_get(_bits, b) = 1)")).alias("_b"), "_word")
    twice = (slots.groupBy("_word", "_b").agg(F.count("*").alias("_n")).where("_n > 1"))
    return twice.groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _b))").alias("_mask"))


def _filter_words(docs, max_filter_bits):
    return 1 << max(0, log2_ceil(min(max_filter_bits, BITS_PER_ROW * docs.count())) - 6)


def _groups(keys, second):
    """One row per text that occurs more than once: the smallest id and the count."""
    found = (_maybe_repeated(keys, second, True).groupBy("_sha")
             .agg(F.min("doc_id").alias("_keep"), F.count("*").alias("_size"))
             .where("_size > 1"))
    return materialize(found, "copies")


def _maybe_repeated(keyed, second, wanted):
    joined = keyed.join(F.broadcast(second), "_word", "left")
    repeated = F.coalesce(F.expr("_mask & _bits = _bits"), F.lit(False))
    return joined.where(repeated if wanted else ~repeated).drop("_mask")


def mark_copies(docs: DataFrame, id_col="doc_id", text_col="text",
                max_filter_bits=MAX_FILTER_BITS) -> DataFrame:
    """One row per document: its id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest id stays. Null and empty texts are equal. A null id
    never wins against another; a group without any id keeps all its rows, with keep_id null.
    Rows that repeat an id and its text share its fate. An empty table gives an empty table.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    words = _filter_words(docs, max_filter_bits)
    keys = materialize(_keyed(narrow, "_text", words).drop("_text"), "text-keys")
    second = materialize(_second_filter(keys), "second-filter")
    groups = _groups(keys, second)
    alone = _maybe_repeated(keys, second, False).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.col("_sha").alias("text_sha256"))
    together = _maybe_repeated(keys, second, True).join(groups, "_sha", "left").select(
        "doc_id", F.when(F.col("_size").isNull(), F.col("doc_id")).otherwise(F.col("_keep"))
        .alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("_size").isNull() | F.col("doc_id").eqNullSafe(F.col("_keep"))).alias("kept"),
        F.col("_sha").alias("text_sha256"))
    return alone.unionByName(together)


def drop_copies(docs: DataFrame, id_col="doc_id", text_col="text",
                max_filter_bits=MAX_FILTER_BITS) -> DataFrame:
    """The documents that stay, all columns as they came. Rows that are surely alone do not
    shuffle."""
    words = _filter_words(docs, max_filter_bits)
    plain, back = shielded(docs, id_col, text_col)
    keyed = _keyed(plain, text_col, words)
    keys = materialize(keyed.select(F.col(id_col).alias("doc_id"), "_sha", "_word", "_bits"),
                       "text-keys")
    second = materialize(_second_filter(keys), "second-filter")
    groups = _groups(keys, second)
    alone = _maybe_repeated(keyed, second, False).drop("_sha", "_word", "_bits")
    together = (_maybe_repeated(keyed, second, True).join(groups, "_sha", "left")
                .where(F.col("_size").isNull() | F.col(id_col).eqNullSafe(F.col("_keep")))
                .drop("_sha", "_word", "_bits", "_keep", "_size"))
    return back(alone.unionByName(together))


SQL = r"""
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha AS text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS sha
      FROM documents)
WINDOW same AS (PARTITION BY sha)"""
