"""Periodic runs of words by a sparse diagonal DP over earlier occurrences.

A run is a stretch of consecutive words with smallest period q that is at least max(6, 4q) words long
and that no neighbouring word extends. Word i against word i - q is diagonal q: along a run that
diagonal matches without a gap, so a run is a match length that ends at q short of the run's length.

Only diagonals that can become runs are followed. Of a word's earlier occurrences those with a lag
in (k/2, k], k a power of two, count through the k words that start there and only at their nearest
earlier occurrence: within a run of period q <= k the nearest one is exactly q words back, since a
nearer one would give the run a smaller period (Fine and Wilf). So every position has one active lag
per k; the DP adds up match lengths along equal lags, and a diagonal that ends long enough is a run,
with its smallest period. Words and their k-grams are numbered exactly, no hashes are compared, and only
k-grams that occur again are doubled, so text that does not repeat costs little more than its words.

The DP runs for a batch of texts at once, in arrays of a bounded number of words unless one text has more.
"""

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (ArrayType, LongType, StringType, StructField, StructType)

from driftgate.llm.common import offsets, text_or_empty, without

MIN_LENGTH = 6
MIN_REPEATS = 4
#: Words of the texts that are worked on at once.
WORDS_AT_ONCE = 400_000
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _numbered(texts):
    """The word numbers of all texts one after another, a number of its own after each text."""
    known = dict.fromkeys(itertools.chain.from_iterable(texts))
    for number, word in enumerate(known):
        known[word] = number
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = offsets(sizes + 1)
    symbols = np.empty(int(starts[-1]), np.int64)
    is_word = np.ones(len(symbols), bool)
    is_word[starts[1:] - 1] = False
    symbols[is_word] = np.fromiter(map(known.__getitem__, itertools.chain.from_iterable(texts)),
                                   np.int64, int(sizes.sum()))
    symbols[~is_word] = len(known) + np.arange(len(texts))
    return symbols, starts


def _lags(keys, at):
    """Distance of each position to the nearest earlier one of the same key (0: none), whether its key
    occurs again at all, and the keys as dense numbers. `at` ascends."""
    order = np.argsort(keys, kind="stable")
    ordered, places = keys[order], at[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    lag, again, dense = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool), np.empty_like(keys)
    lag[order[1:]] = np.where(same[1:-1], np.diff(places), 0)
    again[order] = same[1:] | same[:-1]
    dense[order] = np.cumsum(~same[:-1])
    return lag, again, dense


def _diagonals(at, lag, k):
    """The stretches (start, end, period) of positions with equal lag in (k/2, k] in a row."""
    chosen = (2 * lag > k) & (lag <= k)
    at, lag = at[chosen], lag[chosen]
    if not len(at):
        return np.zeros((0, 3), np.int64)
    first = np.ones(len(at), bool)
    first[1:] = (np.diff(at) != 1) | (np.diff(lag) != 0)
    low = np.flatnonzero(first)
    high = np.append(low[1:], len(at)) - 1
    return np.stack([at[low] - lag[low], at[high] + k, lag[low]], 1)


def runs_of(symbols, longest, min_length=MIN_LENGTH, min_repeats=MIN_REPEATS):
    """Runs (start, length, period) of a sequence of numbers, sorted. `longest`: of its texts, between
    which no number occurs twice."""
    at, k, out = np.arange(len(symbols)), 1, []
    keys = symbols
    while len(at) and k < 2 * max(1, longest // min_repeats):
        lag, again, dense = _lags(keys, at)
        out.append(_diagonals(at, lag, k))
        # Twice as long: two k-grams in a row that both occur again.
        at, dense = at[again], dense[again]
        following = np.searchsorted(at, at + k)
        following[following == len(at)] = 0
        both = at[following] == at + k if len(at) else np.zeros(0, bool)
        keys = dense[both] * (len(symbols) + 1) + dense[following[both]]
        at, k = at[both], 2 * k
    found = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
    found[:, 1] -= found[:, 0]
    found = found[found[:, 1] >= np.maximum(min_length, min_repeats * found[:, 2])]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _kept(size, runs):
    """Which of a batch's words stay: those in no run, or in the first period of all they are in."""
    edges = np.zeros(size + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:-1]) == 0


def _scan_texts(texts, min_length, min_repeats):
    """(words, runs, collapsed text) of each text, given as lists of words."""
    symbols, starts = _numbered(texts)
    longest = max(map(len, texts))
    runs = runs_of(symbols, longest, min_length, min_repeats)
    kept = _kept(len(symbols), runs)
    bounds = np.searchsorted(runs[:, 0], starts)
    for i, words in enumerate(texts):
        low, high = bounds[i], bounds[i + 1]
        own = runs[low:high] - [starts[i], 0, 0]
        if high > low:
            words = itertools.compress(words, kept[starts[i]:starts[i + 1]].tolist())
        yield len(texts[i]), own, b" ".join(words)


def _groups(column, words_at_once):
    """Lists of the texts' words, of about `words_at_once` words unless one text has more."""
    held, size = [], 0
    for value in column:
        words = value.as_py().split()
        if held and size + len(words) > words_at_once:
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield held


def _scan(batches, min_length, min_repeats, words_at_once, with_text):
    for batch in batches:
        sizes, counts, runs, texts = [], [], [np.zeros((0, 3), np.int64)], []
        for group in _groups(batch.column("_utf8"), words_at_once):
            for size, own, text in _scan_texts(group, min_length, min_repeats):
                sizes.append(size)
                counts.append(len(own))
                runs.append(own)
                if with_text:
                    texts.append(text)
        values = np.concatenate(runs)
        runs = pa.ListArray.from_arrays(
            pa.array(offsets(counts), pa.int32()),
            pa.StructArray.from_arrays([pa.array(values[:, i]) for i in range(3)],
                                       fields=list(_RUN)))
        columns = {n: batch.column(n) for n in batch.schema.names if n != "_utf8"}
        columns |= {"n_words": pa.array(sizes, pa.int64()), "runs": runs}
        if with_text:
            columns["collapsed_text"] = pa.array(texts, pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_pydict(columns)


def find_runs(docs: DataFrame, text_col="text", min_length=MIN_LENGTH, min_repeats=MIN_REPEATS,
              words_at_once=WORDS_AT_ONCE, keep_text=True, with_text=True) -> DataFrame:
    """Add n_words, runs (start, length, period in words, by start, then period) and with `with_text`
    collapsed_text: the words joined by a space, without those that a run contains after its first
    period.

    Words are what stands between ASCII white space. A run is at least `min_length` words and
    `min_repeats` (3 or more) periods long. Null and empty texts have no words, no runs and an empty
    collapsed text.
    Rows are worked on alone: repeated rows and ids give repeated results, an empty table gives an empty
    one. Very long texts are taken whole; their memory is some 100 bytes a word. Columns of the added names
    in `docs` give way; all others pass through, the text unless `keep_text` is off.
    """
    if min_repeats < 3:
        raise ValueError("a smallest period is only certain from three periods on")
    frame = without(docs, *{"n_words", "runs", "collapsed_text", "_utf8"} - {text_col}).withColumn(
        "_utf8", text_or_empty(text_col).cast("binary"))
    frame = frame if keep_text else frame.drop(text_col)
    run = StructType([StructField(f.name, LongType()) for f in _RUN])
    schema = StructType([*[f for f in frame.schema.fields if f.name != "_utf8"],
                         StructField("n_words", LongType()), StructField("runs", ArrayType(run))]
                        + [StructField("collapsed_text", StringType())] * with_text)
    return frame.mapInArrow(
        lambda b: _scan(b, min_length, min_repeats, words_at_once, with_text), schema)


def plant_runs(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Make the texts of about a tenth of the ids periodic: with h the CRC-32 of the decimal id,
    g = h div 10 and n words, an id with h % 10 = 0 has its words from a = g % n on replaced by
    repetitions of the first p of them, p = 1 + (n - a) div (3 + g % 8)."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def cycled(words):
        n = F.size(words).cast("long")
        a = g % F.greatest(n, F.lit(1))
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(
            F.get(words, (a + (i - a) % p).cast("int")))), " ")

    words = F.regexp_extract_all(F.col(text_col), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    # One element, so that the words are taken apart once.
    planted = F.get(F.transform(F.array(words), cycled), F.lit(0))
    return docs.withColumn(text_col, F.when(
        (h % 10 == 0) & F.col(text_col).isNotNull(), planted).otherwise(F.col(text_col)))


def digest(found: DataFrame, id_col="doc_id") -> DataFrame:
    """n_runs, the run with the greatest length/period (ties: smallest start, then period), and SHA-256 of
    all runs and of the collapsed text."""
    first = F.get("runs", F.lit(0))
    best = F.aggregate("runs", first, lambda b, r: F.when(
        r.length * b.period > b.length * r.period, r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","),
        r.period.cast("string"), F.lit("\n"))), "")
    return found.withColumn("_best", best).select(
        id_col, F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(F.lit(1000) * F.col("_best.length") / F.col("_best.period"))
        .alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w0,
    CAST(list_reduce(list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1),
        lambda i: CAST(ord(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT)),
      lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda s, z: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END),
      4294967295) AS BIGINT) AS crc
  FROM documents),
e AS (SELECT doc_id, w0, xor(crc, 4294967295) AS h, len(w0) AS n FROM d),
f AS (SELECT *, (h // 10) % n AS a, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) AS p
      FROM e WHERE n > 0 AND h % 10 = 0),
g AS (
  SELECT doc_id, list_transform(range(0, n), lambda i:
    CASE WHEN i < a THEN w0[i + 1] ELSE w0[a + (i - a) % p + 1] END) AS w FROM f
  UNION ALL SELECT doc_id, w0 FROM e WHERE NOT (n > 0 AND h % 10 = 0)),
v AS (SELECT doc_id, unnest(range(0, len(w))) AS i, unnest(w) AS word, len(w) AS n FROM g),
x AS (SELECT doc_id, i, n, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' '
        || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS five
      FROM v WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
y AS (SELECT b.doc_id, b.i, b.i - c.i AS q FROM x b JOIN x c
      ON b.doc_id = c.doc_id AND b.five = c.five AND c.i < b.i AND (b.i - c.i) * 4 <= b.n),
z AS (SELECT doc_id, q, min(i) - q AS s, max(i) + 5 AS e FROM (
        SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM y)
      GROUP BY doc_id, q, island HAVING max(i) + 5 - min(i) + q >= greatest(6, 4 * q)),
r AS (SELECT doc_id, s, e - s AS length, q FROM z WHERE NOT EXISTS (
        SELECT 1 FROM z t WHERE t.doc_id = z.doc_id AND t.q < z.q AND t.s <= z.s AND t.e >= z.e)),
best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id
           ORDER BY CAST(length AS DOUBLE) / q DESC, s, q) = 1),
listed AS (SELECT doc_id, count(*) AS n_runs,
             sha256(string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q)) AS sha
           FROM r GROUP BY doc_id),
dropped AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + length)) AS i FROM r),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM v
         WHERE NOT EXISTS (SELECT 1 FROM dropped k WHERE k.doc_id = v.doc_id AND k.i = v.i)
         GROUP BY doc_id)
SELECT g.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, length, q AS period,
  1000 * length // q AS exponent_milli, coalesce(sha, sha256('')) AS runs_sha256,
  sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM g LEFT JOIN best ON g.doc_id = best.doc_id LEFT JOIN listed ON g.doc_id = listed.doc_id
LEFT JOIN kept ON g.doc_id = kept.doc_id"""
