"""Repeated passages by prefix-free parsing, bounded to the first `length` bytes of each suffix.

A rolling hash of 16 bytes is taken at every byte. The position of its minimum over a sliding
window is a trigger, so triggers depend on content alone and none is further than a window from the
next. Triggers cut a text into phrases. The suffix that starts at byte p is a phrase suffix (from p
to the next trigger) followed by the parse suffix from that trigger on, and the corpus order of
suffixes is the order of parse suffixes refined by the phrase suffixes before them. Two suffixes
share their first `length` bytes only if they share the trigger's place and both of these parts.

So suffixes are put into the classes of that order by hashes, without sorting the classes (no suffix array of
dictionary or parse is built), and refined only where classes may still differ:
parse suffixes are bucketed by the bytes that all suffixes of the phrase have in common (most
buckets hold one suffix, which is settled); inside a bucket, equal phrase contexts are one class of the
dictionary; where a bucket holds several classes, one of each is refined with runs of 16
phrase suffixes and then with single ones. A class of two or more is a repeat.

All buckets and classes are counts and minima that are combined before each exchange. The text is
read twice and joined twice: for the contexts of unsettled phrases and for the final cut.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from driftgate.llm.common import utf8, without
from driftgate.session import materialize

LENGTH = 400
GRAM = 16
WINDOW = 192
STEPS = (16, 1)
_CHUNK = 1 << 18
_POSITION_BITS = np.uint64(20)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _keys(data: np.ndarray) -> np.ndarray:
    """Rolling hash of GRAM bytes at each place, its low bits replaced so that of equal hashes the
    last is the least."""
    hashes, base = data.astype(np.uint64) + np.uint64(1), _BASE
    span = 1
    while span < GRAM:
        hashes = hashes[:-span] * base + hashes[span:]
        base = base * base
        span *= 2
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    low = np.uint64((1 << int(_POSITION_BITS)) - 1)
    places = low - np.arange(len(hashes), dtype=np.uint64)
    return (hashes & ~low) | places


def phrase_suffixes(data: bytes, length=LENGTH, window=WINDOW):
    """(trigger, first, last) for runs of suffix starts that share their trigger; starts have
    `length` bytes after them."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros((0, 3), np.int64)
    raw = np.frombuffer(data, np.uint8)
    triggers = np.empty(n, np.int64)
    low = np.uint64((1 << int(_POSITION_BITS)) - 1)
    with np.errstate(over="ignore"):
        for start in range(0, n, _CHUNK):
            end = min(n, start + _CHUNK)
            least = _keys(raw[start:end + window + GRAM - 2])
            span = 1
            while span < window:
                step = min(span, window - span)
                least = np.minimum(least[:-step], least[step:])
                span += step
            triggers[start:end] = (low - (least & low)).astype(np.int64) + start
    firsts = np.flatnonzero(np.diff(triggers, prepend=-1))
    return np.stack([triggers[firsts], firsts, np.append(firsts[1:], n) - 1], axis=1)


def _place(trigger, near, far):
    """Trigger and the distances of the nearest and the furthest suffix start before it."""
    return (trigger << 16) | (near << 8) | far


def _signed(values):
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _phrase_rows(batches, length, window):
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        rows, cores, hulls, places = [], [], [], []
        for i, value in enumerate(batch.column("_utf8")):
            data = value.as_py()
            found = phrase_suffixes(data, length, window).tolist()
            rows += [i] * len(found)
            for at, first, last in found:
                near, far = at - last, at - first
                cores.append(digest(data[at:at + length - window + 1]))
                hulls.append(digest(data[first:last + length], near << 8 | far))
                places.append(_place(at, near, far))
        take = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id").take(take), batch.column("_h").take(take), _signed(cores),
             _signed(hulls), pa.array(places, pa.int64()),
             pa.array(np.zeros(len(rows), bool))],
            names=["_id", "_h", "core", "hull", "place", "known"])


def _settle(records: DataFrame, name: str):
    """(repeats, unsettled) of records (_id, _h, core, hull, place, known).

    A class is a core and a hull. Members of a class of two or more are repeats; `known` records
    stand for such a class of the step before. Unsettled are, in cores with several classes, the
    members of classes of one and one member of each other class.
    """
    records = materialize(records, f"{name}-records")
    shared = materialize(records.groupBy("core").agg(F.count("*").alias("n")).where("n > 1")
                         .select("core"), f"{name}-shared")
    some = materialize(records.join(shared, "core"), f"{name}-candidates")
    who = F.struct("_id", "_h", "place")
    classes = materialize(some.groupBy("core", "hull").agg(
        F.sum(F.when(F.col("known"), 2).otherwise(1)).alias("n"), F.min(who).alias("first")),
        f"{name}-classes")
    several = classes.groupBy("core").agg((F.count("*") > 1).alias("several"))
    classes = materialize(classes.join(several, "core"), f"{name}-judged")
    members = materialize(some.join(classes, ["core", "hull"]), f"{name}-members")
    repeats = members.where("n > 1 and not known").select("_id", "_h", "place")
    unsettled = members.where(F.col("several") & ((F.col("n") == 1) | (who == F.col("first"))))
    return repeats, unsettled.select("_id", "_h", "place", (F.col("n") > 1).alias("known"))


def _context_rows(batches, length):
    """The bytes around each unsettled trigger, from its furthest start to the nearest one's end."""
    for batch in batches:
        rows, places, known, contexts = [], [], [], []
        for i, value in enumerate(batch.column("_utf8")):
            data = value.as_py()
            for entry in batch.column("_todo")[i].as_py():
                at, near, far = entry["place"] >> 16, entry["place"] >> 8 & 255, entry["place"] & 255
                rows.append(i)
                places.append(entry["place"])
                known.append(entry["known"])
                contexts.append(data[at - far:at - near + length])
        take = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id").take(take), batch.column("_h").take(take),
             pa.array(places, pa.int64()), pa.array(known, pa.bool_()),
             pa.array(contexts, pa.binary())], names=["_id", "_h", "place", "known", "context"])


def _refined_rows(batches, length, step):
    """Each run of starts cut at multiples of `step` before its trigger. A piece's core is what all
    starts of such a piece share; `whole` has the place of the context in the first table."""
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        rows, cores, hulls, places = [], [], [], []
        contexts = batch.column("context")
        origin = batch.column("whole").to_pylist()
        for i, place in enumerate(batch.column("place").to_pylist()):
            at, near, far = place >> 16, place >> 8 & 255, place & 255
            base = origin[i] & 255  # the context starts this far before the trigger
            data = contexts[i].as_py()
            for group in range(near // step, far // step + 1):
                d1, d2 = max(near, group * step), min(far, group * step + step - 1)
                inner, outer = group * step, group * step + step - 1
                # Between the piece's own limits, clipped alike wherever the piece occurs whole.
                core = data[base - inner:base - outer + length]
                cores.append(digest(core, group + 1))
                hulls.append(digest(data[base - d2:base - d1 + length], d1 << 8 | d2))
                rows.append(i)
                places.append(_place(at, d1, d2))
        take = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id").take(take), batch.column("_h").take(take), _signed(cores),
             _signed(hulls), pa.array(places, pa.int64()), batch.column("known").take(take)],
            names=["_id", "_h", "core", "hull", "place", "known"])


_RECORD = "core long, hull long, place long, known boolean"


def repeated_starts(docs: DataFrame, id_col="doc_id", text_col="text", length=LENGTH,
                    window=WINDOW) -> DataFrame:
    """(_id, _h, place): runs of suffix starts whose first `length` bytes start elsewhere too.
    _h is a hash of the id and the text, for rows that repeat an id."""
    base = _base(docs, id_col, text_col)
    kind = base.schema["_id"].dataType.simpleString()
    parts = []
    repeats, unsettled = _settle(base.mapInArrow(
        lambda b: _phrase_rows(b, length, window), f"_id {kind}, _h long, {_RECORD}"), "phrases")
    parts.append(repeats)
    todo = unsettled.groupBy("_id", "_h").agg(F.collect_list(F.struct("place", "known"))
                                              .alias("_todo"))
    # Rows alike in id and text are one text here; their equal records were counted above.
    found = _on_key(base, materialize(todo, "unsettled")).dropDuplicates(["_id", "_h"])
    contexts = materialize(found.select("_id", "_h", "_utf8", "_todo").mapInArrow(
        lambda b: _context_rows(b, length),
        f"_id {kind}, _h long, place long, known boolean, context binary"), "contexts")
    pieces = contexts.withColumn("whole", F.col("place"))
    for step in STEPS:
        repeats, unsettled = _settle(pieces.mapInArrow(
            lambda b, step=step: _refined_rows(b, length, step),
            f"_id {kind}, _h long, {_RECORD}"), f"pieces-{step}")
        parts.append(repeats)
        trigger = F.shiftright("place", 16)
        wholes = contexts.select("_id", "_h", F.col("place").alias("whole"), "context")
        pieces = _on_key(unsettled.withColumn("_at", trigger), wholes.withColumn(
            "_at", F.shiftright("whole", 16)), "_at")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _base(docs, id_col, text_col):
    return docs.select(F.col(id_col).alias("_id"),
                       F.xxhash64(F.col(id_col), F.col(text_col)).alias("_h"),
                       utf8(text_col).alias("_utf8"))


def _on_key(left, right, *more):
    """Inner join on _id (null equals null), _h and more."""
    condition = left["_id"].eqNullSafe(right["_id"]) & (left["_h"] == right["_h"])
    for name in more:
        condition &= left[name] == right[name]
    return left.join(right, condition).drop(right["_id"], right["_h"], *[right[m] for m in more])


def covered(starts, length):
    """Merged byte runs [start, end) that suffixes starting in `starts` cover."""
    out = []
    for first, last in sorted(starts):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return out


def _cut_rows(batches, length, with_text):
    for batch in batches:
        columns = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes")}
        spans_out = []
        todo = batch.column("_places").to_pylist()
        for i, value in enumerate(batch.column("_utf8")):
            data = value.as_py()
            spans = covered([((p >> 16) - (p & 255), (p >> 16) - (p >> 8 & 255))
                             for p in todo[i] or ()], length)
            done, kept = 0, []
            for start, end in spans:
                kept.append(data[done:start])
                done = end
            rest = b"".join([*kept, data[done:]]) if spans else data
            columns["n_bytes"].append(len(data))
            columns["n_removed"].append(len(data) - len(rest))
            columns["n_spans"].append(len(spans))
            columns["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
            columns["kept_bytes"].append(rest if with_text else None)
            spans_out.append(spans)
        arrays = {n: batch.column(n) for n in batch.schema.names if n not in ("_utf8", "_places")}
        arrays |= {n: pa.array(columns[n], pa.int64()) for n in ("n_bytes", "n_removed", "n_spans")}
        arrays["kept_sha256"] = pa.array(columns["kept_sha256"], pa.string())
        arrays["removed"] = pa.array(spans_out, pa.list_(pa.list_(pa.int64())))
        if with_text:
            arrays["kept_bytes"] = pa.array(columns["kept_bytes"], pa.binary())
        yield pa.RecordBatch.from_pydict(arrays)


def remove_repeats(docs: DataFrame, id_col="doc_id", text_col="text", length=LENGTH,
                   window=WINDOW, with_text=False) -> DataFrame:
    """Add n_bytes, n_removed, n_spans, kept_sha256, removed ([start, end) in bytes), and with
    `with_text` kept_bytes, to the documents (without `with_text`: to their ids).

    A byte goes when a string of `length` bytes that covers it also starts anywhere else, in the
    same text or another. Strings are judged on the input and lie inside one text. Null is empty;
    texts shorter than `length` keep all. Rows that repeat an id and a text repeat each other. Input
    columns of these names give way. Kept bytes may cut a letter of several bytes in two.
    """
    if not length - window >= GRAM or window > 256:
        raise ValueError("the window must be at most 256 and shorter than length by GRAM bytes")
    names = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept_bytes")
    starts = repeated_starts(docs, id_col, text_col, length, window)
    places = materialize(starts.groupBy("_id", "_h").agg(
        F.collect_set("place").alias("_places")), "repeats")
    plain = without(docs, *names, "_h", "_utf8", "_places")
    plain = plain if with_text else plain.select(id_col, text_col)
    keyed = plain.withColumn("_h", F.xxhash64(F.col(id_col), F.col(text_col)))
    joined = keyed.join(places, keyed[id_col].eqNullSafe(places["_id"])
                        & (keyed["_h"] == places["_h"]), "left").drop(places["_h"], "_id", "_h")
    joined = joined.withColumn("_utf8", utf8(text_col))
    joined = joined if with_text else joined.drop(text_col)
    schema = joined.drop("_utf8", "_places").withColumns(
        {n: F.lit(0).cast("long") for n in names[:3]} | {"kept_sha256": F.lit("")}
        | {"removed": F.array().cast("array<array<long>>")}
        | ({"kept_bytes": F.lit("").cast("binary")} if with_text else {})).schema
    return joined.mapInArrow(lambda b: _cut_rows(b, length, with_text), schema)


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
starts AS (
  SELECT doc_id, p, hash(substr(x, 2 * p + 1, 800)) AS a, md5(substr(x, 2 * p + 1, 800)) AS b
  FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 399)) AS p FROM d WHERE len(x) >= 800)),
repeated AS (SELECT doc_id, p FROM starts QUALIFY count(*) OVER (PARTITION BY a, b) > 1),
runs AS (
  SELECT doc_id, run, min(p) AS first, max(p) + 400 AS last
  FROM (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run
        FROM (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 400
                                     THEN 0 ELSE 1 END AS fresh FROM repeated))
  GROUP BY doc_id, run),
pieces AS (
  SELECT doc_id, first, last, lag(last, 1, 0) OVER (PARTITION BY doc_id ORDER BY first) AS done
  FROM runs),
cuts AS (
  SELECT r.doc_id, sum(last - first) AS n_removed, count(*) AS n_spans,
         string_agg(substr(x, 2 * done + 1, 2 * (first - done)), '' ORDER BY first)
         || substr(any_value(x), 2 * max(last) + 1) AS kept
  FROM pieces r JOIN d ON r.doc_id = d.doc_id GROUP BY r.doc_id)
SELECT d.doc_id, len(x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN cuts ON d.doc_id = cuts.doc_id"""
