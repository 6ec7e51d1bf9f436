"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every run of words of the benchmark items. A document's words are streamed
through it; at each word it knows the longest match that ends there. Where that reaches a window
of an item, the window's words are hit. Items are taken in blocks of a bounded number of words:
one automaton, one broadcast and one pass over the documents per block, so neither the driver nor
a worker holds more than a block. One block is enough for usual benchmarks.
"""

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from driftgate.llm.common import shielded, text_or_empty, utf8, without
from driftgate.session import materialize

WINDOW = 10
MAX_COVERAGE = 0.5
BLOCK_WORDS = 400_000
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
# Letters, digits and everything beyond ASCII stay (A-Z in lower case), the rest is a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128
             else 32 for c in range(256))
SPANS = ArrayType(ArrayType(IntegerType()))


def words_of(data: bytes) -> list:
    return data.translate(FOLD).split()


class ItemAutomaton:
    """Suffix automaton of items [(id, [word])] over word numbers, with the items per window."""

    def __init__(self, items, window=WINDOW):
        self.window = window
        self.vocab, self.next, self.link, self.length = {}, [{}], [-1], [0]
        coded = [(name, [self.vocab.setdefault(w, len(self.vocab)) for w in words])
                 for name, words in items if words]
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.shortest = min([window, *(len(ids) for _, ids in coded)])
        self._mark(coded)

    def _new(self, length, moves, link):
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, state, target, c):
        """The state of exactly the string of `state` plus c, cloned off `target` if needed."""
        if self.length[target] == self.length[state] + 1:
            return target
        clone = self._new(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = clone
        while state != -1 and self.next[state].get(c) == target:
            self.next[state][c] = clone
            state = self.link[state]
        return clone

    def _extend(self, last, c):
        known = self.next[last].get(c)
        if known is not None:
            return self._split(last, known, c)
        new = self._new(self.length[last] + 1, {}, 0)
        while last != -1 and c not in self.next[last]:
            self.next[last][c] = new
            last = self.link[last]
        if last != -1:
            self.link[new] = self._split(last, self.next[last][c], c)
        return new

    def _mark(self, coded):
        """For each state the state of its last `window` words, and the short items that end it."""
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        self.at_window, self.ending = [-1] * len(self.next), [()] * len(self.next)
        for s in order:
            above = self.link[s]
            self.at_window[s] = (s if self.length[above] < self.window <= self.length[s]
                                 else self.at_window[above])
        self.items = {}
        own = {}
        for name, ids in coded:
            for (state, _), position in zip(self._walk(ids), itertools.count(1)):
                if position >= self.window:
                    self.items.setdefault(self.at_window[state], set()).add(name)
            if len(ids) < self.window:
                own.setdefault(state, set()).add((len(ids), name))
        for s in order:
            if s in own or self.ending[self.link[s]]:
                self.ending[s] = (*self.ending[self.link[s]], *sorted(own.get(s, ())))

    def _walk(self, ids):
        """(state, length of the longest match) after each word."""
        state = length = 0
        for c in ids:
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state, length = self.next[state][c], length + 1
            yield state, length

    def match(self, words):
        """Hit spans [start, end) in words, merged, and the items with occurring windows."""
        spans, names = [], set()
        if not self.vocab or len(words) < self.shortest:
            return spans, names
        ids = np.fromiter(map(self.vocab.get, words, itertools.repeat(-1)), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([-1], np.minimum(ids, 0), [-1]))))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - start < self.shortest:
                continue
            for at, (state, length) in enumerate(self._walk(ids[start:end].tolist()), start + 1):
                reach = 0
                if length >= self.window:
                    reach = self.window
                    names |= self.items[self.at_window[state]]
                for n, name in self.ending[state]:
                    if n <= length:
                        reach = max(reach, n)
                        names.add(name)
                if reach:
                    spans.append((at - reach, at))
        return merge_spans(spans), names


def merge_spans(spans):
    out = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def cut(data: bytes, spans) -> bytes:
    """The text without its hit spans, each from its first word's start to its last word's end."""
    places = [m.span() for m in WORD.finditer(data)]
    out, done = [], 0
    for start, end in spans:
        out.append(data[done:places[start][0]])
        done = places[end - 1][1]
    return b"".join([*out, data[done:]])


def item_blocks(items: DataFrame, id_col, text_col, window, block_words):
    """Lists of (id as text, words) of at most `block_words` words. A longer item comes in pieces
    that overlap by a window less one word, so no window is lost."""
    step = block_words - window + 1
    words = F.filter(F.split(F.regexp_replace(
        F.translate(text_or_empty(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                    "abcdefghijklmnopqrstuvwxyz"),
        r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), " "), lambda w: w != "")
    pieces = items.select(F.col(id_col).cast("string").alias("id"), words.alias("w")).where(
        F.size("w") > 0).select("id", F.size("w").alias("n"), "w", F.explode(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1), F.lit(step)))
        .alias("at")).select("id", F.slice("w", F.col("at"), block_words).alias("w"))
    block, held = [], 0
    for row in pieces.toLocalIterator():
        if held + len(row.w) > block_words and block:
            yield block
            block, held = [], 0
        block.append((row.id or "", [w.encode() for w in row.w]))
        held += len(row.w)
    yield block


def _scan(automaton, batches, with_text, final):
    for batch in batches:
        out_n, out_spans, out_items, out_text = [], [], [], []
        before = zip(batch.column("hit_spans").to_pylist(), batch.column("hit_items").to_pylist())
        texts = batch.column("_utf8")
        for i, (spans, names) in enumerate(before):
            data = texts[i].as_py()
            words = words_of(data)
            more, found = automaton.match(words)
            if more:
                spans, names = merge_spans([*spans, *more]), sorted({*names, *found})
            out_n.append(len(words))
            out_spans.append(spans)
            out_items.append(names)
            if with_text:
                out_text.append(cut(data, spans).decode("utf-8", "replace") if spans else None)
        columns = {name: batch.column(name) for name in batch.schema.names
                   if name not in ("hit_spans", "hit_items", "n_words")
                   and not (final and name == "_utf8")}
        columns |= {"hit_spans": pa.array(out_spans, pa.list_(pa.list_(pa.int32()))),
                    "hit_items": pa.array(out_items, pa.list_(pa.string())),
                    "n_words": pa.array(out_n, pa.int64())}
        if with_text:
            columns["clean_text"] = pa.array(out_text, pa.string())
        yield pa.RecordBatch.from_pydict(columns)


def find_leaks(docs: DataFrame, items: DataFrame, window=WINDOW, block_words=BLOCK_WORDS,
               text_col="text", item_id_col="item_id", item_text_col="text",
               with_text=False, keep_text=True) -> DataFrame:
    """Add n_words, hit_spans ([start, end) in words, merged), hit_items (ids as text, sorted),
    n_hit, and with `with_text` clean_text: the text without its hit spans.

    A window is `window` consecutive words of an item, or a shorter item as a whole. Null texts
    and texts without words have no hits; items without words have no windows. Items that share an
    id count once, and a null id counts as the empty one. Columns of these names in `docs` give
    way; all others pass through, the text unless `keep_text` is off.
    """
    names = ["n_words", "hit_spans", "hit_items", "n_hit", "clean_text", "_utf8"]
    frame = without(docs, *names).withColumns({
        "_utf8": utf8(text_col), "hit_spans": F.array().cast(SPANS),
        "hit_items": F.array().cast("array<string>")})
    frame = frame if keep_text else frame.drop(text_col)
    spark = docs.sparkSession
    blocks = item_blocks(items, item_id_col, item_text_col, window, block_words)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        final = following is None
        shared = spark.sparkContext.broadcast(ItemAutomaton(block, window))
        fields = [f for f in frame.schema.fields
                  if f.name not in ("hit_spans", "hit_items", "n_words")
                  and not (final and f.name == "_utf8")]
        schema = StructType([*fields, StructField("hit_spans", SPANS),
                             StructField("hit_items", ArrayType(StringType())),
                             StructField("n_words", LongType())]
                            + [StructField("clean_text", StringType())]
                            * (final and with_text))

        def run(batches, shared=shared, final=final):
            return _scan(shared.value, batches, final and with_text, final)

        frame = frame.mapInArrow(run, schema)
        if following is not None:
            frame = materialize(frame, "leaks")
        block = following
    hits = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    frame = frame.withColumn("n_hit", hits)
    if with_text:
        frame = frame.withColumn("clean_text", F.coalesce("clean_text", F.col(text_col)))
    return frame


def decontaminate(docs: DataFrame, items: DataFrame, window=WINDOW, max_coverage=MAX_COVERAGE,
                  text_col="text", **options) -> DataFrame:
    """The documents with every hit span removed, without those of which more than
    `max_coverage` of the words were hit. Columns as they came."""
    plain, back = shielded(docs, text_col)
    found = find_leaks(plain, items, window, text_col=text_col, with_text=True, **options)
    kept = found.where(F.col("n_hit") <= F.col("n_words") * max_coverage)
    return back(kept.withColumn(text_col, F.col("clean_text")))


def digest(found: DataFrame, id_col="doc_id") -> DataFrame:
    items = F.array_sort(F.array_distinct("hit_items"))
    return found.select(
        id_col, "n_words", "n_hit", F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


EMPTY = hashlib.sha256(b"").hexdigest()
SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n,
         unnest([array_to_string(w[i:i + 9], ' ') FOR i IN range(1, greatest(len(w) - 9, 1) + 1)])
         AS gram
  FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS pos,
         unnest([array_to_string(w[i:i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS gram
  FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT doc_id, g.n, pos, item FROM grams g JOIN windows v ON g.n = v.n AND g.gram = v.gram),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items,
                 sha256(array_to_string(list_sort(list(DISTINCT item)), ',')) AS items_sha256
          FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, '{EMPTY}') AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN found ON d.doc_id = found.doc_id"""
