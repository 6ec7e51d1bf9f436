"""Line deduplication by an exact set-similarity join.

Lines are sets of words, ordered from rare to common: words below a share of all words come first, by
level (the logarithm of the count in a word's slot) and hash, the others by count. Two lines of
Jaccard similarity t or more share a word among their first n - ceil(t n) + 1, and at their first
shared word enough words follow in both. Lines are indexed by these prefixes, without words that
occur once in all texts; equal sets are one class. Inside a word's group, pairs pass the length
filter, the positional filter, a parity signature (a lower bound of the words that only one
has) and a filter by the word before: two lines that share that too meet at an earlier word. A
line that keeps a partner is a candidate with that word. Sets are fetched for candidates alone; a
signature of 512 bits, which tells long lines apart too, goes to the groups first, and whole sets,
for what still has a partner, are verified inside the groups. No pairs are emitted: a group
reports which of its classes have an earlier match.

Rows of lines and documents are written from the scan; only index rows are exchanged by word. A word
with very many classes is cut into chunks before that, and every pair of chunks is work of its own.
"""

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from driftgate.llm.common import (
    blockwise_groups, log2_ceil, mix64, offsets, runs, shielded, utf8, whole_groups,
)
from driftgate.llm.decontaminate import FOLD
from driftgate.session import broadcast_bounded, materialize

SIMILARITY = 0.8
#: Words with at least this share of all words are ordered by count: as many at most.
COMMON_WORDS = 65_536
GROUP = 20_000
MAX_FETCH_BITS = 1 << 27
#: One byte a slot.
MAX_SLOT_BITS = 24
_PAGE_BITS = 16
_COMMON = np.uint64(1 << 63)
_POSITIONS = 20
WIDE_BITS = 512
#: Text that is taken apart into words at once.
SLICE_BYTES = 1 << 21
#: Words of which equal ones are counted before they are exchanged.
WORDS_AT_ONCE = 1 << 22
#: Words beyond that many bytes are hashed one by one.
LONG_WORD = 64
#: Spreads the lines of a document over the bitmap; times any line it fits 63 bits.
LINE_STEP = 0x5851F42D
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _text_lines(texts):
    """Texts joined by line feeds; first byte and end of each line in that; lines per text."""
    data = b"\n".join(texts)
    feeds = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    begins, ends = np.append(0, feeds + 1), np.append(feeds, len(data))
    if not texts:
        begins = ends = feeds
    counts = np.diff(np.searchsorted(begins, offsets([len(t) + 1 for t in texts])))
    return data, begins, ends, counts


def _word_hashes(data):
    """A hash of 63 bits and the first byte of every word, in order: 8 bytes at a time of all words, up to
    LONG_WORD. Words of up to 8 bytes never share one before it is cut to 63 bits."""
    folded = data.translate(FOLD) + b" "
    inside = np.frombuffer(folded, np.uint8) != 32
    bounds = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        bounds = np.append(0, bounds)
    starts, ends = bounds[::2], bounds[1::2]
    length = ends - starts
    eights = np.frombuffer(folded + bytes(16 - len(folded) % 8), "<u8")

    def eight(at, left):
        shift = ((at & 7) << 3).astype(np.uint64)
        place = at >> 3
        both = (eights[place] >> shift) | ((eights[place + 1] << np.uint64(1)) << (np.uint64(63) - shift))
        return both & _FIRST_BYTES[np.minimum(left, 8)]

    hashes = mix64(eight(starts, length))
    for done in range(8, LONG_WORD, 8):
        more = np.flatnonzero(length > done)
        if not len(more):
            break
        hashes[more] = mix64(hashes[more] ^ eight(starts[more] + done, length[more] - done))
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(folded[starts[i]:ends[i]])
    return hashes >> np.uint64(1), starts


def _count_rows(batches, at_once=WORDS_AT_ONCE):
    words, held = [], 0

    def rows():
        found, n = np.unique(np.concatenate(words), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)],
                                          names=["word", "n"])

    for batch in _slices(batches):
        words.append(_word_hashes(b"\n".join(batch.column("_utf8").to_pylist()))[0])
        held += len(words[-1])
        if held > at_once:
            yield rows()
            words, held = [], 0
    if words:
        yield rows()


def word_counts(base: DataFrame) -> DataFrame:
    # A task's rows are of different words: they are added up after the exchange only.
    return materialize(base.select("_utf8").mapInArrow(_count_rows, "word long, n long").repartition("word")
                       .groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def common_words(counts: DataFrame, limit=COMMON_WORDS) -> np.ndarray:
    """Hashes of the words that make up at least one in `limit` of all words, rarest first; there
    are `limit` of them at most."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = counts.where(F.col("n") * limit >= total).orderBy("n", "word").collect()
    return np.array([r.word for r in rows], np.uint64)


def _page_rows(batches):
    """Rows (page, levels): the levels of 65,536 slots each, from rows (slot, n)."""
    pages = {}
    for batch in batches:
        slots, n = (batch.column(c).to_numpy() for c in ("slot", "n"))
        by = np.argsort(slots)
        slots, n = slots[by], n[by]
        starts, ends = runs(slots >> _PAGE_BITS)
        for start, end in zip(starts.tolist(), ends.tolist()):
            page = pages.setdefault(int(slots[start]) >> _PAGE_BITS, np.zeros(
                1 << _PAGE_BITS, np.int64))
            np.add.at(page, slots[start:end] & ((1 << _PAGE_BITS) - 1), n[start:end])
    levels = [np.floor(np.log2(np.maximum(x, 1))).astype(np.uint8).tobytes() for x in pages.values()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(pages), pa.int64()), pa.array(levels, pa.binary())], names=["page", "levels"])


def word_levels(counts: DataFrame) -> np.ndarray:
    """The logarithm of the count of all words in a slot, by the low bits of the word's hash, in at most
    16 MiB. A word whose slot has level 0 occurs once in all texts."""
    bits = min(MAX_SLOT_BITS, max(_PAGE_BITS, log2_ceil(4 * counts.count())))
    slots = counts.select(F.col("word").bitwiseAND(F.lit((1 << bits) - 1)).alias("slot"), "n")
    rows = slots.repartition(F.shiftright("slot", _PAGE_BITS)).mapInArrow(
        _page_rows, "page long, levels binary").collect()
    out = np.zeros(1 << bits, np.uint8)
    for row in rows:
        out[row.page << _PAGE_BITS:(row.page + 1) << _PAGE_BITS] = np.frombuffer(row.levels, np.uint8)
    return out


def hot_words(index: DataFrame, counts: DataFrame, common, group) -> DataFrame:
    """The keys with more than `group` index rows. A word has no more of them than it has places
    in the texts, so only the words with that many places are counted."""
    ranks = (_COMMON | np.arange(len(common), dtype=np.uint64)).view(np.int64)
    ranks = counts.sparkSession.createDataFrame(
        pa.table({"word": common.view(np.int64), "rank": ranks}))
    frequent = materialize(counts.where(F.col("n") > group).join(ranks, "word", "left").select(
        F.coalesce("rank", "word").alias("key")), "frequent-words")
    frequent = broadcast_bounded(frequent, frequent.count())
    found = index.select("key").join(frequent, "key", "left_semi").groupBy("key").count()
    return materialize(found.where(F.col("count") > group).select("key"), "hot-keys")


class WordOrder:
    """Hashes of words, sorted, to their places in the order as unsigned integers."""

    def __init__(self, common):
        self.by = np.argsort(common)
        self.common = common[self.by]

    def __call__(self, words) -> np.ndarray:
        if not len(self.common):
            return words
        at = np.minimum(np.searchsorted(self.common, words), len(self.common) - 1)
        return np.where(self.common[at] == words, _COMMON | self.by[at].astype(np.uint64), words)


class LineSets:
    """The word sets of many lines, one after the other, with class, signature, size, from the hashes of
    their words and the numbers of these words. They are sorted by level, if there are levels, and key."""

    def __init__(self, words, sizes, order, levels=None):
        words, word = np.unique(words, return_inverse=True)
        keys = order(words)
        level = np.where(keys < _COMMON, 0 if levels is None else levels[
            keys & np.uint64(len(levels) - 1)], 255).astype(np.uint8)
        # Rare words are in order of their hashes already, common ones stand last.
        by = np.argsort(level, kind="stable")
        common = by[np.count_nonzero(level < 255):]
        common[:] = common[np.argsort(keys[common])]
        keys = keys[by]
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        # A line and a word's place among these words in one integer.
        bits = log2_ceil(len(by) + 1)
        both = np.sort((np.repeat(np.arange(len(sizes)), sizes) << bits) | rank[word])
        fresh = np.ones(len(both), bool)
        fresh[1:] = both[1:] != both[:-1]
        both = both[fresh]
        word, line = both & ((1 << bits) - 1), both >> bits
        self.keys, self.line = keys[word], line
        self.levels = level[by][word]
        self.sizes = np.bincount(line, minlength=len(sizes))
        self.starts = offsets(self.sizes)
        scrambled = mix64(keys)
        self.classes = np.zeros(len(sizes), np.uint64)
        self.signatures = np.zeros(len(sizes), np.uint64)
        some = np.flatnonzero(self.sizes)
        if len(some):
            at = self.starts[some]
            self.classes[some] = np.add.reduceat(
                mix64(scrambled ^ np.uint64(0x5851F42D4C957F2D))[word], at)
            self.signatures[some] = np.bitwise_xor.reduceat(
                (np.uint64(1) << (scrambled >> np.uint64(58)))[word], at)

    def prefixes(self, lines, ratio):
        """The prefix words of chosen lines that occur more than once: all keys, and per chosen line how
        many and the position of the first. Those that occur once stand before them."""
        length = self.sizes - -(-self.sizes * ratio.numerator // ratio.denominator) + 1
        position = np.arange(len(self.keys)) - self.starts[:-1][self.line]
        chosen = np.zeros(len(self.sizes), bool)
        chosen[lines] = True
        inside = chosen[self.line] & (position < length[self.line])
        once = np.bincount(self.line[inside & (self.levels == 0)], minlength=len(self.sizes))
        inside &= self.levels > 0
        count = np.bincount(self.line[inside], minlength=len(self.sizes))
        return self.keys[inside], count[lines], once[lines]


def _sets(data, begins, order, levels=None) -> LineSets:
    """The word sets of the lines of `data`, which begin at `begins`."""
    words, places = _word_hashes(data)
    return LineSets(words, np.diff(np.append(np.searchsorted(places, begins), len(places))), order, levels)


def _slices(batches, size=SLICE_BYTES):
    """The batches in pieces of about `size` bytes of text, or of one longer text."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("_utf8")).to_numpy(zero_copy_only=False))
        starts, stops = runs(ends // size)
        for start, end in zip(starts.tolist(), stops.tolist()):
            yield batch.slice(start, end - start)


def _index_rows(batches, common, levels, ratio):
    """Rows (keys, class, signature, place, _id, _h, line): one per line, one per document with line -1
    and the number of lines as place, and index rows, which have keys but no id and no line."""
    order, seen = WordOrder(common), set()
    for batch in _slices(batches):
        there = np.flatnonzero(~batch.column("_null").to_numpy(zero_copy_only=False))
        data, begins, _, per_text = _text_lines(batch.column("_utf8").take(pa.array(there)).to_pylist())
        counts = np.zeros(batch.num_rows, np.int64)
        counts[there] = per_text
        own = np.repeat(np.arange(batch.num_rows), counts)
        numbers = np.arange(len(own)) - offsets(counts)[own]
        sets = _sets(data, begins, order, levels)
        names = sets.classes.tolist()
        if len(seen) > 1_000_000:
            seen.clear()
        fresh = []
        for i, name in enumerate(names):
            if name not in seen and sets.sizes[i]:
                seen.add(name)
                fresh.append(i)
        line = np.array(fresh, np.int64)
        keys, lengths, position = sets.prefixes(line, ratio)
        docs = np.arange(len(counts))
        n_index, n_other = len(line), len(own) + len(docs)
        zeros = np.zeros(n_index, np.int64)
        is_index = np.arange(n_other + n_index) >= n_other
        take = pa.array(np.concatenate([own, docs, zeros]), mask=is_index)
        blank = np.zeros(len(docs), np.uint64)
        ends = np.concatenate([np.zeros(n_other, np.int64), offsets(lengths)])
        yield pa.RecordBatch.from_arrays([
            pa.LargeListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64))).cast(
                pa.list_(pa.int64())),
            pa.array(np.concatenate([sets.classes, blank, sets.classes[line]]).view(np.int64)),
            pa.array(np.concatenate([sets.signatures, blank, sets.signatures[line]]).view(np.int64)),
            pa.array(np.concatenate([sets.sizes << _POSITIONS, counts,
                                     (sets.sizes[line] << _POSITIONS) | position]).astype(np.int64)),
            batch.column("_id").take(take), batch.column("_h").take(take),
            pa.array(np.concatenate([numbers, docs * 0 - 1, zeros]).astype(
                np.int32), mask=is_index),
        ], names=["keys", "class", "signature", "place", "_id", "_h", "line"])


def _apart(size, i, j, ratio):
    """How many words two lines of rows i, j share at least if they match, and how many are then in one of
    them alone at most."""
    p, q = ratio.numerator, ratio.denominator
    both = size[i] + size[j]
    needed = -(-p * both // (p + q))
    return needed, both - 2 * needed


def _partnered(starts, ends, size, ratio, possible):
    """Which rows, sorted by size between `starts` and `ends` of their key, have a partner: `possible` picks
    from pairs of rows i, j of one key and of sizes that fit."""
    n = len(size)
    found, own = np.zeros(n, bool), np.repeat(np.arange(len(starts)), ends - starts) << 32
    # Sizes rise within a key: a partner too long stays too long further on.
    stops = np.searchsorted(own | size, own | (size * ratio.denominator // ratio.numerator), side="right")
    left, step = np.arange(n), 1
    while len(left):
        left = left[left + step < stops[left]]
        right = left + step
        open_ = np.flatnonzero(~(found[left] & found[right]))
        i, j = (left, right) if len(open_) == len(left) else (left[open_], right[open_])
        hit = possible(i, j)
        found[i[hit]] = True
        found[j[hit]] = True
        step += 1
        if step % 64 == 0:  # long runs: rows that have a partner no longer look for one to the right
            last_open = np.maximum.accumulate(np.where(found, -1, np.arange(n)))
            left = left[~found[left] | (last_open[stops[left] - 1] > left)]
    return found


def _candidate_rows(batches, name, ratio):
    """The index rows with a possible partner in their piece of work, which is named by a column."""
    for table in whole_groups(batches, [name]):
        piece, place = (table.column(c).to_numpy() for c in (name, "place"))
        starts, ends = runs(piece)
        by = np.argsort((np.repeat(np.arange(len(starts)), ends - starts) << 32)
                        | (place >> _POSITIONS))
        place = place[by]
        before, classes, signature = (table.column(c).to_numpy().view(np.uint64)[by]
                                      for c in ("before", "class", "signature"))
        size, position = place >> _POSITIONS, place & ((1 << _POSITIONS) - 1)

        def possible(i, j):
            """The signature, positional and length filters for rows of another class. Rows with the same
            word before (0: none that occurs twice) share that word: they are partners at the first of
            such."""
            needed, alone = _apart(size, i, j, ratio)
            hit = np.flatnonzero(np.bitwise_count(signature[i] ^ signature[j]) <= alone)
            i, j = i[hit], j[hit]
            follow = np.minimum(size[i] - position[i], size[j] - position[j])
            return hit[(follow >= needed[hit])
                       & ((classes[i] != classes[j]) | (signature[i] != signature[j]))
                       & ((before[i] != before[j]) | (before[i] == 0))]

        found = by[_partnered(starts, ends, size, ratio, possible)]
        yield from table.select(["key", "class", "signature"]).take(
            pa.array(found)).combine_chunks().to_batches()


def _wide_signatures(keys, starts, ends) -> list:
    """The parity of the words in each of WIDE_BITS slots, for sets from `starts` to `ends` in `keys`."""
    slots = (mix64(keys ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(WIDE_BITS)).astype(np.int64)
    out = []
    for low in range(0, len(starts), 1024):
        first, sizes = starts[low:low + 1024], (ends - starts)[low:low + 1024]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        places = np.arange(len(owner)) + (first - offsets(sizes)[:-1])[owner]
        odd = np.bincount(owner * WIDE_BITS + slots[places], minlength=len(sizes) * WIDE_BITS) & 1
        out += [x.tobytes() for x in np.packbits(odd.astype(np.uint8).reshape(-1, WIDE_BITS), axis=1)]
    return out


def _near_rows(batches, ratio):
    """The candidates with a partner, in their piece of work, by size and wide signature."""
    for table in whole_groups(batches, ["key", "part"]):
        starts, ends = runs(*(table.column(c).to_numpy() for c in ("key", "part")))
        size = table.column("size").to_numpy()
        wide = np.frombuffer(b"".join(table.column("wide").to_pylist()), np.uint64).reshape(
            len(size), WIDE_BITS // 64)

        def possible(i, j):
            apart = np.bitwise_count(wide[i] ^ wide[j]).sum(axis=1, dtype=np.int64)
            return np.flatnonzero(apart <= _apart(size, i, j, ratio)[1])

        found = _partnered(starts, ends, size, ratio, possible)
        yield from table.select(["key", "part", "class", "signature"]).filter(
            pa.array(found)).combine_chunks().to_batches()


def _locations(docs, lines):
    """As `_bitmap` has it. `_h` stands for the document, since an id may be null."""
    return docs ^ (lines * LINE_STEP)


def _rank_type(common):
    return "<u2" if len(common) <= 1 << 16 else "<u4"


def _packed(keys, starts, ends, width) -> list:
    """Sorted word sets from `starts` to `ends` in `keys` in bytes: how many rare words, their hashes,
    the ranks of common words."""
    common = keys >= _COMMON
    rare = offsets(~common)
    hashes = keys[~common].astype("<u8").tobytes()
    ranks = (keys[common] ^ _COMMON).astype(width)
    size, ranks = ranks.itemsize, ranks.tobytes()
    a, b = rare[starts], rare[ends]
    c, d = size * (starts - a), size * (ends - b)
    return [(j - i).to_bytes(4, "little") + hashes[8 * i:8 * j] + ranks[k:m]
            for i, j, k, m in zip(a.tolist(), b.tolist(), c.tolist(), d.tolist())]


def _unpacked(data, width):
    """The rare and the common words as two sets."""
    n, view = int.from_bytes(data[:4], "little"), memoryview(data)
    return (frozenset(view[4:4 + 8 * n].cast("Q")),
            frozenset(view[4 + 8 * n:].cast(np.dtype(width).char)))


def _fetch_rows(batches, common, bitmap):
    """The word sets of the lines whose place is in the bitmap, which holds all wanted ones."""
    order, mask, width = WordOrder(common), len(bitmap) * 8 - 1, _rank_type(common)
    for batch in _slices(batches):
        data, begins, ends, counts = _text_lines(batch.column("_utf8").to_pylist())
        own = np.repeat(np.arange(len(counts)), counts)
        slots = _locations(batch.column("_h").to_numpy()[own],
                           np.arange(len(own)) - offsets(counts)[own]) & mask
        wanted = np.flatnonzero((bitmap[slots >> 3] >> (slots & 7)) & 1)
        data, begins, _, _ = _text_lines([data[a:b] for a, b in zip(begins[wanted].tolist(),
                                                                    ends[wanted].tolist())])
        sets = _sets(data, begins, order)
        fresh = np.unique(sets.classes, return_index=True)[1]
        places = sets.starts[fresh], sets.starts[fresh + 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(sets.classes[fresh].view(np.int64)),
             pa.array(sets.signatures[fresh].view(np.int64)),
             pa.array(sets.sizes[fresh].astype(np.int64)),
             pa.array(_wide_signatures(sets.keys, *places), pa.binary()),
             pa.array(_packed(sets.keys, *places, width), pa.binary())],
            names=["class", "signature", "size", "wide", "words"])


def _later_rows(batches, ratio, width):
    """Classes with a verified match among the earlier ones of the same piece of work."""
    p, q = ratio.numerator, ratio.denominator
    for table in whole_groups(batches, ["key", "part"]):
        starts, ends = runs(table.column("key").to_numpy(), table.column("part").to_numpy())
        names = table.column("class").to_numpy(), table.column("signature").to_numpy()
        words = table.column("words").to_pylist()
        found = []
        for start, end in zip(starts.tolist(), ends.tolist()):
            earlier = []
            for i in range(start, end):
                rare, common = _unpacked(words[i], width)
                own = len(rare) + len(common)
                for size, other_rare, other_common in earlier:
                    if min(own, size) * q >= max(own, size) * p and (
                            len(rare & other_rare) + len(common & other_common)) * (p + q) >= p * (own + size):
                        found.append(i)
                        break
                earlier.append((own, rare, common))
        yield pa.RecordBatch.from_arrays([pa.array(n[found]) for n in names],
                                         names=["class", "signature"])


def _bitmap(places: DataFrame, count: int) -> np.ndarray:
    """The places' bits, 16 MiB at most: with more lines more of them look wanted."""
    bits = 1 << min(log2_ceil(MAX_FETCH_BITS), max(15, log2_ceil(16 * count)))
    slot = F.col("_h").bitwiseXOR(F.col("line").cast("long") * LINE_STEP).bitwiseAND(
        F.lit(bits - 1).cast("long"))
    packed = places.select(slot.alias("s")).groupBy(
        F.shiftright("s", 15).alias("page")).agg(
        F.bitmap_construct_agg(F.col("s") % 32768).alias("bits")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for row in packed:
        out[row.page * 4096:(row.page + 1) * 4096] = np.frombuffer(row.bits, np.uint8)
    return out


def removed_lines(docs: DataFrame, id_col="doc_id", text_col="text", similarity=SIMILARITY,
                  common=COMMON_WORDS, group=GROUP) -> DataFrame:
    """One row per document: the id, `_h` (a hash of id and text), n_lines, removed: the numbers of
    the lines, from 0, that match an earlier line of the corpus.

    Lines end at \\n; words are runs of ASCII letters and digits and of everything beyond ASCII, A-Z
    in lower case. Lines are compared as sets, on the input, in the order of id, then hash, then
    number. Lines without words match nothing. Null texts have no lines, empty texts one.
    Rows that repeat an id and a text count as one document and get the same numbers.
    """
    ratio = Fraction(similarity).limit_denominator(1000)
    base = docs.select(F.col(id_col).alias("_id"),
                       F.xxhash64(F.col(id_col), F.col(text_col)).alias("_h"),
                       F.col(text_col).isNull().alias("_null"), utf8(text_col).alias("_utf8"))
    kind = base.schema["_id"].dataType.simpleString()
    spark = docs.sparkSession
    counts = word_counts(base)
    shared = spark.sparkContext.broadcast(common_words(counts, common))
    levels = spark.sparkContext.broadcast(word_levels(counts))
    width = _rank_type(shared.value)
    schema = f"keys array<long>, class long, signature long, place long, _id {kind}, _h long, line int"
    rows = base.mapInArrow(lambda b: _index_rows(b, shared.value, levels.value, ratio), schema)
    rows = materialize(rows, "lines")
    who = ["class", "signature"]
    lines = rows.where("line >= 0 and place > 0").select(*who, "_id", "_h", "line")
    classes = materialize(lines.groupBy(*who).agg(
        F.min(F.struct("_id", "_h", "line")).alias("first"), F.count("*").alias("n")), "classes")

    # Words with very many classes, in pairs of chunks; a class counts once in each.
    index = rows.where("line is null").select(F.posexplode("keys").alias("_n", "key"), "keys", *who,
                                              "place").select(
        "key", F.when(F.col("_n") == 0, 0).otherwise(F.get("keys", F.col("_n") - 1)).alias("before"),
        *who, (F.col("place") + F.col("_n")).alias("place"))
    hot = hot_words(index, counts, shared.value, group)
    hot = broadcast_bounded(hot, hot.count())
    pieces = blockwise_groups(index.join(hot, "key", "left_semi").distinct(), "key", group,
                              "hot-words")
    # One number to sort by; pairs of chunks that share it by chance are compared in vain.
    pieces = pieces.withColumn("piece", F.xxhash64("key", "part")).drop("part")
    schema = "key long, class long, signature long"
    found = [df.repartition(name).sortWithinPartitions(name).mapInArrow(
        lambda b, name=name: _candidate_rows(b, name, ratio), schema)
        for df, name in ((index.join(hot, "key", "left_anti"), "key"), (pieces, "piece"))]
    found = found[0].unionByName(found[1])
    candidates = materialize(found.distinct(), "candidates")

    wanted = materialize(candidates.select(*who).distinct().join(classes, who), "wanted")
    bitmap = spark.sparkContext.broadcast(_bitmap(wanted.select("first.*"), wanted.count()))
    sets = base.where("not _null").select("_h", "_utf8").mapInArrow(
        lambda b: _fetch_rows(b, shared.value, bitmap.value),
        "class long, signature long, size long, wide binary, words binary")
    sets = materialize(sets.dropDuplicates(who).join(wanted, who), "sets")
    # Partners are brought together by word; a class without one in its word is alone there.
    paired = blockwise_groups(candidates, "key", group, "pairs")
    near = paired.join(sets.select(*who, "size", "wide"), who).repartition(
        "key", "part").sortWithinPartitions("key", "part", "size").select(
        "key", "part", *who, "size", "wide")
    near = materialize(near.mapInArrow(lambda b: _near_rows(b, ratio),
                                       "key long, part int, class long, signature long"), "near")
    checked = near.join(sets.select(*who, "first", "words"), who).repartition("key", "part").sortWithinPartitions(
        "key", "part", "first").select("key", "part", *who, "words")
    later = materialize(checked.mapInArrow(lambda b: _later_rows(b, ratio, width),
                                           "class long, signature long").distinct(), "later")

    judged = materialize(classes.join(later.withColumn("_later", F.lit(True)), who, "left").where(
        F.col("_later") | (F.col("n") > 1)), "judged")
    # The lines of a class of very many are not brought together.
    many = judged.where(F.col("n") > group)
    many = broadcast_bounded(many, many.count())
    gone = lines.join(many, who).unionByName(lines.join(many.select(*who), who, "left_anti").join(
        judged.where(F.col("n") <= group), who)).where(
        F.col("_later") | (F.struct("_id", "_h", "line") != F.col("first")))
    gone = gone.groupBy(F.col("_id").alias("_gone_id"), F.col("_h").alias("_gone_h")).agg(
        F.array_sort(F.collect_set("line")).alias("removed"))
    per_doc = rows.where("line = -1").select("_id", "_h", F.col("place").alias("n_lines"))
    joined = per_doc.join(gone, F.col("_id").eqNullSafe(F.col("_gone_id"))
                          & (F.col("_h") == F.col("_gone_h")), "left")
    return joined.select(F.col("_id").alias(id_col), "_h", "n_lines", F.coalesce(
        "removed", F.array().cast("array<int>")).alias("removed"))


def dedup_lines(docs: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """The documents without the lines that match an earlier one, columns as they came."""
    found = removed_lines(docs, id_col, text_col, **options).dropDuplicates([id_col, "_h"])
    found = found.where(F.size("removed") > 0).select(F.col(id_col).alias("_gone_id"),
                                                      F.col("_h").alias("_gone_h"), "removed")
    plain, back = shielded(docs, id_col, text_col)
    keyed = plain.withColumn("_h", F.xxhash64(F.col(id_col), F.col(text_col)))
    joined = keyed.join(found, keyed[id_col].eqNullSafe(found["_gone_id"])
                        & (keyed["_h"] == found["_gone_h"]), "left")
    rest = F.array_join(F.transform(F.filter(F.arrays_zip(
        F.split(F.col(text_col), "\n").alias("x"),
        F.sequence(F.lit(0), F.size(F.split(F.col(text_col), "\n")) - 1).alias("k")),
        lambda e: ~F.array_contains(F.col("removed"), e["k"])), lambda e: e["x"]), "\n")
    return back(joined.withColumn(text_col, F.when(F.col("removed").isNull(), F.col(text_col))
                                  .otherwise(rest)))


def digest(found: DataFrame, id_col="doc_id") -> DataFrame:
    return found.select(
        id_col, F.col("n_lines").cast("long").alias("n_lines"),
        F.size("removed").cast("long").alias("n_removed"),
        F.concat_ws(",", F.transform("removed", lambda n: n.cast("string"))).alias("removed_lines"))


# Letters and digits and all beyond ASCII make words; the similarity is 4/5.
SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS t
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
sets AS (
  SELECT doc_id, line, doc_id * 10000000 + line AS place, list_sort(list_distinct(
    regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))) AS w FROM lines),
classes AS (SELECT w, len(w) AS n, min(place) AS first, row_number() OVER () AS c
            FROM sets WHERE len(w) > 0 GROUP BY w),
words AS (SELECT c, n, first, unnest(w) AS word FROM classes),
often AS (SELECT word, count(*) AS f FROM words GROUP BY word),
prefixes AS (
  SELECT c, n, first, word FROM words JOIN often USING (word)
  QUALIFY row_number() OVER (PARTITION BY c ORDER BY f, word) <= n - (4 * n + 4) // 5 + 1),
pairs AS (SELECT DISTINCT b.c AS later, a.c AS earlier FROM prefixes a JOIN prefixes b
          ON a.word = b.word AND a.first < b.first AND a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4),
matched AS (
  SELECT DISTINCT later FROM pairs JOIN classes x ON x.c = later JOIN classes y ON y.c = earlier
  WHERE 9 * len(list_intersect(x.w, y.w)) >= 4 * (x.n + y.n)),
gone AS (
  SELECT s.doc_id, s.line FROM sets s JOIN classes k ON s.w = k.w
  WHERE s.place != k.first OR k.c IN (SELECT later FROM matched)),
listed AS (SELECT doc_id, count(*) AS n, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS l
           FROM gone GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n, 0) AS n_lines, coalesce(l.n, 0) AS n_removed,
       coalesce(l.l, '') AS removed_lines
FROM documents d LEFT JOIN counted c ON c.doc_id = d.doc_id LEFT JOIN listed l ON l.doc_id = d.doc_id"""
