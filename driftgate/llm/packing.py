"""Packing documents into sequences: shortest pack first, over the histogram of lengths.

A document's ids are cut into full sequences and one tail. Only the histogram of the tails' lengths goes to
the driver: at most as many numbers as a sequence is long. There lengths are placed longest first, all
tails of a length at once: the shortest packs that have room take one each, as often as there are such
packs, and what finds no room opens packs. A pack is a pattern with a count, of slots that each stand for a
range of ranks among the tails of one length. Packs that are left with more open places than a given slack
are filled by cutting: the shortest are taken apart, last slot first, and their tails go whole or cut
into the next shortest, pattern by pattern, until one such pack is left at most. The plan's size thus
follows the lengths, not the documents.

The patterns go back to the documents by rank. A task that writes tokenised documents counts its own
tails by length, so a tail's rank is that count plus the tails of its length in earlier tasks' counts,
and no document is sorted or sent to one place for its length, however many share it.
"""

import base64
import functools
import heapq
import zlib
from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from driftgate.llm.common import offsets, text_or_empty
from driftgate.session import materialize

LENGTH = 1024
END_ID = 0


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


# How the vocabulary's tokenizer takes text apart, and its one special token, which
# counts as such wherever a text holds it.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
SPECIAL = {"<|endoftext|>": 50256}


@functools.lru_cache(maxsize=1)
def byte_tokenizer(path):
    """A byte-level BPE from a file of (token in base64, rank) lines: the same ids as the vocabulary's
    own tokenizer, at about a fifth of its time."""
    import tiktoken
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks,
                             special_tokens=SPECIAL)


def encode(tokenizer, text, end_id) -> np.ndarray:
    if not text:
        return np.array([end_id], np.uint32)
    special = "all" if any(s in text for s in SPECIAL) else set()
    ids = tokenizer.encode_to_numpy(text, allowed_special=special, disallowed_special=())
    return np.append(ids, np.uint32(end_id))


# --- the plan over the histogram --------------------------------------------

class _Pack:
    """`count` equal packs. A slot (length, rank, a, b) holds the ids a to b of the tails with the
    ranks rank to rank + count - 1 among those of that length."""

    __slots__ = ("count", "fill", "slots")

    def __init__(self, count, fill, slots):
        self.count, self.fill, self.slots = count, fill, slots

    def split(self, count):
        """The first `count` packs and the others."""
        rest = [(length, rank + count, a, b) for length, rank, a, b in self.slots]
        return (_Pack(count, self.fill, self.slots),
                _Pack(self.count - count, self.fill, rest))

    def add(self, slot):
        self.slots = [*self.slots, slot]
        self.fill += slot[3] - slot[2]


class _Open:
    """Open packs, the shortest first."""

    def __init__(self):
        self.heap, self.made = [], 0

    def push(self, pack):
        self.made += 1
        heapq.heappush(self.heap, (pack.fill, self.made, pack))

    def pop(self):
        return heapq.heappop(self.heap)[2]


def place(histogram: dict, length: int):
    """Shortest pack first: (full packs, open packs) for {length: number of tails}."""
    done, opened = [], _Open()
    for own in sorted(histogram, reverse=True):
        rank, left = 0, histogram[own]
        while left:
            if opened.heap and opened.heap[0][0] + own <= length:
                pack = opened.pop()
                if pack.count > left:
                    pack, rest = pack.split(left)
                    opened.push(rest)
            else:  # as many as fit one after another into a new pack, then the next
                each = min(length // own, left)
                pack = _Pack(left // each, 0, [])
                for i in range(each - 1):
                    pack.add((own, rank + i * pack.count, 0, own))
                rank, left = rank + (each - 1) * pack.count, left - (each - 1) * pack.count
            pack.add((own, rank, 0, own))
            rank, left = rank + pack.count, left - pack.count
            if pack.fill == length:
                done.append(pack)
            else:
                opened.push(pack)
    return done, [p for _, _, p in opened.heap]


def fill_up(opened, length: int, slack: int):
    """Packs with the same tails, of which all but one have at most `slack` open places: the shortest
    pack gives its last slot, or as much of it as there is room for, to the next shortest."""
    done, queue = [], _Open()

    def put(pack):
        if pack.fill >= length - slack:
            done.append(pack)
        else:
            queue.push(pack)

    for pack in opened:
        put(pack)
    while queue.heap:
        giver = queue.pop()
        if queue.heap:
            taker = queue.pop()
        elif giver.count > 1:  # only equal packs are left: half of them give
            taker, giver = giver.split(giver.count // 2)
        else:
            done.append(giver)
            break
        if taker.count > giver.count:
            taker, rest = taker.split(giver.count)
            queue.push(rest)
        elif giver.count > taker.count:
            giver, rest = giver.split(taker.count)
            queue.push(rest)
        own, rank, a, b = giver.slots[-1]
        moved = min(length - taker.fill, b - a)
        taker.add((own, rank, b - moved, b))
        giver.slots = giver.slots[:-1] + [(own, rank, a, b - moved)] * (moved < b - a)
        giver.fill -= moved
        put(taker)
        if giver.slots:
            queue.push(giver)
    return done


class Plan:
    """Where the tails go, as arrays: for every length and range of ranks the slots that hold it."""

    def __init__(self, histogram: dict, length=LENGTH, slack=LENGTH // 512, first_sequence=0):
        done, opened = place(histogram, length)
        slots, self.n_sequences = defaultdict(list), first_sequence
        for pack in [*done, *fill_up(opened, length, slack)]:
            at = 0
            for own, rank, a, b in pack.slots:
                slots[own].append((rank, rank + pack.count, a, b, self.n_sequences - rank, at))
                at += b - a
            self.n_sequences += pack.count
        keys, counts, self.slots = [], [], []
        for own in sorted(slots):
            cuts = sorted({x for s in slots[own] for x in s[:2]})
            inside = defaultdict(list)
            for slot in slots[own]:
                for i in range(bisect_left(cuts, slot[0]), bisect_left(cuts, slot[1])):
                    inside[i].append(slot[2:])
            for i in sorted(inside):
                keys.append((own << 40) + cuts[i])
                counts.append(len(inside[i]))
                self.slots += sorted(inside[i])
        self.keys, self.ends = np.array(keys, np.int64), offsets(counts)

    def slots_of(self, lengths, ranks):
        """For each tail its (start, end, sequence, offset) in order of start."""
        found = np.searchsorted(self.keys, (lengths << 40) + ranks, "right") - 1
        for i, rank in zip(found.tolist(), ranks.tolist()):
            yield [(a, b, base + rank, at)
                   for a, b, base, at in self.slots[self.ends[i]:self.ends[i + 1]]]


# --- the documents ----------------------------------------------------------

def _tokenise(batches, path, end_id, length, with_ids, kind):
    """A row per document: its ids' number, CRC-32 of its full sequences, its tail's ids (or all), and
    the rank of its tail and of its first full sequence among those of the same task."""
    tokenizer, part = byte_tokenizer(path), TaskContext.get().partitionId()
    ranks, full_so_far = np.zeros(length, np.int64), 0
    for batch in batches:
        for low in range(0, batch.num_rows, 512):  # long texts: few at a time
            rows = batch.slice(low, 512)
            sizes, crcs, kept, rank, before = [], [], [], [], []
            for text in rows.column("_text").to_pylist():
                ids = encode(tokenizer, text, end_id).astype("<u4")
                full, tail = divmod(len(ids), length)
                sizes.append(len(ids))
                crcs.append(np.array([zlib.crc32(ids[k * length:(k + 1) * length])
                                      for k in range(full)], "<u4").tobytes())
                kept.append(ids[0 if with_ids else full * length:].astype(kind).tobytes())
                rank.append(int(ranks[tail]))
                before.append(full_so_far)
                ranks[tail] += 1
                full_so_far += full
            sizes = np.array(sizes, np.int64)
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(np.full(len(sizes), part, np.int32)), "_id": rows.column("_id"),
                "n": pa.array(sizes), "tail": pa.array((sizes % length).astype(np.int32)),
                "rank": pa.array(rank, pa.int64()), "full_before": pa.array(before, pa.int64()),
                "crcs": pa.array(crcs, pa.binary()), "kept": pa.array(kept, pa.binary())})


def _pieces(batches, plan, length, with_ids, kind):
    for batch in batches:
        columns = {n: batch.column(n) for n in batch.schema.names}
        sizes, tails = columns["n"].to_numpy(), columns["tail"].to_numpy().astype(np.int64)
        ranks = columns["rank"].to_numpy() + columns["tails_before"].to_numpy()
        first = (columns["full_before"].to_numpy() + columns["fulls_before"].to_numpy()).tolist()
        slots = plan.slots_of(np.maximum(tails, 1), ranks)
        crcs, kept = columns["crcs"].to_pylist(), columns["kept"].to_pylist()
        row, start, size, crc, sequence, at, ids = [], [], [], [], [], [], []
        for i, (n, tail, places) in enumerate(zip(sizes.tolist(), tails.tolist(), slots)):
            full, own = n - tail, np.frombuffer(kept[i], kind)
            sums = np.frombuffer(crcs[i], "<u4").tolist()
            k = len(sums)
            start += range(0, full, length)
            size += [length] * k
            crc += sums
            sequence += range(first[i], first[i] + k)
            at += [0] * k
            if with_ids:
                ids += np.split(own[:full], k) if k else []
                own = own[full:]
            if tail:
                k += len(places)
                for a, b, number, offset in places:
                    piece = own[a:b]
                    start.append(full + a)
                    size.append(b - a)
                    crc.append(zlib.crc32(piece.astype("<u4")))
                    sequence.append(number)
                    at.append(offset)
                    if with_ids:
                        ids.append(piece)
            row += [i] * k
        longs = {"start": start, "length": size, "ids_crc32": crc, "sequence_id": sequence,
                 "offset": at}
        out = {"_id": columns["_id"].take(pa.array(row, pa.int64())),
               "doc_tokens": columns["n"].take(pa.array(row, pa.int64()))}
        out |= {name: pa.array(values, pa.int64()) for name, values in longs.items()}
        if with_ids:
            out["ids"] = pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_pydict(out)


def pack_documents(docs: DataFrame, id_col="doc_id", text_col="text", tokenizer=None, end_id=END_ID,
                   length=LENGTH, slack=None, with_ids=False) -> DataFrame:
    """Pack every text's ids and an end id into sequences of `length` ids. All but one of them have at
    most `slack` open places, by default a 512th of `length`, so less than 0.2 % is padding.

    One row per piece: the document's id, start (its ids before the piece), length, ids_crc32 (of the
    ids as little-endian unsigned 32-bit integers), doc_tokens, sequence_id, offset in it, and with
    `with_ids` the ids. Sequences are numbered from 0, the uncut full ones first.

    Null and empty texts are the end id alone. Rows are packed one by one, so repeated rows and
    repeated or null ids are documents of their own; long texts are many full sequences and one
    tail; an empty table gives no piece. Columns other than id and text are not looked at. `tokenizer` is
    the path of a byte-level BPE in ranks.
    """
    path, spark = tokenizer or vocabulary_path(), docs.sparkSession
    slack = length // 512 if slack is None else slack
    base = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    kind = base.schema["_id"].dataType.simpleString()
    ids = "<u2" if max(byte_tokenizer(path).n_vocab - 1, end_id) < 1 << 16 else "<u4"
    stored = materialize(base.mapInArrow(
        lambda b: _tokenise(b, path, end_id, length, with_ids, ids),
        f"part int, _id {kind}, n long, tail int, rank long, full_before long, crcs binary, "
        "kept binary"), "tails")
    counts = materialize(stored.groupBy("part", "tail").agg(
        F.count("*").alias("tails"), F.sum(F.col("n") - F.col("tail")).alias("fulls")), "tail-counts")
    # One row per task that tokenised.
    fulls = counts.groupBy("part").agg((F.sum("fulls") / length).cast("long").alias("fulls"))
    fulls = fulls.select("part", (F.sum("fulls").over(Window.orderBy("part")) - F.col("fulls"))
                         .alias("fulls_before"))
    earlier = Window.partitionBy("tail").orderBy("part")
    places = counts.withColumn("tails_before", F.sum("tails").over(earlier) - F.col("tails")).join(
        fulls, "part").select("part", "tail", "tails_before", "fulls_before")
    total = counts.agg(F.sum("fulls")).first()[0] or 0
    # Below `length` rows, whatever the input.
    histogram = {r.tail: r.n for r in counts.where("tail > 0").groupBy("tail").agg(
        F.sum("tails").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(Plan(histogram, length, slack, total // length))
    schema = f"_id {kind}, doc_tokens long, start long, length long, ids_crc32 long, " \
             "sequence_id long, offset long" + ", ids array<int>" * with_ids
    pieces = stored.join(places, ["part", "tail"]).mapInArrow(
        lambda b: _pieces(b, plan.value, length, with_ids, ids), schema)
    return pieces.select(F.col("_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
                         "sequence_id", "offset", *["ids"] * with_ids)
