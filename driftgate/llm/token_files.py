"""Token ids in binary files: tokenised, range coded in checksummed blocks, and read back.

Documents are range partitioned and sorted by id. Each task tokenises its own range and writes
segments: the ids of consecutive documents, their model, and the blocks they are cut into, each of which
decodes with the model alone (see `range_coder`); with the length and the CRC-32 of each block and the
length of each document. A
segment is a row of a Parquet file, so files are written and committed by Spark and can be read from
any store; `part` and `segment` give the order. A document is never split over segments.
"""

import functools
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from driftgate.llm.common import utf8
from driftgate.llm.range_coder import BLOCK, decode_blocks, encode_blocks
from driftgate.session import scratch_path

END_ID = 1
#: Ids of a segment before the next one starts, unless one document is longer.
SEGMENT_IDS = 2048 * BLOCK
CACHED_WORDS = 600_000
#: New words that go to the tokenizer as one text.
WORDS_AT_ONCE = 500
TEXT_AT_ONCE = 1 << 23
VERSION = 2
_SCHEMA = ("version int, part int, segment int, n_ids long, docs array<struct<id: {id}, n: long>>, "
           "model binary, blocks array<struct<crc32: long, n: int, data: binary>>")
#: Letters of ASCII and Latin-1, in UTF-8, and one mark after them.
_LETTERS = "".join(c for c in map(chr, [*range(0x41, 0x7B), *range(0xC0, 0x100)]) if c.isalpha())
_MARKS = ".,;:!?"
_PLAIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,;:!?]?)")
#: Makes their UTF-8 small: after the byte C3, capitals are 80 to 9E.
_SMALL = bytes(c + 32 * (0x41 <= c <= 0x5A or 0x80 <= c <= 0x9E) for c in range(256))


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """A tokenizer's ids of UTF-8 texts as unsigned 16-bit integers.

    White space never belongs to a token of this vocabulary's pre-tokenizer and no rule looks
    across it, so a text's ids are those of its pieces between ASCII white space, which repeat. A
    bounded number of them is remembered. Where the vocabulary's rules are seen to leave small letters
    whole and to part them from a mark, words of letters go to its model without those rules, once
    for all their forms that differ in capitals and in the mark.
    """

    def __init__(self, path):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.known, self.letters, self.letters_before = {}, {}, {}
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.model, self.names = self.tokenizer.model, self._letter_names()
        self.marks = {c.encode(): self._ids(c) for c in _MARKS}

    def _ids(self, text):
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _letter_names(self):
        """What small letters are to the model; None if words need all rules."""
        normal, split = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        small = _LETTERS.lower()
        if normal is None or split is None or normal.normalize_str(_LETTERS) != small:
            return None
        plain = set(_LETTERS + _MARKS)
        if any(plain.issuperset(t.content)
               for t in self.tokenizer.get_added_tokens_decoder().values()):
            return None
        names = {c: split.pre_tokenize_str(c) for c in small}
        whole = [("".join(names[c][0][0] for c in small), (0, len(small)))]
        if split.pre_tokenize_str(small) != whole or any(
                c.isascii() and names[c][0][0] != c for c in small) or any(
                normal.normalize_str(c + mark) != c + mark
                or [x for x, _ in split.pre_tokenize_str(c + mark)] != [names[c][0][0], mark]
                for c in small for mark in _MARKS):
            return None
        return {ord(c): found[0][0] for c, found in names.items()}

    def encode(self, texts, end_id=END_ID) -> list:
        """Bytes of the ids of each text with the end id."""
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        if len(self.letters) > CACHED_WORDS // 2:
            self.letters, self.letters_before = {}, self.letters
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.large_binary())
        split = pc.ascii_split_whitespace(texts.cast(pa.large_binary()).view(pa.large_string()))
        words = split.flatten().view(pa.large_binary()).dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn([w for w in distinct if w not in self.known])
        coded = pa.array(list(map(self.known.__getitem__, distinct)), pa.large_binary())
        ids = coded.take(words.indices)
        if len(ids) == 0:
            return [struct.pack("<H", end_id)] * len(texts)
        at = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, 8 * ids.offset)
        first = split.offsets.to_numpy()
        cuts = at[first - first[0]].tolist()
        data, end = memoryview(ids.buffers()[2] or b""), struct.pack("<H", end_id)
        return [bytes(data[a:b]) + end for a, b in zip(cuts, cuts[1:])]

    def _learn(self, new):
        if self.names is None:
            self._learn_by_rules(new)
            return
        rest, known, letters, before = [], self.known, self.letters, self.letters_before
        for word in new:
            name, mark = word, b""
            if not word.isalpha():
                plain = _PLAIN.fullmatch(word)
                if plain is None:
                    rest.append(word)
                    continue
                name, mark = plain.groups()
            small = name.translate(_SMALL)
            ids = letters.get(small)
            if ids is None:
                ids = letters[small] = before.get(small) or self._letter_ids(small)
            known[word] = ids + self.marks[mark] if mark else ids
        self._learn_by_rules(rest)

    def _letter_ids(self, small):
        name = small.decode()
        if not name.isascii():
            name = name.translate(self.names)
        ids = [t.id for t in self.model.tokenize(name)]
        return struct.pack(f"<{len(ids)}H", *ids)

    def _learn_by_rules(self, new):
        """Encode words line by line in one text: a token belongs to the line it starts in."""
        groups = [new[i:i + WORDS_AT_ONCE] for i in range(0, len(new), WORDS_AT_ONCE)]
        lines = [[w.decode("utf-8", "replace") for w in group] for group in groups]
        found = self.tokenizer.encode_batch(["\n".join(x) for x in lines], add_special_tokens=False)
        for group, texts, encoded in zip(groups, lines, found):
            ids = np.array(encoded.ids, "<u2").tobytes()
            starts = np.array([a for a, _ in encoded.offsets], np.int64)
            ends = np.cumsum([len(t) + 1 for t in texts])
            cuts = [0, *(2 * np.searchsorted(starts, ends)).tolist()]
            for word, a, b in zip(group, cuts, cuts[1:]):
                self.known[word] = ids[a:b]


@functools.lru_cache(maxsize=1)
def word_tokenizer(path) -> WordTokenizer:
    """One per Python worker: later tasks find the words that earlier ones met."""
    return WordTokenizer(path)


def _segment_row(part, number, ids, doc_ids, counts):
    values = np.frombuffer(b"".join(ids), "<u2")
    model, *blocks = encode_blocks(values)
    pieces = []
    for k, data in enumerate(blocks):
        own = values[k * BLOCK:(k + 1) * BLOCK]
        pieces.append({"crc32": zlib.crc32(own.astype("<u4").tobytes()), "n": len(own),
                       "data": data})
    return {"version": VERSION, "part": part, "segment": number, "n_ids": len(values),
            "docs": [{"id": i, "n": n} for i, n in zip(doc_ids, counts)],
            "model": model, "blocks": pieces}


def _some_rows(texts):
    """From and to of rows that hold about TEXT_AT_ONCE bytes together; long texts stand alone."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = np.flatnonzero(np.diff(ends // TEXT_AT_ONCE, prepend=0)).tolist()
    cuts = [0, *cuts, len(texts)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


def _encode(batches, path, end_id, segment_ids, schema):
    tokenizer, part, number = word_tokenizer(path), TaskContext.get().partitionId(), 0
    ids, doc_ids, counts, held = [], [], [], 0

    def flush():
        return pa.RecordBatch.from_pylist(
            [_segment_row(part, number, ids, doc_ids, counts)], schema=schema)

    for batch in batches:
        for low, high in _some_rows(batch.column("_utf8")):
            rows = batch.slice(low, high - low)
            names = rows.column("_id").to_pylist()
            for name, coded in zip(names, tokenizer.encode(rows.column("_utf8"), end_id)):
                ids.append(coded)
                doc_ids.append(name)
                counts.append(len(coded) // 2)
                held += len(coded) // 2
                if held >= segment_ids:
                    yield flush()
                    number += 1
                    ids, doc_ids, counts, held = [], [], [], 0
    if doc_ids:
        yield flush()


def write_token_files(docs: DataFrame, path: str, id_col="doc_id", text_col="text",
                      tokenizer=None, end_id=END_ID, segment_ids=SEGMENT_IDS) -> str:
    """Write every text's ids and an end id in ascending order of document id; the path.

    Null texts are empty: only the end id. Null ids come first, rows that repeat an id stand next
    to each other, ordered by the hash of their text. Without documents the folder holds no segment.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    tokenizer = tokenizer or vocabulary_path()
    base = docs.select(F.col(id_col).alias("_id"), utf8(text_col).alias("_utf8"))
    kind = base.schema["_id"].dataType.simpleString()
    layout = _SCHEMA.format(id=kind)
    arrow = to_arrow_schema(_parse_datatype_string(layout))
    ordered = base.repartitionByRange("_id").sortWithinPartitions("_id", F.xxhash64("_utf8"))
    ordered.mapInArrow(lambda b: _encode(b, tokenizer, end_id, segment_ids, arrow), layout).write.option(
        "parquet.enable.dictionary", "false").option("compression", "uncompressed").parquet(path)
    return path


def _decode(batches):
    for batch in batches:
        for row in range(batch.num_rows):
            segment = batch.slice(row, 1).to_pylist()[0]
            if segment["version"] != VERSION:
                raise ValueError(f"version {segment['version']} is not known")
            blocks = segment["blocks"]
            values = decode_blocks([segment["model"], *(b["data"] for b in blocks)],
                                   [b["n"] for b in blocks])
            values, at = values.astype("<u4"), 0
            for k, block in enumerate(blocks):
                if zlib.crc32(values[at:at + block["n"]].tobytes()) != block["crc32"]:
                    raise ValueError(f"part {segment['part']}, segment {segment['segment']}, "
                                     f"block {k}: wrong checksum")
                at += block["n"]
            ends = np.cumsum([d["n"] for d in segment["docs"]])
            yield segment, values, ends


def _document_rows(batches, with_ids):
    for segment, values, ends in _decode(batches):
        starts = ends - np.array([d["n"] for d in segment["docs"]])
        pieces = [values[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        n = len(pieces)
        arrays = [pa.array([segment["part"]] * n, pa.int32()),
                  pa.array([segment["segment"]] * n, pa.int32()),
                  pa.array([d["id"] for d in segment["docs"]]),
                  pa.array(starts, pa.int64()), pa.array(ends - starts, pa.int64()),
                  pa.array([zlib.crc32(p.tobytes()) for p in pieces], pa.int64())]
        names = ["part", "segment", "_id", "_before", "n_tokens", "ids_crc32"]
        if with_ids:
            arrays.append(pa.array([p.astype(np.int32) for p in pieces], pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def read_token_files(spark: SparkSession, path: str, id_col="doc_id", with_ids=False) -> DataFrame:
    """One row per document of the files: its id, start (ids of all documents before it), n_tokens,
    ids_crc32, and with `with_ids` ids. A block whose ids do not match its checksum is an error.

    Starts come from the segments' sizes alone: parts are added up first, then segments in a part.
    """
    segments = spark.read.parquet(path)
    kind = segments.schema["docs"].dataType.elementType["id"].dataType.simpleString()
    sizes = segments.select("part", "segment", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("_all"))
    # One row per task that wrote, added up in one place.
    parts = parts.select("part", (F.sum("_all").over(Window.orderBy("part")) - F.col("_all"))
                         .alias("_part_start"))
    inside = Window.partitionBy("part").orderBy("segment")
    starts = sizes.withColumn("_start", F.sum("n_ids").over(inside) - F.col("n_ids")).join(
        parts, "part").select("part", "segment",
                              (F.col("_start") + F.col("_part_start")).alias("_start"))
    schema = f"part int, segment int, _id {kind}, _before long, n_tokens long, ids_crc32 long"
    found = segments.mapInArrow(lambda b: _document_rows(b, with_ids),
                                schema + ", ids array<int>" * with_ids)
    return found.join(starts, ["part", "segment"]).select(
        F.col("_id").alias(id_col), (F.col("_start") + F.col("_before")).alias("start"), "n_tokens",
        "ids_crc32", *["ids"] * with_ids)


def round_trip(docs: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """Write the files below the shared folder and read them back."""
    path = write_token_files(docs, scratch_path(docs.sparkSession, "tokens"), id_col, text_col,
                             **options)
    return read_token_files(docs.sparkSession, path, id_col)
