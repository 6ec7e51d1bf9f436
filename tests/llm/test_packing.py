"""Packing against its rules, the tokenizer and a plain shortest-pack-first."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from driftgate.llm import packing

SF = "/root/testdata/sf0.001"


def _check_pieces(rows, ids_of, length=1024):
    """Every id lies in one piece, and every sequence is gapless; the number of short sequences, with
    more open places than a 512th."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(ids_of)
    for name, pieces in by_doc.items():
        ids, at = np.array(ids_of[name], "<u4"), 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    short = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
        short += at < length - length // 512
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return short


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def _ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_documents(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: _ids(tokenizer, r.text) for r in docs.collect()}
    rows = packing.pack_documents(docs.repartition(5)).collect()
    assert _check_pieces(rows, want) <= 1
    assert len({r.sequence_id for r in rows}) <= sum(map(len, want.values())) / 1022 + 1


def test_odd_texts(spark, tokenizer):
    texts = [None, "", " ", "a", "x<|endoftext|> y<|endoftext|>", "　a \xa0b\x1f c​", "é" * 5000,
             "\n\n  a\t b", "ß1２३", "\U0001f600 \U0001f600", "word " * 4000, "'s 'LL don't"]
    rows = [(i, t, "extra", 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, start string, part int")
    want = {i: _ids(tokenizer, t) for i, t in enumerate(texts)}
    for length in (1024, 16, 1):
        got = packing.pack_documents(docs.repartition(3), length=length, with_ids=True).collect()
        assert _check_pieces(got, want, length) <= 1
        for r in got:
            assert r.ids == want[r.doc_id][r.start:r.start + r.length]


def test_edges(spark):
    assert packing.pack_documents(
        spark.createDataFrame([], "doc_id long, text string")).count() == 0
    same = spark.createDataFrame([(None, "a")] * 3 + [("k", None)] * 2, "name string, said string")
    rows = packing.pack_documents(same, "name", "said").collect()
    assert Counter((r.name, r.doc_tokens) for r in rows) == {(None, 2): 3, ("k", 1): 2}
    assert sorted(r.offset for r in rows) == [0, 2, 4, 6, 7]


def _plain_place(lengths, room):
    """One by one, longest first, into the shortest pack with room."""
    packs = []
    for own in sorted(lengths, reverse=True):
        fitting = [p for p in packs if sum(p) + own <= room]
        if fitting:
            min(fitting, key=sum).append(own)
        else:
            packs.append([own])
    return sorted(sorted(p) for p in packs)


@pytest.mark.parametrize("seed", range(20))
def test_places_like_one_by_one(seed):
    rng = random.Random(seed)
    room = rng.choice([10, 37, 64])
    lengths = [rng.randrange(1, room) for _ in range(rng.randrange(60))] + [
        rng.randrange(1, room)] * rng.randrange(40)
    done, opened = packing.place(Counter(lengths), room)
    assert Counter(p.fill for p in done for _ in range(p.count)) + Counter(
        p.fill for p in opened for _ in range(p.count)) == Counter(
        map(sum, _plain_place(lengths, room)))
    plan = packing.Plan(Counter(lengths), room, slack=0)
    assert plan.n_sequences == -(-sum(lengths) // room)
    filled = defaultdict(list)
    for own, count in Counter(lengths).items():
        slots = plan.slots_of(np.full(count, own), np.arange(count))
        for places in slots:
            at = 0
            for a, b, sequence, offset in places:
                assert a == at
                at = b
                filled[sequence].append((offset, b - a))
            assert at == own
    for pieces in filled.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size


def test_many_tails_of_few_lengths():
    """The plan's size follows the lengths, not the documents."""
    for histogram in ({700: 10 ** 9}, {1: 10 ** 9 + 5}, {700: 10 ** 9, 1: 10 ** 9},
                      {n: 10 ** 9 + 7919 * n % 10 ** 6 for n in range(1, 1024)}):
        plan = packing.Plan(histogram)
        assert plan.n_sequences <= sum(n * c for n, c in histogram.items()) / 1022 + 1
        assert len(plan.slots) < 20_000
