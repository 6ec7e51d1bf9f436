"""Periodic runs against a plain version."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from driftgate.llm import periodic


def _plain(words, min_length=6, min_repeats=4):
    found, n = [], len(words)
    for q in range(1, n // min_repeats + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            end = i
            while end < n and words[end] == words[end - q]:
                end += 1
            start, length = i - q, end - i + q
            own = words[start:end]
            smaller = any(all(own[j] == own[j - d] for j in range(d, length)) for d in range(1, q))
            if length >= max(min_length, min_repeats * q) and not smaller:
                found.append((start, length, q))
            i = end
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    return sorted(found), [w for i, w in enumerate(words) if i not in dropped]


def _random_words(rng):
    words = []
    for _ in range(rng.randrange(8)):
        block = [rng.choice("abc") for _ in range(rng.randrange(1, 9))]
        words += block * rng.choice([1, 1, 2, 3, 4, 6]) + block[:rng.randrange(len(block) + 1)]
    return words


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_random_words(seed):
    rng = random.Random(seed)
    texts = [_random_words(rng) for _ in range(150)] + [[], ["a"], ["a"] * 6, ["a"] * 5,
                                                        ["a", "b"] * 4, ["a", "b"] * 3]
    texts = [[w.encode() for w in t] for t in texts]
    for words, (size, runs, text) in zip(texts, periodic._scan_texts(texts, 6, 4)):
        want, kept = _plain(words)
        assert (size, [tuple(r) for r in runs.tolist()], text) == (len(words), want, b" ".join(kept))


def test_a_word_a_million_times():
    runs = periodic.runs_of(np.zeros(1_000_000, np.int64), 1_000_000)
    assert runs.tolist() == [[0, 1_000_000, 1]]


def test_query_equals_plain_version(spark):
    rng = random.Random(9)
    rows = [(i, " \t\n"[rng.randrange(3)].join(_random_words(rng))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, " \n"), (None, "x x x x x x"), (63, "y " * 30_000), (7, "z")]
    rows += [(i, "longer text of words " * 9 + "end") for i in range(70, 130)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = periodic.digest(periodic.find_runs(periodic.plant_runs(docs), words_at_once=500))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        (_plain_digest(i, t) for i, t in rows), key=repr)


def _plain_digest(i, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = (zlib.crc32(str(i).encode()) if i is not None else 1), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    if len(set(words)) == 1 and n > 1000:
        runs, kept = [(0, n, 1)], words[:1]
    else:
        runs, kept = _plain(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(" ".join(kept).encode()).hexdigest())


def test_edges(spark):
    schema = "doc_id string, text string, Runs int, collapsed_text int, _utf8 int, extra string"
    empty = spark.createDataFrame([], schema)
    found = periodic.find_runs(empty)
    assert found.count() == 0
    assert found.columns == ["doc_id", "text", "extra", "n_words", "runs", "collapsed_text"]
    rows = [("a", "p q " * 5, 1, 2, 3, "e")] * 2 + [(None, None, None, None, None, None)]
    got = sorted(map(tuple, periodic.find_runs(spark.createDataFrame(rows, schema), keep_text=False)
                     .collect()), key=repr)
    assert got == [*[("a", "e", 10, [(0, 10, 2)], "p q")] * 2, (None, None, 0, [], "")]
    with pytest.raises(ValueError):
        periodic.find_runs(empty, min_repeats=2)


def test_own_parameters(spark):
    docs = spark.createDataFrame([(1, "a b a b a b c c c")], "doc_id long, text string")
    row = periodic.find_runs(docs, min_length=3, min_repeats=3).first()
    assert [tuple(r) for r in row.runs] == [(0, 6, 2), (6, 3, 1)]
