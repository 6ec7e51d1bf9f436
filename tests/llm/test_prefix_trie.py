"""The prefix trie against a plain version."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from driftgate.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string, shard int, Path string, kind int"


def _plain(sequences):
    """Node rows of {id: [(role, text)]}."""
    members = defaultdict(list)
    for name, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(name)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        leaves, saved = 0 if children[node] else 1, 0
        if node:
            saved = (len(members[node]) - 1) * len(node[-1][1].encode())
        for child in children[node]:
            more = below(child)
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves, saved

    return sorted(((min(names), len(node), min(members[node[:-1]]) if node else None, len(names),
                    len(children[node]), *below(node), hashlib.sha256(",".join(
                        str(c) for c in sorted(names) if len(sequences[c]) == len(node)).encode())
                    .hexdigest()) for node, names in members.items()), key=repr)


def _plain_sequences(rows, splice=True):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    if not splice:
        return own
    return {c: own.get(c - c % 5, [])[:(h := zlib.crc32(str(c).encode()) % 9)] + ts[h:]
            for c, ts in own.items()}


def _rows(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        length = rng.choice([1, 1, 2, 3, 5, 12])
        for turn in range(length):
            same = rng.random() < 0.7
            rows.append((c, turn, ("user", "assistant")[turn % 2] if same else rng.choice(["x", None]),
                         "hi" if same else rng.choice(["", None, "ä", "b" * 50]), 1, "p", 2))
        if rng.random() < 0.1:
            rows.append((c, None, None, "system", 1, "p", 2))
    rows += [(None, 0, "user", "lost", 1, "p", 2)] * 3
    return rows


def _got(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.mark.parametrize("shards", [1, 2, 9, 40])
def test_any_number_of_shards(spark, shards):
    rows = _rows(shards)
    turns = spark.createDataFrame(rows, TURNS).repartition(3)
    paths = prefix_trie.spliced(prefix_trie.conversation_paths(turns))
    assert _got(prefix_trie.prefix_trie(paths, shards)) == _plain(_plain_sequences(rows))


def test_one_conversation_most_of_the_time(spark):
    """Equal paths stand in several shards: their ends are hashed over all of them."""
    rows = [(c, t, "user", f"turn {t}", 1, "p", 2) for c in range(300) for t in range(4 if c % 3 else 3)]
    turns = spark.createDataFrame(rows, TURNS)
    paths = prefix_trie.conversation_paths(turns)
    skeleton = prefix_trie.choose_splitters(paths, 20)
    assert 10 < len(skeleton.keys) < 30
    assert _got(prefix_trie.prefix_trie(paths, 20)) == _plain(_plain_sequences(rows, splice=False))


def test_long_paths_are_cut_in_splitters_only(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(c, t, "user", "same" if t < 30 else rng.choice("ab"), 1, "p", 2)
            for c in range(40) for t in range(rng.randrange(28, 40))]
    monkeypatch.setattr(prefix_trie, "SKELETON_NODES", 80)
    paths = prefix_trie.conversation_paths(spark.createDataFrame(rows, TURNS))
    assert all(len(k[0]) <= 10 * prefix_trie.ITEM for k in prefix_trie.choose_splitters(paths, 8).keys)
    assert _got(prefix_trie.prefix_trie(paths, 8)) == _plain(_plain_sequences(rows, splice=False))


def test_edges(spark):
    empty = spark.createDataFrame([], TURNS)
    assert prefix_trie.prefix_trie(prefix_trie.conversation_paths(empty), 3).count() == 0
    # Turnless: base 5 does not exist and all own turns are before h; ids as text; repeated rows.
    gone = next(c for c in range(6, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(gone, 0, "user", "x", 1, "p", 2)]
    paths = prefix_trie.spliced(prefix_trie.conversation_paths(spark.createDataFrame(rows, TURNS)))
    assert _got(prefix_trie.prefix_trie(paths, 3)) == _plain({gone: []})
    rows = [("b", 1, "r", "x"), ("b", 1, "r", "x"), ("a", 1, "r", "x"), ("ä", 1, "r", "y")]
    named = spark.createDataFrame(rows, "Name string, n int, who string, said string")
    paths = prefix_trie.conversation_paths(named, "Name", "n", "who", "said")
    assert _got(prefix_trie.prefix_trie(paths, 2)) == _plain(
        {"b": [("r", "x")] * 2, "a": [("r", "x")], "ä": [("r", "y")]})


def test_shared_turns():
    a, b = b"x" * 20, b"y" * 20
    assert prefix_trie.shared_turns(a * 9, a * 5 + b + a * 3) == 5
    assert prefix_trie.shared_turns(a * 9, a * 4) == 4
    assert prefix_trie.shared_turns(b, a) == prefix_trie.shared_turns(b"", a) == 0
