"""Operators that SQL cannot state, against plain versions on small tables."""

import itertools
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from driftgate.llm import (
    components, decontaminate, licenses, line_dedup, mixing, quality, range_coder, repeats, simhash,
    token_files,
)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def _roots(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def _plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("chunk", [4096, 3])
def test_simhash(docs, texts, chunk):
    ids = sorted(texts)
    prints = [_plain_fingerprint(texts[i]) for i in ids]
    near = [(i, j) for i, j in itertools.combinations(range(len(ids)), 2)
            if (prints[i] ^ prints[j]).bit_count() <= 3]
    want = {ids[i]: (f"{prints[i]:016x}", ids[r]) for i, r in enumerate(_roots(len(ids), near))}
    got = {r.doc_id: (r.fingerprint, r.component_id)
           for r in simhash.near_duplicates(docs, chunk=chunk).collect()}
    assert got == want


def test_no_pair_misses_its_key():
    rng = random.Random(3)
    for _ in range(300):
        value = rng.getrandbits(64)
        other = value
        for bit in rng.sample(range(64), 3):
            other ^= 1 << bit
        keys = [simhash.chain_keys(np.array([v], np.uint64))[0] for v in (value, other)]
        shared = np.flatnonzero(keys[0] == keys[1])
        assert any(simhash._chain_passes(
            np.array([value], np.uint64), np.array([other], np.uint64), int(k) // 2,
            simhash._budgets(3))[0] for k in shared)


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 3)]
    got = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 160)}}


def _plain_lines(texts):
    seen, index, out = [], defaultdict(list), {}
    for name in sorted(texts):
        out[name] = []
        for k, line in enumerate(texts[name].split("\n")):
            words = frozenset(re.findall(rb"[0-9a-z\x80-\xff]+", line.encode().lower()))
            shared = Counter(c for w in words for c in index[w])
            if any(9 * n >= 4 * (len(words) + len(seen[c])) for c, n in shared.items()):
                out[name].append(k)
            if words:
                for w in words:
                    index[w].append(len(seen))
                seen.append(words)
    return out


@pytest.mark.parametrize("group", [20_000, 3])
def test_lines(docs, texts, group):
    got = {r.doc_id: r.removed for r in line_dedup.removed_lines(docs, group=group).collect()}
    assert got == _plain_lines(texts)


@pytest.mark.parametrize("length,window", [(24, 8), (400, 192)])
def test_repeats(spark, length, window):
    rng = random.Random(length)
    letters = "ab" if length < 100 else "abcdefgh "
    shared = "".join(rng.choice(letters) for _ in range(length + 60))
    texts = []
    for i in range(30):
        own = "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3 * length)))
        cut = rng.randrange(60)
        texts.append(own + shared[cut:cut + rng.randrange(length + 60)] + own[:5])
    texts += ["a" * (2 * length), "xy" * length, "z" * length, shared[:length - 1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    starts = defaultdict(list)
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            starts[t[p:p + length]].append((i, p))
    hit = [set() for _ in texts]
    for places in starts.values():
        for i, p in places if len(places) > 1 else ():
            hit[i].update(range(p, p + length))
    got = {r.doc_id: r.removed for r in repeats.remove_repeats(
        docs, length=length, window=window).collect()}
    for i in range(len(texts)):
        assert {b for s, e in got[i] for b in range(s, e)} == hit[i]


def test_leaks_in_small_blocks(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole, parts = [sorted(map(str, decontaminate.digest(decontaminate.find_leaks(
        docs, items, block_words=n)).collect())) for n in (400_000, 60)]
    assert whole == parts
    clean = decontaminate.decontaminate(docs, items)
    assert decontaminate.find_leaks(clean, items).where("n_hit > 0").count() == 0


def test_mixing_targets(docs):
    plan = mixing.plan_mix(docs, block_words=500).collect()
    sources = sorted({r.source for r in plan}, key=lambda s: (s is None, s))
    size = Counter()
    taken = Counter()
    for r in plan:
        size[r.source] += r["size"]
        taken[r.source] += r.taken
    want, open_ = {}, set(sources)
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    while True:
        rest = sum(size.values()) - sum(want.values())
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * size[s]}
        if not over:
            break
        want |= {s: 3 * size[s] for s in over}
        open_ -= over
    want |= {s: weight[s] * level for s in open_}
    for r in plan:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == size[r.source]
    longest = max(r["size"] for r in plan)
    assert all(abs(taken[s] - want[s]) <= longest for s in sources)


def test_quotas_split_exactly(spark):
    quotas = {0: 4000, 1: 37, 2: 1, 3: 963}
    table = spark.createDataFrame(list(quotas.items()), "idx long, quota long")
    means = []
    for seed in range(12):
        got = mixing.split_quotas(table, 3, seed).collect()
        per_source, per_shard = Counter(), Counter()
        for r in got:
            per_source[r.idx] += r.quota
            per_shard[r.shard] += r.quota
        assert per_source == quotas and max(per_shard.values()) - min(per_shard.values()) <= 3
        means.append(sum(r.quota for r in got if r.idx == 3 and r.shard < 4))
    assert abs(np.mean(means) - 481.5) < 25 and np.std(means) > 3


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 7000])
def test_range_coder(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 65_536, n), np.zeros(n, int), rng.zipf(1.3, n) % 50_000,
                np.arange(n) % 7 * 777):
        coded = range_coder.encode_blocks(ids)
        lengths = [min(range_coder.BLOCK, n - i) for i in range(0, n, range_coder.BLOCK)]
        assert (range_coder.decode_blocks(coded, lengths) == ids).all()
    if n > 5000:
        assert sum(map(len, coded)) < n / 8


def test_token_files(spark, docs, texts, tmp_path):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(token_files.vocabulary_path())
    path = token_files.write_token_files(docs, str(tmp_path / "files"), segment_ids=5000)
    got = {r.doc_id: r for r in token_files.read_token_files(spark, path, with_ids=True).collect()}
    start = 0
    for name in sorted(texts):
        ids = tokenizer.encode(texts[name], add_special_tokens=False).ids + [1]
        assert (got[name].start, got[name].ids) == (start, ids)
        assert got[name].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    damaged = spark.read.parquet(path).withColumn("blocks", F.transform("blocks", lambda b: F.struct(
        (b["crc32"] + 1).alias("crc32"), b["n"].alias("n"), b["data"].alias("data"))))
    damaged.write.parquet(str(tmp_path / "damaged"))
    with pytest.raises(Exception, match="wrong checksum"):
        token_files.read_token_files(spark, str(tmp_path / "damaged")).collect()


def test_word_pieces_equal_whole_texts():
    from tokenizers import Tokenizer
    path = token_files.vocabulary_path()
    odd = ["", " ", "a\u0301 b", "don't  DON'T 're", "<|endoftext|> x<|startoftext|>y <|endof text|>",
           "ΣΑΣ Σ", "\u00a0a\u2003b c\x85d", "İstanbul ﬁ", "12 345 ½", "日本語 テスト", "> \u0338a",
           "\x1ca\x00", "👍🏽 x"]
    pieces = token_files.WordTokenizer(path).encode([t.encode() for t in odd])
    whole = Tokenizer.from_file(path).encode_batch(odd, add_special_tokens=False)
    assert [np.frombuffer(p, "<u2")[:-1].tolist() for p in pieces] == [w.ids for w in whole]


def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    hidden = labels.where("doc_id % 4 = 1")
    scored = quality.score_documents(docs, labels.where("doc_id % 4 != 1"))
    rows = scored.join(hidden, "doc_id").collect()
    clean = [r.keep for r in rows if r.quality == 1 and r.toxic == 0]
    junk = [r.keep for r in rows if r.quality == 0]
    toxic = [r.keep for r in rows if r.quality == 1 and r.toxic == 1]
    assert np.mean(clean) > 0.95 and np.mean(junk) < 0.1 and np.mean(toxic) < 0.4


def _plain_cut(text, windows):
    """The text without benchmark windows, and the share of its words that were in one."""
    places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), text[a:b]) for a, b in places]
    hit = set()
    for n in {len(w) for w in windows}:
        for i in range(len(words) - n + 1):
            if tuple(words[i:i + n]) in windows:
                hit.update(range(i, i + n))
    out, done = [], 0
    for first, last in _stretches(sorted(hit)):
        out.append(text[done:places[first][0]])
        done = places[last][1]
    return "".join([*out, text[done:]]), len(hit) / max(1, len(words))


def _stretches(numbers):
    for _, group in itertools.groupby(enumerate(numbers), lambda x: x[1] - x[0]):
        group = [n for _, n in group]
        yield group[0], group[-1]


def test_pipeline_equals_plain_steps(spark, docs, texts):
    """All rows of the run, from plain versions of SimHash, decontamination and tokenising. What the
    classifier keeps and what the mix draws are taken from the operators, which have tests of their own."""
    from tokenizers import Tokenizer
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    gone = {r.doc_id for r in quality.score_documents(docs, labels).where("not keep").collect()}
    left = [i for i in sorted(texts) if i not in gone]
    prints = [_plain_fingerprint(texts[i]) for i in left]
    near = [(i, j) for i, j in itertools.combinations(range(len(left)), 2)
            if (prints[i] ^ prints[j]).bit_count() <= 3]
    roots = _roots(len(left), near)
    left = [i for k, i in enumerate(left) if roots[k] == k]

    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(
            "[A-Z]", lambda m: m[0].lower(), r.text or ""))
        windows |= {tuple(words[i:i + 10]) for i in range(max(1, len(words) - 9)) if words}
    clean = {i: _plain_cut(texts[i], windows) for i in left}
    clean = {i: text for i, (text, share) in clean.items() if share <= 0.5}
    assert any(clean[i] != texts[i] for i in clean)

    rows = [tuple(clean[r.doc_id] if c == "text" else r[c] for c in docs.columns)
            for r in docs.collect() if r.doc_id in clean]
    drawn = mixing.mix(spark.createDataFrame(rows, docs.schema)).select("doc_id").collect()
    tokenizer, want, start = Tokenizer.from_file(token_files.vocabulary_path()), [], 0
    for i in sorted(r.doc_id for r in drawn):
        ids = np.array([*tokenizer.encode(clean[i], add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == want


def test_lines_of_a_hot_group_stay_spread(spark, monkeypatch):
    """Most lines are blank or one line, and most others share their rarest word."""
    texts = {i: "\n".join(["", "the very same line here"] * 20 + [
        f"hot x{i % 7} y{(i + k) % 11} z{k}" for k in range(4)]) for i in range(80)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    kept, write = {}, line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize",
                        lambda df, name: kept.setdefault(name, write(df, name)))
    got = {r.doc_id: r.removed for r in line_dedup.removed_lines(docs, group=20).collect()}
    assert got == _plain_lines(texts)
    files = [r["count"] for r in kept["lines"].where("line >= 0").groupBy(
        F.input_file_name()).count().collect()]
    assert len(files) >= 4 and max(files) < sum(files) / 2


def test_near_copies_meet_at_few_words(spark, monkeypatch):
    """Long near copies share most of their first words; each is fetched for a few of them only."""
    rng, texts = random.Random(9), {}
    for i in range(30):
        words = [f"w{rng.randrange(100_000)}" for _ in range(100)]
        texts[2 * i] = " ".join(words)
        for k in rng.sample(range(100), 3 + i % 14):
            words[k] = f"v{rng.randrange(100_000)}"
        texts[2 * i + 1] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept, write = {}, line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize",
                        lambda df, name: kept.setdefault(name, write(df, name)))
    got = {r.doc_id: r.removed for r in line_dedup.removed_lines(docs, common=100).collect()}
    assert got == _plain_lines(texts) and 10 < sum(map(len, got.values())) < 30
    assert kept["candidates"].count() < 300
    # Words that occur once are not indexed.
    assert kept["lines"].where("line is null").agg(F.sum(F.size("keys"))).first()[0] < 1000


def test_unlike_long_lines_are_not_fetched(spark, monkeypatch):
    """Long lines that share their rare words and little else: 64 bits cannot tell them apart."""
    rng, texts = random.Random(2), {}
    for i in range(40):
        words = rng.sample(range(4000), 300)
        texts[i] = " ".join([f"rare{i // 4}"] * 2 + [f"w{w}" for w in words])
    texts[40], texts[41] = texts[0] + " one more", texts[5] + " one more"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept, write = {}, line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize",
                        lambda df, name: kept.setdefault(name, write(df, name)))
    got = {r.doc_id: r.removed for r in line_dedup.removed_lines(docs).collect()}
    assert got == _plain_lines(texts) and [i for i in got if got[i]] == [40, 41]
    assert kept["candidates"].count() > 40
    assert kept["near"].select("class").distinct().count() == 4


def test_words_by_eight_bytes():
    """Words of all lengths and places in eight bytes, at the ends of lines and texts, and texts without any."""
    rng, texts = random.Random(4), [b"", b"\n", b"a", b"\x00a\x00", b"Ab1 ab1\nAB1", "\u00e9t\u00e9".encode()]
    for n in range(1, 150):
        word = bytes(rng.choice(b"abXY09\xc3\xa9") for _ in range(n))
        texts.append(b" " * rng.randrange(9) + word + rng.choice([b" ", b"\n", b"."]) + word[:-1] + b"-" + word.lower())
    data, begins, ends, counts = line_dedup._text_lines(texts)
    lines = [line for t in texts for line in t.split(b"\n")]
    assert counts.tolist() == [t.count(b"\n") + 1 for t in texts]
    assert [data[a:b] for a, b in zip(begins.tolist(), ends.tolist())] == lines
    hashes, places = line_dedup._word_hashes(data)
    per_line = np.diff(np.append(np.searchsorted(places, begins), len(places)))
    words = [decontaminate.words_of(line) for line in lines]
    assert per_line.tolist() == [len(w) for w in words]
    flat = list(itertools.chain.from_iterable(words))
    pairs = set(zip(flat, hashes.tolist()))
    assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})
    assert line_dedup._text_lines([])[3].tolist() == [] and max(hashes.tolist()) < 1 << 63


def test_lines_are_taken_apart_in_bulk():
    """100,000 lines of 20 words with few Python calls for each (2,721,353 in all when words were looked up
    one by one, 206,083 now)."""
    rng, calls = random.Random(6), Counter()
    text = "\n".join(" ".join(f"w{rng.randrange(50_000)}" for _ in range(20)) for _ in range(20_000)).encode()
    batch = pa.RecordBatch.from_pydict({"_id": list(range(5)), "_h": list(range(5)), "_null": [False] * 5,
                                        "_utf8": pa.array([text] * 5, pa.binary())})
    levels, common = np.ones(1 << 16, np.uint8), np.zeros(0, np.uint64)
    every = np.full(1 << 12, 255, np.uint8)
    sys.setprofile(lambda frame, event, _: calls.update([event]))
    try:
        counted = list(line_dedup._count_rows([batch]))
        rows = list(line_dedup._index_rows([batch], common, levels, Fraction(4, 5)))
        fetched = list(line_dedup._fetch_rows([batch.slice(0, 1)], common, every))
    finally:
        sys.setprofile(None)
    assert sum(sum(b.column("n").to_pylist()) for b in counted) == 2_000_000
    assert sum(b.num_rows for b in rows) == 120_005  # lines, texts, classes of lines
    assert sum(b.num_rows for b in fetched) == 20_000 and sum(calls.values()) < 400_000


@pytest.mark.parametrize("n", [40, 400])
def test_partners_in_long_runs(n):
    """Rows of a key with a partner of a size that fits, against all pairs; runs beyond 64 rows too."""
    rng = np.random.default_rng(n)
    keys, sizes = np.sort(rng.integers(0, 3, n)), rng.integers(1, 60, n)
    by = np.lexsort((sizes, keys))
    keys, sizes, mark = keys[by], sizes[by], rng.integers(0, n // 2, n)
    want = [any(keys[i] == keys[j] and i != j and mark[i] == mark[j] and 5 * min(sizes[i], sizes[j])
                >= 4 * max(sizes[i], sizes[j]) for j in range(n)) for i in range(n)]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    got = line_dedup._partnered(starts, np.append(starts[1:], n), sizes, Fraction(4, 5),
                                lambda i, j: np.flatnonzero(mark[i] == mark[j]))
    assert got.tolist() == want and 0 < sum(want) < n


def _plain_licenses(text, least=0.8):
    """All matches (dice, name) of the lines and the text, then of windows for names without one."""
    templates = [(name, set(licenses._bigrams_of(t))) for name, t in licenses.TEMPLATES]

    def grams(part):
        words = re.findall("[a-z0-9]+", re.sub("[^A-Za-z0-9]+", " ", part).lower())
        return [f"{a} {b}" for a, b in zip(words, words[1:])]

    def score(own, t):
        return 2.0 * len(own & t) / (len(own) + len(t))

    lines = text.split("\n")
    found = [max((score(set(grams(part)), t), name) for name, t in templates)
             for part in (lines + [text] if len(lines) > 1 else lines)]
    found = [m for m in found if m[0] >= least]
    pairs, more = grams(text), {}
    for name, t in templates:
        places = [i for i, g in enumerate(pairs) if g in t]
        if not any(m[1] == name for m in found):
            best = max((score(set(pairs[i:j + 1]), t) for i in places for j in places
                        if 0 <= j - i < len(t) * (2 - least) / least), default=0)
            more[name] = max(best, more.get(name, 0))
    return found + [(dice, name) for name, dice in more.items() if dice >= least]


def test_licenses_equal_a_plain_comparison(spark):
    rng, texts = random.Random(4), {}
    prose = "the music of an old town is played by people who walk in its streets at night".split()
    for i in range(80):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            words = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice(prose + words)
            words = [rng.choice([str.upper, str.title, str])(w) for w in words]
            parts += [" ".join(rng.choices(prose, k=rng.randrange(12))),
                      rng.choice([" ", " ", "\n", " İ\n* "]).join(words)]
        texts[i] = rng.choice([" ", "\n"]).join(parts)
    for i in range(80, 160):
        texts[i] = " ".join(rng.choices(prose, k=60)).replace("by", "near") + "\nK" * (i % 2)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    for i, text in texts.items():
        want = _plain_licenses(text)
        assert got[i].n_matches == len(want) and (got[i].dice, got[i].license) == max(
            want, default=(None, None)), text
    assert sum(r.n_matches > 0 for r in got.values()) > 40
    # Prose without the words that a match needs is not taken apart.
    looked = docs.where(licenses._any_word(F.lower("text"), licenses.TEMPLATES, 0.8))
    assert {r.doc_id for r in looked.collect()} <= set(range(80))
