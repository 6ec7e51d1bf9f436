"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every
operator."""

import hashlib

import pytest

from driftgate.llm import (
    decontaminate, exact_dedup, licenses, line_dedup, mixing, quality, repeats, simhash,
    token_files, url_reputation,
)

SCHEMA = ("doc_id long, text string, source string, n_hit string, size string, kept string, "
          "keep string, shard string, _h string, _fp string, _utf8 string, n_lines string, "
          "removed string, n_words string, posterior string")
LONG = " ".join(f"word{i % 977} tail{i % 31}" for i in range(60_000))
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def rows():
    extra = ["x"] * 12
    texts = [(1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, "one two three", "b"),
             (4, "one two three", "b"), (5, "one  two\tthree", "b"), (None, "one two three", None),
             (6, LONG, "c"), (7, LONG, "c"), (8, "é", "é"), (9, None, None)]
    return [(*t, *extra) for t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "One, TWO"), (None, "é")],
                                 "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 0), (4, 1, 0), (5, None, None), (None, 0, 1)],
                                 "doc_id long, quality int, toxic int")


def test_decontaminate(docs, none, items):
    found = {(r.doc_id, r.text): r for r in decontaminate.find_leaks(docs, items).collect()}
    assert found[4, "one two three"].hit_spans == [[0, 2]]
    assert found[4, "one two three"].hit_items == ["3"] and found[8, "é"].hit_items == [""]
    assert found[1, None].n_words == found[2, ""].n_words == 0
    digest = {r.doc_id: r for r in decontaminate.digest(
        decontaminate.find_leaks(docs, items)).collect()}
    assert digest[1].items_sha256 == EMPTY_SHA and not digest[1].contaminated
    clean = decontaminate.decontaminate(docs, items, max_coverage=0.7)
    assert clean.columns == docs.columns
    assert {(r.doc_id, r.text) for r in clean.collect()} >= {(4, " three"), (1, None), (6, LONG)}
    assert decontaminate.find_leaks(none, items).count() == 0
    assert decontaminate.find_leaks(docs, items.limit(0)).where("n_hit > 0").count() == 0


def test_exact(docs, none):
    marks = [tuple(r) for r in exact_dedup.mark_copies(docs).select(
        "doc_id", "keep_id", "group_size", "kept").collect()]
    assert sorted(m for m in marks if m[0] in (1, 2, 9)) == [
        (1, 1, 3, True), (2, 1, 3, False), (9, 1, 3, False)]
    assert marks.count((4, 4, 4, True)) == 2 and (None, 4, 4, False) in marks
    assert exact_dedup.mark_copies(none).count() == 0
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "3", "4", "4", "6", "8"]


def test_repeats(docs, none):
    found = {r.doc_id: r for r in repeats.remove_repeats(docs).collect()}
    assert found[6].n_removed == found[6].n_bytes == len(LONG) and found[6].n_spans == 1
    assert found[1].n_bytes == 0 and found[1].kept_sha256 == EMPTY_SHA
    assert found[8].n_bytes == 2 and found[8].n_removed == 0
    assert repeats.remove_repeats(none).count() == 0
    whole = repeats.remove_repeats(docs, with_text=True)
    assert {"source", "kept_bytes", "removed"} <= set(whole.columns)


def test_mixing(docs, none):
    plan = mixing.plan_mix(docs)
    got = plan.collect()
    assert len(got) == 11 and max(r.copies for r in got) <= 3
    assert all(r.taken == r["size"] * r.copies and len(r.shards) == r.copies for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan_mix(docs.repartition(5)).collect()))
    mixed = mixing.mix(docs)
    assert "shard_order" in mixed.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.plan_mix(none).count() == 0 and mixing.mix(none).count() == 0


def test_simhash(docs, none):
    found = {(r.doc_id, r.fingerprint): r.component_id
             for r in simhash.near_duplicates(docs).collect()}
    zero = "0" * 16
    assert found[1, zero] == found[2, zero] == found[3, zero] == found[9, zero] == 1
    assert len({v for (i, _), v in found.items() if i in (4, 5, None)}) == 1
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "4", "6", "8", "None"]


def test_lines(docs, none):
    found = {r.doc_id: r for r in line_dedup.removed_lines(docs).collect() if r.doc_id is not None}
    assert found[1].n_lines == 0 and found[2].n_lines == 1 and found[3].n_lines == 2
    assert found[5].removed == [0] and found[7].removed == [0] and found[6].removed == []
    assert line_dedup.removed_lines(none).count() == 0
    left = line_dedup.dedup_lines(docs)
    assert left.columns == docs.columns
    assert {r.doc_id: r.text for r in left.collect()}[7] == ""


@pytest.mark.parametrize("kind", ["long", "boolean"])
def test_lines_near_those_of_a_null_id(spark, kind):
    words = "one two three four five six seven eight nine ten"
    later = 7 if kind == "long" else True
    docs = spark.createDataFrame([(None, f"first {words}"), (later, f"x\nlast {words}")],
                                 f"doc_id {kind}, text string")
    found = {r.doc_id: r.removed for r in line_dedup.removed_lines(docs).collect()}
    assert found == {None: [], later: [1]}


def test_tokens(docs, none):
    found = sorted(token_files.round_trip(docs).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None, 1, 2, 3, 4, 4, 5, 6, 7, 8, 9]
    assert [r.n_tokens for r in found][1:4] == [1, 1, 1]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(found, found[1:]))
    assert token_files.round_trip(none).count() == 0


def test_quality(docs, none, labels):
    got = quality.score_documents(docs, labels).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in got)
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.score_documents(none, labels).count() == 0
    assert quality.score_documents(docs, labels.limit(0)).count() == 11


def test_quality_with_ids_of_text(spark):
    """Ids of any type; ids that repeat, in documents and labels, do not enlarge the samples."""
    good = [(f"d{i % 40}", f"the quick brown fox number {i} jumps over a lazy dog again", 1, 0)
            for i in range(60)]
    bad = [(f"b{i}", "BUY NOW!!! $$$ " * 30, 0, 0) for i in range(20)]
    rows = [(i, t, "x") for i, t, *_ in good + bad] + [(None, "nobody's text", "x")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, score string").repartition(3)
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in good + bad[:10]] + [(None, 1, 0)],
                                   "doc_id string, quality int, toxic int")
    got = quality.score_documents(docs, labels).collect()
    assert len(got) == 81 and {type(r.doc_id) for r in got} == {str, type(None)}
    kept = {r.doc_id for r in got if r.keep}
    assert sum(r.keep for r in got if (r.doc_id or "").startswith("b")) == 0
    assert len([i for i in kept if i and i.startswith("d")]) == 40
    left = quality.keep_good(docs, labels)
    assert left.columns == docs.columns and left.count() == sum(r.keep for r in got)


def test_licenses(docs, none):
    found = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert found[1].n_lines == 0 and found[2].n_lines == 1 and found[6].license is None
    assert licenses.scan_licenses(none).count() == 0


def test_licenses_over_lines_and_inside_lines(spark):
    notice = dict(reversed(licenses.TEMPLATES))  # the first of each name
    long = {name: text for name, text in licenses.TEMPLATES}
    prose = " ".join(f"other{i} words{i}" for i in range(150)) + " "
    mit = long["MIT"].split()
    texts = [
        prose + "\n" + "\n".join("# " + " ".join(mit[i:i + 9]) for i in range(0, len(mit), 9)) + "\n" + prose,
        prose + notice["Apache-2.0"] + " " + prose,
        "Copyright 2020\n\n" + long["MIT"] + " The above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the Software. " + prose,
        prose + long["GPL-3.0"].replace("and/or modify", "and, if you so wish, modify") + prose,
        prose, notice["MIT"] + "\n" + prose]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = {r.doc_id: (r.licenses, r.n_matches, r.dice) for r in licenses.scan_licenses(docs).collect()}
    assert [found[i][0] for i in range(6)] == ["MIT", "Apache-2.0", "MIT", "GPL-3.0", "", "MIT"]
    assert [found[i][1] for i in range(6)] == [1, 1, 1, 1, 0, 1]
    assert found[0][2] == found[1][2] == found[2][2] == 1.0 and 0.8 <= found[3][2] < 1


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (3, "no scheme", "x"), (4, "http://", "x"), (4, "http://", "x"),
         (5, "HTTP://A.Example.NET:80/EN?x", "x"), (6, "http://net", "x"), (7, "a://net/?b", "x"),
         (8, "http://x.net//y://z", "x"), (None, "http://q.org/fr/", "x")],
        "page_id long, url string, mean string")
    outcomes = spark.createDataFrame([(1, 0), (5, None), (77, 1)], "page_id long, good int")
    found = {r.page_id: r for r in url_reputation.filter_urls(pages, outcomes).collect()}
    assert [(found[i].host, found[i].path) for i in (1, 3, 4)] == [("", "")] * 3
    assert (found[5].host, found[5].path, found[5].rule) == ("a.example.net:80", "/EN", None)
    assert (found[6].rule, found[7].rule, found[8].rule) == (None, "net/", "net/")
    assert found[None].rule == "org/fr/" and found[8].path == "//y://z"
    assert url_reputation.filter_urls(pages, outcomes).count() == 10
    assert url_reputation.filter_urls(pages.limit(0), outcomes).count() == 0
    assert url_reputation.filter_urls(pages, outcomes.limit(0)).where("verdict is null").count() == 0
