"""Quality classifier: a weak-label model and a hashed linear scorer.

Heuristic labellers vote good, bad or nothing on every document; people's labels are one more
labeller that covers some. Expectation-maximisation over the counts of vote patterns, which cover
all documents, estimates how often each labeller gives each vote on good and on bad documents. The
posterior of a document's pattern is its training label. A linear scorer over hashed words, the
votes and the measures behind them is fitted to a bounded sample of these labels and decides.

One labeller knows terms of toxic documents, learned from a bounded sample of labelled rows: words
and word beginnings that clean documents lack, taken greedily until they cover the toxic ones.
"""

import math
import operator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from driftgate.llm.common import shielded, utf8
from driftgate.session import materialize

#: Labelled rows that the toxic terms are learned from, rows that the scorer is fitted to, and the
#: most terms that are considered.
LABELLED_ROWS = 6000
TRAINING_ROWS = 6000
MAX_TERMS = 20_000
#: Unlike toxic documents that a term needs, their share of all, and the least log ratio.
MIN_HITS = 4
MIN_SHARE = 0.012
MIN_WEIGHT = 3.0
HASH_BITS = 18
EM_ROUNDS = 40
REJECT = 0.5
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_SPACE = b"\t\n\x0b\x0c\r "
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: Labeller: (bad from, good below) of its measure.
LABELLERS = {"symbols": (0.18, 0.10), "shouting": (0.5, 0.2), "repeats": (0.2, 0.06),
             "separators": (0.1, 0.02), "sameness": (0.85, 0.6), "toxic_terms": (4.5, 2.5)}


def _without(data, chars):
    return len(data) - len(data.translate(None, chars))


def terms_of(word: bytes):
    """A word as a term, and its beginnings of four to eight letters."""
    text = word.decode("utf-8", "replace")
    return [text, *(f"{text[:n]}*" for n in range(4, min(9, len(text))))]


def words_of(data: bytes):
    return data.lower().translate(_TO_SPACE).split()


_TO_SPACE = bytes(32 if c in _PUNCTUATION else c for c in range(256))


def measures(data: bytes, term_weight) -> list:
    """One number per labeller; `term_weight(set of words)` is the weight of their toxic terms."""
    raw = data.split()
    n = max(1, len(raw))
    upper, lower = _without(data, _UPPER), _without(data, _LOWER)
    vocabulary = set(words_of(data))
    return [
        _without(data, _PUNCTUATION) / max(1, len(data) - _without(data, _SPACE)),
        upper / max(1, upper + lower),
        sum(map(operator.eq, raw, raw[1:])) / n,
        raw.count(b"|") / n,
        1 - len(vocabulary) / n if n >= 50 else 0.0,
        term_weight(vocabulary),
    ]


def votes_of(values) -> list:
    """1 bad, 0 good, -1 nothing."""
    return [1 if v >= bad else 0 if v < good else -1
            for v, (bad, good) in zip(values, LABELLERS.values())]


class TermWeights:
    """The summed weight of the toxic terms of distinct words, each word by its heaviest term;
    remembers a bounded number of words."""

    def __init__(self, terms):
        self.terms, self.known = terms, {}

    def __call__(self, vocabulary):
        if len(self.known) > 500_000:
            self.known.clear()
        return sum(map(self._weight, sorted(vocabulary)))

    def _weight(self, word):
        found = self.known.get(word)
        if found is None:
            found = self.known[word] = max(self.terms.get(t, 0.0) for t in terms_of(word))
        return found


def _labels(labels, id_col):
    """One row per labelled id: bad and toxic as 0 or 1. Null labels say nothing."""
    toxic = F.coalesce(F.col("toxic"), F.lit(0))
    return (labels.where(F.col("doc_id").isNotNull()
                         & (F.col("quality").isNotNull() | F.col("toxic").isNotNull()))
            .groupBy(F.col("doc_id").alias("_id")).agg(
                F.max(F.when((F.col("quality") == 0) | (toxic == 1), 1).otherwise(0)).alias("_bad"),
                F.max(F.when(toxic == 1, 1).otherwise(0)).alias("_toxic")))


def _kind(df, column):
    """A column's type as text: ids may be of any."""
    return df.schema[column].dataType.simpleString()


def _sketch(words):
    """Eight minima of hashed word triples: near copies share at least one of them."""
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(b" ".join(words[i:i + 3])) for i in range(max(1, len(words) - 2))],
                      np.uint64)
    return [int((hashes * np.uint64(2 * k + 1) ^ (hashes >> np.uint64(k + 20))).min() >> np.uint64(1))
            for k in range(8)]


def _term_rows(batches):
    for batch in batches:
        terms, sketches = [], []
        for data in batch.column("_utf8"):
            words = words_of(data.as_py())
            terms.append(sorted({t for w in set(words) for t in terms_of(w)}))
            sketches.append(_sketch(words))
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), batch.column("_toxic"), pa.array(terms, pa.list_(pa.string())),
             pa.array(sketches, pa.list_(pa.int64()))], names=["id", "toxic", "terms", "sketch"])


def _families(sketches: dict) -> dict:
    """{id: family}, where ids that share a sketch value are one family."""
    root, owner = {}, {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for name, values in sorted(sketches.items()):
        root[name] = name
        for place in enumerate(values):
            root[find(name)] = find(owner.setdefault(place, name))
    return {name: find(name) for name in root}


def toxic_terms(docs, labels, id_col, text_col, rows=LABELLED_ROWS) -> dict:
    """{term: weight} of terms that enough unlike toxic documents have and clean ones hardly: the log
    ratio of their shares, from MIN_WEIGHT up. Near copies count as one document, so the other words
    of a copied text are not taken for toxic."""
    sample = labels.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    joined = docs.select(F.col(id_col).alias("_id"), utf8(text_col).alias("_utf8")).join(
        F.broadcast(sample), "_id")
    found = materialize(joined.select("_id", "_toxic", "_utf8").mapInArrow(
        _term_rows, f"id {_kind(joined, '_id')}, toxic int, terms array<string>, "
                    "sketch array<long>").dropDuplicates(["id"]), "terms")
    sketches = {r.id: r.sketch for r in found.where("toxic = 1").select("id", "sketch").collect()}
    families = _families(sketches)
    clean = found.where("toxic = 0").count()
    of = {t: found.where(f"toxic = {t}").select("id", F.explode("terms").alias("term"))
          for t in (0, 1)}
    often = materialize(of[1].groupBy("term").count().where(F.col("count") >= MIN_HITS).orderBy(
        F.desc("count"), "term").limit(MAX_TERMS).select("term"), "often")
    seen = {}
    for row in of[1].join(F.broadcast(often), "term").toLocalIterator():
        seen.setdefault(row.term, set()).add(families[row.id])
    in_clean = dict(of[0].join(F.broadcast(often), "term").groupBy("term").count().collect())
    toxic = len(set(families.values()))
    weights = {}
    for term, kinds in seen.items():
        weight = math.log((len(kinds) + 0.5) / (toxic + 1)) - math.log(
            (in_clean.get(term, 0) + 1) / (clean + 1))
        if len(kinds) >= max(MIN_HITS, MIN_SHARE * toxic) and weight >= MIN_WEIGHT:
            weights[term] = round(weight, 6)
    return weights


def _features(data, values, votes):
    """Hashed words, each once, and the dense part: measures and votes."""
    digest = xxhash.xxh64_intdigest
    hashed = np.fromiter((digest(w) & ((1 << HASH_BITS) - 1) for w in set(words_of(data))),
                         np.int64)
    dense = [*(min(v, 10.0) / 10 for v in values), *(v == 1 for v in votes), *(v == 0 for v in votes)]
    return hashed, np.array([1.0, *dense])


def em(patterns, rounds=EM_ROUNDS):
    """From rows (votes, count), people's vote last: the posterior of bad for every pattern, and
    each labeller's table of P(vote | class).

    The classes are good and one kind of bad per heuristic labeller, since a shouted text and a
    toxic one get unlike votes. Votes are -1, 0, 1. The start is who says bad, or what people say;
    people's table leans on a prior of being right.
    """
    votes = np.array([p for p, _ in patterns], np.int64).reshape(len(patterns), -1)
    weight = np.array([n for _, n in patterns], float)
    kinds = votes.shape[1] - 1
    bad = (votes[:, :-1] == 1).astype(float)
    some = bad.any(axis=1, keepdims=True)
    share = np.where(some, bad, 1.0) / np.where(some, bad.sum(axis=1, keepdims=True), kinds)
    people = votes[:, -1:]
    good = np.where(people == 0, 0.95, np.where(people == 1, 0.02, np.where(some, 0.1, 0.98)))
    classes = np.concatenate([good, (1 - good) * share], axis=1)
    lean = np.full((kinds + 1, 3), 0.1)
    lean[0, 1] = lean[1:, 2] = 20.0
    for _ in range(rounds):
        held = classes.T * weight
        prior = (held.sum(axis=1) + 1) / (weight.sum() + kinds + 1)
        logs = np.log(prior)[:, None]
        tables = []
        for k in range(kinds + 1):
            table = np.stack([held[:, votes[:, k] == v].sum(axis=1) for v in (-1, 0, 1)], axis=1)
            if k == kinds:  # whom people have labelled says nothing: only what they said counts
                table = table + lean
                table /= table[:, 1:].sum(axis=1, keepdims=True)
                table[:, 0] = 1
            else:
                table = (table + 0.1) / (table + 0.1).sum(axis=1, keepdims=True)
            logs = logs + np.log(table[:, votes[:, k] + 1])
            tables.append(table)
        classes = np.exp(logs - logs.max(axis=0)).T
        classes /= classes.sum(axis=1, keepdims=True)
    return 1 - classes[:, 0], np.array(tables)


def fit_scorer(rows, epochs=12, rate=0.5, decay=1e-4):
    """Logistic regression by adaptive gradient steps on (hashed, dense, label) rows in their
    given order; words share one unit of weight per document, so long texts count no more."""
    words, dense = np.zeros(1 << HASH_BITS), None
    sum_w, sum_d = np.full(1 << HASH_BITS, 1e-6), None
    for _ in range(epochs):
        for hashed, values, label in rows:
            if dense is None:
                dense, sum_d = np.zeros(len(values)), np.full(len(values), 1e-6)
            unit = 1 / max(1.0, len(hashed)) ** 0.5
            p = _logistic(words[hashed].sum() * unit + dense @ values)
            step = (p - label) * unit + decay * words[hashed]
            sum_w[hashed] += step ** 2
            words[hashed] -= 0.1 * rate * step / np.sqrt(sum_w[hashed])
            step = (p - label) * values + decay * dense
            sum_d += step ** 2
            dense -= rate * step / np.sqrt(sum_d)
    return words, dense


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _vote_rows(batches, terms):
    counter = TermWeights(terms)
    for batch in batches:
        votes = [votes_of(measures(x.as_py(), counter)) for x in batch.column("_utf8")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), pa.array(votes, pa.list_(pa.int32()))], names=["_id", "_votes"])


def _feature_rows(batches, terms):
    counter = TermWeights(terms)
    for batch in batches:
        hashed, dense = [], []
        for x in batch.column("_utf8"):
            values = measures(x.as_py(), counter)
            h, d = _features(x.as_py(), values, votes_of(values))
            hashed.append(h)
            dense.append(d)
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), pa.array(hashed, pa.list_(pa.int64())),
             pa.array(dense, pa.list_(pa.float64())), batch.column("_posterior")],
            names=["_id", "hashed", "dense", "label"])


def _score_rows(batches, terms, words, dense):
    counter = TermWeights(terms)
    for batch in batches:
        scores = []
        for x in batch.column("_utf8"):
            values = measures(x.as_py(), counter)
            h, d = _features(x.as_py(), values, votes_of(values))
            scores.append(float(_logistic(words[h].sum() / max(1.0, len(h)) ** 0.5 + dense @ d)))
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(scores, pa.float64())],
                                         names=["_id", "_score"])


def _packed(votes, human):
    """A vote pattern as text: fewer than 3 ** 7 different ones."""
    return F.concat_ws(",", F.transform(votes, lambda v: v.cast("string")), human.cast("string"))


def score_documents(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text",
                    labelled_rows=LABELLED_ROWS, training_rows=TRAINING_ROWS,
                    reject=REJECT) -> DataFrame:
    """One row per document: doc_id, posterior (of bad, from the votes), score (of the linear
    scorer), keep.

    A document goes when its score reaches `reject`; where people have labelled it, when the
    posterior does. Null and empty texts get the votes of an empty text. Rows that repeat an id are
    scored each by its own text; labels that repeat an id count as bad if one says so. Without
    documents there are no rows; without labels the votes alone teach. `labels` needs doc_id, quality, toxic.
    """
    spark = docs.sparkSession
    people = materialize(_labels(labels, id_col), "labels")
    base = docs.select(F.col(id_col).alias("_id"), utf8(text_col).alias("_utf8"))
    kind = _kind(base, "_id")
    terms = toxic_terms(docs, people, id_col, text_col, labelled_rows)
    votes = materialize(base.mapInArrow(lambda b: _vote_rows(b, terms),
                                        f"_id {kind}, _votes array<int>"), "votes")
    voted = votes.join(people.select("_id", "_bad"), "_id", "left").withColumn(
        "_human", F.coalesce("_bad", F.lit(-1))).withColumn(
        "_pattern", _packed(F.col("_votes"), F.col("_human")))
    patterns = [(r._pattern, r.n) for r in voted.groupBy("_pattern").agg(
        F.count("*").alias("n")).orderBy("_pattern").collect()]
    schema = "_pattern string, _posterior double"
    rows = []
    if patterns:
        bad, _ = em([([int(v) for v in p.split(",")], n) for p, n in patterns])
        rows = [(p, round(float(b), 9)) for (p, _), b in zip(patterns, bad)]
    posterior = F.broadcast(spark.createDataFrame(rows, schema))
    judged = materialize(voted.join(posterior, "_pattern").select("_id", "_human", "_posterior"),
                         "posteriors")
    # Half of the training rows from each side of the posterior, so rare junk is learned too.
    side = [judged.where(c).dropDuplicates(["_id"]).orderBy(F.xxhash64("_id"), "_id")
            .limit(training_rows // 2) for c in ("_posterior >= 0.5", "_posterior < 0.5")]
    sample = materialize(side[0].unionByName(side[1]).select("_id", "_posterior"), "training")
    # Of rows that repeat an id one text teaches, so the sample stays as small as it was drawn.
    chosen = base.join(F.broadcast(sample), "_id").groupBy("_id").agg(
        F.min("_utf8").alias("_utf8"), F.first("_posterior").alias("_posterior"))
    features = chosen.mapInArrow(
        lambda b: _feature_rows(b, terms),
        f"_id {kind}, hashed array<long>, dense array<double>, label double")
    training = [(np.array(r.hashed, np.int64), np.array(r.dense), r.label) for r in
                features.orderBy(F.xxhash64("_id"), "label", "hashed").toLocalIterator()]
    words, dense = fit_scorer(training) if training else (
        np.zeros(1 << HASH_BITS), np.zeros(1 + 3 * len(LABELLERS)))
    shared = spark.sparkContext.broadcast((terms, words.astype(np.float32), dense))
    scored = base.mapInArrow(lambda b: _score_rows(b, *shared.value), f"_id {kind}, _score double")
    # The posterior belongs to a row's votes; rows that repeat an id take the worst of theirs.
    worst = judged.groupBy("_id").agg(F.max("_posterior").alias("posterior"),
                                      F.max("_human").alias("_human"))
    joined = scored.join(worst, scored["_id"].eqNullSafe(worst["_id"])).drop(worst["_id"])
    keep = F.when(F.col("_human") >= 0, F.col("posterior") < reject).otherwise(
        F.col("_score") < reject)
    return joined.select(F.col("_id").alias("doc_id"), "posterior", F.col("_score").alias("score"),
                         keep.alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text",
              **options) -> DataFrame:
    """The documents that the classifier keeps, columns as they came. Rows that repeat an id go
    together."""
    judged = score_documents(docs, labels, id_col, text_col, **options)
    gone = judged.where("not keep").select(F.col("doc_id").alias("_gone")).distinct()
    plain, back = shielded(docs, id_col, text_col)
    return back(plain.join(gone, plain[id_col].eqNullSafe(gone["_gone"]), "left_anti"))
