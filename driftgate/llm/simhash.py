"""SimHash near-duplicates with pigeonring filtering.

Equal fingerprints are one class first. The 64 bits are a ring of 8 segments. If two
fingerprints differ in at most 3 bits, then from some segment on, every chain of l consecutive
segments differs in at most floor(3 l / 8) bits: the first two segments are equal, the next three
differ in at most one bit together, and so on. Equality of the first two segments and of one half
of the following three is therefore an index key that no true pair can miss. Pairs that share a
key are pruned by the rest of the chain and only then compared in full.

A key with very many fingerprints is cut into chunks; pairs of chunks are separate pieces of work,
and each piece emits a spanning forest of its links, never all its pairs.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from driftgate.llm.common import blockwise_groups, runs, shielded, utf8, whole_groups, without
from driftgate.llm.components import components
from driftgate.session import materialize

SHINGLE = 3
MAX_BITS = 3
SEED = 42
SEGMENTS = 8
SEGMENT_BITS = 64 // SEGMENTS
CHUNK = 4096
_PAIR_ROWS = 1 << 18


def fingerprint(data: bytes, shingle=SHINGLE) -> int:
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist()
    starts = [0, *(s + 1 for s in spaces)]
    ends = [*spaces, len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[i:j], SEED) for i, j in zip(starts, ends[shingle - 1:])]
    if not hashes:
        hashes = [digest(joined, SEED)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1,
                         bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(batches, shingle):
    for batch in batches:
        values = [fingerprint(x.as_py(), shingle) for x in batch.column("_utf8")]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(n) for n in batch.schema.names if n != "_utf8"],
             pa.array(np.array(values, np.uint64).view(np.int64))],
            names=[*[n for n in batch.schema.names if n != "_utf8"], "_fp"])


def with_fingerprint(docs: DataFrame, text_col="text", shingle=SHINGLE) -> DataFrame:
    """Add `_fp`, the fingerprint as a signed 64-bit integer."""
    plain = without(docs, "_fp", "_utf8")
    schema = plain.withColumn("_fp", F.lit(0).cast("long")).schema
    return plain.withColumn("_utf8", utf8(text_col)).mapInArrow(
        lambda batches: _fingerprints(batches, shingle), schema)


def _budgets(max_bits):
    return [max_bits * length // SEGMENTS for length in range(1, SEGMENTS + 1)]


def chain_keys(values: np.ndarray, max_bits=MAX_BITS):
    """The index keys of each fingerprint: (key, position in values).

    The chain's free run is the longest with budget 0; up to the last length of budget 1 the bits
    that follow are halved, and one of the halves is equal. A larger budget takes more parts.
    """
    budgets = _budgets(max_bits)
    exact = sum(b == 0 for b in budgets)
    spread = sum(b <= 1 for b in budgets)
    parts = 2 if exact and spread > exact else 1
    n = len(values)
    keys = []
    for start in range(SEGMENTS):
        turn = np.uint64(start * SEGMENT_BITS)
        rolled = values >> turn
        if start:
            rolled = rolled | (values << (np.uint64(64) - turn))
        fixed = rolled & np.uint64((1 << exact * SEGMENT_BITS) - 1)
        width = (spread - exact) * SEGMENT_BITS // parts
        for part in range(parts):
            rest = (rolled >> np.uint64(exact * SEGMENT_BITS + part * width)) \
                & np.uint64((1 << width) - 1)
            tag = np.uint64((start * parts + part) << 56)
            keys.append(tag | (fixed << np.uint64(width)) | rest)
    return np.concatenate(keys), np.tile(np.arange(n), len(keys))


def _key_rows(batches, max_bits):
    for batch in batches:
        values = batch.column("fp").to_numpy().view(np.uint64)
        keys, at = chain_keys(values, max_bits)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.view(np.int64)), pa.array(values[at].view(np.int64))],
            names=["key", "fp"])


def _chain_passes(a, b, start, budgets):
    """Which pairs stay within every budget of the chain from segment `start` on; the last
    length is the full Hamming check."""
    turn = np.uint64(start * SEGMENT_BITS)
    diff = a ^ b
    diff = (diff >> turn) | (diff << (np.uint64(64) - turn)) if start else diff
    passes = np.ones(len(diff), bool)
    for length, budget in enumerate(budgets, 1):
        mask = np.uint64((1 << length * SEGMENT_BITS) - 1)
        passes &= np.bitwise_count(diff & mask) <= budget
    return passes


def _forest(values, start, budgets):
    """A spanning forest of the links between distinct fingerprints of one piece of work."""
    n = len(values)
    root = np.arange(n)
    links = []

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    step = max(1, _PAIR_ROWS // n)
    for low in range(0, n, step):
        rows = values[low:low + step]
        a, b = np.meshgrid(np.arange(low, low + len(rows)), np.arange(n), indexing="ij")
        ahead = b > a
        a, b = a[ahead], b[ahead]
        near = _chain_passes(values[a], values[b], start, budgets)
        for i, j in zip(a[near].tolist(), b[near].tolist()):
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
                links.append((i, j))
    return links


def _links(batches, max_bits):
    budgets = _budgets(max_bits)
    parts = 2 if 0 in budgets and 1 in budgets else 1
    for table in whole_groups(batches, ["key", "part"]):
        keys = table.column("key").to_numpy()
        fps = table.column("fp").to_numpy().view(np.uint64)
        starts, ends = runs(keys, table.column("part").to_numpy())
        chain = (keys.view(np.uint64) >> np.uint64(56)).astype(np.int64) // parts
        pairs_a, pairs_b = [], []
        sizes = ends - starts
        two = starts[sizes == 2]
        for start in range(SEGMENTS):  # the usual case, all at once
            own = two[chain[two] == start]
            near = own[_chain_passes(fps[own], fps[own + 1], start, budgets)]
            pairs_a.append(fps[near])
            pairs_b.append(fps[near + 1])
        for s, e in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist()):
            found = _forest(fps[s:e], int(chain[s]), budgets)
            if found:
                i, j = np.array(found).T
                pairs_a.append(fps[s:e][i])
                pairs_b.append(fps[s:e][j])
        a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                                             names=["a", "b"])


def fingerprint_links(classes: DataFrame, max_bits=MAX_BITS, chunk=CHUNK) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` of at most `max_bits` differing bits; the
    links that a piece of work can leave out join what others have joined."""
    if not 2 <= max_bits < SEGMENTS:
        raise ValueError("max_bits must be from 2 to 7: the keys fit that many budgets")
    keyed = classes.select("fp").mapInArrow(lambda b: _key_rows(b, max_bits), "key long, fp long")
    pieces = blockwise_groups(keyed, "key", chunk, "simhash-keys")
    spread = pieces.repartition("key", "part").sortWithinPartitions("key", "part")
    return spread.select("key", "part", "fp").mapInArrow(
        lambda b: _links(b, max_bits), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", shingle=SHINGLE,
                    max_bits=MAX_BITS, chunk=CHUNK) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints of at most `max_bits` differing bits are linked; component_id is the smallest id
    that links reach. Null texts and texts without words have fingerprint 0, which links like any
    other. Rows that repeat an id count as one document with several fingerprints. A null id is
    nobody's component; a component without ids has a null one. An empty table gives an empty one.
    """
    marked = materialize(with_fingerprint(docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), "_text", shingle)
        .drop("_text"), "fingerprints")
    classes = materialize(marked.groupBy(F.col("_fp").alias("fp")).agg(
        F.min("doc_id").alias("least")), "fingerprint-classes")
    groups = materialize(components(fingerprint_links(classes, max_bits, chunk)), "components")
    # Fingerprints are the nodes; the smallest id of a component is a minimum over its classes.
    grouped = classes.join(groups, classes["fp"] == groups["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialize(grouped.join(least, "component").select("fp", "component_id"), "named")
    return marked.join(named, marked["_fp"] == named["fp"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """The documents that are their component's smallest id; those without an id stay. Columns as
    they came."""
    found = near_duplicates(docs, id_col, text_col, **options)
    later = found.where("doc_id != component_id").select(F.col("doc_id").alias("_later")).distinct()
    plain, back = shielded(docs, id_col, text_col)
    return back(plain.join(later, plain[id_col] == later["_later"], "left_anti"))
