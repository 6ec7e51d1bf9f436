"""Prefix trie of conversations by a splitter skeleton.

A conversation is its path: one item of 20 bytes a turn, 16 of the SHA-256 of role and text and 4 of
the text's length, so texts are read once and never exchanged. Paths are range-partitioned in
order of path, then id, by splitters from a bounded sample, so equal paths are spread too. Their trie,
the skeleton, is broadcast: it has every node whose members may stand in several shards, since such
a node's range holds a splitter, which it is then a prefix of. A sorted shard builds all other nodes alone
in one pass with a stack as deep as the path; of a skeleton node it gives the partial aggregates of its own
members and own finished subtrees. Partials are added up by node and reduced over the skeleton.

Memory: a shard's stack; splitters of at most SKELETON_NODES turns in all. Only a conversation's own
path, 20 bytes a turn, is one value.
"""

import bisect
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from driftgate.llm.common import text_or_empty
from driftgate.session import materialize

ITEM = 20
#: Nodes of the skeleton at most, over all splitters.
SKELETON_NODES = 1 << 20
MAX_SHARDS = 1 << 14
CONVS_PER_SHARD = 100_000
#: Sampled paths for each splitter. The sample only sets the balance of the shards.
SAMPLED = 20
#: Ids of a skeleton node's ends that travel as one text.
IDS_AT_ONCE = 4096
_ROWS_AT_ONCE = 20_000
_NODE, _PARTIAL, _ENDS = 0, 1, 2
_SCHEMA = ("kind int, shard int, number long, parent_number long, owner int, parent_owner int, "
           "depth long, conv_id {id}, n_convs long, n_children long, n_leaves long, "
           "saved_tokens long, n_bytes long, ends string")
EMPTY = hashlib.sha256(b"").hexdigest()


def conversation_paths(turns: DataFrame, id_col="conv_id", turn_col="turn", role_col="role",
                       text_col="text") -> DataFrame:
    """(conv_id, path) of every conversation: the items of its turns by turn, null first.

    Null roles and texts count as empty. Equal turns stand in the order of their items, repeated rows
    are repeated turns. Rows without an id belong to no conversation and are left out.
    """
    role, text = text_or_empty(role_col), text_or_empty(text_col)
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
                    .cast("binary"), 256)
    item = F.concat(F.substring(digest, 1, 32),
                    F.lower(F.lpad(F.hex(F.octet_length(text)), 8, "0")))
    rows = turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("conv_id"), F.struct(F.col(turn_col).alias("t"), item.alias("i")).alias("x"))
    items = F.array_sort(F.collect_list("x"), lambda a, b: F.when(
        a.t.eqNullSafe(b.t), F.when(a.i < b.i, -1).when(a.i > b.i, 1).otherwise(0)).when(
        a.t.isNull(), -1).when(b.t.isNull(), 1).when(a.t < b.t, -1).otherwise(1))
    return rows.groupBy("conv_id").agg(items.alias("x")).select(
        "conv_id", F.unhex(F.array_join(F.transform("x", lambda x: x.i), "")).alias("path"))


def spliced(paths: DataFrame, group=5, most=9) -> DataFrame:
    """Every conversation c with its first h turns replaced by those of conversation c - c % group
    (all if fewer, none if there is no such), h = CRC-32 of the decimal c, modulo `most`."""
    base = (F.col("conv_id") - F.col("conv_id") % group).alias("_base")
    cut = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most * ITEM
    heads = paths.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("_base"),
        F.substring("path", 1, (most - 1) * ITEM).alias("_head"))
    rest = F.expr("substring(path, _cut + 1)")
    return paths.select("conv_id", "path", base, cut.cast("int").alias("_cut")).join(
        heads, "_base", "left").select("conv_id", F.concat(
            F.coalesce(F.expr("substring(_head, 1, _cut)"), F.lit(b"")), rest).alias("path"))


def shared_turns(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with in common."""
    low, high = 0, min(len(a), len(b)) // ITEM
    if a[:high * ITEM] == b[:high * ITEM]:
        return high
    while low < high - 1:  # the first `low` are equal, the first `high` are not
        middle = (low + high) // 2
        if a[low * ITEM:middle * ITEM] == b[low * ITEM:middle * ITEM]:
            low = middle
        else:
            high = middle
    return low


class Skeleton:
    """The trie of the splitters' paths. A node is (owner, depth): the first splitter that has it.

    Keys are (path, 1, id), or (path, 0) for a path that was cut; shard i holds the conversations from
    key i - 1 up to key i. Owners follow from the turns that each key shares with the one before, and
    the nodes in the order of (owner, depth) are the trie in preorder.
    """

    def __init__(self, keys):
        self.keys, self.owners = keys, []
        for number, key in enumerate(keys):
            before = self.owners[-1] if number else []
            shared = shared_turns(keys[number - 1][0], key[0]) if number else -1
            self.owners.append(before[:shared + 1]
                               + [number] * (len(key[0]) // ITEM - max(shared, -1)))

    def shard_of(self, path, name):
        return bisect.bisect_right(self.keys, (path, 1, name))

    def owners_of(self, path, shard):
        """Owners of the path's skeleton nodes from the root down."""
        best = [0]
        for number in (shard - 1, shard):
            if 0 <= number < len(self.keys):
                shared = shared_turns(path, self.keys[number][0])
                if shared + 1 > len(best) or number == shard - 1:
                    best = self.owners[number][:shared + 1]
        return best


def choose_splitters(paths: DataFrame, shards: int) -> Skeleton:
    """Splitters at equal distances of a sample of some SAMPLED paths a shard, each cut to a length that
    keeps the skeleton below SKELETON_NODES."""
    longest = max(1, SKELETON_NODES // shards)
    rows = paths.count()
    if shards < 2 or rows < 2:
        return Skeleton([])
    fraction = min(1.0, SAMPLED * shards / rows)
    sample = paths.sample(fraction, seed=11) if fraction < 1 else paths.limit(SAMPLED * shards)
    cut = F.octet_length("path") > longest * ITEM
    keys = sample.select(F.substring("path", 1, longest * ITEM).alias("path"),
                         F.when(~cut, F.col("conv_id")).alias("conv_id"))
    # A bounded sample: one task may order it.
    place = F.row_number().over(Window.orderBy("path", "conv_id")) - 1
    every = max(1, round(rows * fraction / shards))
    chosen = keys.withColumn("_place", place).where(
        (F.col("_place") > 0) & (F.col("_place") % every == 0)).collect()
    return Skeleton(sorted({(bytes(r.path), 0) if r.conv_id is None
                            else (bytes(r.path), 1, r.conv_id) for r in chosen})[:MAX_SHARDS])


def _shards_of(batches, skeleton):
    for batch in batches:
        shards = [skeleton.shard_of(p, c) for c, p in zip(
            batch.column("conv_id").to_pylist(), batch.column("path").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(shards, pa.int32()), *batch.columns], names=["shard", *batch.schema.names])


class _Node:
    __slots__ = ("number", "owner", "n_bytes", "least", "convs", "children", "leaves", "saved",
                 "hasher", "ids")

    def __init__(self, number, owner, n_bytes):
        self.number, self.owner, self.n_bytes = number, owner, n_bytes
        self.least, self.convs, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.hasher, self.ids = None, []

    def add(self, name):
        self.convs += 1
        if self.least is None or name < self.least:
            self.least = name

    def take(self, child):
        self.convs += child.convs
        if self.least is None or child.least < self.least:
            self.least = child.least
        if child.owner is None:
            self.children += 1
            self.leaves += child.leaves
            self.saved += child.saved


class _Shard:
    """The open nodes of one shard, from the root down, and the rows that are ready."""

    def __init__(self, shard, schema):
        self.shard, self.schema, self.rows = shard, schema, []
        self.stack, self.path, self.numbers = [], b"", 0

    def _row(self, kind, node, depth, **more):
        self.rows.append({"kind": kind, "shard": self.shard, "owner": node.owner, "depth": depth,
                          "conv_id": node.least} | more)

    def _flush_ids(self, node, depth):
        if node.ids:
            self._row(_ENDS, node, depth, conv_id=node.ids[0], ends=",".join(map(str, node.ids)))
            node.ids = []

    def _close(self):
        depth = len(self.stack) - 1
        node, parent = self.stack.pop(), self.stack[-1] if depth else None
        if node.owner is not None:
            self._flush_ids(node, depth)
            self._row(_PARTIAL, node, depth, n_convs=node.convs, n_children=node.children,
                      n_leaves=node.leaves, saved_tokens=node.saved, n_bytes=node.n_bytes)
        else:
            node.leaves = node.leaves or 1
            node.saved += (node.convs - 1) * node.n_bytes
            self._row(_NODE, node, depth, number=node.number, n_convs=node.convs,
                      n_children=node.children, n_leaves=node.leaves, saved_tokens=node.saved,
                      parent_number=parent.number if parent.owner is None else None,
                      parent_owner=parent.owner,
                      ends=node.hasher.hexdigest() if node.hasher else EMPTY)
        if parent:
            parent.take(node)

    def close_to(self, depth):
        while len(self.stack) > depth + 1:
            self._close()

    def add(self, name, path, skeleton):
        shared = shared_turns(self.path, path) if self.stack else -1
        self.close_to(shared)
        turns, owners = len(path) // ITEM, None
        if shared < turns:
            owners = skeleton.owners_of(path, self.shard)
        for depth in range(shared + 1, turns + 1):
            self.numbers += 1
            self.stack.append(_Node(
                self.numbers, owners[depth] if depth < len(owners) else None,
                int.from_bytes(path[depth * ITEM - 4:depth * ITEM], "big") if depth else 0))
        self.path, node = path, self.stack[-1]
        node.add(name)
        if node.owner is not None:
            node.ids.append(name)
            if len(node.ids) >= IDS_AT_ONCE:
                self._flush_ids(node, turns)
        elif node.hasher is None:
            node.hasher = hashlib.sha256(str(name).encode())
        else:
            node.hasher.update(b"," + str(name).encode())

    def ready(self):
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_pylist(rows, schema=self.schema)


def _build(batches, skeleton, schema):
    """Rows of a task's shards, which come one after another, sorted by path and id."""
    shard = None
    for batch in batches:
        for number, name, path in zip(*[batch.column(c).to_pylist()
                                        for c in ("shard", "conv_id", "path")]):
            if shard is None or shard.shard != number:
                if shard is not None:
                    shard.close_to(-1)
                    yield shard.ready()
                shard = _Shard(number, schema)
            shard.add(name, path, skeleton)
            if len(shard.rows) >= _ROWS_AT_ONCE:
                yield shard.ready()
    if shard is not None:
        shard.close_to(-1)
        yield shard.ready()


def _reduce(batches, schema):
    """Skeleton nodes in preorder: every node's totals with those of the skeleton nodes below it."""
    stack, rows = [], []

    def close():
        node = stack.pop()
        if not node["n_children"]:
            node["n_leaves"] = 1
        node["saved_tokens"] += (node["n_convs"] - 1) * node.pop("n_bytes")
        if stack:
            stack[-1]["n_children"] += 1
            stack[-1]["n_leaves"] += node["n_leaves"]
            stack[-1]["saved_tokens"] += node["saved_tokens"]
            node["parent_conv_id"] = stack[-1]["conv_id"]
        rows.append(node)

    for batch in batches:
        for node in batch.to_pylist():
            while len(stack) > node["depth"]:
                close()
            stack.append(node)
        yield pa.RecordBatch.from_pylist(rows, schema=schema)
        rows.clear()
    while stack:
        close()
    yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _hash_ends(batches, schema):
    """SHA-256 of each node's ids, which come in texts one after another."""
    key, hasher = None, None
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            if (row["owner"], row["depth"]) != key:
                if hasher:
                    rows.append({"owner": key[0], "depth": key[1], "ends": hasher.hexdigest()})
                key, hasher = (row["owner"], row["depth"]), hashlib.sha256(row["ends"].encode())
            else:
                hasher.update(b"," + row["ends"].encode())
        yield pa.RecordBatch.from_pylist(rows, schema=schema)
    if hasher:
        yield pa.RecordBatch.from_pylist(
            [{"owner": key[0], "depth": key[1], "ends": hasher.hexdigest()}], schema=schema)


def _arrow(text):
    return to_arrow_schema(_parse_datatype_string(text))


def prefix_trie(paths: DataFrame, shards=None, name="conv_id") -> DataFrame:
    """The nodes of the trie of (conv_id, path), the root with depth 0 among them: conv_id, the smallest
    member; depth; parent_conv_id (root: null); n_convs, members; n_children; n_leaves, childless
    nodes of the subtree, which holds its top; saved_tokens, over the subtree the bytes of a
    node's last text times its members but one; ends_sha256 of the ids, comma-joined in ascending
    order, of the members that end at the node.

    Ids are unique and not null (as `conversation_paths` gives them), integers or strings. Equal paths
    are one node; an empty path ends at the root; very long paths pass as one value of 20 bytes a
    turn; no conversations give no nodes. `shards`: range partitions, by default by the number of
    conversations.
    """
    spark = paths.sparkSession
    paths = materialize(paths.select("conv_id", "path"), "conversation-paths")
    if shards is None:
        shards = min(MAX_SHARDS, max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                                     -(-paths.count() // CONVS_PER_SHARD)))
    kind = paths.schema["conv_id"].dataType.simpleString()
    skeleton = choose_splitters(paths, shards)
    shared = spark.sparkContext.broadcast(skeleton)  # at most SKELETON_NODES
    ranged = paths.mapInArrow(lambda b: _shards_of(b, shared.value),
                              f"shard int, conv_id {kind}, path binary")
    ranged = ranged.repartitionById(len(skeleton.keys) + 1, "shard").sortWithinPartitions(
        "shard", "path", "conv_id")
    layout = _SCHEMA.format(id=kind)
    arrow = _arrow(layout)
    built = materialize(ranged.mapInArrow(lambda b: _build(b, shared.value, arrow), layout), "trie")

    reduced = f"owner int, depth long, conv_id {kind}, parent_conv_id {kind}, n_convs long, " \
              "n_children long, n_leaves long, saved_tokens long"
    top = _arrow(reduced)
    partial = built.where(F.col("kind") == _PARTIAL).groupBy("owner", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.max("n_bytes").alias("n_bytes"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    # At most SKELETON_NODES rows, whatever the input: one task orders them.
    tops = materialize(partial.repartition(1).sortWithinPartitions("owner", "depth").mapInArrow(
        lambda b: _reduce(b, top), reduced), "skeleton")
    ends = _arrow("owner int, depth long, ends string")
    ended = built.where(F.col("kind") == _ENDS).select("owner", "depth", "conv_id", "ends")
    ended = ended.repartition("owner", "depth").sortWithinPartitions(
        "owner", "depth", "conv_id").select("owner", "depth", "ends").mapInArrow(
        lambda b: _hash_ends(b, ends), "owner int, depth long, ends string")

    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
               "saved_tokens", "ends"]
    nodes = built.where(F.col("kind") == _NODE)
    inner = nodes.where("n_children > 0").select(
        "shard", F.col("number").alias("parent_number"), F.col("conv_id").alias("parent_conv_id"))
    below = nodes.where("parent_number is not null").join(inner, ["shard", "parent_number"])
    over = F.broadcast(tops.select(F.col("owner").alias("parent_owner"), (F.col("depth") + 1).alias("depth"),
                                   F.col("conv_id").alias("parent_conv_id")))
    under = nodes.where("parent_number is null").join(over, ["parent_owner", "depth"])
    tops = tops.join(ended, ["owner", "depth"], "left").fillna(EMPTY, ["ends"])
    out = below.select(columns).unionByName(under.select(columns)).unionByName(tops.select(columns))
    return out.select(F.col("conv_id").alias(name), *columns[1:-1], F.col("ends").alias("ends_sha256"))


SQL = r"""
WITH own AS (
  SELECT conv_id, list([coalesce(role, ''), coalesce(text, '')] ORDER BY turn NULLS FIRST) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
hashed AS (
  SELECT *, xor(CAST(list_reduce(list_transform(range(1, len(CAST(conv_id AS VARCHAR)) + 1),
        lambda i: CAST(ord(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT)),
      lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda s, z: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END),
      4294967295) AS BIGINT), 4294967295) % 9 AS h
  FROM own),
built AS (
  SELECT a.conv_id, coalesce(b.t[1:a.h], []) || a.t[a.h + 1:] AS t
  FROM hashed a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5),
prefixes AS (
  SELECT conv_id, len(t) AS turns, unnest(range(0, len(t) + 1)) AS depth, t FROM built),
members AS (
  SELECT conv_id, turns, depth, md5(CAST(t[1:depth] AS VARCHAR)) || '/' || depth AS node,
    CASE WHEN depth > 0 THEN md5(CAST(t[1:depth - 1] AS VARCHAR)) || '/' || (depth - 1) END AS parent,
    CASE WHEN depth > 0 THEN strlen(t[depth][2]) ELSE 0 END AS n_bytes
  FROM prefixes),
nodes AS (
  SELECT node, depth, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
    (count(*) - 1) * min(n_bytes) AS saved,
    sha256(coalesce(string_agg(CASE WHEN turns = depth THEN CAST(conv_id AS VARCHAR) END, ','
      ORDER BY conv_id), '')) AS ends_sha256
  FROM members GROUP BY node, depth),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL
             GROUP BY parent),
below AS (
  SELECT a.node, sum(n.saved) AS saved_tokens,
    sum(CASE WHEN c.n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves
  FROM nodes n JOIN members a ON a.conv_id = n.conv_id AND a.depth <= n.depth
  LEFT JOIN children c ON c.node = n.node GROUP BY a.node)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs,
  coalesce(c.n_children, 0) AS n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves,
  CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN children c ON c.node = n.node
JOIN below b ON b.node = n.node"""
