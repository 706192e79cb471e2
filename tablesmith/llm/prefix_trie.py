"""Conversation prefix trie, built as a burst trie.

A conversation is a path: the root, then one node for each turn, named by the MD5 of its
parent's name and the turn, so equal names are equal prefixes. Equal conversations are
combined first. Then:

- Burst: the root is a container of all paths. A container of more than `capacity` paths
  bursts into one container for each next turn id, and its own node joins the trie's heads.
  Paths that are still in an oversized container go on; each round looks at twice as many
  further turns, so a long common prefix takes few rounds.
- Sweep: each remaining container holds the suffixes of `capacity` different paths at most.
  Its paths are sorted and swept once: nodes open and close on a stack where neighbours
  part, and a closed node adds its counts to its parent.
- Heads get their counts from the burst, their children from the nodes right below, and
  their subtree's sums from one row for each container and head, sent to all heads above.

A node's ends are the conversations that are over there. Their list can be as long as the
table, so it is sorted by range over all tasks, joined to stretches of bounded size there,
and hashed stretch by stretch.

`rebuilt` makes the conversations of the query: the first h turns of conversation
c - c % 20, then c's own turns behind its first h, h = crc32(decimal c) % 4. Only three
turns of every twentieth conversation are joined to the others. A conversation is one row
of turn ids (20 bytes a turn) without text.

Defined results: turns are ordered by turn number, NULL first, turns of one number by their
id (hash of role and text); NULL roles and texts count as empty; rows without a conv_id
belong to no conversation; a conversation all of whose turns are gone is at the root; an
empty table has no node. Columns other than the four named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.common import WORD, stored, text_of

CAPACITY = 256
FIRST_LEVELS = 4
STRETCH_BYTES = 1 << 20
ROOT = b"root"
NO_ENDS = hashlib.sha256(b"").hexdigest()
PATHS = "conv_id long, path array<binary>, words array<long>"
NODES = ("key binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
         "n_leaves long, saved_tokens long, top boolean, above array<binary>")


def turn_lists(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as ids and word counts."""
    role, text = text_of("role"), text_of("text")
    turn_id = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(
            F.col("turn").isNotNull().alias("has"), F.col("turn").cast("long").alias("turn"), turn_id.alias("id"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).alias("t"))
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return lists.select("conv_id", F.transform("t", lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("turns"))


def rebuilt(conversations: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """(conv_id, turns): c's first h turns replaced by those of conversation c - c % group."""
    own = stored(turn_lists(conversations), "trie-turns")
    base = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("front"))
    own = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    own = own.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int"))
    front = F.coalesce("front", F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return own.join(base, "base", "left").select("conv_id", F.concat(F.slice(front, F.lit(1), F.col("h")), rest).alias("turns"))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        paths, words = [], []
        for ids, counts in zip(b.column("ids").to_pylist(), b.column("words").to_pylist()):
            path = [ROOT]
            for t in ids:
                path.append(hashlib.md5(path[-1] + t).digest())
            paths.append(path)
            words.append([0, *counts])
        yield pa.RecordBatch.from_pydict({"conv_id": b.column("conv_id"), "path": pa.array(paths, pa.list_(pa.binary())),
                                          "words": pa.array(words, pa.list_(pa.int64()))})


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path, words): names of the nodes from the root to the last turn, words of each one's text."""
    return turns.select("conv_id", F.transform("turns", lambda t: t["id"]).alias("ids"),
                        F.transform("turns", lambda t: t["words"]).alias("words")).mapInArrow(_paths, PATHS)


def _stretches(size: int):
    """Rows (key, conv_id) in order -> (key, first, ids): comma-joined ids of about `size` bytes each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, parts, length = None, 0, [], 0

        def row():
            return pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "first": pa.array([first], pa.int64()), "ids": [",".join(parts)]})

        for b in batches:
            for k, c in zip(b.column("key").to_pylist(), b.column("conv_id").to_pylist()):
                if k != key or length >= size:
                    if parts:
                        yield row()
                    key, first, parts, length = k, c, [], 0
                parts.append(str(c))
                length += len(parts[-1]) + 1
        if parts:
            yield row()
    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, h = None, None
    for b in batches:
        keys, out = [], []
        for k, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist()):
            if k != key:
                if h is not None:
                    keys.append(key)
                    out.append(h.hexdigest())
                key, h = k, hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "ends_sha256": pa.array(out, pa.string())})
    if h is not None:
        yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends_sha256": [h.hexdigest()]})


def end_digests(ended: DataFrame, size: int = STRETCH_BYTES) -> DataFrame:
    """(key, ends_sha256) of (key, conv_id): SHA-256 of each key's ids, ascending, joined by commas."""
    parts = int(ended.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = ended.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    runs = spread.mapInArrow(_stretches(size), "key binary, first long, ids string")
    return runs.repartition(parts, "key").sortWithinPartitions("key", "first").mapInArrow(_digests, "key binary, ends_sha256 string")


def burst(distinct: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """Heads (key, depth, conv_id, n_convs, words, path) and the distinct paths with their container and its depth.

    Paths that end at a head have no container (NULL).
    """
    spark, start, levels = distinct.sparkSession, 0, FIRST_LEVELS
    going, heads, settled = distinct, [], []
    while True:
        step = going.select("key", "conv_id", "n", "path", "words", F.posexplode(F.slice("path", start + 1, levels)).alias("i", "node"))
        step = step.withColumn("depth", F.col("i") + start)
        found = step.groupBy("node").agg(
            F.count("*").alias("size"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.first("depth").alias("depth"),
            F.min_by(F.struct(F.element_at("words", F.col("depth") + 1).alias("w"), F.slice("path", F.lit(1), F.col("depth") + 1).alias("p")),
                     "conv_id").alias("one")).where(F.col("size") > capacity)
        found = stored(found.select(F.col("node").alias("key"), "depth", "conv_id", "n_convs", F.col("one.w").alias("words"),
                                    F.col("one.p").alias("path")), "trie-heads")
        heads.append(found)
        inside = step.select("key", "node").join(found.select(F.col("key").alias("node")), "node").groupBy("key").agg(F.count("*").alias("in_heads"))
        now = going.join(inside, "key", "left").withColumn("in_heads", F.coalesce("in_heads", F.lit(0)).cast("int"))
        now = stored(now.withColumn("at", F.col("in_heads") + start), "trie-burst").drop("in_heads")
        deeper = (F.col("at") == start + levels) & (F.size("path") > F.col("at"))
        settled.append(now.where(~deeper).withColumn("container", F.get("path", F.col("at"))))
        going = now.where(deeper).drop("at")
        if going.isEmpty():
            break
        start, levels = start + levels, 2 * levels
    all_heads, all_settled = heads[0], settled[0]
    for h, s in zip(heads[1:], settled[1:]):
        all_heads, all_settled = all_heads.unionByName(h), all_settled.unionByName(s)
    return all_heads, all_settled


class _Node:
    __slots__ = ("key", "depth", "words", "conv_id", "n_convs", "leaves", "saved", "children", "rows")

    def __init__(self, key: bytes, depth: int, words: int):
        self.key, self.depth, self.words = key, depth, words
        self.conv_id, self.n_convs, self.leaves, self.saved, self.children, self.rows = None, 0, 0, 0, 0, []

    def add(self, conv_id: int, n: int) -> None:
        self.n_convs += n
        if self.conv_id is None or conv_id < self.conv_id:
            self.conv_id = conv_id

    def close(self) -> tuple:
        self.saved += (self.n_convs - 1) * self.words
        self.leaves = self.leaves or 1
        return (self.conv_id, self.depth, self.n_convs, self.children, self.leaves, self.saved)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted paths of each container -> its nodes. `rows` of an open node: its closed children, for whom its smallest member is not known yet."""
    stack: list[_Node] = []
    container, above, out = None, [], []

    def pop() -> None:
        node = stack.pop()
        row = node.close()
        parent = stack[-1] if stack else None
        for key, child in node.rows:
            out.append((key, node.key, child[0], child[1], node.conv_id, *child[2:], False, None))
        if parent is None:
            out.append((node.key, above[-1] if above else None, row[0], row[1], None, *row[2:], True, list(above)))
        else:
            parent.children += 1
            parent.leaves += node.leaves
            parent.saved += node.saved
            parent.rows.append((node.key, row))

    def batch() -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [[]] * len(kinds)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.values())], names=list(kinds))

    b, i, z = pa.binary(), pa.int64(), pa.bool_()
    kinds = {"key": b, "parent": b, "conv_id": i, "depth": i, "parent_conv_id": i, "n_convs": i, "n_children": i, "n_leaves": i,
             "saved_tokens": i, "top": z, "above": pa.list_(b)}
    for part in batches:
        for c, at, conv_id, n, path, words in zip(*(part.column(x).to_pylist() for x in ("container", "at", "conv_id", "n", "path", "words"))):
            if c != container:
                while stack:
                    pop()
                container, above = c, path[:at]
            same = 0
            while same < len(stack) and at + same < len(path) and stack[same].key == path[at + same]:
                same += 1
            while len(stack) > same:
                pop()
            for d in range(at + same, len(path)):
                stack.append(_Node(path[d], d, words[d]))
            for node in stack:
                node.add(conv_id, n)
        if len(out) >= 4096:
            yield batch()
    while stack:
        pop()
    yield batch()


def trie(turns: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per node of the trie over (conv_id, turns): key, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = turns.sparkSession
    all_paths = stored(paths(turns), "trie-paths")
    at_end = all_paths.select(F.element_at("path", -1).alias("key"), "conv_id", "path", "words")
    distinct = at_end.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"),
                                         F.min_by(F.struct("path", "words"), "conv_id").alias("p"))
    distinct = stored(distinct.select("key", "conv_id", "n", "p.path", "p.words"), "trie-distinct")
    heads, settled = burst(distinct, capacity)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    inside = settled.where(F.col("container").isNotNull()).select("container", "at", "conv_id", "n", "path", "words")
    swept = stored(inside.repartition(parts, "container").sortWithinPartitions("container", "path").mapInArrow(_sweep, NODES), "trie-nodes")
    # sums of the subtrees below heads: each container's top and each head reports to all heads above
    own = (F.col("n_convs") - 1) * F.col("words")
    reports = swept.where("top").select("above", "n_leaves", "saved_tokens").unionByName(
        heads.select(F.col("path").alias("above"), F.lit(0).cast("long").alias("n_leaves"), own.alias("saved_tokens")))
    sums = reports.select(F.explode("above").alias("key"), "n_leaves", "saved_tokens").groupBy("key").agg(
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    heads = heads.withColumn("parent", F.get("path", F.size("path") - 2))
    below = swept.where("top").select("parent").unionByName(heads.select("parent")).groupBy(F.col("parent").alias("key")).agg(
        F.count("*").alias("n_children"))
    trunk = heads.drop("path", "words").join(sums, "key").join(below, "key")
    trunk = trunk.withColumn("parent_conv_id", F.lit(None).cast("long"))
    columns = ["key", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    nodes = stored(trunk.select(*[F.col(c) if c != "depth" else F.col(c).cast("long") for c in columns], F.lit(True).alias("top")).unionByName(
        swept.select(*columns, "top")), "trie-all")
    # only heads and the tops of containers do not know their parent yet
    tops = nodes.where("top").drop("parent_conv_id", "top").join(
        heads.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent", "left")
    nodes = tops.select(*columns).unionByName(nodes.where("not top").select(*columns)).drop("parent")
    # one conversation's end needs no gathering
    single = distinct.where("n = 1").select("key", F.sha2(F.col("conv_id").cast("string").cast("binary"), 256).alias("ends_sha256"))
    shared = distinct.where("n > 1").select("key")
    ended = at_end.select("key", "conv_id").join(shared, "key", "left_semi")
    ends = single.unionByName(end_digests(ended))
    return nodes.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))


def conversation_trie(conversations: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(rebuilt(conversations), capacity)
