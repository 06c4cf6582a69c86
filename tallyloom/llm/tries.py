"""A prefix trie over conversations, built from sorted matrices of turn ids.

Turns become two 63-bit ids by their role and text, conversations rows of such ids.
Rows are dealt out by range, in the order of their ids and then their conversation,
so rows with a common beginning lie side by side, and many equal rows still fall
into several shards. A shard sorts its rows with one ``lexsort`` over a padded matrix of
``WIDTH`` turns (rows that go on come back for the next ``WIDTH``, so padding stays
bounded), takes differences between neighbouring rows, and accumulates them along
the row: where the result is set, a new node starts. ``reduceat`` over those starts
gives members and smallest ids of every depth.

A node can lie in several shards only if it is on the path of a shard's first or last
row. Each shard is told the last row before it and the first row after it. So it
knows which of its nodes began before it and which go on after it, counts a
node as new, and as a leaf, in one shard only, and everything it emits for boundary
nodes adds up. All other nodes are complete where they were made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyloom.llm.common import written

#: Turns of a row that one matrix holds.
WIDTH = 16
#: Turns of a shard at most, on average, and at least where there are fewer shards than tasks that can run.
SHARD_TURNS = 500_000
LEAST_TURNS = 4096
#: Members in one row on the way to a boundary node's digest.
ENDS = 50_000
#: Boundary nodes whose smallest members are broadcast at most, about 60 bytes each.
BROADCAST_NODES = 500_000
#: Turns that a conversation can share with that of its group.
SHARED = 9
GROUP = 5
EMPTY = hashlib.sha256(b"").hexdigest()

NODE = (
    "key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "spent long, new_bytes long, ends string, shard long, part int, digest string"
)
_FIELDS = pa.schema([
    ("key", pa.binary()), ("parent_key", pa.binary()), *((n, pa.int64()) for n in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "spent", "new_bytes")),
    ("ends", pa.string()), ("shard", pa.int64()), ("part", pa.int32()), ("digest", pa.string()),
])


def conversation_rows(turns: DataFrame) -> DataFrame:
    """``(base, conv_id, turns)``: every conversation's turns in order, as number, two ids and the bytes of the text.

    Turns are ordered by ``turn``, null first, and turns of equal number by their
    ids. Null role and text are empty; turns of no conversation (null ``conv_id``) are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    high, low = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), role, text), 1) for seed in (1, 2))
    given = turns.filter("conv_id is not null").select(
        (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), "conv_id",
        F.struct(F.col("turn").alias("turn"), high.alias("high"), low.alias("low"), F.octet_length(text).alias("size")).alias("t"),
    )
    own = given.repartition("base").groupBy("base", "conv_id").agg(F.array_sort(F.collect_list("t"), _null_first).alias("turns"))
    return own


def _null_first(a, b):
    """Order of turns, for ``array_sort``: by number with null first, then by ids."""
    by_ids = F.when(a["high"] < b["high"], -1).when(a["high"] > b["high"], 1).when(a["low"] < b["low"], -1).when(a["low"] > b["low"], 1).otherwise(0)
    return (
        F.when(a["turn"].isNull() & b["turn"].isNull(), by_ids).when(a["turn"].isNull(), -1).when(b["turn"].isNull(), 1)
        .when(a["turn"] < b["turn"], -1).when(a["turn"] > b["turn"], 1).otherwise(by_ids)
    )


def rebuilt(rows: DataFrame) -> DataFrame:
    """``(conv_id, path, sizes)`` with the first turns replaced by those of the group's first conversation.

    The number of turns replaced depends on the id alone; a group's rows are where
    they were gathered, so nothing is shuffled again.
    """
    share = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    first = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, SHARED - 1))).over(W.partitionBy("base"))
    lead = F.coalesce(F.slice("first", 1, F.col("share")), F.slice("turns", 1, 0))
    own = F.slice("turns", F.col("share") + 1, F.size("turns"))
    whole = rows.withColumns({"first": first, "share": share}).select("conv_id", F.concat(lead, own).alias("t"))
    return whole.select("conv_id", F.flatten(F.transform("t", lambda t: F.array(t["high"], t["low"]))).alias("path"), F.transform("t", lambda t: t["size"]).alias("sizes"))


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Turns that two rows of ids begin with alike."""
    n = min(len(a), len(b)) // 2 * 2
    differ = np.flatnonzero(a[:n] != b[:n])
    return (int(differ[0]) if len(differ) else n) // 2


class _Shard:
    """The nodes of one shard's rows, in arrays; a node's number is higher than its parent's."""

    def __init__(self, convs: np.ndarray, paths: np.ndarray, path_at: np.ndarray, sizes: np.ndarray):
        self.convs = convs
        lengths = np.diff(path_at) // 2
        row = np.argsort(convs, kind="stable")
        group = np.zeros(len(convs), dtype=np.int64)
        node = np.zeros(len(convs), dtype=np.int64)
        self.levels = [(0, 1)]
        parent, count, least, byte = [np.full(1, -1)], [np.array([len(convs)])], [np.array([convs.min()])], [np.zeros(1, dtype=np.int64)]
        total, depth = 1, 0
        self.last_node = np.zeros(len(convs), dtype=np.int64)
        while len(row):
            row = row[lengths[row] > depth]
            if not len(row):
                break
            width = int(min(WIDTH, lengths[row].max() - depth))
            place = path_at[row][:, None] + 2 * (depth + np.arange(width))
            there = lengths[row][:, None] > depth + np.arange(width)
            place = np.where(there, place, 0)
            high, low = np.where(there, paths[place], -1), np.where(there, paths[place + 1], -1)
            keys = [convs[row]]
            for c in range(width - 1, -1, -1):
                keys += [low[:, c], high[:, c]]
            order = np.lexsort([*keys, group[row]])
            row, high, low, there = row[order], high[order], low[order], there[order]
            before = np.ones((len(row), width), dtype=bool)
            before[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
            before[1:, 0] |= group[row[1:]] != group[row[:-1]]
            starts = np.logical_or.accumulate(before, axis=1)
            for c in range(width):
                inside = np.flatnonzero(there[:, c])
                if not len(inside):
                    break
                members, begin = row[inside], np.flatnonzero(starts[inside, c])
                n = len(begin)
                parent.append(node[members[begin]])
                count.append(np.add.reduceat(np.ones(len(members), dtype=np.int64), begin))
                least.append(np.minimum.reduceat(convs[members], begin))
                byte.append(sizes[path_at[members[begin]] // 2 + depth + c].astype(np.int64))
                node[members] = total + np.repeat(np.arange(n), np.diff(begin, append=len(members)))
                self.last_node[members] = node[members]
                self.levels.append((total, total + n))
                total += n
            group[row] = node[row]
            depth += width
        self.parent, self.count, self.least, self.byte = map(np.concatenate, (parent, count, least, byte))
        self.depth = np.repeat(np.arange(len(self.levels)), [b - a for a, b in self.levels])
        ends = np.lexsort([convs, self.last_node])
        self.enders, self.ends_at = convs[ends], np.searchsorted(self.last_node[ends], np.arange(total + 1))

    def chain(self, row: int) -> list[int]:
        """The nodes of a row, the root first."""
        out, at = [], int(self.last_node[row])
        while at >= 0:
            out.append(at)
            at = int(self.parent[at])
        return out[::-1]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Each value with all values below it."""
        out = values.copy()
        for a, b in self.levels[:0:-1]:
            np.add.at(out, self.parent[a:b], out[a:b])
        return out


def _shard_nodes(shard: int, convs: np.ndarray, paths: np.ndarray, path_at: np.ndarray, sizes: np.ndarray, before, after) -> Iterator[pa.RecordBatch]:
    """The nodes of a shard: whole ones with their digest, and the parts of boundary nodes with their key."""
    t = _Shard(convs, paths, path_at, sizes)
    n = len(t.parent)
    lines = [paths[path_at[i]:path_at[i + 1]] for i in (0, len(convs) - 1)]
    chains = [t.chain(0), t.chain(len(convs) - 1)]
    shared = [0 if other is None else _common(line, other) for line, other in zip(lines, (before, after))]
    new, last = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
    if before is not None:
        new[chains[0][:shared[0] + 1]] = False
    if after is not None:
        last[chains[1][:shared[1] + 1]] = False
    keys: dict[int, bytes] = {}
    for chain, line, depth in zip(chains, lines, shared):
        digest = hashlib.md5()
        for d, node in enumerate(chain[:depth + 1]):
            digest.update(line[2 * d - 2:2 * d].tobytes() if d else b"")
            keys[node] = digest.digest()
    inner = np.bincount(t.parent[1:], minlength=n) if n > 1 else np.zeros(n, dtype=np.int64)
    children = np.bincount(t.parent[1:], weights=new[1:], minlength=n).astype(np.int64) if n > 1 else inner
    leaves = t.sums(((inner == 0) & last).astype(np.int64))
    spent, bytes_new = t.sums(t.count * t.byte), t.sums(np.where(new, t.byte, 0))
    parent_conv = np.where(t.parent >= 0, t.least[t.parent], 0)
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), _FIELDS)], schema=_FIELDS)
        rows.clear()
        return out

    values = [v.tolist() for v in (t.least, t.depth, parent_conv, t.count, children, leaves, spent, bytes_new)]
    for i, (least, depth, above, count, kids, below, s, b) in enumerate(zip(*values)):
        key, up = keys.get(i), keys.get(int(t.parent[i])) if i else None
        ends = t.enders[t.ends_at[i]:t.ends_at[i + 1]]
        if key is None:
            digest = hashlib.sha256(",".join(map(str, ends.tolist())).encode()).hexdigest() if len(ends) else EMPTY
            rows.append((None, up, least, depth, above if up is None else None, count, kids, below, s, b, None, shard, 0, digest))
        else:
            for part in range(0, max(1, len(ends)), ENDS):
                text = ",".join(map(str, ends[part:part + ENDS].tolist())) or None
                rows.append((key, up, least, depth, None, *((count, kids, below, s, b) if not part else (0, 0, 0, 0, 0)), text, shard, part // ENDS, None))
        if len(rows) >= 20_000:
            yield batch()
    if rows:
        yield batch()


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the shards of a partition, each of which is held alone; rows come sorted by shard and kind."""
    held: list[pa.RecordBatch] = []

    def nodes() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        kind = table.column("kind").to_numpy()
        beside = {k: np.array(p, dtype=np.int64) for k, p in zip(kind, table.column("path").slice(0, 2).to_pylist()) if k != 2}
        own = table.filter(pa.array(kind == 2)).combine_chunks()
        path, size = (own.column(c).chunk(0) for c in ("path", "sizes"))
        yield from _shard_nodes(
            table.column("shard")[0].as_py(), own.column("conv_id").to_numpy(), path.flatten().to_numpy(zero_copy_only=False),
            path.offsets.to_numpy() - path.offsets[0].as_py(), size.flatten().to_numpy(zero_copy_only=False), beside.get(0), beside.get(1),
        )

    for batch in batches:
        shard = batch.column("shard").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if held and held[-1].column("shard")[0].as_py() != shard[a]:
                yield from nodes()
            held.append(batch.slice(a, b - a))
    if held:
        yield from nodes()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each boundary node's members, whose parts come in order; only the digest is held."""
    key, sha, first, done = None, None, True, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["key"] != key:
                if key is not None:
                    done.append((key, sha.hexdigest()))
                key, sha, first = r["key"], hashlib.sha256(), True
            if r["ends"]:
                sha.update((("" if first else ",") + r["ends"]).encode())
                first = False
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*done), (pa.binary(), pa.string()))], names=["key", "digest"])
            done = []
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])], names=["key", "digest"])


def prefix_trie(rows: DataFrame, shard_turns: int = SHARD_TURNS, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """Nodes of the trie of ``(conv_id, path, sizes)``.

    Returns ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256)``: the smallest member, that of the parent, members, children,
    childless nodes below and the bytes that sharing saves below (the node
    included), and the digest of the members that end there. Rows without turns are
    members of the root; no rows make no nodes; rows of equal ``conv_id`` count each for itself.
    A conversation is one row, so its turns (20 bytes each) are held by one task.
    """
    spark = rows.sparkSession
    rows = written(rows.select("conv_id", "path", "sizes"), "rebuilt")
    turns = rows.agg(F.sum(F.size("sizes") + 1)).first()[0]
    if not turns:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = max(-(-turns // shard_turns), min(tasks, -(-turns // LEAST_TURNS)))
    sorted_rows = rows.repartitionByRange(parts, "path", "conv_id").withColumn("shard", F.spark_partition_id().cast("long"))
    dealt = written(sorted_rows, "ranged")
    edges = dealt.groupBy("shard").agg(F.min(F.struct("path", "conv_id")).alias("first"), F.max(F.struct("path", "conv_id")).alias("last"))
    beside = W.orderBy("shard")  # one row for each shard
    near = edges.select("shard", F.lag("last.path").over(beside).alias("before"), F.lead("first.path").over(beside).alias("after"))
    marks = near.select("shard", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("before").alias("path")), F.struct(F.lit(1).alias("kind"), F.col("after").alias("path")))).alias("m"))
    none = F.lit(None)
    marks = marks.filter("m.path is not null").select("shard", "m.kind", none.cast("long").alias("conv_id"), "m.path", none.cast("array<int>").alias("sizes"))
    every = marks.union(dealt.select("shard", F.lit(2).alias("kind"), "conv_id", "path", "sizes"))
    # sorted rows: the first and last of a shard are those of its range
    nodes = every.repartition(parts, "shard").sortWithinPartitions("shard", "kind", "path", "conv_id").mapInArrow(_shards, NODE)
    nodes = written(nodes, "nodes")
    edge = nodes.filter("key is not null")
    added = edge.groupBy("key").agg(
        F.min("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "spent", "new_bytes")],
    )
    digests = edge.filter("ends is not null").select("key", "shard", "part", "ends").repartition("key").sortWithinPartitions("key", "shard", "part") \
        .mapInArrow(_digests, "key binary, digest string")
    added = written(added.join(digests, "key", "left").withColumn("digest", F.coalesce("digest", F.lit(EMPTY))), "boundary")
    tops = added.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("top"))
    if added.count() <= broadcast_nodes:
        tops = F.broadcast(tops)
    same = ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "spent", "new_bytes", "digest")
    whole = nodes.filter("key is null")
    settled = whole.filter("parent_key is null").select(*same, "parent_conv_id")
    open_ = whole.filter("parent_key is not null").select(*same, "parent_key").union(added.select(*same, "parent_key"))
    joined = open_.join(tops, "parent_key", "left").select(*same, F.col("top").alias("parent_conv_id"))
    return settled.union(joined).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("spent") - F.col("new_bytes")).alias("saved_tokens"), F.col("digest").alias("ends_sha256"),
    )
