"""The trie of conversation prefixes, with totals of its subtrees by time-forward processing.

A node is a sequence of first turns. It is named by sums of hashes of (position, turn), so the names
along a conversation are running sums and a very long conversation is summed in blocks. Totals go up
the tree by time-forward processing: nodes are sorted by level, deepest first, and each sends its totals to
its parent through a priority queue that is ordered like the nodes and spills to disk.

The tree is cut into shards so that no task holds too much of it. Nodes with over `share` members form the
trunk; every member has a row on each of its nodes, so the trunk has at most (rows / share) of them, 65,536
by the choice of `share`. What hangs from the trunk are shards of at most `share` conversations each, dealt over the
cluster. Shard roots send their totals to the trunk as grouped sums, and the trunk is processed last, in the same way.
Nodes of a single conversation need no queue: they have one leaf and save nothing.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

TRUNK = 1 << 16
LEAST_SHARE = 1024
BLOCK = 4096
MASK = (1 << 48) - 1
NODE, PARENT = ["x", "y"], ["px", "py"]
EMPTY = hashlib.sha256(b"").hexdigest()


class Messages:
    """A priority queue of tuples of five integers; beyond `limit` of them in memory, a sorted run goes to disk."""

    RECORD = struct.Struct("<5q")

    def __init__(self, limit: int = 1 << 18):
        self.limit, self.heap, self.heads, self.runs = limit, [], [], []

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.limit:
            run = tempfile.TemporaryFile()
            self.heap.sort()
            for entry in self.heap:
                run.write(self.RECORD.pack(*entry))
            run.seek(0)
            self.heap = []
            self.runs.append(run)
            self._advance(len(self.runs) - 1)

    def _advance(self, k: int) -> None:
        data = self.runs[k].read(self.RECORD.size)
        if data:
            heapq.heappush(self.heads, (self.RECORD.unpack(data), k))
        else:
            self.runs[k].close()

    def take(self, key: tuple):
        """The messages whose first three numbers are the key; none smaller is left."""
        while True:
            first = self.heap[0] if self.heap else None
            spilled = self.heads[0][0] if self.heads else None
            if spilled is not None and (first is None or spilled < first):
                if spilled[:3] != key:
                    return
                _, k = heapq.heappop(self.heads)
                self._advance(k)
                yield spilled
            elif first is not None and first[:3] == key:
                yield heapq.heappop(self.heap)
            else:
                return


def time_forward(limit: int = 1 << 18):
    """A function over Arrow batches sorted by shard, level (deepest first) and node.

    Each row has the shard's root (rx, ry), the node (x, y), its parent (px, py), depth, and what it adds itself
    (leaves, saved). It gives x, y, px, py, n_leaves, saved_tokens, is_root. A root sends nothing within the shard.
    """

    def run(batches):
        queue, shard = Messages(limit), None
        for batch in batches:
            out = []
            for rx, ry, x, y, px, py, depth, leaves, saved in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != (rx, ry):
                    shard, queue = (rx, ry), Messages(limit)
                for message in queue.take((-depth, x, y)):
                    leaves, saved = leaves + message[3], saved + message[4]
                root = (x, y) == shard
                if not root:
                    queue.push((1 - depth, px, py, leaves, saved))
                out.append((x, y, px, py, leaves, saved, root))
            columns = list(zip(*out)) or [()] * 7
            kinds = [pa.int64()] * 6 + [pa.bool_()]
            names = ["x", "y", "px", "py", "n_leaves", "saved_tokens", "is_root"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, range, at, digest, n_bytes: turns in the order of conversation and turn, `at` counting on in a range.

    A null turn comes first; turns of one number are ordered by role and text. Rows without a conv_id are left out.
    """
    held = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = ["conv_id", "turn", "role", "text"]
    placed = held.repartitionByRange(*order).sortWithinPartitions(*order)
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    placed = placed.select(
        "conv_id", F.monotonically_increasing_id().alias("at"), F.unhex(F.left(digest, F.lit(32))).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")
    )
    return placed.withColumn("range", F.shiftright("at", 33))


def rebuilt(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations (conv_id, length) and their turns (conv_id, pos, length, digest, n_bytes).

    A conversation c begins with the first h turns of c - c % group, and goes on with its own after its first h;
    h is crc32(c) % most.
    """
    placed = stored(numbered_turns(turns))
    parts = placed.groupBy("conv_id", "range").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored(parts.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))))
    convs = parts.groupBy("conv_id").agg(F.sum("rows").alias("own"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = convs.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("leader"))
    led = convs.select(F.col("conv_id").alias("leader"), F.col("own").alias("leads"))
    taken = F.least("h", F.coalesce("leads", F.lit(0)))
    convs = convs.join(led, "leader", "left").withColumn("taken", taken)
    convs = stored(convs.withColumn("length", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))

    i = F.col("at") - F.col("first") + F.col("before") + 1
    known = parts.join(convs, "conv_id").drop("rows", "own")
    turn = stored(placed.join(known, ["conv_id", "range"]).withColumn("i", i))
    kept = ["length", "digest", "n_bytes"]
    own = turn.filter("i > h").select("conv_id", (F.col("taken") + F.col("i") - F.col("h")).alias("pos"), *kept)
    heads = turn.filter((F.col("i") < most) & (F.col("conv_id") % group == 0))
    heads = heads.select(F.col("conv_id").alias("leader"), "i", "digest", "n_bytes")
    lent = heads.join(convs.select("conv_id", "leader", "taken", "length"), "leader").filter("i <= taken")
    return convs.select("conv_id", "length"), lent.select("conv_id", F.col("i").alias("pos"), *kept).union(own)


def paths(turns: DataFrame) -> DataFrame:
    """The turns of `rebuilt` with their node (x, y), its parent (px, py), and whether they are the last."""
    name = F.sha2(F.concat(F.concat(F.col("pos").cast("string"), F.lit(":")).cast("binary"), "digest"), 256)
    lane = lambda k: F.conv(F.substring("name", 12 * k + 1, 12), 16, 10).cast("long")
    named = turns.withColumn("name", name).select(
        "conv_id", "pos", "length", "n_bytes", lane(0).alias("a"), lane(1).alias("b"), F.floor((F.col("pos") - 1) / BLOCK).alias("block")
    )
    up_to = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    inside = named.withColumns({"sa": F.sum("a").over(up_to), "sb": F.sum("b").over(up_to)})
    whole = F.col("pos") % BLOCK == 0
    ends = inside.filter(whole).select("conv_id", F.col("block"), "sa", "sb")
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: (F.sum(F.col(c).cast("decimal(38,0)")).over(earlier) % (MASK + 1)).cast("long")
    ends = ends.select("conv_id", (F.col("block") + 1).alias("block"), total("sa").alias("ba"), total("sb").alias("bb"))
    joined = inside.join(ends, ["conv_id", "block"], "left")
    node = lambda s, b: (F.col(s) + F.coalesce(b, F.lit(0))).bitwiseAND(F.lit(MASK))
    above = lambda s, t: (F.col(s) - F.col(t)).bitwiseAND(F.lit(MASK))
    joined = joined.select("conv_id", "pos", "length", "n_bytes", "a", "b", node("sa", "ba").alias("x"), node("sb", "bb").alias("y"))
    return joined.select(
        "conv_id", "pos", "n_bytes", *NODE, above("x", "a").alias("px"), above("y", "b").alias("py"), (F.col("pos") == F.col("length")).alias("last")
    )


def _id_digests(ends: DataFrame) -> DataFrame:
    """x, y, ends_sha256 of the rows (x, y, conv_id): SHA-256 of the ids in ascending order, comma-joined.

    Ids are joined to pieces where a range partitioning puts them, so one node's ids may lie in many tasks;
    the task that makes the digest reads a few long pieces, one at a time.
    """

    def joined(batches):
        node, first, ids, size = None, None, [], 0
        for batch in batches:
            out = []
            for x, y, c in zip(*(col.to_pylist() for col in batch.columns)):
                if node != (x, y) or size > 1 << 16:
                    if ids:
                        out.append((*node, first, ",".join(ids)))
                    node, first, ids, size = (x, y), c, [], 0
                ids.append(str(c))
                size += len(ids[-1])
            yield _pieces(out)
        if ids:
            yield _pieces([(*node, first, ",".join(ids))])

    def digests(batches):
        node, state = None, None
        for batch in batches:
            out = []
            for x, y, _, text in zip(*(col.to_pylist() for col in batch.columns)):
                if node != (x, y):
                    if node:
                        out.append((*node, 0, state.hexdigest()))
                    node, state = (x, y), hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield _pieces(out)
        if node:
            yield _pieces([(*node, 0, state.hexdigest())])

    def _pieces(rows):
        columns = list(zip(*rows)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["x", "y", "first", "text"])

    schema = "x long, y long, first long, text string"
    order = ["x", "y", "conv_id"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(joined, schema)
    pieces = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return pieces.mapInArrow(digests, schema).select(*NODE, F.col("text").alias("ends_sha256"))


def _sorted(nodes: DataFrame) -> DataFrame:
    ordered = nodes.sortWithinPartitions("rx", "ry", F.desc("depth"), *NODE)
    return ordered.select("rx", "ry", *NODE, *PARENT, "depth", "leaves", "saved")


TOTALS = "x long, y long, px long, py long, n_leaves long, saved_tokens long, is_root boolean"


def _own(singles: Column) -> list[Column]:
    """What a node adds: a leaf where it has no children, else its children of a single conversation."""
    leaves = F.when(F.col("n_children") == 0, F.lit(1)).otherwise(singles)
    return [leaves.cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved")]


def prefix_trie(turns: DataFrame, share: int | None = None, limit: int = 1 << 18) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node.

    `turns` has conv_id, turn, role, text. Null roles and texts are empty, a null turn comes first, turns of one
    number are ordered by role and text, and repeated rows are turns of their own. Rows without a conv_id are
    left out. Texts and conversations may be of any length. An empty table has no node, not even a root. `share`
    is the number of members beyond which a node belongs to the trunk, and `limit` that of messages in memory.
    """
    convs, steps = rebuilt(turns)
    steps = stored(paths(steps))
    share = share or max(LEAST_SHARE, -(-steps.count() // TRUNK))

    nodes = steps.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"),
        F.min("pos").alias("depth"),
        F.count("*").alias("n_convs"),
        *(F.min(c).alias(c) for c in (*PARENT, "n_bytes")),
    )
    zero = F.lit(0).cast("long")
    root = convs.groupBy().agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(zero.alias("x"), zero.alias("y"), "conv_id", zero.alias("depth"), "n_convs", zero.alias("px"), zero.alias("py"), zero.alias("n_bytes"))
    nodes = stored(nodes.unionByName(root))
    below = nodes.filter("depth > 0")
    children = below.groupBy(*PARENT).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("singles"))
    children = children.withColumnsRenamed({"px": "x", "py": "y"})
    many = nodes.filter("depth = 0 OR n_convs > 1").join(children, NODE, "left").fillna(0, ["n_children", "singles"])
    in_trunk = (F.col("depth") == 0) | (F.col("n_convs") > share)
    many = stored(many.withColumn("trunk", in_trunk))
    trunk, branches = many.filter("trunk"), many.filter("NOT trunk")
    trunk_names = F.broadcast(trunk.select(*NODE))  # at most TRUNK + 1 rows

    # The shard of a node: the first node below the trunk on the way of its smallest member.
    tops = steps.join(trunk_names, NODE, "left_semi").groupBy("conv_id").agg(F.max("pos").alias("top"))
    firsts = branches.select("conv_id").distinct().join(tops, "conv_id", "left")
    firsts = firsts.select("conv_id", (F.coalesce("top", zero) + 1).alias("pos"))
    firsts = firsts.join(steps, ["conv_id", "pos"]).select("conv_id", F.col("x").alias("rx"), F.col("y").alias("ry"))
    sharded = branches.join(firsts, "conv_id").select("rx", "ry", *NODE, *PARENT, "depth", *_own(F.col("singles")))
    in_shards = stored(_sorted(sharded.repartition("rx", "ry")).mapInArrow(time_forward(limit), TOTALS))

    sent = in_shards.filter("is_root").groupBy(*PARENT).agg(F.sum("n_leaves").alias("more"), F.sum("saved_tokens").alias("more_saved"))
    sent = sent.withColumnsRenamed({"px": "x", "py": "y"})
    top = trunk.join(sent, NODE, "left").fillna(0, ["more", "more_saved"])
    leaves, saved = _own(F.col("singles") + F.col("more"))
    top = top.select(zero.alias("rx"), zero.alias("ry"), *NODE, *PARENT, "depth", leaves, (saved + F.col("more_saved")).alias("saved"))
    in_trunk = stored(_sorted(top.repartition(1)).mapInArrow(time_forward(limit), TOTALS))

    totals = in_shards.union(in_trunk).select(*NODE, "n_leaves", "saved_tokens")
    facts = ["conv_id", "depth", "n_convs"]
    counted = many.join(totals, NODE).select(*NODE, *PARENT, *facts, "n_children", "n_leaves", "saved_tokens")
    single = below.filter("n_convs = 1").join(children, NODE, "left").select(
        *NODE, *PARENT, *facts, F.coalesce("n_children", zero).alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens")
    )
    ends = steps.filter("last").select(*NODE, "conv_id").union(convs.filter("length = 0").select(zero.alias("x"), zero.alias("y"), "conv_id"))
    full = stored(counted.union(single).join(_id_digests(ends), NODE, "left").fillna(EMPTY, ["ends_sha256"]))

    def parents(of: DataFrame) -> DataFrame:
        return of.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"))

    child = full.filter("depth > 0")
    from_trunk = child.join(F.broadcast(parents(trunk)), PARENT)
    others = child.join(trunk_names.withColumnsRenamed({"x": "px", "y": "py"}), PARENT, "left_anti")
    others = others.join(parents(nodes.filter(~((F.col("depth") == 0) | (F.col("n_convs") > share)))), PARENT)
    alone = full.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    out = alone.unionByName(from_trunk).unionByName(others)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
