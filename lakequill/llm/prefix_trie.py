"""Prefix trie of conversations: vertical bitmaps in shards, merged by path.

A node is a distinct sequence of first turns (role, text); its path key is the sum
of one 128-bit hash for each (position, turn), so a key of any prefix is a running
sum and needs no earlier text.  Conversations are cut into segments of ``SEGMENT``
turns, and a batch of segments is a shard.  A shard indexes every (position, turn)
to a bitset of its conversations; from the bitset of an entering path, depth first,
the parent's bitset is intersected with the postings of its members' next turns:
that gives the children, their popcounts and the lists of conversations that end
there.  Shards' nodes are added up by path key, at most one row a node and shard.

Sums over subtrees follow paths.  The nodes with one smallest member m are a path
along m, so within a path they are suffix sums; and a path's total belongs to all
of m's nodes above its top, whose keys m itself has.  Rows for that are at most the
turns.  A long conversation is scanned in blocks (positions, sums), and the digest
of an end list goes over chunks of ids in order, in constant memory.

Defined results: a null role or text is empty; rows with a null conversation take
no part; turns are ordered by turn (null first), ties by role, then text; repeated
rows are turns of their own.  Very long texts only count by length and hash.  A
conversation without turns ends at the root.  An empty table has no nodes.  Paths
are told apart by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.scans import running_sum
from ..scale import settle
from .shared import col

SEGMENT, SHARD_ROWS, TURN_BLOCK, ID_BLOCK = 64, 4096, 4096, 1024
_HALF = 0xFFFFFFFF
_LOCAL = "k1 long, k2 long, p1 long, p2 long, depth long, n long, conv long, bytes long, ends array<bigint>"


def ordered_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv, pos from 1, t1, t2, bytes): a hash and the text's length for each turn, in order."""
    said = [F.coalesce(col(c).cast("string"), F.lit("")) for c in (role, text)]
    turns = rows.filter(col(conv).isNotNull()).select(col(conv).cast("long").alias("conv"), col(turn).cast("long").alias("turn"), said[0].alias("role"), said[1].alias("text"))
    turns = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / TURN_BLOCK).cast("long"), F.lit(-(2**62))))
    counted = turns.groupBy("conv", "block", "turn").agg(F.count("*").alias("n"))
    tied = (counted.agg(F.max("n")).first()[0] or 0) > 1
    before = W.partitionBy("conv").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = counted.groupBy("conv", "block").agg(F.sum("n").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
    order = [F.col("turn").asc_nulls_first(), *([F.col("role"), F.col("text")] if tied else [])]  # texts are only sent where they decide
    hashed = turns.select(
        "conv", "block", "turn", *(["role", "text"] if tied else []), F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit(11), "text", "role").alias("t2"),
        F.octet_length("text").cast("long").alias("bytes"),
    )
    local = hashed.withColumn("_at", F.row_number().over(W.partitionBy("conv", "block").orderBy(*order)))
    return local.join(offsets.select("conv", "block", "ahead"), ["conv", "block"]).select("conv", (F.col("_at") + F.col("ahead")).alias("pos"), "t1", "t2", "bytes")


def rebuilt_turns(turns: DataFrame, base: Column, heads: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Turns with the first ``heads`` of each conversation taken from conversation ``base``; both are expressions of ``conv``.

    ``heads`` is at most ``most``.  Also the conversations with their new lengths.
    """
    lengths = turns.groupBy("conv").agg(F.max("pos").alias("own"))
    convs = lengths.select("conv", "own", base.alias("base"), heads.alias("h"))
    first = turns.filter(F.col("pos") <= most).withColumnRenamed("conv", "base")
    reach = lengths.select(F.col("conv").alias("base"), F.least("own", F.lit(most)).alias("reach"))
    convs = convs.join(reach, "base", "left").withColumn("lent", F.least("h", F.coalesce("reach", F.lit(0))))
    convs = settle(convs.select("conv", "base", "lent", (F.col("lent") - F.col("h")).alias("moved"), (F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n_turns")))
    lent = convs.select("conv", "base", "lent").join(first, "base").filter("pos <= lent").select("conv", "pos", "t1", "t2", "bytes")
    rest = turns.filter(F.col("pos") > heads).join(convs.select("conv", "moved"), "conv").select("conv", (F.col("pos") + F.col("moved")).alias("pos"), "t1", "t2", "bytes")
    return lent.union(rest), convs.select("conv", "n_turns")


def segments(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Rows (conv, seg, steps, a, b, last): the turns of a segment with their path hashes, the path key ahead of it, is it the last."""
    step = F.struct("pos", F.xxhash64("pos", "t1", "t2").alias("a"), F.xxhash64(F.lit(13), "pos", "t2", "t1").alias("b"), "bytes")
    empty = convs.filter("n_turns = 0").select("conv", F.lit(0).cast("long").alias("seg"), F.array().cast("array<struct<pos:bigint,a:bigint,b:bigint,bytes:bigint>>").alias("steps"))
    grouped = turns.select("conv", F.floor((F.col("pos") - 1) / SEGMENT).cast("long").alias("seg"), step.alias("s")).groupBy("conv", "seg").agg(F.array_sort(F.collect_list("s")).alias("steps"))
    segs = settle(grouped.union(empty))
    half = lambda c, high: F.aggregate("steps", F.lit(0).cast("long"), lambda t, s: t + (F.shiftrightunsigned(s[c], 32) if high else s[c].bitwiseAND(F.lit(_HALF))))
    halves = {f"{c}{int(high)}": half(c, high) for c in "ab" for high in (False, True)}  # halves of 64 bits, so that sums don't overflow
    along = W.partitionBy("conv").orderBy("seg")
    ahead = along.rowsBetween(W.unboundedPreceding, -1)
    sums = segs.select("conv", "seg", *[v.alias(k) for k, v in halves.items()])
    keys = sums.select("conv", "seg", *[F.coalesce(F.sum(k).over(ahead), F.lit(0)).alias(k) for k in halves], F.lead("seg").over(along).isNull().alias("last"))
    return segs.join(keys, ["conv", "seg"])


def _wrapped(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))


class Shard:
    """Segments of one batch, by conversation, with the path keys of all their turns."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks().sort_by("conv")
        self.conv, self.seg, self.last = (rows[c].to_numpy(zero_copy_only=False) for c in ("conv", "seg", "last"))
        steps = rows["steps"].chunk(0) if rows.num_rows else pa.array([], rows["steps"].type)
        self.sizes = np.asarray(steps.value_lengths().to_numpy(zero_copy_only=False), np.int64)
        flat = steps.flatten()
        self.start = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.bytes = flat.field("bytes").to_numpy(zero_copy_only=False)
        step = [flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in "ab"]
        self.step = step
        self.enter = [_wrapped(rows[f"{c}0"].to_numpy(), rows[f"{c}1"].to_numpy()) for c in "ab"]
        self.key = []
        for values, enter in zip(step, self.enter):  # running sums restart at each row
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
            row = np.repeat(np.arange(len(self.conv)), self.sizes)
            self.key.append(total[1:] - total[self.start][row] + enter[row])

    def keys(self, row: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
        """Path keys after ``q`` turns of the row's segment."""
        at = self.start[row] + q - 1
        return [np.where(q > 0, key[np.maximum(at, 0)] if len(key) else enter[row], enter[row]).view(np.int64) for key, enter in zip(self.key, self.enter)]

    def nodes(self) -> Iterator[pa.RecordBatch]:
        """Depth-first over bitsets: one row for each node of this shard."""
        _, turn = np.unique(np.stack(self.step, 1), axis=0, return_inverse=True) if len(self.bytes) else (None, np.zeros(0, np.int64))
        turn, sizes, start = turn.reshape(-1).tolist(), self.sizes.tolist(), self.start.tolist()
        posting: dict[int, int] = {}  # (position, turn), numbered, to the rows that have it
        stop: dict[int, int] = {}  # after so many turns these rows go no further
        done = 0
        for row, (at, size) in enumerate(zip(start, sizes)):
            bit = 1 << row
            for t in turn[at : at + size]:
                posting[t] = posting.get(t, 0) | bit
            stop[size] = stop.get(size, 0) | bit
            done |= bit if self.last[row] else 0
        out: list[list] = [[], [], [], []]  # row of the smallest member, turns, members, ends

        def seen(bits: int, row: int, q: int) -> None:
            ended = bits & stop.get(q, 0) & done
            for values, value in zip(out, (row, q, bits.bit_count(), self.conv[_bits(ended)].tolist() if ended else None)):
                values.append(value)

        entering: dict[tuple, int] = {}
        for row, path in enumerate(zip(self.seg.tolist(), *[e.tolist() for e in self.enter])):
            entering[path] = entering.get(path, 0) | 1 << row
        for (seg, *_), bits in entering.items():
            if seg == 0:
                seen(bits, (bits & -bits).bit_length() - 1, 0)
            todo = [(bits, 0)]
            while todo:
                bits, q = todo.pop()
                rest = bits & ~stop.get(q, 0)
                while rest:
                    row = (rest & -rest).bit_length() - 1
                    child = bits & posting[turn[start[row] + q]]
                    rest &= ~child
                    seen(child, row, q + 1)
                    if child & (child - 1):
                        todo.append((child, q + 1))
                    else:  # one member left: its other turns are nodes of their own
                        for more in range(q + 2, sizes[row] + 1):
                            seen(child, row, more)
        row, q = np.array(out[0], np.int64), np.array(out[1], np.int64)
        k, p = self.keys(row, q), self.keys(row, np.maximum(q - 1, 0))
        at = np.maximum(self.start[row] + q - 1, 0) if len(self.bytes) else None
        size = np.where(q > 0, self.bytes[at], 0) if at is not None else np.zeros(len(q), np.int64)
        columns = [*k, *p, self.seg[row] * SEGMENT + q, np.array(out[2], np.int64), self.conv[row], size]
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], pa.array(out[3], pa.list_(pa.int64()))], [f.split()[0] for f in _LOCAL.split(", ")])


def _bits(bits: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(bits.bit_length() // 8 + 1, "little"), np.uint8), bitorder="little"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for batch in batches:
        for at in range(0, batch.num_rows, SHARD_ROWS):
            yield pa.Table.from_batches([batch.slice(at, SHARD_ROWS)])


def _local_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _slices(batches):
        yield from Shard(rows).nodes()


def _owed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of paths (top, saved, leaf) for all nodes of their conversation above the top, added up within a slice."""
    for rows in _slices(batches):
        shard = Shard(rows)
        rows = rows.combine_chunks().sort_by("conv")
        top, saved, leaf = (rows[c].to_numpy() for c in ("top", "saved", "leaf"))
        first = np.where(shard.seg == 0, 0, 1)  # the entering node is the last one of the segment before
        n = np.clip(np.minimum(top - 1 - shard.seg * SEGMENT, shard.sizes) - first + 1, 0, None)
        row = np.repeat(np.arange(len(n)), n)
        q = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]
        k1, k2 = shard.keys(row, q)
        names = ["k1", "k2", "saved", "leaves"]
        table = pa.table([k1, k2, saved[row], leaf[row]], names).group_by(["k1", "k2"]).aggregate([("saved", "sum"), ("leaves", "sum")])
        yield from pa.table([table["k1"], table["k2"], table["saved_sum"], table["leaves_sum"]], names).to_batches()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's list, fed chunk by chunk."""
    at, state = None, None
    out: list[list] = [[], [], []]
    for batch in batches:
        for k1, k2, ids in zip(*[batch.column(c).to_pylist() for c in ("k1", "k2", "ids")]):
            if (k1, k2) == at:
                state.update(b",")
            else:
                if at:
                    for values, value in zip(out, (*at, state.hexdigest())):
                        values.append(value)
                at, state = (k1, k2), hashlib.sha256()
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["k1", "k2", "ends"])
        out = [[], [], []]
    if at:
        yield pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([state.hexdigest()], pa.string())], ["k1", "k2", "ends"])


def _end_digests(local: DataFrame) -> DataFrame:
    ids = local.filter(F.size("ends") > 0).select("k1", "k2", F.explode("ends").alias("id"))
    chunks = ids.groupBy("k1", "k2", F.floor(F.col("id") / ID_BLOCK).cast("long").alias("chunk")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    chunks = chunks.select("k1", "k2", "chunk", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    return chunks.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "chunk").mapInArrow(_digests, "k1 long, k2 long, ends string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the prefix trie of turns (conv, pos, t1, t2, bytes) of convs (conv, n_turns)."""
    segs = segments(turns, convs)
    local = settle(segs.mapInArrow(_local_nodes, _LOCAL))
    nodes = local.groupBy("k1", "k2").agg(*[F.min(c).alias(c) for c in ("p1", "p2", "depth", "conv", "bytes")], F.sum("n").alias("n"))
    nodes = settle(nodes.withColumn("worth", (F.col("n") - 1) * F.col("bytes")))
    paths = nodes.groupBy("conv").agg(F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.sum("worth").alias("saved"))
    nodes = running_sum(nodes, ["conv"], "depth", "worth", "upto").join(paths, "conv")
    nodes = settle(nodes.withColumn("below", F.col("saved") - F.col("upto") + F.col("worth")))

    tops = nodes.filter("depth = top and depth > 0")
    kids = tops.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("kids"))
    ends = nodes.filter("depth = bottom").select("k1", "k2", "conv", "top", "saved").join(kids, ["k1", "k2"], "left")
    paths = ends.select("conv", "top", "saved", F.when(F.col("kids").isNull(), 1).otherwise(0).cast("long").alias("leaf"))
    paths = settle(paths)
    owing = segs.join(paths.filter("top > 0 and (saved > 0 or leaf > 0)"), "conv").filter(F.col("seg") * SEGMENT < F.col("top"))
    owed = owing.mapInArrow(_owed, "k1 long, k2 long, saved long, leaves long")

    long = lambda value: F.lit(value).cast("long")
    whole = nodes.join(paths.select("conv", "leaf"), "conv").select(
        "k1", "k2", F.struct("conv", "depth", "n", "top", "bottom", "p1", "p2").alias("node"), long(0).alias("kids"), F.col("below").alias("saved"), F.col("leaf").alias("leaves"), F.lit(None).cast("string").alias("ends"),
    )
    gone = F.lit(None).cast(whole.schema["node"].dataType).alias("node")
    parts = whole.union(kids.select("k1", "k2", gone, "kids", long(0), long(0), F.lit(None).cast("string")))
    parts = parts.union(owed.select("k1", "k2", gone, long(0), "saved", "leaves", F.lit(None).cast("string")))
    parts = parts.union(_end_digests(local).select("k1", "k2", gone, long(0), long(0), long(0), "ends"))
    full = parts.groupBy("k1", "k2").agg(F.max("node").alias("node"), *[F.sum(c).alias(c) for c in ("kids", "saved", "leaves")], F.max("ends").alias("ends")).select("k1", "k2", "node.*", "kids", "saved", "leaves", "ends")
    above = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("over"))
    joined = full.filter("depth = top and depth > 0").join(above, ["p1", "p2"]).select(full.columns + ["over"])
    inside = full.filter("depth <> top or depth = 0").withColumn("over", F.when(F.col("depth") > 0, F.col("conv")))
    none = hashlib.sha256(b"").hexdigest()
    return inside.union(joined).select(
        F.col("conv").alias("conv_id"), "depth", F.col("over").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        (F.col("kids") + (F.col("depth") < F.col("bottom")).cast("long")).alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(none)).alias("ends_sha256"), F.struct("k1", "k2").alias("path"), F.when(F.col("depth") > 0, F.struct("p1", "p2")).alias("parent_path"),
    )


def conversation_trie(conversations: DataFrame, base: Column | None = None, heads: Column | None = None, most: int = 0) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text), rebuilt first if ``heads`` and ``base`` (of ``conv``) are given."""
    turns = settle(ordered_turns(conversations))
    if heads is None:
        return trie(turns, turns.groupBy("conv").agg(F.max("pos").alias("n_turns")))
    return trie(*rebuilt_turns(turns, base, heads, most))
