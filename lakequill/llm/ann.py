"""Approximate nearest neighbours: random-projection trees, one queue for all of them.

Trees are fitted on a bounded, documented sample (``fit_rows``): a node splits at
the median of the projections on the difference of two of its vectors.  Every
vector is then sent down every tree.  A query walks all trees through one shared
priority queue, ordered by how far it lies on the wrong side of the splits, and
takes leaves until they hold its budget of rows; the vectors of these leaves are
ranked exactly by cosine in double precision.

The budget is a share of all rows, the least that finds ``recall`` of the true
neighbours of held-out sample vectors.  Data with clusters need little of the
table; data without any structure need much of it (README has figures).

Leaves are cut into blocks of ``block_rows`` rows by hash.  A task holds one
block at a time and streams the queries that visit it, so neither a hot leaf nor
a popular one has to fit into memory.  Equal vectors are indexed once, with their
``k + 1`` smallest ids: no more of them can be among ``k`` neighbours.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, rows with a null id, and vectors not of the most common length take
no part, neither as query nor as candidate.  Ties go to the smaller id.  With
fewer than ``k`` candidates all are returned.  A query's own id is never its
candidate, also where rows repeat it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scale import settle
from .cells import groups
from .shared import col
from .vectors import matrix, unit, usable

TREES, LEAF_ROWS, FIT_ROWS, RECALL, SEED = 12, 256, 16_384, 0.97, 31
_SHARES = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 2.5, 3.0, 4.0, 6.0, 8.0, 12.0)


@dataclass
class Trees:
    """Complete binary trees of one depth: direction and median of every inner place."""

    direction: np.ndarray  # trees, places, components
    median: np.ndarray
    depth: int

    @property
    def leaves(self) -> int:
        return 2**self.depth

    def place(self, u: np.ndarray) -> np.ndarray:
        """Leaf of every vector in every tree."""
        out = np.empty((len(u), len(self.median)), np.int64)
        for t, (direction, median) in enumerate(zip(self.direction, self.median)):
            at = np.zeros(len(u), np.int64)
            for _ in range(self.depth):
                right = np.einsum("ij,ij->i", u, direction[at]) >= median[at]
                at = 2 * at + 1 + right
            out[:, t] = at - (self.leaves - 1)
        return out

    def walk(self, u: np.ndarray) -> Iterator[tuple[int, int]]:
        """(tree, leaf) for one vector, the most promising first, over all trees."""
        gap = np.einsum("tpc,c->tp", self.direction, u) - self.median
        side, gap = (gap >= 0).tolist(), np.abs(gap).tolist()
        inner = self.leaves - 1
        queue = [(0.0, t, 0) for t in range(len(side))]
        while queue:
            far, t, at = heapq.heappop(queue)
            while at < inner:  # down on the near side; the other waits in the queue
                near = 2 * at + 1 + side[t][at]
                heapq.heappush(queue, (max(far, gap[t][at]), t, 4 * at + 3 - near))
                at = near
            yield t, at - inner


def grow(sample: np.ndarray, depth: int, trees: int = TREES, seed: int = SEED) -> Trees:
    rng = np.random.default_rng(seed)
    width = sample.shape[1]
    direction, median = np.zeros((trees, 2**depth - 1, width)), np.zeros((trees, 2**depth - 1))
    for t in range(trees):
        rows = {0: np.arange(len(sample))}
        for at in range(2**depth - 1):
            mine = rows.pop(at)
            line = rng.standard_normal(width)
            if len(mine) > 1:
                a, b = sample[rng.choice(mine, 2, replace=False)]
                if np.abs(a - b).max() > 1e-9:
                    line = a - b
            line /= np.sqrt(line @ line)
            along = sample[mine] @ line
            cut = float(np.median(along)) if len(mine) else 0.0
            direction[t, at], median[t, at] = line, cut
            rows[2 * at + 1], rows[2 * at + 2] = mine[along < cut], mine[along >= cut]
    return Trees(direction, median, depth)


def calibrate(trees: Trees, sample: np.ndarray, k: int, recall: float, tries: int = 100) -> float:
    """Least share of the rows, counted once per tree, that finds ``recall`` of the k nearest in the sample."""
    asked = np.unique(np.linspace(0, len(sample) - 1, tries).astype(int))
    leaf = trees.place(sample)
    members = [[np.flatnonzero(leaf[:, t] == x) for x in range(trees.leaves)] for t in range(leaf.shape[1])]
    near = sample[asked] @ sample.T
    near[np.arange(len(asked)), asked] = -2
    found, total = np.zeros(len(_SHARES)), 0
    for row, true in zip(asked, np.argsort(-near, axis=1)[:, : min(k, len(sample) - 1)]):
        wanted, seen, step = set(true.tolist()), 0, 0
        total += len(wanted)
        got: set[int] = set()
        for t, x in trees.walk(sample[row]):
            while step < len(_SHARES) and seen >= _SHARES[step] * len(sample):
                found[step] += len(got)
                step += 1
            if step == len(_SHARES):
                break
            seen += len(members[t][x])
            got |= wanted & set(members[t][x].tolist())
        found[step:] += len(got)
    good = np.flatnonzero(found >= recall * total)
    return _SHARES[good[0]] if len(good) else _SHARES[-1]


def _best(asks: np.ndarray, u: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the best ``k`` of u for each query, best first; their exact cosines; how many there are for each query."""
    few, spare = min(k, len(u)), min(k + 3, len(u))
    rough = asks @ u.T
    near = np.argpartition(-rough, spare - 1, axis=1)[:, :spare]
    exact = np.clip((u[near] * asks[:, None, :]).sum(axis=2), -1.0, 1.0)
    order = np.lexsort((first[near], -exact), axis=1)[:, :few]
    best, scores = np.take_along_axis(near, order, 1), np.take_along_axis(exact, order, 1)
    # where more rows tie with the last one than there is room for, all of them are looked at
    for q in np.flatnonzero((rough >= scores[:, -1:] - 1e-9).sum(axis=1) > spare):
        some = np.flatnonzero(rough[q] >= scores[q, -1] - 1e-9)
        own = np.clip((u[some] * asks[q]).sum(axis=1), -1.0, 1.0)
        line = np.lexsort((first[some], -own))[:few]
        best[q], scores[q] = some[line], own[line]
    return best.ravel(), scores.ravel(), np.full(len(asks), few)


def _ranker(k: int):
    """Best ``k`` vectors of one block for each query that visits it."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, ["cell", "part", "kind", "slice"]):
            if not rows["kind"][0].as_py():
                held, u, first = rows, unit(matrix(rows["v"])), rows["first"].to_numpy()
                where = rows["cell"][0].as_py(), rows["part"][0].as_py()
                continue
            if not rows.num_rows or where != (rows["cell"][0].as_py(), rows["part"][0].as_py()):
                continue
            asks = unit(matrix(rows["v"]))
            parts = [_best(asks[at : at + 512], u, first, k) for at in range(0, len(asks), 512)]
            best, scores, counts = (np.concatenate(x) for x in zip(*parts))
            pick = held.take(pa.array(best))
            asked = rows.take(pa.array(np.repeat(np.arange(len(counts)), counts)))
            yield pa.RecordBatch.from_arrays(
                [x.combine_chunks() for x in (asked["h1"], asked["h2"], pick["h1"], pick["h2"])] + [pa.array(scores), pick["ids"].combine_chunks()],
                ["q1", "q2", "h1", "h2", "score", "ids"],
            )

    return rank


def nearest(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", *,
    k: int = 5, trees: int = TREES, leaf_rows: int = LEAF_ROWS, fit_rows: int = FIT_ROWS, recall: float = RECALL, block_rows: int = 4096,
) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest found for every row where ``is_query`` holds."""
    spark = vectors.sparkSession
    rows = vectors.select(col(id_col).alias("id"), col(vector_col).alias("v"), is_query.alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias(id_col), F.lit(0.0).alias("score"))
    rows = rows.filter(F.size("v") == sizes["size"]).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(5), "v")})
    same = W.partitionBy("h1", "h2").orderBy("id")
    lowest = rows.select("h1", "h2", "id").distinct().withColumn("r", F.row_number().over(same)).filter(F.col("r") <= k + 1)
    ids = lowest.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # at most k + 1
    texts = rows.groupBy("h1", "h2").agg(F.first("v").alias("v"))
    index = settle(texts.join(ids, ["h1", "h2"]))
    n = index.count()
    kind = dict(index.dtypes)

    sample = index.filter(F.pmod(F.col("h1"), F.lit(1_000_000)) <= int(1_000_000 * fit_rows / n)).select("h1", "h2", "v").orderBy("h1", "h2").limit(fit_rows)
    points = unit(np.array([r["v"] for r in sample.collect()], np.float64))
    depth = int(max(0, min(np.log2(max(1, n / leaf_rows)), np.log2(max(1, len(points) / 8)))))
    grown = grow(points, depth, trees)
    share = calibrate(grown, points, k, recall) if len(points) > k else float(trees)
    shared = spark.sparkContext.broadcast(grown)  # bounded: trees x 2 ** depth directions, depth by fit_rows

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.place(unit(matrix(batch["v"])))
            for t in range(leaf.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(leaf[:, t] + t * shared.value.leaves), *batch.columns], ["cell", *batch.schema.names])

    shape = f"cell long, h1 long, h2 long, v {kind['v']}, ids {kind['ids']}"
    members = index.select("h1", "h2", "v", "ids").mapInArrow(placed, shape)
    counts = np.zeros(trees * grown.leaves, np.int64)
    for row in members.groupBy("cell").count().collect():  # one row for each leaf: as bounded as the trees
        counts[row["cell"]] = row["count"]
    told = spark.sparkContext.broadcast(counts)
    budget = share * n
    parts = np.maximum(1, -(-counts // block_rows))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, which = [], []
            for q, vector in enumerate(unit(matrix(batch["v"]))):
                seen = 0
                for t, leaf in shared.value.walk(vector):
                    cell = t * shared.value.leaves + leaf
                    if told.value[cell]:
                        cells.append(cell)
                        which.append(q)
                        seen += told.value[cell]
                        if seen >= budget:
                            break
            blocks = parts[cells] if cells else np.zeros(0, np.int64)
            cells, which = np.repeat(np.array(cells, np.int64), blocks), np.repeat(np.array(which, np.int64), blocks)
            part = np.arange(len(cells)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            rows = batch.take(pa.array(which))
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(part), rows["h1"], rows["h2"], rows["v"]], ["cell", "part", "h1", "h2", "v"])

    asking = rows.filter("asks").select("h1", "h2", "id").distinct()
    asked = index.join(asking.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select("h1", "h2", "v")
    slices = -(-asked.count() // block_rows) or 1  # queries that meet a block at a time: about block_rows at most
    splits = F.element_at(F.array(*[F.lit(int(x)) for x in parts]), (F.col("cell") + 1).cast("int")) if parts.max() > 1 else F.lit(1)
    blocks = members.select("cell", F.pmod(F.col("h2"), splits).cast("long").alias("part"), F.lit(0).alias("kind"), F.lit(0).alias("slice"), "h1", "h2", "v", "ids", F.get("ids", F.lit(0)).alias("first"))
    visitors = asked.mapInArrow(visits, f"cell long, part long, h1 long, h2 long, v {kind['v']}").select(
        "cell", "part", F.lit(1).alias("kind"), F.pmod(F.col("h1"), F.lit(slices)).cast("int").alias("slice"), "h1", "h2", "v",
        F.lit(None).cast(kind["ids"]).alias("ids"), F.lit(None).cast("long").alias("first"),
    )
    dealt = blocks.union(visitors).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind", "slice")
    found = dealt.mapInArrow(_ranker(k + 1), f"q1 long, q2 long, h1 long, h2 long, score double, ids {kind['ids']}")
    return _answers(found, asking, k, id_col)


def _answers(found: DataFrame, asking: DataFrame, k: int, id_col: str) -> DataFrame:
    """Best rows of each query over all its blocks; a vector met in several trees counts once."""
    once = found.groupBy("q1", "q2", "h1", "h2").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    near = W.partitionBy("q1", "q2").orderBy(F.desc("score"), F.get("ids", F.lit(0)))
    few = once.withColumn("r", F.row_number().over(near)).filter(F.col("r") <= k + 1)
    every = few.select("q1", "q2", "score", F.explode("ids").alias("other"))
    pairs = asking.select(F.col("h1").alias("q1"), F.col("h2").alias("q2"), F.col("id").alias("query_id")).join(every, ["q1", "q2"]).filter("other <> query_id")
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "q1", "q2").orderBy(F.desc("score"), "other"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias(id_col), "score")
