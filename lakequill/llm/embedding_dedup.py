"""Near-duplicate embeddings by collision-counting projections.

Unit vectors are projected on many fixed random directions.  Two vectors at the
cosine threshold differ by a normal variable of known spread in each of them,
so a window of ``REACH`` spreads around a vector's own projection (a
query-centred window, sorted, not a grid) holds the other with a known chance.
A pair collides in a projection if it lies in the window; pairs with at least
the count of collisions that all but one in a million pairs at the threshold
reach are verified by their cosine in double precision.

Which pairs are looked at: a few sets of projections deal the rows into cells;
a row stands in its own cell and in the lower neighbours within a window of it,
so every pair that collides in a whole set meets exactly once in it, and a pair
counts in the first set in which it collides.  The number of sets follows from
the same chance (one miss in a million), the projections per set from the size
of the largest label.  A cell beyond ``block_rows`` rows is split into parts that
meet in separate tasks.  Tasks return counts per vector and links that connect
what all links of a part connect, never all pairs of a group.

Equal vectors of one label are compared once and counted with all their rows.

Defined results: a vector that is null, zero, or holds null or non-finite
components, one without a label or an id, and an empty one link with nothing:
no links, a component of its own, kept.  Vectors of different lengths are not
compared.  Rows with the same id count as separate vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import broadcast_if_small, settle
from .cells import groups, split_cells
from .components import components
from .shared import col
from .simhash import connected_rows
from .vectors import matrix, unit, usable

THRESHOLD, REACH, PROJECTIONS, MISS, SEED = 0.98, 2.5, 32, 1e-6, 23


class Plan:
    """Windows, sets and counts for a threshold and a size of the largest label."""

    def __init__(self, threshold: float, largest: int):
        apart = math.sqrt(2 - 2 * threshold)  # distance of unit vectors at the threshold
        self.window = REACH * apart
        self.chance = math.erf(REACH / math.sqrt(2))
        self.cell = 2 * self.window
        self.dims = min(8, max(2, round(math.log(max(1, largest) / 2000) / 0.8))) if largest > 2000 else 2
        miss = 1 - self.chance**self.dims
        self.sets = max(1, math.ceil(math.log(MISS) / math.log(miss)))
        self.m = max(PROJECTIONS, self.dims * self.sets)
        tail, self.least = 0.0, 0  # the largest count that is missed with a chance of at most MISS
        for k in range(self.m + 1):
            tail += math.comb(self.m, k) * self.chance**k * (1 - self.chance) ** (self.m - k)
            if tail > MISS:
                self.least = k
                break

    def columns(self, s: int) -> slice:
        """The projections of a set."""
        return slice(s * self.dims, (s + 1) * self.dims)

    def home(self, own: np.ndarray) -> np.ndarray:
        return np.floor(own / self.cell).astype(np.int64)

    def project(self, u: np.ndarray) -> np.ndarray:
        return u @ np.random.default_rng(SEED).standard_normal((u.shape[1], self.m))


def _hash(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = (h ^ np.asarray(p).astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _placer(plan: Plan):
    """Rows of every vector in every cell where it takes part."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch["v"]).to_numpy()
            for size in np.unique(sizes):
                rows = batch.filter(pa.array(sizes == size))
                at = plan.project(unit(matrix(rows["v"])))
                group = rows["g"].to_numpy()
                for s in range(plan.sets):
                    own = at[:, plan.columns(s)]
                    home = plan.home(own)
                    low = own - home * plan.cell <= plan.window
                    for lower in range(2**plan.dims):
                        step = np.array([lower >> d & 1 for d in range(plan.dims)])
                        here = np.flatnonzero((low | (step == 0)).all(axis=1))
                        if len(here):
                            some = rows.take(pa.array(here))
                            cell = _hash(group[here], np.full(len(here), s), *(home[here] - step).T)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(cell), pa.array(np.full(len(here), s, np.int32)), some["g"], some["node"], some["n"], some["v"]], ["cell", "set", "g", "node", "n", "v"]
                            )

    return place


def _meeter(plan: Plan, threshold: float, tile: int = 512, chunk: int = 50_000):
    def collide(s: int, side: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs that collide in all projections of a set; rows are sorted by the first of them."""
        lead = np.ascontiguousarray(at[:, plan.columns(s)][:, 0])
        for a in range(0, len(lead), tile):
            b = min(len(lead), a + tile)
            to = int(np.searchsorted(lead, lead[b - 1] + plan.window, "right"))
            near = np.triu(np.ones((b - a, to - a), bool), 1)
            near &= (side[a:b, None] == 0) | (side[a:b, None] != side[None, a:to])
            for d in range(s * plan.dims, (s + 1) * plan.dims):
                near &= np.abs(at[a:b, d, None] - at[None, a:to, d]) <= plan.window
            i, j = np.nonzero(near)
            for k in range(0, len(i), chunk):
                yield i[k : k + chunk] + a, j[k : k + chunk] + a

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, ["cell", "part"]):
            if rows.num_rows < 2:
                continue
            s = rows["set"][0].as_py()
            u = unit(matrix(rows["v"]))
            at = plan.project(u)
            order = np.argsort(at[:, s * plan.dims], kind="stable")
            u, at = u[order], at[order]
            side, node, n, group, cell = (rows[x].to_numpy()[order] for x in ("side", "node", "n", "g", "cell"))
            home = plan.home(at[:, plan.columns(s)])
            links, left, right = np.zeros(len(node), np.int64), [], []
            for x, y in collide(s, side, at):
                keep = group[x] == group[y]
                # the pair may meet in several cells: the lowest of both counts
                keep &= _hash(group[x], np.full(len(x), s), *np.minimum(home[x], home[y]).T) == cell[x]
                x, y = x[keep], y[keep]
                met = np.abs(at[x] - at[y]) <= plan.window
                keep = met.sum(axis=1) >= plan.least
                for earlier in range(s):  # counted in the first set in which it collides
                    keep &= ~met[:, plan.columns(earlier)].all(axis=1)
                x, y = x[keep], y[keep]
                close = (u[x] * u[y]).sum(axis=1) >= threshold
                x, y = x[close], y[close]
                np.add.at(links, x, n[y])
                np.add.at(links, y, n[x])
                left.append(x)
                right.append(y)
            some = np.flatnonzero(links)
            if len(some):
                root = connected_rows(len(node), np.concatenate(left), np.concatenate(right))
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[root[some]]), pa.array(links[some])], ["a", "b", "links"])

    return meet


def embedding_groups(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, threshold: float = THRESHOLD, block_rows: int = 2000,
) -> DataFrame:
    """Per vector: its id, n_links, component_id and kept."""
    rows = vectors.select(col(id_col).alias("id"), col(vector_col).alias("v"), col(label_col).alias("label"))
    ok = F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"))
    marked = rows.select(
        "id", "v", F.when(ok, F.xxhash64("label", F.size("v"))).alias("g"), F.when(ok, F.xxhash64("v")).alias("h1"), F.when(ok, F.xxhash64(F.lit(5), "v")).alias("h2"),
    )
    kinds = settle(
        marked.filter("g IS NOT NULL").groupBy("g", "h1", "h2").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.first("v").alias("v"))
        .withColumn("node", F.xxhash64("g", "h1", "h2"))
    )
    largest = kinds.groupBy("g").count().agg(F.max("count")).first()[0] or 0
    plan = Plan(threshold, largest)
    columns = f"cell long, set int, g long, node long, n long, v {dict(kinds.dtypes)['v']}"
    placed = kinds.select("g", "node", "n", "v").mapInArrow(_placer(plan), columns)
    parts = split_cells(placed, "node", block_rows, counted=placed.select("cell")).repartition("cell", "part").sortWithinPartitions("cell", "part")
    found = settle(parts.mapInArrow(_meeter(plan, threshold), "a long, b long, links long"))
    roots = components(found, "a", "b")
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    placed_kinds = (
        kinds.select("g", "h1", "h2", "node", "n", "first").join(roots, "node", "left").join(links, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    names = placed_kinds.groupBy("root").agg(F.min("first").alias("component_id"))
    each = placed_kinds.join(names, "root").select(
        "g", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"
    )
    out = marked.select("id", "g", "h1", "h2").join(broadcast_if_small(each, max_bytes=16 << 20), ["g", "h1", "h2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
