"""Hard negatives: exact integer scores by Kronecker-packed products.

Components become floor(scale * x), and a score is the integer inner product
with an anchor.  A cell of candidates is packed once: for each component the
candidates' values, biased to be non-negative, stand in fields of one wide
integer.  An anchor multiplies each wide integer once by its own biased component
and adds the products; the fields of the sum are the scores of all candidates,
after the biases' share is taken off.  Fields are wide enough for the largest sum
of the cell, so nothing carries over and scores are exact.

Anchors are a stated set of rows that meets all others: candidates are dealt into
cells of ``cell_rows`` by id, a task holds one cell and streams the anchors past
it.  The first pass finds each anchor's positives, best rows of its label (only
that label's fields are multiplied); the second finds, for every positive, the
best rows of other labels within its score band.  Each cell passes on at most k
rows per anchor (and positive), so what is ordered afterwards is small.

Defined results: rows with a null id or label, a null vector, or a null or
non-finite component take no part, nor do those with a component so large that a
score of its length might not fit a long.  An all-zero vector takes part.  Vectors
meet only vectors of their own length.  An id is one row: of rows that repeat an
id the one with the smallest label (as text), then vector, stays.  Ties go to the
smaller id; an anchor without positives, or a positive without negatives in its
band, has no rows.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import col

CELL_ROWS, MAX_PARTITIONS = 16_384, 20_000
_FOUND = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


class Packed:
    """Candidates' components in the fields of wide integers, one integer for each component."""

    def __init__(self, values: np.ndarray):
        self.values, self.bias = values, int(np.abs(values).max(initial=0))
        self.sums = values.sum(axis=1).view(np.uint64)
        self.wide: dict[int, list[int]] = {}

    def _packed(self, width: int) -> list[int]:
        if width not in self.wide:
            fields = np.zeros((len(self.values), max(1, width // 64)), "<u4" if width == 32 else "<u8")
            out = []
            for column in self.values.T:
                fields[:, 0] = column + self.bias
                out.append(int.from_bytes(fields.tobytes(), "little"))
            self.wide[width] = out
        return self.wide[width]

    def scores(self, anchor: list[int]) -> np.ndarray:
        """Inner products of an anchor with all candidates."""
        lift = max(map(abs, anchor), default=0)
        most = 4 * len(anchor) * lift * self.bias
        width = 32 if most < 1 << 32 else 64 if most < 1 << 64 else 128
        total = sum(map(mul, [x + lift for x in anchor], self._packed(width)))
        raw = np.frombuffer(total.to_bytes(len(self.values) * width // 8, "little"), "<u4" if width == 32 else "<u8")
        fields = raw[:: max(1, width // 64)].astype(np.uint64)  # of a wider field the low half: the result fits it
        fixed = (self.bias * sum(anchor) + len(anchor) * lift * self.bias) % (1 << 64)
        with np.errstate(over="ignore"):
            return (fields - np.uint64(fixed) - self.sums * np.uint64(lift)).view(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, highest score first, ties to the smaller id."""
    at = np.arange(len(ids))
    if len(at) > k:
        at = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    return at[np.lexsort((ids[at], -scores[at]))][:k]


class Cell:
    """One cell's candidates by vector length, those of a label side by side."""

    def __init__(self, rows: pa.Table, scale: int):
        self.by_length = {}
        lengths = pc.list_value_length(rows["x"]).to_numpy()
        for n in np.unique(lengths):
            mine = rows.filter(pa.array(lengths == n))
            labels, ids = mine["label"].to_numpy(zero_copy_only=False).astype(str), mine["id"].to_numpy()
            order = np.lexsort((ids, labels))
            values = _scaled(mine["x"], int(n), scale)[order]
            names, starts = np.unique(labels[order], return_index=True)
            ends = np.r_[starts[1:], len(order)]
            self.by_length[int(n)] = (ids[order], Packed(values), {name: (int(a), int(b)) for name, a, b in zip(names, starts, ends)}, {})

    def positives(self, ident: int, label: str, anchor: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        ids, packed, labels, of_label = self.by_length.get(len(anchor), (None, None, {}, {}))
        if label not in labels:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = labels[label]
        if label not in of_label:
            of_label[label] = Packed(packed.values[a:b])
        other = ids[a:b] != ident
        near, scores = ids[a:b][other], of_label[label].scores(anchor)[other]
        at = _best(near, scores, k)
        return near[at], scores[at]

    def negatives(self, label: str, anchor: list[int], bands: list[tuple[int, int]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each band of scores (both ends in it) the best rows of other labels."""
        if len(anchor) not in self.by_length:
            return
        ids, packed, labels, _ = self.by_length[len(anchor)]
        scores = packed.scores(anchor)
        a, b = labels.get(label, (0, 0))
        scores, ids = np.r_[scores[:a], scores[b:]], np.r_[ids[:a], ids[b:]]
        for low, high in bands:
            inside = np.flatnonzero((scores >= low) & (scores <= high))
            at = inside[_best(ids[inside], scores[inside], k)]
            yield ids[at], scores[at]


def _scaled(column: pa.ChunkedArray, length: int, scale: int) -> np.ndarray:
    flat = np.concatenate([np.zeros(0), *[c.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for c in column.chunks]])
    return np.floor(flat * scale).astype(np.int64).reshape(-1, length) if length else np.zeros((len(column), 0), np.int64)


def _per_cell(scale: int, k: int, band: tuple[int, int] | None):
    """Candidates (kind 0) first, then the anchors of each cell, in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, cell = None, [], None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            cells, kinds = rows["cell"].to_numpy(), rows["kind"].to_numpy()
            cuts = np.r_[0, np.flatnonzero((cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])) + 1, len(cells)]
            for a, b in zip(cuts, cuts[1:]):
                if b == a:
                    continue
                if cells[a] != at:
                    at, held, cell = cells[a], [], None
                part = rows.slice(a, b - a)
                if kinds[a] == 0:
                    held.append(part)
                    continue
                if cell is None:
                    cell, held = Cell(pa.concat_tables(held), scale) if held else None, []
                if cell:
                    yield _met(cell, part, scale, k, band)

    return run


def _met(cell: Cell, anchors: pa.Table, scale: int, k: int, band: tuple[int, int] | None) -> pa.RecordBatch:
    out: list[list] = [[], [], [], [], []]
    ids, labels, wanted = anchors["id"].to_pylist(), anchors["label"].to_pylist(), anchors["positives"].to_pylist()
    for n, (ident, label, vector) in enumerate(zip(ids, labels, anchors["x"])):
        anchor = np.floor(np.array(vector.as_py(), np.float64) * scale).astype(np.int64).tolist()
        if band is None:
            near, scores = cell.positives(ident, label, anchor, k)
            rows = [([ident] * len(near), near, scores, [None] * len(near), [None] * len(near))]
        else:
            low, of = band
            positives = [(p["id"], p["score"]) for p in wanted[n]]
            found = cell.negatives(label, anchor, [(-(-low * score // of), score) for _, score in positives], k)
            rows = [([ident] * len(near), [p] * len(near), [s] * len(near), near, scores) for (p, s), (near, scores) in zip(positives, found)]
        for row in rows:
            for values, more in zip(out, row):
                values.extend(more.tolist() if isinstance(more, np.ndarray) else more)
    names = [f.split()[0] for f in _FOUND.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], names)


def _unsound(x: Column, scale: int):
    """Null, not finite, or so large that inner products of this length might leave a long."""
    most = F.sqrt(F.lit(2.0**62) / F.greatest(F.size(x), F.lit(1)))
    return lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double") * scale) >= most)


def _first(rows: DataFrame, keys: list[str], score: str, ident: str, k: int) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.col(score).desc(), ident)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine_negatives(
    vectors: DataFrame,
    anchors: Column,
    ident: str = "vec_id",
    label: str | Column = "label",
    vector: str = "embedding",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 5,
    band: tuple[int, int] = (80, 100),
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` is a condition on the id.  A negative's score s keeps to its
    positive's score p by band[0] * p <= band[1] * s <= band[1] * p.
    """
    label = col(label) if isinstance(label, str) else label
    x = col(vector)
    rows = vectors.select(col(ident).cast("long").alias("id"), label.cast("string").alias("label"), x.alias("x"), anchors.alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", _unsound(F.col("x"), scale)))
    seen = rows.groupBy("id").agg(F.count("*").alias("n")).agg(F.count("*").alias("ids"), F.max("n").alias("most")).first()
    if (seen["most"] or 0) > 1:
        rows = rows.groupBy("id").agg(F.min(F.struct("label", "x", "asks")).alias("r")).select("id", "r.*")
    cells = max(1, -(-seen["ids"] // cell_rows))
    here = F.pmod(F.xxhash64("id"), F.lit(cells))
    wanted = "array<struct<id:bigint,score:bigint>>"
    candidates = rows.select(here.alias("cell"), F.lit(0).alias("kind"), "id", "label", "x", F.lit(None).cast(wanted).alias("positives"))
    asked = rows.filter("asks").select("id", "label", "x")

    def meet(asked: DataFrame, k: int, within: tuple[int, int] | None) -> DataFrame:
        everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias("cell")
        sent = asked.select(everywhere, F.lit(1).alias("kind"), "id", "label", "x", "positives")
        dealt = candidates.union(sent).repartition(min(cells, MAX_PARTITIONS), "cell").sortWithinPartitions("cell", "kind")
        return dealt.mapInArrow(_per_cell(scale, k, within), _FOUND)

    near = meet(asked.withColumn("positives", F.lit(None).cast(wanted)), positives, None)
    near = _first(near, ["anchor_id"], "positive_score", "positive_id", positives)
    near = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score")))).alias("positives"))
    ready = asked.join(near, asked["id"] == near["anchor_id"]).select("id", "label", "x", "positives")
    found = meet(ready, negatives, band)
    found = _first(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
