"""SimHash near-duplicates through pivot distance tables.

A text's fingerprint is the bit majority of its shingles' hashes.  For every
distinct fingerprint the Hamming distances to ``PIVOTS`` reference fingerprints
are computed once.  By the triangle inequality, two fingerprints within
``radius`` bits differ by at most ``radius`` in every one of these coordinates:
in a cell, rows are sorted by the first coordinate, only rows within the radius
of it are paired, pairs with a larger difference in another coordinate are
discarded, and the survivors are verified on the fingerprints.

Cells keep the work far from all pairs.  For a small radius they lose none: the
64 bits are cut into ``radius + 2`` blocks, so two fingerprints within the radius
agree on at least two of them; a row goes to the cell of every pair of blocks.
A cell beyond ``block_rows`` rows is split, and each two of its parts meet in a
task of their own.  Tasks return links that connect the same rows as all links
of a part do (at most one for each row), never all pairs of a group.

For texts of a given similarity (``keep_one_of_similar``) fingerprints only
propose.  They have four words of 64 bits and count every shingle once; cells
are sets of least hashes, as many as find all but ``MISS`` of the pairs at that
similarity, whatever the number of rows; the radius is wide.  The texts of what
is connected so far then meet again, and two of them are linked only when the
Jaccard similarity of their shingle sets is reached.

Defined results: a null or empty text has fingerprint zero, and all such are
linked.  Null ids take part; a component's id is its smallest id that is not
null (null if there is none).  Repeated rows stay repeated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scale import broadcast_if_small, settle
from .arrowtext import each_bytes
from .cells import groups as single_groups
from .cells import split_cells, whole_groups
from .components import components
from .shared import col, free_name

#: Fixed value: the seed of the shingle hash.
SEED = 42
PIVOTS = 16
RADIUS = 4
#: Words of the fingerprint for a given similarity, least hashes of a cell, and the share of pairs at the similarity that no cell may find.
WORDS, LEAST, MISS = 4, 4, 0.001
#: Sets of four and five shingles are at 0.8 and differ in a bit with chance 3 / 16; no other two sets at 0.8 differ by more.
SMALLEST = 3 / 16
_STEP = 1 << 16  # shingles hashed at a time: a long text needs no more memory


def _hashes(raw: bytes, width: int) -> Iterator[np.ndarray]:
    """XXH64 of all word shingles of a text, a stretch at a time."""
    words = raw.lower().split()  # bytes: lower-cases A-Z, splits on ASCII white space
    if not words:
        return
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        yield np.array([digest(joined, SEED)], "<u8")
        return
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: 1 - width].tolist(), ends[width - 1 :].tolist()
    for at in range(0, len(starts), _STEP):
        yield np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + _STEP], ends[at : at + _STEP])], "<u8")


def _mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return hashes ^ (hashes >> np.uint64(29))


def fingerprint(raw: bytes, width: int, words: int = 1) -> np.ndarray:
    """Majority bits over the hashes of all word shingles; each word after the first is of the hashes mixed again."""
    counts, n = np.zeros((words, 64), np.int64), 0
    for hashes in _hashes(raw, width):
        n += len(hashes)
        for w in range(words):
            if w:
                hashes = _mixed(hashes)
            counts[w] += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits((2 * counts > n).astype(np.uint8), axis=1, bitorder="little").view("<i8")[:, 0]


def with_fingerprint(docs: DataFrame, text_col: str, width: int, words: int = 1) -> DataFrame:
    """``docs`` with w0, w1, ...: the fingerprint of each whole text in signed 64-bit words."""

    @F.arrow_udf("array<long>")
    def prints(texts: pa.Array) -> pa.Array:
        rows = [fingerprint(raw, width, words) for raw in each_bytes(texts)]
        return pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)), words).cast(pa.list_(pa.int64()))

    made = docs.withColumn("_words", prints(col(text_col)))
    return made.withColumns({f"w{i}": F.get("_words", F.lit(i)) for i in range(words)}).drop("_words")


def pivots(words: int = 1, n: int = PIVOTS, seed: int = 11) -> np.ndarray:
    """Reference fingerprints, drawn at random."""
    return np.random.default_rng(seed).integers(0, 2**64, (n, words), dtype=np.uint64)


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, mask) of each of the ``radius + 2`` bit blocks."""
    cuts = np.linspace(0, 64, radius + 3).round().astype(int)
    return [(int(a), (1 << int(b - a)) - 1) for a, b in zip(cuts, cuts[1:])]


def _cells(prints: DataFrame, radius: int) -> DataFrame:
    """Every print in the cells of any two blocks' bits."""
    parts = [F.shiftrightunsigned("w0", a).bitwiseAND(F.lit(m)) if a else F.col("w0").bitwiseAND(F.lit(m)) for a, m in _blocks(radius)]
    keys = [F.xxhash64(F.lit(i), F.lit(j), parts[i], parts[j]) for i, j in combinations(range(radius + 2), 2)]
    return prints.withColumn("cell", F.explode_outer(F.array(*keys)))


def _shingle_set(raw: bytes, width: int) -> np.ndarray:
    """Sorted hashes of a text's different word shingles."""
    parts = list(_hashes(raw, width))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, "<u8")


def cell_sets(similarity: float) -> int:
    """Cells a text goes to, so that a pair just at the similarity shares none of them with chance ``MISS`` at most."""
    alike = similarity**LEAST
    return 1 if alike >= 1 else math.ceil(math.log(MISS) / math.log(1 - alike))


def sketch(raw: bytes, width: int, sets: int, seed: int = 13) -> np.ndarray:
    """Hash of the shingle set, its fingerprint with every shingle counted once, and ``sets`` cells of ``LEAST`` least hashes each."""
    found = _shingle_set(raw, width)
    counts, hashes = np.zeros((WORDS, 64), np.int64), found
    for w in range(WORDS):
        hashes = _mixed(hashes) if w else hashes
        for at in range(0, len(hashes), _STEP):
            counts[w] += np.unpackbits(hashes[at : at + _STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    words = np.packbits((2 * counts > len(found)).astype(np.uint8), axis=1, bitorder="little").view("<u8")[:, 0]
    draws = np.random.default_rng(seed).integers(0, 2**64, (sets * LEAST, 2), dtype=np.uint64)
    least = np.array([((found ^ x) * (m | np.uint64(1))).min() if len(found) else 0 for x, m in draws], "<u8").reshape(sets, LEAST)
    cells = [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least)]
    return np.array([xxhash.xxh64_intdigest(found.tobytes(), SEED), *words.tolist(), *cells], np.uint64).view("<i8")


def _sketched(width: int, sets: int):
    @F.arrow_udf("array<long>")
    def sketches(texts: pa.Array) -> pa.Array:
        rows = [sketch(raw, width, sets) for raw in each_bytes(texts)]
        made = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
        return pa.FixedSizeListArray.from_arrays(made, 1 + WORDS + sets).cast(pa.list_(pa.int64()))

    return sketches


def connected_rows(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row index that the links (a, b) connect each of n rows to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _survivors(group: np.ndarray, side: np.ndarray, fp: np.ndarray, table: np.ndarray, radius: int, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified pairs of rows; rows are sorted by group and first coordinate.

    ``side``: 0 pairs with all of its group, 1 only with 2 (the parts of a split cell).
    """
    place = group * 1024 + table[:, 0]
    stop = np.searchsorted(place, place + radius, "right")
    width = stop - np.arange(len(fp)) - 1
    done = np.cumsum(width)
    at = 0
    while at < len(fp):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + most, "right")))
        w = width[at:to]
        left = np.repeat(np.arange(at, to), w)
        right = left + 1 + np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        keep = (side[left] == 0) | (side[left] != side[right])
        left, right = left[keep], right[keep]
        for k in range(1, table.shape[1]):
            near = np.abs(table[left, k] - table[right, k]) <= radius
            left, right = left[near], right[near]
        near = np.bitwise_count(fp[left] ^ fp[right]).sum(axis=1, dtype=np.int64) <= radius
        yield left[near], right[near]
        at = to


def _linker(radius: int, refs: np.ndarray):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(rows: pa.Table) -> pa.RecordBatch:
            cell, part, side, node = (rows[x].to_numpy() for x in ("cell", "part", "side", "node"))
            fp = np.column_stack([rows[f"w{i}"].to_numpy() for i in range(refs.shape[1])]).view(np.uint64)
            group = np.cumsum(np.r_[0, (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])])
            table = np.column_stack([np.bitwise_count(fp ^ p).sum(axis=1, dtype=np.int64) for p in refs])
            order = np.lexsort((table[:, 0], group))
            group, side, fp, table, ids = group[order], side[order], fp[order], table[order].astype(np.int16), node[order]
            pairs = list(_survivors(group, side, fp, table, radius))
            a, b = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, int), np.zeros(0, int))
            root = connected_rows(len(fp), a, b)
            move = np.flatnonzero(root != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(ids[root[move]]), pa.array(ids[move])], ["a", "b"])

        for rows in whole_groups(batches, ["cell", "part"]):
            yield work(rows)

    return link


def _linked(cells: DataFrame, radius: int, words: int, block_rows: int = 4000) -> DataFrame:
    """Links (a, b) of nodes that connect exactly what all pairs of a cell within ``radius`` bits connect."""
    rows = split_cells(cells, "node", block_rows)
    dealt = rows.repartition("cell", "part").sortWithinPartitions("cell", "part")
    return dealt.mapInArrow(_linker(radius, pivots(words)), "a long, b long")


def _named(rows: DataFrame, radius: int, words: int, cells) -> DataFrame:
    """Per distinct fingerprint of ``rows`` (id, w0, ...): component_id, the smallest id of its group."""
    parts = [f"w{i}" for i in range(words)]
    node = F.col("w0") if words == 1 else F.xxhash64(*parts)
    least = settle(rows.groupBy(*parts).agg(F.min("id").alias("first")).withColumn("node", node))
    found = components(_linked(cells(least.select("node", *parts)), radius, words), "a", "b")
    placed = least.join(found, "node", "left").select(*parts, "first", F.coalesce("root", "node").alias("root"))
    names = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return placed.join(names, "root").select(*parts, "root", "component_id")


def _joined(rows: DataFrame, groups: DataFrame, words: int) -> DataFrame:
    return rows.join(broadcast_if_small(groups, max_bytes=16 << 20), [f"w{i}" for i in range(words)])


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = RADIUS) -> DataFrame:
    """Per document: its id, fingerprint (signed) and component_id; all links within ``radius`` bits count."""
    named = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    rows = settle(with_fingerprint(named, "text", width).select("id", "w0"))
    groups = _named(rows, radius, 1, lambda prints: _cells(prints, radius))
    return _joined(rows, groups, 1).select(F.col("id").alias(id_col), F.col("w0").alias("fingerprint"), "component_id")


def similar_radius(similarity: float) -> int:
    """Bits that may differ in a pair that is proposed for a Jaccard similarity of shingle sets.

    Sets of that similarity have the cosine 2s / (1 + s) at least; a bit
    differs with chance angle / pi, or a little more in very small sets.  The
    radius is wider by three spreads: it only proposes.
    """
    differ = max(SMALLEST, math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi)
    bits = 64 * WORDS
    return math.ceil(bits * differ + 3 * math.sqrt(bits * differ * (1 - differ)))


def _similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have that Jaccard similarity."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return not len(b)
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return common / (len(a) + len(b) - common) >= similarity


def _verifier(width: int, similarity: float, radius: int, refs: np.ndarray):
    """Links that connect what the pairs of a part with the exact similarity connect; connected rows are not compared again."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in single_groups(batches, ["cell", "part"]):
            side, ids = rows["side"].to_numpy(), rows["node"].to_numpy()
            fp = np.column_stack([rows[f"w{i}"].to_numpy() for i in range(refs.shape[1])]).view(np.uint64)
            table = np.column_stack([np.bitwise_count(fp ^ p).sum(axis=1, dtype=np.int64) for p in refs])
            order = np.argsort(table[:, 0], kind="stable")
            sets = [_shingle_set(raw, width) for raw in each_bytes(rows["text"])]
            sets = [sets[i] for i in order]
            side, ids, fp, table = side[order], ids[order], fp[order], table[order].astype(np.int16)
            sizes, root = np.array([len(x) for x in sets]), np.arange(len(sets))
            for left, right in _survivors(np.zeros(len(fp), np.int64), side, fp, table, radius):
                fits = np.minimum(sizes[left], sizes[right]) >= similarity * np.maximum(sizes[left], sizes[right]) - 1e-6
                left, right = left[fits], right[fits]
                near = np.argsort(np.bitwise_count(fp[left] ^ fp[right]).sum(axis=1, dtype=np.int64), kind="stable")
                left, right = left[near], right[near]
                for at in range(0, len(left), 2048):
                    a, b = left[at : at + 2048], right[at : at + 2048]
                    apart = root[a] != root[b]
                    for i, j in zip(a[apart].tolist(), b[apart].tolist()):
                        if root[i] != root[j] and _similar(sets[i], sets[j], similarity):
                            low, high = sorted((root[i], root[j]))
                            root[root == high] = low
            move = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[root[move]]), pa.array(ids[move])], ["a", "b"])

    return verify


def keep_one_of_similar(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, block_rows: int = 1000,
) -> DataFrame:
    """``docs`` without near copies: of each group the row with the smallest id stays, with its own columns.

    A group is what pairs with the exact similarity of their shingle sets
    connect.  Of rows that share this id one stays.  Rows with a null id stay
    only in a group without any other id, one of them.
    """
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    carried = docs.select(*[col(c).alias(n) for c, n in names.items()])
    ident, text = names[id_col], names[text_col]
    radius, sets = similar_radius(similarity), cell_sets(similarity)
    parts = [f"w{i}" for i in range(WORDS)]
    keys = {"h1": F.xxhash64(text), "h2": F.hash(text)}
    sketched = carried.withColumn("_s", _sketched(width, sets)(F.col(text)))
    # sketches are made once; a text is met again by its own hash
    rows = settle(sketched.select(
        F.col(ident).alias("id"), *[k.alias(n) for n, k in keys.items()], F.get("_s", F.lit(0)).alias("node"),
        *[F.get("_s", F.lit(1 + i)).alias(p) for i, p in enumerate(parts)], F.slice("_s", 2 + WORDS, sets).alias("cells"),
    ))
    # one node for each shingle set, with one text that has it
    least = settle(rows.groupBy("node").agg(
        F.min("id").alias("first"), F.min(F.struct("id", "h1", "h2")).alias("sample"), *[F.first(p).alias(p) for p in [*parts, "cells"]]
    ))
    proposed = components(_linked(least.select("node", *parts, F.explode_outer("cells").alias("cell")), radius, WORDS), "a", "b")
    asked = settle(proposed.join(least, "node").select("node", F.col("root").alias("cell"), *parts, "sample.*"))
    texts = carried.select(F.col(ident).alias("_id"), F.col(text).alias("text"), keys["h1"].alias("_h1"), keys["h2"].alias("_h2"))
    sample = texts["_id"].eqNullSafe(asked["id"]) & (texts["_h1"] == asked["h1"]) & (texts["_h2"] == asked["h2"])
    met = texts.join(broadcast_if_small(asked), sample).select("node", "cell", *parts, "text")
    if not rows.join(asked, ["node", "h1", "h2"]).filter(rows["id"].eqNullSafe(asked["id"])).groupBy("node").count().filter("count > 1").isEmpty():
        met = met.dropDuplicates(["node"])  # rows repeated in full
    dealt = split_cells(met, "node", block_rows, asked.select("cell")).repartition("cell", "part").sortWithinPartitions("cell", "part")
    links = dealt.mapInArrow(_verifier(width, similarity, radius, pivots(WORDS)), "a long, b long")
    placed = least.join(components(links, "a", "b"), "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    placed = settle(placed)
    groups = placed.join(placed.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("node", "root", "component_id")
    first = rows.join(broadcast_if_small(groups, max_bytes=16 << 20), "node").filter(F.col("id").eqNullSafe(F.col("component_id")))
    chosen = settle(
        first.groupBy("root", "component_id", "h1", "h2").agg(F.count("*").alias("times"))
        .groupBy("root", "component_id").agg(F.min(F.struct("h1", "h2", "times")).alias("r")).select("component_id", "r.*")
    )
    marked = carried.withColumns(keys)
    same = marked[ident].eqNullSafe(chosen["component_id"]) & (marked["h1"] == chosen["h1"]) & (marked["h2"] == chosen["h2"])
    kept = marked.join(broadcast_if_small(chosen), same, "left_semi")
    if not chosen.filter("times > 1").isEmpty():  # rows repeated in full
        kept = kept.dropDuplicates([ident, "h1", "h2"])
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])
