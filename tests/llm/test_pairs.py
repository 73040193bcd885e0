"""Searches and near-duplicate operators against brute force, and their defined results."""

import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lakequill.llm.ann import nearest
from lakequill.llm.components import components
from lakequill.llm.embedding_dedup import embedding_groups
from lakequill.llm.simhash import LEAST, MISS, RADIUS, WORDS, cell_sets, keep_one_of_similar, pivots, similar_radius, simhash_groups, sketch

VECTORS = "vec_id long, embedding array<float>, label int"


def _vectors(seed: int, n: int = 160):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.standard_normal(16)
        if i % 4 == 1:  # near copies of the one before, over and under the threshold
            v = np.array(rows[-1][1]) + rng.standard_normal(16) * rng.choice([0.02, 0.2])
        if i % 17 == 3:
            v = np.array(rows[-2][1])  # exact copies
        if i % 23 == 5:
            v = np.array(rows[-1][1]) * 3
        rows.append((i, [float(np.float32(x)) for x in v], int(i // 4 % 3)))
    return rows


ODD = [
    (900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [float("inf")] + [1.0] * 15, 1), (904, [], 1),
    (905, [None] + [1.0] * 15, 1), (None, [1.0] * 16, 1), (906, [1.0] * 16, None), (907, [1.0, 2.0], 1),
]


def _cosine(a, b):
    return float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))


@pytest.mark.parametrize("block_rows", [2000, 7])
def test_embedding_groups(spark, block_rows):
    rows = _vectors(1)
    frame = spark.createDataFrame(rows + ODD, VECTORS).repartition(5).withColumns({"g": F.lit(1), "cell": F.lit("x"), "n": F.lit(None).cast("int")})
    got = {r["vec_id"]: r for r in embedding_groups(frame, block_rows=block_rows).collect() if r["vec_id"] is not None}
    link = {i: {j for j, w, m in rows if j != i and m == k and _cosine(v, w) >= 0.98} for i, v, k in rows}
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(link[i]), min(seen), min(seen) == i)
    for i in range(900, 908):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert sum(map(len, link.values())) > 50


def test_embedding_groups_repeats_and_empty(spark):
    frame = spark.createDataFrame([(3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (5, [2.0, 0.0], 1), (6, [2.0, 0.0], 2)], VECTORS)
    got = sorted(tuple(r) for r in embedding_groups(frame).collect())
    assert got == [(3, 2, 3, True), (3, 2, 3, True), (5, 2, 3, False), (6, 0, 6, True)]
    assert embedding_groups(frame.limit(0)).collect() == []


@pytest.mark.parametrize("block_rows", [4096, 20])
def test_nearest(spark, block_rows):
    rows = _vectors(2, 400)
    frame = spark.createDataFrame(rows + ODD + rows[50:51], VECTORS).repartition(3).withColumn("cell", F.lit(1))
    found = nearest(frame, F.col("vec_id") % 50 == 0, leaf_rows=32, block_rows=block_rows).collect()
    plain = [r for r in rows] + [(906, [1.0] * 16, None)]
    hit = total = 0
    for q in range(0, 400, 50):
        mine = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        scores = {i: _cosine(rows[q][1], v) for i, v, _ in plain if i != q}
        for r in mine:
            assert abs(scores[r["vec_id"]] - r["score"]) < 1e-12
        order = [(-r["score"], r["vec_id"]) for r in mine]
        assert order == sorted(order)
        best = sorted(scores, key=lambda i: (-round(scores[i], 12), i))[:5]
        hit += len(set(best) & {r["vec_id"] for r in mine})
        total += 5
    assert hit / total >= 0.9
    assert {r["query_id"] for r in found} == set(range(0, 400, 50)) | {q for q in (900, 950) if False}


def test_nearest_small_and_ties(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0], 1), (7, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (4, [2.0, 0.0], 1)], VECTORS)
    got = nearest(frame, F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [2, 4, 7] and all(r["score"] == 1.0 for r in got)
    assert nearest(frame.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    many = spark.createDataFrame([(i, [1.0, 1.0], 1) for i in range(0, 60)], VECTORS)
    got = nearest(many, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 3, 4, 5, 0, 1, 2, 3, 4]


def _print(text, width=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] if len(words) >= width else ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _texts(seed=3, n=120):
    rng = random.Random(seed)
    rows = [(None, "a b c d e f"), (1000, None), (1001, ""), (1002, " \t\n"), (1003, "One two"), (1004, "one TWO"), (1005, "ÄB c d e f"), (1005, "äb c d e f")]
    for i in range(n):
        words = [rng.choice("alpha beta gamma delta rho sigma tau phi chi psi".split()) + str(rng.randrange(30)) for _ in range(rng.randrange(3, 300))]
        if i % 3 == 1:
            words = rows[-1][1].split()
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    return rows + rows[-5:]


def test_simhash_groups(spark):
    rows = _texts()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns({"w0": F.lit(1), "node": F.lit("x"), "fp": F.lit(2)})
    got = sorted(((r["doc_id"], r["fingerprint"] & (2**64 - 1), r["component_id"]) for r in simhash_groups(frame).collect()), key=str)
    prints = [_print(t) for _, t in rows]
    want = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            a = todo.pop()
            for b in range(len(rows)):
                if b not in seen and (prints[a] ^ prints[b]).bit_count() <= RADIUS:
                    seen.add(b)
                    todo.append(b)
        ids = [rows[b][0] for b in seen if rows[b][0] is not None]
        want.append((i, prints[k], min(ids) if ids else None))
    assert got == sorted(want, key=str)
    assert simhash_groups(frame.limit(0)).collect() == []


def test_pivot_rule_never_discards_a_link():
    rng = np.random.default_rng(4)
    refs = pivots()
    fp = rng.integers(0, 2**64, (500, 1), dtype=np.uint64)
    for flips in range(RADIUS + 1):
        other = fp.copy()
        for _ in range(flips):
            other ^= np.uint64(1) << rng.integers(0, 64, (500, 1), dtype=np.uint64)
        table = [np.abs(np.bitwise_count(fp ^ p).astype(int) - np.bitwise_count(other ^ p).astype(int)).max() for p in refs]
        assert max(table) <= RADIUS


def _jaccard(a, b, width=5):
    sets = []
    for t in (a, b):
        w = t.encode().lower().split()
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_keep_one_of_similar(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("lorem ipsum dolor sit amet".split()) + str(rng.randrange(999))
    rows, expected = [], set()
    for i in range(60):
        words = [word() for _ in range(rng.randrange(60, 400))]
        rows.append((i * 10, " ".join(words), "s"))
        expected.add(i * 10)
        for c in range(i % 4):
            near = list(words)
            near[rng.randrange(len(near))] = "altered"
            if _jaccard(" ".join(words), " ".join(near)) >= 0.85:
                rows.append((i * 10 + 1 + c, " ".join(near), "s"))
    rows += [rows[0], rows[0], (5000, None, "s"), (5001, "", None), (None, rows[0][1], "s"), (None, "only here and nowhere else at all", "s"), (None, "only here and nowhere else at all", "s")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, w0 string").repartition(4)
    kept = keep_one_of_similar(frame)
    assert kept.columns == ["doc_id", "text", "w0"]
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert ids == sorted([*expected, 5000, None], key=str)
    assert keep_one_of_similar(frame.limit(0)).collect() == []


def _around(seed=8, n=45):
    """Texts with copies a little over and a little under the similarity of 0.8, chains of copies, and texts of one repeated shingle."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([8, 12, 40, 150, 600]))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(3):  # each a copy of the one before, so a group may be a chain
            words, goal = list(words), rng.choice([0.7, 0.76, 0.79, 0.81, 0.84])
            whole = " ".join(words)
            while _jaccard(whole, " ".join(words)) > goal:
                if rng.random() < 0.1:
                    words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
                words.append(f"y{rng.randrange(10**6)}")
            rows.append((len(rows), " ".join(words)))
    for i in range(4):  # one shingle fills the majority of every bit, the sets have next to nothing in common
        rows.append((len(rows), "again and again and again " * 300 + " ".join(f"z{rng.randrange(10**6)}" for _ in range(60))))
    return rows


@pytest.mark.parametrize("block_rows", [1000, 2])
def test_keep_one_of_similar_is_exact_at_the_similarity(spark, block_rows):
    rows = _around()
    pairs = {(a, b): _jaccard(s, t) for a, s in rows for b, t in rows[a + 1 :]}
    links = [p for p, s in pairs.items() if s >= 0.8]
    assert len(links) > 30 and sum(0.65 <= s < 0.8 for s in pairs.values()) > 30
    root = {i: i for i, _ in rows}
    for a, b in sorted(links) * len(rows):
        root[a] = root[b] = min(root[a], root[b])
    kept = keep_one_of_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block_rows=block_rows)
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, _ in rows if root[i] == i]


def test_cells_find_pairs_at_the_similarity():
    rng = np.random.default_rng(9)
    sets = cell_sets(0.8)
    missed = far = 0
    for _ in range(1000):
        words = [str(x) for x in rng.integers(0, 10**9, 44)]  # 40 shingles
        a, b = sketch(" ".join(words[:40]).encode(), 5, sets), sketch(" ".join(words[4:]).encode(), 5, sets)  # 36 each, 32 of them shared
        missed += not (a[1 + WORDS :] == b[1 + WORDS :]).any()
        far += int(np.bitwise_count((a ^ b)[1 : 1 + WORDS].view(np.uint64)).sum()) > similar_radius(0.8)
    assert missed + far <= 5
    assert (1 - 0.8**LEAST) ** sets <= MISS <= 0.001


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    near: dict = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            for other in near[todo.pop()] - seen:
                seen.add(other)
                todo.append(other)
        assert got[start] == min(seen)
    assert set(got) == set(near)


def test_plan_of_windows():
    from lakequill.llm.embedding_dedup import MISS, Plan

    for largest in (0, 5000, 10**6, 10**9):
        plan = Plan(0.98, largest)
        assert (1 - plan.chance**plan.dims) ** plan.sets <= MISS
        missed = sum(math.comb(plan.m, k) * plan.chance**k * (1 - plan.chance) ** (plan.m - k) for k in range(plan.least))
        assert missed <= MISS and plan.least > plan.m // 2
