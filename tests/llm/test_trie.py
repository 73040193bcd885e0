"""Conversation tries against a dictionary of prefixes, and their defined results."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lakequill.llm import prefix_trie
from lakequill.llm.prefix_trie import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _heads():
    conv = F.col("conv")
    return {"base": conv - conv % 5, "heads": F.crc32(conv.cast("string").cast("binary")) % 9, "most": 8}


def _brute(rows, rebuild):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts)] for c, ts in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        full[c] = own.get(c - c % 5, [])[:h] + turns[h:] if rebuild else turns
    members = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, ids in members.items():
        under = [(p, m) for p, m in members.items() if p[: len(path)] == path]
        children = lambda q: sum(len(p) == len(q) + 1 and p[: len(q)] == q for p in members)
        ends = sorted(c for c in ids if len(full[c]) == len(path))
        saved = sum((len(m) - 1) * len(p[-1][1].encode()) for p, m in under if p)
        above = min(members[path[:-1]]) if path else None
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(ids), len(path), above, len(ids), children(path), sum(not children(p) for p, _ in under), saved, digest))
    return sorted(out, key=str)


def _rows(seed, convs=60, words="abc"):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(convs * 2), convs):
        for t in range(rng.choice([0, 1, 2, 5, 12])):
            rows.append((c, t, rng.choice(["user", "assistant", None]) if t > 2 else "user", rng.choice(words) * rng.choice([0, 1, 3])))
    rng.shuffle(rows)
    return rows


ODD = [(None, 1, "user", "x"), (900, None, "user", "n"), (900, 3, None, None), (900, 3, None, None), (900, 3, "user", "b"), (900, 3, "user", "a"), (901, 0, "user", "é" * 100_000), (905, 1, "user", "x")]


@pytest.mark.parametrize("rebuild", [True, False])
@pytest.mark.parametrize("small", [False, True])
def test_brute_force(spark, monkeypatch, rebuild, small):
    if small:  # many segments, blocks and chunks (shards: by the batches of the session)
        monkeypatch.setattr(prefix_trie, "TURN_BLOCK", 2)
        monkeypatch.setattr(prefix_trie, "ID_BLOCK", 3)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = _rows(4 + rebuild) + ODD
        got = conversation_trie(spark.createDataFrame(rows, SCHEMA), **(_heads() if rebuild else {})).select(*COLUMNS).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert sorted(map(tuple, got), key=str) == _brute(rows, rebuild)


def test_long_and_nested_conversations(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(3, 160, 13) for t in range(c)]  # each a prefix of the next, over several segments
    rows += [(c, t, "user", "same") for c in range(1000, 1200) for t in range(3)]  # one large group of copies
    got = conversation_trie(spark.createDataFrame(rows, SCHEMA)).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == _brute(rows, False)


def test_clashing_names_and_empty_table(spark):
    rows = spark.createDataFrame(_rows(9, 20), SCHEMA).withColumns({"conv": F.lit(1), "pos": F.lit("x"), "block": F.lit(2), "depth": F.lit(0), "k1": F.lit(0)})
    got = conversation_trie(rows).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == _brute(_rows(9, 20), False)
    assert conversation_trie(rows.limit(0)).count() == 0
    assert conversation_trie(rows.limit(0), **_heads()).count() == 0


def test_paths_link_up(spark):
    nodes = conversation_trie(spark.createDataFrame(_rows(5), SCHEMA)).collect()
    by_path = {n.path: n for n in nodes}
    assert len(by_path) == len(nodes)
    assert all(by_path[n.parent_path].depth == n.depth - 1 for n in nodes if n.depth)
