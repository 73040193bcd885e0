"""Byte-level BPE encoding and decoding by DuckDB recursive queries in each task.

A text is cut into pieces by the tokenizer's pattern.  Distinct pieces that a
worker has not met lately become rows (piece, position, token), one for each
byte, in an in-memory DuckDB; a recursive query joins neighbouring rows with the
merge table, contracts every piece's leftmost pair of minimum rank, and ends
when no piece has a pair left.  An ordered aggregation joins the tokens' bytes
again: ids decode to bytes, a text of ids to the chain of its pieces.

Spark only reads, maps and writes here: no shuffle, and a lost task is simply
run again.  Memory is bounded: pieces are streamed through a text of any
length, a query gets at most ``_CALL`` pieces, and a worker keeps at most two
generations of ``_KEEP`` pieces.  The recursion costs the square of a piece's
length; pieces of more than ``LONG`` bytes (none in prose) are contracted one by
one from a heap instead, by the same rule.

Defined results: a null or empty text has no ids and decodes to no bytes.  Null
ids decode to null; an id outside the vocabulary raises an error.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import col

LONG, _CALL, _KEEP, _STREAM = 400, 20_000, 200_000, 150_000

_ENCODE = """
WITH RECURSIVE tok(step, piece, pos, id, nxt, nid) AS (  -- a token knows the place and id of the next one (-1: none)
  SELECT CAST(0 AS SMALLINT), piece, pos, id, nxt, nid FROM start
  UNION ALL
  (WITH best AS (  -- rank, place and next place of the leftmost pair of minimum rank
     SELECT piece, min((rank << 24) | (CAST(pos AS BIGINT) << 12) | nxt) AS low FROM tok JOIN merges ON pair = CAST(id AS BIGINT) * 1048576 + nid GROUP BY piece),
   gone AS (  -- the pair's second token, whose next one the contracted token takes over
     SELECT best.piece, CAST(low >> 24 AS INTEGER) AS rank, CAST((low >> 12) & 4095 AS SMALLINT) AS first, tok.pos AS second, tok.nxt, tok.nid
     FROM best JOIN tok ON tok.piece = best.piece AND tok.pos = CAST(low & 4095 AS SMALLINT))
   SELECT CAST(step + 1 AS SMALLINT), piece, pos, CASE WHEN pos = first THEN rank ELSE id END, CASE WHEN pos = first THEN gone.nxt ELSE tok.nxt END,
     CASE WHEN pos = first THEN gone.nid WHEN tok.nxt = first THEN rank ELSE tok.nid END
   FROM tok JOIN gone USING (piece) WHERE pos <> second))
SELECT piece, list(CAST(id AS UINTEGER) ORDER BY pos) AS ids, CAST(array_to_string(list(shown ORDER BY pos), '') AS BLOB) AS decoded
FROM tok JOIN (SELECT piece, max(step) AS step FROM tok GROUP BY piece) USING (piece, step) JOIN vocab USING (id)
GROUP BY piece ORDER BY piece"""
_DECODE = """
SELECT doc, CAST(array_to_string(list(shown ORDER BY pos), '') AS BLOB) AS decoded
FROM given LEFT JOIN vocab USING (id) GROUP BY doc HAVING count(*) = count(shown) ORDER BY doc"""


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file in tiktoken's format."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Codec:
    """One worker's DuckDB with the vocabulary, and the pieces it met lately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append((left * 1048576 + right, rank))
        table = np.array(pairs, np.int64).reshape(-1, 2)
        self.token = {rank: token for token, rank in ranks.items()}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})  # nothing is spilled to a local folder
        self._create("merges", pa.table({"pair": table[:, 0], "rank": table[:, 1]}), "*")
        words = pa.table({"id": pa.array(list(ranks.values()), pa.int64()), "token": pa.array(list(ranks), pa.binary())})
        self._create("vocab", words, "id, CAST(token AS VARCHAR) AS shown")  # bytes outside ASCII are shown escaped
        self.new: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}

    def _create(self, name: str, rows: pa.Table, what: str) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT {what} FROM given")
        self.db.unregister("given")

    def _recursive(self, pieces: list[str]) -> None:
        raw = [p.encode() for p in pieces]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(sizes)
        pos = (np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)).astype(np.int16)
        ids = self.single[np.frombuffer(b"".join(raw), np.uint8)]
        nxt, nid = pos + np.int16(1), np.r_[ids[1:], ids[:1]]
        nxt[ends - 1] = nid[ends - 1] = -1
        piece = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
        self.db.register("start", pa.table({"piece": piece, "pos": pos, "id": ids, "nxt": nxt, "nid": nid}))
        rows = self.db.sql(_ENCODE).to_arrow_table()
        self.db.unregister("start")
        pa.default_memory_pool().release_unused()  # else the worker keeps what one query needed
        lists = rows["ids"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()
        cuts = (lists.offsets.to_numpy() * 4).tolist()
        for piece, a, b, decoded in zip(pieces, cuts, cuts[1:], rows["decoded"].to_pylist()):
            self.new[piece] = (flat[a:b], decoded)

    def _heap(self, piece: str) -> None:
        """The same contraction for one long piece: pairs wait in a heap by rank and place."""
        raw = piece.encode()
        n = len(raw)
        token = [raw[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = lambda i: self.ranks.get(token[i] + token[after[i]]) if after[i] < n else None
        heap = [(r, i) for i in range(n) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if token[i] is None or rank(i) != r:
                continue
            j = after[i]
            token[i], token[j] = token[i] + token[j], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (s := rank(k)) is not None:
                    heapq.heappush(heap, (s, k))
        ids = [self.ranks[t] for t in token if t is not None]
        self.new[piece] = (np.array(ids, "<u4").tobytes(), b"".join([self.token[i] for i in ids]))

    def learn(self, pieces) -> None:
        """Encode and decode what neither generation holds."""
        fresh = []
        for p in pieces:
            if p in self.new:
                continue
            if p in self.old:
                self.new[p] = self.old[p]
            elif len(p) > LONG or len(p.encode()) > LONG:
                self._heap(p)
            else:
                fresh.append(p)
        for at in range(0, len(fresh), _CALL):
            self._recursive(fresh[at : at + _CALL])

    def coded(self, texts: list[list[str]]) -> list[list[tuple[bytes, bytes]]]:
        """For each list of pieces, their (ids, decoded)."""
        if len(self.new) > _KEEP:
            self.old, self.new = self.new, {}
        self.learn(set().union(*texts))
        known = self.new.__getitem__
        return [list(map(known, pieces)) for pieces in texts]

    def each(self, texts: Iterator[str | None]) -> Iterator[Iterator[list[tuple[bytes, bytes]]]]:
        """For each text, (ids, decoded) of its pieces, in stretches; short texts share their queries."""
        near: list[list[str]] = []
        size = 0
        for text in texts:
            text = text or ""
            if len(text) <= 2_000_000:
                near.append(self.pattern.findall(text))
                size += len(near[-1])
                if size <= _STREAM:
                    continue
            for pieces in self.coded(near):
                yield iter((pieces,))
            near, size = [], 0
            if len(text) > 2_000_000:
                found = (m.group() for m in self.pattern.finditer(text))
                yield (self.coded([pieces])[0] for pieces in iter(lambda: list(islice(found, _STREAM)), []))  # noqa: B023
        for pieces in self.coded(near):
            yield iter((pieces,))

    def decode(self, ids: pa.Array) -> list[bytes | None]:
        """Bytes of each list of ids."""
        ids = ids.cast(pa.list_(pa.int64()))
        flat, owner = ids.flatten(), pc.list_parent_indices(ids)
        self.db.register("given", pa.table({"doc": owner, "pos": np.arange(len(flat)), "id": flat}))
        found = dict(self.db.execute(_DECODE).fetchall())
        self.db.unregister("given")
        sizes = pc.list_value_length(ids).to_pylist()  # null for a null list
        out = [None if n is None else found.get(i) if n else b"" for i, n in enumerate(sizes)]
        if any(o is None and n for o, n in zip(out, sizes)):
            raise ValueError("an id is not in the vocabulary")
        return out


_CODECS: dict[tuple[str, str], Codec] = {}


def _codec(shared, pattern: str) -> Codec:
    """This worker's codec; made once, kept for later tasks."""
    name, ranks = shared.value
    if (name, pattern) not in _CODECS:
        _CODECS.clear()
        _CODECS[name, pattern] = Codec(ranks, pattern)
    return _CODECS[name, pattern]


def _share(df: DataFrame, path: str):
    """The vocabulary (bounded: one file of a tokenizer) for all workers, named by its content."""
    ranks = read_ranks(path)
    return df.sparkSession.sparkContext.broadcast((hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest(), ranks))


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text, an array of integers."""
    shared = _share(docs, path)

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        flat, cuts = [], [0]
        for stretches in _codec(shared, pattern).each(x.as_py() for x in texts):
            blob = b"".join(ids for stretch in stretches for ids, _ in stretch)
            flat.append(blob)
            cuts.append(cuts[-1] + len(blob) // 4)
        return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.frombuffer(b"".join(flat), "<i4")))

    return docs.withColumn(out, ids(col(text_col)))


def decode(rows: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the bytes that the ids stand for."""
    shared = _share(rows, path)

    @F.arrow_udf("binary")
    def bytes_of(ids: pa.Array) -> pa.Array:
        return pa.array(_codec(shared, r"(?s).+").decode(ids), pa.binary())

    return rows.withColumn(out, bytes_of(col(ids_col)))


def _digest(keep_ids: bool) -> T.StructType:
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * keep_ids)


def encode_and_check(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "coded", keep_ids: bool = True) -> DataFrame:
    """``docs`` with a struct: n_tokens, hashes of the ids (little-endian 32-bit) and of the decoded bytes, and the ids if wished."""
    shared = _share(docs, path)
    kind = _digest(keep_ids)

    @F.arrow_udf(kind)
    def coded(texts: pa.Array) -> pa.Array:
        counts, of_ids, of_bytes, all_ids = [], [], [], bytearray()
        for stretches in _codec(shared, pattern).each(x.as_py() for x in texts):
            n, a, b = 0, hashlib.sha256(), hashlib.sha256()
            for stretch in stretches:
                blob = b"".join([ids for ids, _ in stretch])
                n += len(blob) // 4
                a.update(blob)
                b.update(b"".join([decoded for _, decoded in stretch]))
                if keep_ids:
                    all_ids += blob
            counts.append(n)
            of_ids.append(a.hexdigest())
            of_bytes.append(b.hexdigest())
        columns = [pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
        if keep_ids:
            flat = pa.Array.from_buffers(pa.int32(), len(all_ids) // 4, [None, pa.py_buffer(all_ids)])
            columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), flat))
        return pa.StructArray.from_arrays(columns, names=kind.names)

    return docs.withColumn(out, coded(col(text_col)))
