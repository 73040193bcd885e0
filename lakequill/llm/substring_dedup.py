"""Exact substring dedup over all documents, by bytes.

A byte goes if it lies in a ``WINDOW``-byte string that also starts in a
document with a smaller id.  No suffix array of the whole corpus is built:

1. Documents are packed into blocks of about a megabyte (compressed, written to
   the checkpoint folder; all later steps read the same blocks).
2. Every window is assigned to an anchor, the ``GRAM``-byte string in it with
   the least hash.  Equal windows have equal anchors, so runs of windows with
   one anchor (segments) can be compared apart from all others.  A block asks,
   with 32 bits for each distinct anchor, which of them other blocks have.
3. Segments of anchors that occur in several documents are sent to their
   anchor's bucket, each distinct segment once per block, with its least id.
4. In a bucket, equal segments are merged.  Where an anchor has several
   different segments, their texts go into a Burrows-Wheeler transform, whose
   intervals of common prefixes, expanded up to ``WINDOW`` bytes, give the least
   id of every window.
5. Removed runs return to their block, which cuts them out.

The number of buckets follows the input; what a block asks and sends is
distinct within it, so a passage that a third of all documents share is one row
per block.  Anchors that very many blocks have are sent window by window, so
that their different surroundings spread over all buckets.

Defined results: a null or empty text has no bytes; texts shorter than a window
lose nothing; rows with the same id never remove each other's bytes; a null id
is larger than any other, and null ids do not remove each other's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import settle
from .arrowtext import each_bytes
from .intervals import least_of_equal
from .shared import col

WINDOW, GRAM = 50, 20
GRAMS = WINDOW - GRAM + 1  # strings of GRAM bytes in a window
LONGEST = WINDOW + GRAMS - 1  # bytes of the longest segment
BLOCK = 1 << 20
_SLICE = 1 << 20  # windows looked at together; places fit in _LOW
_LOW = np.uint64((1 << 21) - 1)
_NONE = np.iinfo(np.int64).max
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def _blobs(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Slices of an array as binary values."""
    offsets = (cuts * data.dtype.itemsize).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd", 3)
    ids: list = []
    texts: list[bytes] = []
    size = 0

    def block() -> pa.RecordBatch:
        data = b"".join(texts)
        keys = np.array([_NONE if i is None else i for i in ids], "<i8").tobytes()
        sizes = np.fromiter(map(len, texts), "<i8", len(texts)).tobytes()
        name = xxhash.xxh64_intdigest(data, xxhash.xxh64_intdigest(keys + sizes)) - (1 << 63)
        held = codec.compress(data, asbytes=True) if data else b""
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, keys, sizes, held, len(data))], ["block", "ids", "sizes", "data", "n_bytes"])

    for batch in batches:
        for ident, raw in zip(batch.column(0).to_pylist(), each_bytes(batch.column(1))):
            if texts and (size + len(raw) > BLOCK or len(texts) >= 5000):
                yield block()
                ids, texts, size = [], [], 0
            ids.append(ident)
            texts.append(raw)
            size += len(raw)
    if texts:
        yield block()


def _open(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, sizes and bytes of a block."""
    data = pa.Codec("zstd").decompress(row["data"], decompressed_size=row["n_bytes"], asbytes=True) if row["n_bytes"] else b""
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["sizes"], "<i8"), np.frombuffer(data, np.uint8)


def _segments(sizes: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments of a block: first window, number of windows, document, hash of the anchor."""
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    found = []
    for base in range(0, max(0, len(data) - WINDOW + 1), _SLICE):
        part = data[base : base + _SLICE + WINDOW - 1]
        grams = len(part) - GRAM + 1
        padded = np.concatenate([part, np.zeros(16, np.uint8)])
        word = lambda at, kind: np.ndarray((grams,), kind, buffer=padded, offset=at, strides=(1,))  # noqa: E731, B023
        h = word(0, "<u8") * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(32)
        h += word(8, "<u8")
        h *= _U(0xBF58476D1CE4E5B9)
        h ^= h >> _U(29)
        h += word(16, "<u4")
        h *= _U(0x94D049BB133111EB)
        h ^= h >> _U(32)
        low = (h & ~_LOW) | np.arange(grams, dtype=np.uint64)  # equal hashes: the leftmost
        width = 1
        while 2 * width <= GRAMS:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < GRAMS:
            low = np.minimum(low[: width - GRAMS], low[GRAMS - width :])
        anchor = low & _LOW
        mine = owner[base : base + len(part)]
        inside = mine[: len(anchor)] == mine[WINDOW - 1 :]
        edge = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])])
        count = np.diff(np.r_[edge, len(anchor)])
        ok = inside[edge]
        edge, count = edge[ok], count[ok]
        found.append((edge + base, count, mine[edge], _mix(h[anchor[edge].astype(np.int64)])))
    if not found:
        return tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, np.int32, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found))


def _asker(buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, sizes, data = _open(row)
                h = np.unique(_segments(sizes, data)[3])
                if not len(h):
                    continue
                of = _bucket(h, buckets)
                cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True])
                rest = (h & _U(0xFFFFFFFF)).astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(cuts) - 1, row["block"])), pa.array(of[cuts[:-1]]), _blobs(rest, cuts)], ["block", "bucket", "anchors"]
                )

    return ask


def _groups(batches: Iterator[pa.RecordBatch], key: str = "bucket") -> Iterator[list[dict]]:
    """Rows of sorted batches, all of one key together."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for _, group in groupby(rows, key=lambda r: r[key]):
        yield list(group)


def _answerer(hot_blocks: int):
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            parts = [np.frombuffer(r["anchors"], "<u4") for r in rows]
            every = np.concatenate(parts)
            _, where, counts = np.unique(every, return_inverse=True, return_counts=True)
            many = counts[where]
            ends = np.cumsum([len(p) for p in parts])
            out = []
            for row, a, b in zip(rows, ends - [len(p) for p in parts], ends):
                shared = many[a:b] > 1
                if shared.any():
                    out.append((row["block"], row["bucket"], np.packbits(shared).tobytes(), np.packbits(many[a:b] > hot_blocks).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["block", "bucket", "shared", "hot"])

    return answer


def _content(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hash of each stretch of bytes (at most ``LONGEST``)."""
    out = np.zeros(len(start), np.uint64)
    for at in range(0, len(start), 50_000):
        s, n = start[at : at + 50_000], size[at : at + 50_000]
        cells = np.arange(LONGEST)[None, :]
        block = np.where(cells < n[:, None], data[np.minimum(s[:, None] + cells, len(data) - 1)], 0).astype(np.uint8)
        h = n.astype(np.uint64)
        for word in np.ascontiguousarray(block).view("<u8").T:
            h = _mix(h ^ word) + word
        out[at : at + 50_000] = _mix(h)
    return out


def _stretch(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of all bytes of many stretches, one after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


_SENT = "block long, bucket long, sizes binary, text binary, anchors binary, least binary, uses binary, places binary, gone binary, gone_sizes binary"
_RUNS = "block long, starts binary, sizes binary"


def _sender(buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 3)
        for batch in batches:
            for row in batch.to_pylist():
                ids, sizes, data = _open(row)
                start, count, doc, h = _segments(sizes, data)
                if not len(start):
                    continue
                names, of = np.unique(h, return_inverse=True)
                lo, hi = np.full(len(names), len(ids)), np.full(len(names), -1)
                np.minimum.at(lo, of, doc)
                np.maximum.at(hi, of, doc)
                shared, hot = lo < hi, np.zeros(len(names), bool)
                place = _bucket(names, buckets)
                for said in row["answers"] or ():
                    a, b = np.searchsorted(place, [said["bucket"], said["bucket"] + 1])
                    shared[a:b] |= np.unpackbits(np.frombuffer(said["shared"], np.uint8))[: b - a].astype(bool)
                    hot[a:b] |= np.unpackbits(np.frombuffer(said["hot"], np.uint8))[: b - a].astype(bool)
                keep, each = shared[of], hot[of]
                wide = keep & each
                if wide.any():  # one segment for each window, found by all of its bytes
                    s = _stretch(start[wide], count[wide])
                    d = np.repeat(doc[wide], count[wide])
                    own = _mix(_content(data, s, np.full(len(s), WINDOW)))
                    keep &= ~each
                    start, count = np.r_[start[keep], s], np.r_[count[keep], np.ones(len(s), np.int64)]
                    doc, h = np.r_[doc[keep], d], np.r_[h[keep], own]
                else:
                    start, count, doc, h = start[keep], count[keep], doc[keep], h[keep]
                if not len(start):
                    continue
                n = count + WINDOW - 1
                ident = ids[doc]
                # distinct texts in order of bucket; the anchor is part of the text
                content = _content(data, start, n)
                order = np.lexsort((content, h))
                start, n, ident, h, content = start[order], n[order], ident[order], h[order], content[order]
                new = np.r_[True, (h[1:] != h[:-1]) | (content[1:] != content[:-1])]
                text = np.cumsum(new) - 1
                first = np.flatnonzero(new)
                least = np.minimum.reduceat(ident, first)
                later = ident > least[text]
                used = np.flatnonzero(~later)
                size, at = n[first], _bucket(h[first], buckets)
                cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1], True])
                bytes_at = np.r_[0, np.cumsum(size)][cuts]
                uses_at = np.searchsorted(text[used], cuts)
                back = text[used] - np.repeat(cuts[:-1], np.diff(uses_at))
                k = len(cuts) - 1
                none = pa.array([b""] * k, pa.binary())
                sent = data[_stretch(start[first], size)].tobytes()
                texts = pa.array([codec.compress(sent[a:b], asbytes=True) for a, b in zip(bytes_at, bytes_at[1:])], pa.binary())
                rows = [
                    pa.array(np.full(k, row["block"])), pa.array(at[cuts[:-1]]), _blobs(size.astype("u1"), cuts), texts,
                    _blobs((h[first] & _U(0xFFFFFFFF)).astype("<u4"), cuts), _blobs(least.astype("<i8"), cuts),
                    _blobs(back.astype("<u4"), uses_at), _blobs(start[used].astype("<u4"), uses_at), none, none,
                ]
                fields = [f.split()[0] for f in _SENT.split(", ")]
                yield pa.RecordBatch.from_arrays(rows, fields)
                if later.any():  # known to go without asking
                    lost = [pa.array([row["block"]]), pa.array([int(row["block"] % buckets)])] + [pa.array([b""])] * 6
                    lost += [pa.array([start[later].astype("<u4").tobytes()]), pa.array([n[later].astype("<u4").tobytes()])]
                    yield pa.RecordBatch.from_arrays(lost, fields)

    return send


def _least_windows(data: np.ndarray, sizes: np.ndarray, group: np.ndarray, least: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """Least id of every window of the texts, text by text; only texts of one group share windows.

    Groups are put together into transforms of about ``most`` bytes.
    """
    out, begin, ends = [], 0, np.cumsum(sizes)
    last = np.flatnonzero(np.r_[group[1:] != group[:-1], True])
    while begin < len(sizes):
        done = int(ends[begin - 1]) if begin else 0
        fit = last[np.searchsorted(ends[last], done + most, "right") - 1] + 1 if ends[last[np.searchsorted(last, begin)]] <= done + most else last[np.searchsorted(last, begin)] + 1
        out.append(least_of_equal(data[done : int(ends[fit - 1])], sizes[begin:fit], least[begin:fit], WINDOW))
        begin = int(fit)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd")
    for rows in _groups(batches):
        for row in rows:
            if row["gone"]:
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.array([row["gone"]]), pa.array([row["gone_sizes"]])], ["block", "starts", "sizes"])
        rows = [r for r in rows if r["sizes"]]
        if not rows:
            continue
        read = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in rows])  # noqa: E731, B023
        size, anchor, least = read("sizes", "u1").astype(np.int64), read("anchors", "<u4"), read("least", "<i8")
        raw = [codec.decompress(r["text"], decompressed_size=int(np.frombuffer(r["sizes"], "u1").sum(dtype=np.int64)), asbytes=True) for r in rows]
        data = np.frombuffer(b"".join(raw), np.uint8)
        begin = np.cumsum(size) - size
        content = _content(data, begin, size)
        texts = np.array([len(r["sizes"]) for r in rows])
        uses = np.array([len(r["uses"]) // 4 for r in rows])
        use = read("uses", "<u4").astype(np.int64) + np.repeat(np.cumsum(texts) - texts, uses)
        place, source = read("places", "<u4").astype(np.int64), np.repeat(np.arange(len(rows)), uses)
        # equal texts of all blocks
        order = np.lexsort((content, anchor))
        a, c = anchor[order], content[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])]
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        of_kind = np.minimum.reduceat(least[order], first)
        head = order[first]
        group = np.cumsum(np.r_[0, anchor[head][1:] != anchor[head][:-1]])
        several = np.bincount(group)[group] > 1
        # an anchor with one text: the whole text has the same least id
        alone = ~several[kind[use]]
        gone = alone & (least[use] > of_kind[kind[use]])
        found = [(source[gone], place[gone], size[use[gone]])]
        # an anchor with several texts: windows of each, by the transform
        pick = np.flatnonzero(several)
        if len(pick):
            chosen = head[pick]
            windows = _least_windows(data[_stretch(begin[chosen], size[chosen])], size[chosen], group[pick], of_kind[pick])
            counts = size[chosen] - WINDOW + 1
            where = np.zeros(len(several), np.int64)
            where[pick] = np.cumsum(counts) - counts
            mixed = np.flatnonzero(~alone)
            k = size[use[mixed]] - WINDOW + 1
            flat = windows[_stretch(where[kind[use[mixed]]], k)] < np.repeat(least[use[mixed]], k)
            edge = np.zeros(len(flat), bool)
            edge[np.cumsum(k) - k] = True
            runs = np.flatnonzero(np.r_[True, edge[1:] | (flat[1:] != flat[:-1])]) if len(flat) else np.zeros(0, np.int64)
            length = np.diff(np.r_[runs, len(flat)])
            runs, length = runs[flat[runs]], length[flat[runs]]
            one = np.repeat(np.arange(len(mixed)), k)[runs]
            inside = runs - (np.cumsum(k) - k)[one]
            found.append((source[mixed][one], place[mixed][one] + inside, length + WINDOW - 1))
        src, at, n = (np.concatenate(x) for x in zip(*found))
        if len(src):
            by = np.argsort(src, kind="stable")
            src, at, n = src[by], at[by], n[by]
            cuts = np.flatnonzero(np.r_[True, src[1:] != src[:-1], True])
            names = pa.array([rows[i]["block"] for i in src[cuts[:-1]]], pa.int64())
            yield pa.RecordBatch.from_arrays([names, _blobs(at.astype("<u4"), cuts), _blobs(n.astype("<u4"), cuts)], ["block", "starts", "sizes"])


_OUT = "id long, n_bytes long, n_removed long, n_spans long, span_starts array<int>, span_sizes array<int>, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, sizes, data = _open(row)
            level = np.zeros(len(data) + 1, np.int32)
            for run in row["runs"] or ():
                s, n = np.frombuffer(run["starts"], "<u4").astype(np.int64), np.frombuffer(run["sizes"], "<u4")
                np.add.at(level, s, 1)
                np.add.at(level, s + n, -1)
            off = np.cumsum(level)[:-1] > 0
            ends = np.cumsum(sizes)
            begins = ends - sizes
            total = np.r_[0, np.cumsum(off)]
            removed = total[ends] - total[begins]
            first = off.copy()
            first[1:] &= ~off[:-1]
            starts = begins[sizes > 0]
            first[starts] = off[starts]  # a run ends with its document
            at = np.flatnonzero(first)
            after = np.append(at, len(off))[1:]
            doc = np.searchsorted(ends, at, "right")
            stop = np.minimum(after, ends[doc])
            n = total[stop] - total[at]
            cuts = np.searchsorted(at, np.r_[begins, len(data)])
            lists = pa.array(cuts.astype(np.int32), pa.int32())
            kept = _blobs(data[~off], np.r_[0, np.cumsum(sizes - removed)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64(), mask=ids == _NONE), pa.array(sizes), pa.array(removed), pa.array(np.diff(cuts).astype(np.int64)),
                    pa.ListArray.from_arrays(lists, pa.array((at - begins[doc]).astype(np.int32))), pa.ListArray.from_arrays(lists, pa.array(n.astype(np.int32))), kept,
                ],
                [f.split()[0] for f in _OUT.split(", ")],
            )


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bucket_bytes: int = 8 << 20, hot_blocks: int = 20_000) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, the removed spans (start and size in bytes) and the kept bytes."""
    named = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text"))
    blocks = settle(named.mapInArrow(_pack, "block long, ids binary, sizes binary, data binary, n_bytes long"))
    total = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    buckets = max(64, -(-total // bucket_bytes))
    asked = blocks.mapInArrow(_asker(buckets), "block long, bucket long, anchors binary")
    dealt = asked.repartition("bucket").sortWithinPartitions("bucket")
    said = dealt.mapInArrow(_answerer(hot_blocks), "block long, bucket long, shared binary, hot binary")
    answers = said.groupBy("block").agg(F.collect_list(F.struct("bucket", "shared", "hot")).alias("answers"))
    sent = blocks.join(answers, "block", "left").mapInArrow(_sender(buckets), _SENT)
    runs = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_resolve, _RUNS)
    gone = runs.groupBy("block").agg(F.collect_list(F.struct("starts", "sizes")).alias("runs"))
    return blocks.join(gone, "block", "left").mapInArrow(_cut, _OUT).withColumnRenamed("id", id_col)
