"""Grams of whole texts, counted inside tasks.

A task numbers the grams of the distinct words of some texts and adds up the
words of each text; no row exists per text and gram.  Tasks hand on how many of
their texts hold a gram, and the corpus's frequencies come back as one table
that every task holds (``gram_table``).  With more than ``MAX_GRAMS`` grams texts
are dealt into blocks of a bounded number of letters instead, a gram leaves a
block once, and what the corpus says of it is joined to the blocks that hold it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BLANK
from ..scale import settle

#: Letters of a block, least letters that are worth one, and grams of texts held at once.
LETTERS, FEW_LETTERS, CELLS = 4_000_000, 500_000, 1 << 19
SIZES = (3, 4, 5)


def _ranks(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, rank): where each distinct key of so many bits stands first, and the rank of every key."""
    room = max(len(key), 1).bit_length()
    if bits + room > 63:
        _, first, rank = np.unique(key, return_index=True, return_inverse=True)
        return first, rank
    both = key << room | np.arange(len(key))
    both.sort()
    place = both & (1 << room) - 1
    opens = np.ones(len(key), bool)
    opens[1:] = np.diff(both >> room) > 0
    rank = np.empty(len(key), np.int64)
    rank[place] = np.cumsum(opens) - 1
    return place[opens], rank


def _numbered(words: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray, str, np.ndarray, np.ndarray, np.ndarray]:
    """(start, number, joined, letters, place, size): gram i stands at ``place[i]`` of the joined words and has ``size[i]`` letters."""
    if isinstance(words, pa.Array):
        sizes = pc.utf8_length(words).to_numpy().astype(np.int64) + 2
        joined = f" {pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words.cast(pa.string())), '  ')[0].as_py()} " if len(words) else ""
    else:
        sizes, joined = np.array([len(w) + 2 for w in words], np.int64), f" {'  '.join(words)} " if words else ""
    letters = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(words)), sizes)
    inside = np.arange(len(letters)) - begin[word]
    left = sizes[word] - inside
    seen = np.zeros(0x110000, bool)
    seen[letters] = True
    letter = (np.cumsum(seen) - 1)[letters]  # fewer bits than the letters, in their order
    bits = int(seen.sum()).bit_length()
    grams = sum(np.maximum(sizes - n + 1, 0) for n in SIZES) if len(words) else sizes
    start = np.concatenate([[0], np.cumsum(grams)])
    number, ahead = np.zeros(start[-1], np.int64), start[:-1].copy()
    shorter, places, lengths, known, high = np.zeros(len(letters), np.int64), [], [], 0, 3 * bits
    for n in SIZES:
        at = np.flatnonzero(left >= n)
        key = (letter[at] << 2 * bits | letter[at + 1] << bits if n == SIZES[0] else shorter[at] << bits) | letter[at + n - 1]
        first, rank = _ranks(key, high)
        shorter[at] = rank
        number[ahead[word[at]] + inside[at]] = rank + known
        ahead += np.maximum(sizes - n + 1, 0)
        places.append(at[first])
        lengths.append(np.full(len(first), n))
        known, high = known + len(first), max(len(first), 1).bit_length() + bits
    return start, number, joined, letters, np.concatenate(places), np.concatenate(lengths)


def gram_numbers(words: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(start, number, grams): the numbers of word w's grams are ``number[start[w]:start[w + 1]]``, in the order of the grams' letters."""
    start, number, joined, _, place, size = _numbered(words)
    return start, number, [joined[i : i + n] for i, n in zip(place.tolist(), size.tolist())]


def gram_keys(letters: np.ndarray, place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hi, lo): three letters and up to two more of each gram, whole, as numbers."""
    at = lambda i: np.where(size > i, letters[np.minimum(place + i, max(len(letters) - 1, 0))] + 1, 0)
    return letters[place] << 42 | letters[place + 1] << 21 | letters[place + 2], at(3) << 21 | at(4)


def _runs(start: np.ndarray, number: np.ndarray, names: int, texts: int, text: np.ndarray, word: np.ndarray, times: np.ndarray):
    """For runs of texts (from, to) the text, number and count of each gram in each: keys of text, gram and count are sorted and summed."""
    bits = int(times.max(initial=1)).bit_length()
    room = max(names, 1).bit_length()
    shifted, sizes = number << bits, start[word + 1] - start[word]
    upto = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(text, np.arange(texts + 1))]
    low, most = 0, 1 << max(0, 62 - bits - room)
    while low < texts:
        high = min(texts, low + most, max(low + 1, int(np.searchsorted(upto, upto[low] + CELLS, "right")) - 1))
        a, b = np.searchsorted(text, [low, high])
        n, ahead = sizes[a:b], np.cumsum(sizes[a:b]) - sizes[a:b]
        key = np.repeat((text[a:b] - low) << room + bits | times[a:b], n) + shifted[np.arange(n.sum()) + np.repeat(start[word[a:b]] - ahead, n)]
        key.sort()
        cell = key >> bits
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        tf = np.add.reduceat(key & (1 << bits) - 1, first) if len(first) else np.zeros(0, np.int64)
        cell = cell[first]
        yield low, high, (cell >> room) + low, cell & (1 << room) - 1, tf.astype(float)
        low = high


def _pairs(codes: np.ndarray, owner: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, times) of the distinct words of each text."""
    key, times = np.unique(owner * known + codes, return_counts=True)
    return key // known, key % known, times


def counted(words: pa.ChunkedArray) -> tuple[list[str], Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]]:
    """The grams of some texts' words, and for runs of texts (from, to) the text, number and count of each gram in each."""
    lists = words.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    coded = lists.flatten().dictionary_encode()
    start, number, names = gram_numbers(coded.dictionary.to_pylist())
    pairs = _pairs(coded.indices.to_numpy(), pc.list_parent_indices(lists).to_numpy(), max(len(coded.dictionary), 1))
    return names, _runs(start, number, len(names), len(lists), *pairs)


# ---- words as runs of letters of one kind, found in the bytes of many texts at once

_BLANK_BYTES = np.ones(256, np.uint8)
_BLANK_BYTES[[*range(9, 14), *range(28, 33)]] = 0
_TERM_BYTES = np.zeros(256, np.uint8)
_TERM_BYTES[[*b"abcdefghijklmnopqrstuvwxyz0123456789_./*-"]] = 1


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts without nulls, and where each begins."""
    texts = texts.cast(pa.large_string())
    cuts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[cuts[0] : cuts[-1]] if len(texts) else np.zeros(0, np.uint8)
    return data, cuts - cuts[0]


def _not_blank(data: np.ndarray) -> np.ndarray:
    """1 for bytes of letters, 0 for those of BLANK."""
    kind = _BLANK_BYTES[data]
    for lead, rest in ((0xC2, ((0x85,), (0xA0,))), (0xE1, ((0x9A, 0x80),)), (0xE2, (*((0x80, x) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0x81, 0x9F))), (0xE3, ((0x80, 0x80),))):
        at = np.flatnonzero(data == lead)
        for tail in rest if len(at) else ():
            fits = at[at + len(tail) < len(data)]
            for i, x in enumerate(tail, 1):
                fits = fits[data[fits + i] == x]
            for i in range(len(tail) + 1):
                kind[fits + i] = 0
    return kind


def _term_kinds(data: np.ndarray) -> np.ndarray:
    """1 for the letters of a term, 2 for Chinese characters, 0 for others."""
    kind = _TERM_BYTES[data]
    at = np.flatnonzero((data >= 0xE4) & (data <= 0xE9))
    at = at[(data[at] > 0xE4) | (data[np.minimum(at + 1, max(len(data) - 1, 0))] >= 0xB8)]
    for i in range(3):
        kind[at + i] = 2
    return kind


def _words(data: np.ndarray, cuts: np.ndarray, kind: np.ndarray, least: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
    """(words, text): runs of one kind; ``least`` has the fewest bytes of a run by kind."""
    opens = np.zeros(len(data), bool)
    opens[1:] = kind[1:] != kind[:-1]
    opens[cuts[:-1][cuts[:-1] < len(data)]] = True
    at = np.flatnonzero(opens)
    sizes, held = np.diff(np.append(at, len(data))), kind[at] > 0
    if least is not None:
        held &= sizes >= least[kind[at]]
    text = np.searchsorted(cuts, at[held], "right") - 1
    offsets = np.concatenate([[0], np.cumsum(sizes[held])])
    return pa.Array.from_buffers(pa.large_string(), len(text), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[np.repeat(held, sizes)])]), text


def blank_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(word, text) of lower-case texts, split at BLANK."""
    data, cuts = _bytes(texts)
    return _words(data, cuts, _not_blank(data))


def index_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(term, text) of lower-case texts without accents: runs of two characters or more, as ``functions.text.tokens`` has them."""
    data, cuts = _bytes(texts)
    return _words(data, cuts, _term_kinds(data), np.array([0, 2, 6]))


# ---- grams without a shuffle of texts: counts of each task's texts, then one table for all tasks

#: Most grams of the table that every task holds (24 bytes each); grams that a task gathers before it hands on their counts; bytes of texts at once.
MAX_GRAMS, GATHERED, PIECE = 4_000_000, 2_000_000, 6_000_000


def pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Rows of about ``PIECE`` bytes of text, at least one."""
    for batch in batches:
        upto = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))])
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(upto, upto[low] + PIECE, "right")) - 1)
            yield batch.slice(low, high - low)
            low = high


def _grams_of(texts: pa.Array):
    """(hi, lo, runs) of some texts."""
    words, owner = blank_words(texts)
    coded = words.dictionary_encode()
    start, number, _, letters, place, size = _numbered(coded.dictionary)
    pairs = _pairs(coded.indices.to_numpy(), owner, max(len(coded.dictionary), 1))
    return *gram_keys(letters, place, size), _runs(start, number, len(place), len(texts), *pairs)


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hi, lo, n = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((lo, hi))
    hi, lo, n = hi[order], lo[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])) if len(hi) else np.zeros(0, np.int64)
    return hi[first], lo[first], np.add.reduceat(n, first) if len(first) else n


def gram_table(texts: DataFrame, text_col: str) -> DataFrame:
    """(hi, lo, df): in how many texts each gram is.  Tasks hand on sums; texts stay where they are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in pieces(batches, "_low"):
            hi, lo, runs = _grams_of(batch.column("_low"))
            n = np.zeros(len(hi), np.int64)
            for _, _, _, number, _ in runs:
                n += np.bincount(number, minlength=len(hi))
            parts.append((hi, lo, n))
            held += len(hi)
            if held > GATHERED:
                parts = [_merged(parts)]
                held = len(parts[0][0])
                if held > GATHERED // 2:
                    yield from emitted(*parts.pop())
                    held = 0
        if parts:
            yield from emitted(*_merged(parts))

    def emitted(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        whole = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["hi", "lo", "n"])
        for at in range(0, whole.num_rows, 100_000):
            yield whole.slice(at, 100_000)

    found = texts.select(F.lower(text_col).alias("_low")).mapInArrow(count, "hi long, lo long, n long")
    return settle(found.groupBy("hi", "lo").agg(F.sum("n").alias("df")))


class GramTable:
    """Frequencies of all grams by a number of 64 bits, which ``fits`` has found to tell all of them apart."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, df: np.ndarray):
        for self.factor in range(3, 103, 2):
            keys = self._mixed(hi, lo)
            order = np.argsort(keys)
            self.keys = keys[order]
            if not (self.keys[1:] == self.keys[:-1]).any():
                break
        else:
            raise ValueError("no factor tells the grams apart")
        self.df, self.hi, self.lo = df[order], hi[order], lo[order]

    def _mixed(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        return (hi.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + lo.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9 * self.factor % 2**64) ^ hi.astype(np.uint64) >> np.uint64(7)

    def places(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Rows of grams that are in the table."""
        keys = self._mixed(hi, lo)
        order = np.argsort(keys)
        out = np.empty(len(keys), np.int64)
        out[order] = np.searchsorted(self.keys, keys[order])
        return out

    def found(self, grams: list[str]) -> np.ndarray:
        """Rows of any grams, -1 where the table has none."""
        letters = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.array([len(g) for g in grams], np.int64)
        hi, lo = gram_keys(letters, np.cumsum(size) - size, size)
        at = np.minimum(self.places(hi, lo), max(len(self.keys) - 1, 0))
        return np.where((self.hi[at] == hi) & (self.lo[at] == lo), at, -1) if len(self.keys) else np.full(len(grams), -1)


# ---- a text's codes and counts as bytes


def _sizes(values: np.ndarray) -> np.ndarray:
    """Bytes of each number, seven bits a byte."""
    size = np.ones(len(values), np.int64)
    for i in range(1, -(-int(values.max(initial=1)).bit_length() // 7)):
        size += values >= 1 << 7 * i
    return size


def _put(out: np.ndarray, at: np.ndarray, values: np.ndarray, size: np.ndarray) -> None:
    out[at] = (values & 127).astype(np.uint8) | (size > 1).astype(np.uint8) << 7
    for i in range(1, int(size.max(initial=1))):
        has = np.flatnonzero(size > i)
        out[at[has] + i] = (values[has] >> 7 * i & 127).astype(np.uint8) | (size[has] > i + 1).astype(np.uint8) << 7


def pack(texts: int, text: np.ndarray, code: np.ndarray, count: np.ndarray) -> list[bytes]:
    """Codes (rising within a text) and counts: how many, steps between codes, the counts over one; numbers of seven bits a byte, compressed behind their length."""
    n = np.bincount(text, minlength=texts)
    first = (np.cumsum(n) - n)[n > 0]
    code = code.astype(np.int64)
    step = np.diff(code, prepend=0)
    step[first] = code[first]
    more = np.flatnonzero(count > 1)
    rest = count[more].astype(np.int64) - 2
    step <<= 1
    step[more] |= 1
    above = np.bincount(text[more], minlength=texts)
    sizes = [_sizes(n), _sizes(step), _sizes(rest)]
    ends = [np.cumsum(x) for x in sizes]
    upto = [np.concatenate([[0], end])[np.cumsum(k)] for end, k in ((ends[1], n), (ends[2], above))]  # bytes up to the end of each text
    cuts = np.concatenate([[0], ends[0] + upto[0] + upto[1]])
    out = np.zeros(int(cuts[-1]), np.uint8)
    _put(out, cuts[:-1], n, sizes[0])
    begins = [cuts[:-1] + sizes[0], cuts[1:] - np.diff(upto[1], prepend=0)]
    for begin, k, end, size, done, values in zip(begins, (n, above), ends[1:], sizes[1:], upto, (step, rest)):
        _put(out, end - size + np.repeat(begin - np.concatenate([[0], done[:-1]]) if len(done) else begin, k), values, size)
    data, cuts, codec = out.tobytes(), cuts.tolist(), pa.Codec("zstd", 1)
    return [(b - a).to_bytes(4, "little") + codec.compress(data[a:b], asbytes=True) for a, b in zip(cuts, cuts[1:])]


def unpack(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, code, count) of what ``pack`` made."""
    codec = pa.Codec("zstd", 1)
    plain = [codec.decompress(b[4:], int.from_bytes(b[:4], "little"), asbytes=True) for b in packed]
    data = np.frombuffer(b"".join(plain), np.uint8)
    closes = np.flatnonzero(data < 128)
    if not len(closes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    start = np.concatenate([[0], closes[:-1] + 1])
    values = (data[start] & 127).astype(np.int64)
    size = closes - start + 1
    for i in range(1, int(size.max())):
        has = np.flatnonzero(size > i)
        values[has] |= (data[start[has] + i] & 127).astype(np.int64) << 7 * i
    head = np.searchsorted(start, np.cumsum([0, *map(len, plain[:-1])]))
    n = values[head]
    text = np.repeat(np.arange(len(packed)), n)
    ahead = np.cumsum(n) - n
    at = np.arange(len(text)) + np.repeat(head + 1 - ahead, n)
    both = values[at]
    total = np.cumsum(both >> 1)
    code = total - np.repeat(np.concatenate([[0], total])[ahead], n)
    count = np.ones(len(text))
    more = both & 1 == 1
    rest = np.ones(len(values), bool)
    rest[head] = rest[at] = False
    count[more] = values[rest] + 2
    return text, code, count


def worded_blocks(texts: DataFrame, key: str, text_col: str, letters: int) -> DataFrame:
    """``texts`` with their words (column _words) and block (column _block), dealt by block."""
    spread = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated: adaptive execution would merge blocks before they are counted
    blocks = max(1, -(-letters // LETTERS), min(4 * spread, -(-letters // FEW_LETTERS)))
    words = F.array_remove(F.split(F.lower(F.col(text_col)), f"{BLANK}+"), "")
    return texts.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).repartition(spread, "_block").withColumn("_words", words)


def block_grams(blocks: DataFrame) -> DataFrame:
    """(_block, number, gram, df): the grams of each block, df being the number of texts of all blocks with the gram."""

    def count(rows: pa.Table) -> pa.Table:
        names, runs = counted(rows["_words"])
        texts = np.zeros(len(names), np.int64)
        for _, _, _, number, _ in runs:
            texts += np.bincount(number, minlength=len(names))
        block = np.full(len(names), rows["_block"][0].as_py(), np.int32)
        return pa.table({"_block": block, "number": np.arange(len(names), dtype=np.int32), "gram": pa.array(names, pa.string()), "n": texts})

    found = blocks.select("_block", "_words").groupBy("_block").applyInArrow(count, "_block int, number int, gram string, n long")
    return settle(found.select("_block", "number", "gram", F.sum("n").over(Window.partitionBy("gram")).alias("df")))


def with_grams(blocks: DataFrame, rated: DataFrame, name: str) -> DataFrame:
    """Texts with their wanted grams and the square of their norm; ``rated`` is (_block, number, idf, code), code null for a gram that isn't wanted."""
    rest = [c for c in blocks.columns if c not in ("_block", "_words")]
    kinds = dict(blocks.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in rest) + f", {name} array<struct<code:int,x:double>>, _square double"

    def rate(rows: pa.Table, grams: pa.Table) -> pa.Table:
        names, runs = counted(rows["_words"])
        idf, code = np.zeros(len(names)), np.full(len(names), -1, np.int32)
        idf[grams["number"].to_numpy()] = grams["idf"].to_numpy()
        code[grams["number"].to_numpy()] = pc.fill_null(grams["code"], -1).to_numpy()
        square, sizes, codes, counts = np.zeros(rows.num_rows), np.zeros(rows.num_rows, np.int64), [], []
        for low, high, text, number, tf in runs:
            square[low:high] = np.bincount(text - low, (tf * idf[number]) ** 2, high - low)
            asked = code[number] >= 0
            sizes[low:high] = np.bincount(text[asked] - low, minlength=high - low)
            codes.append(code[number[asked]])
            counts.append(tf[asked])
        none = [np.zeros(0, np.int32)], [np.zeros(0)]
        flat = pa.StructArray.from_arrays([pa.array(np.concatenate(codes or none[0])), pa.array(np.concatenate(counts or none[1]))], ["code", "x"])
        cuts = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        columns = [rows[c].cast(pa.list_(rows[c].type.value_type)) if pa.types.is_list(rows[c].type) else rows[c] for c in rest]  # elements as the schema has them
        return pa.Table.from_arrays([*columns, pa.ListArray.from_arrays(cuts, flat), pa.array(square, mask=square == 0)], [*rest, name, "_square"])

    return blocks.groupBy("_block").cogroup(rated.groupBy("_block")).applyInArrow(rate, schema)
