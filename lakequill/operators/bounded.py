"""Retrieval without a table of question-by-text scores.

Texts become compact rows that hold what the questions can meet: their terms with
BM25 saturations, their n-grams with the text's norm.  A pass over these rows
multiplies blocks of texts with the questions' weights inside the tasks and only
keeps what its reducers ask for: peaks per question, the k best texts or files,
the best texts of given files, sums per file, or how many rows beat a given one.
So a task hands on at most k rows per question, however many texts there are.

Blocks carry bounds: the largest value of each term in a block, times the
question's weights, is more than any of its texts can reach (per signal).  Once a
question has its k best so far, blocks below the k-th are not multiplied for it.

Questions are the bounded side: sets of more than ``MAX_QUERIES``, or with more
weights than ``MAX_WEIGHTS``, are cut into blocks of questions, one run each.
Texts of one file lie side by side; files of more than ``PART`` texts are cut into
parts and their sums are added up afterwards, so that no file is one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import BM25_B, BM25_K1
from ..functions.text import strip_accents
from ..scale import broadcast_if_small, is_small, settle
from . import gramrows
from .bm25 import query_terms
from .chargram import gram_counts
from .gramrows import GramTable, block_grams, gram_table, index_terms, pack, pieces, unpack, with_grams, worded_blocks

MAX_QUERIES, MAX_WEIGHTS = 2048, 1_000_000
BLOCK, PART, DENSE, SPREAD = 256, 4096, 8_000_000, 1000
PAIR = 128  # cells of a matrix product that take the time of one text's and question's pair
TERMS, GRAMS, GRAMS_QUERY = "terms", "grams", "grams_query"  # signals; the last fits its idf on texts and question


@dataclass
class Saturation:
    """BM25's value of a term that a text of so many terms holds so often."""

    k1: float
    b: float
    average: float

    def of(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return tf / (tf + self.k1 * ((1 - self.b) + self.b * (np.maximum(length, 1) / self.average)))


@dataclass
class Weights:
    """Questions' weights by term: rows of a sparse matrix (terms by questions)."""

    start: np.ndarray
    owner: np.ndarray
    value: np.ndarray
    shift: np.ndarray | None
    questions: int
    saturation: Saturation | None = None
    _dense: dict = field(default_factory=dict)

    @classmethod
    def of(cls, rows, vocabulary: list, names: list, shift: bool = False) -> Weights:
        code = {u: i for i, u in enumerate(vocabulary)}
        at = {q: i for i, q in enumerate(names)}
        units = np.array([code[u] for u in rows["u"]], np.int64)
        order = np.argsort(units, kind="stable")
        owner = np.array([at[q] for q in rows["q"]], np.int64)[order]
        start = np.searchsorted(units[order], np.arange(len(vocabulary) + 1))
        return cls(start, owner, rows["w"].to_numpy(float)[order], rows["s"].to_numpy(float)[order] if shift else None, len(names))

    def dense(self, codes: np.ndarray, what: str = "value") -> np.ndarray:
        """The rows of the given terms as a dense matrix."""
        if (len(self.start) - 1) * self.questions <= DENSE:
            if what not in self._dense:
                self._dense[what] = self._rows(np.arange(len(self.start) - 1), what)
            return self._dense[what][codes]
        return self._rows(codes, what)

    def _rows(self, codes: np.ndarray, what: str) -> np.ndarray:
        out = np.zeros((len(codes), self.questions))
        row, entry = self.entries(codes)
        out[row, self.owner[entry]] = getattr(self, what)[entry]
        return out

    def entries(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i, entry) of all weights of the i-th term."""
        sizes = self.start[codes + 1] - self.start[codes]
        row = np.repeat(np.arange(len(codes)), sizes)
        return row, np.arange(len(row)) + np.repeat(self.start[codes] - np.cumsum(sizes) + sizes, sizes)


def _entries(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, code, x) of packed texts, or of lists of code and x."""
    if not pa.types.is_list(column.type):
        return unpack(column.to_pylist())
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return pc.list_parent_indices(lists).to_numpy(), lists.flatten().field("code").to_numpy(), lists.flatten().field("x").to_numpy()


class Block:
    """Some texts: their values per signal, in the order of the terms that occur."""

    def __init__(self, rows: pa.Table, weights: dict[str, Weights]):
        self.rows, self.n = rows, rows.num_rows
        self.parts = {}
        for name, w in weights.items():
            owner, code, x = _entries(rows[name])
            if w.saturation is not None:
                x = w.saturation.of(x, rows["_dl"].to_numpy()[owner])
            key = code.astype(np.int64) << 32 | np.arange(len(code))
            key.sort()  # by term
            code, order = key >> 32, key & 0xFFFFFFFF
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
            self.parts[name] = (owner[order], x[order], code[first], np.append(first, len(code)), rows[f"{name}_norm"].to_numpy())

    def bounds(self, weights: dict[str, Weights]) -> list[np.ndarray]:
        """Per signal what no text of the block exceeds, for every question."""
        out = []
        for name, w in weights.items():
            owner, x, used, first, norm = self.parts[name]
            if w.shift is not None:  # the norm depends on the question
                out.append(np.full(w.questions, np.inf))
            else:
                most = np.maximum.reduceat(x / norm[owner], first[:-1]) if len(used) else x
                unit, entry = w.entries(used)
                out.append(np.bincount(w.owner[entry], np.maximum(most, 0)[unit] * np.maximum(w.value[entry], 0), w.questions) * (1 + 1e-9))
        return out

    def scores(self, weights: dict[str, Weights], active: np.ndarray) -> list[np.ndarray]:
        out = []
        for name, w in weights.items():
            owner, x, used, first, norm = self.parts[name]
            if w.shift is None:
                out.append(self._product(owner, x, used, first, w, "value", active) / norm[:, None])
            else:
                shift = self._product(owner, x * x, used, first, w, "shift", active)
                out.append(self._product(owner, x, used, first, w, "value", active) / np.sqrt(norm[:, None] + shift))
        return out

    def _product(self, owner, x, used, first, w: Weights, what: str, active: np.ndarray) -> np.ndarray:
        """Texts by questions: terms that many texts and questions share as matrices, the others pair by pair."""
        sizes = np.diff(first)
        heavy = sizes * (w.start[used + 1] - w.start[used]) * PAIR > self.n * len(active)
        taken = np.repeat(heavy, sizes)
        values = np.zeros((self.n, int(heavy.sum())))
        values[owner[taken], np.repeat(np.arange(values.shape[1]), sizes[heavy])] = x[taken]
        rows = w.dense(used[heavy], what)
        dots = values @ (rows if len(active) == w.questions else rows[:, active])
        unit, entry = w.entries(np.repeat(used[~heavy], sizes[~heavy]))
        pairs = np.bincount(owner[~taken][unit] * w.questions + w.owner[entry], x[~taken][unit] * getattr(w, what)[entry], self.n * w.questions)
        return dots + pairs.reshape(self.n, w.questions)[:, active]


@dataclass
class Mixer:
    """Final score of a text: the signals over their peaks, weighted and rounded; with one signal just rounded."""

    shares: list[float]
    peaks: list[np.ndarray] | None
    digits: int

    def mix(self, signals: list[np.ndarray], active=slice(None)) -> np.ndarray:
        total = 0.0
        for k, (share, s) in enumerate(zip(self.shares, signals)):
            if self.peaks is not None:
                peak = self.peaks[k][active]
                s = np.where(peak > 0, s / np.where(peak > 0, peak, 1.0), 0.0)
            total = total + share * s
        return np.round(total, self.digits)


class Peaks:
    """Largest value of every signal per question, and of the final score."""

    kinds = (0,)

    def __init__(self, questions: int, signals: int):
        self.best, self.least = np.zeros((signals + 1, questions)), None

    def add(self, block: Block, active, signals, final, labels) -> None:
        for best, s in zip(self.best, [*signals, final]):
            best[active] = np.maximum(best[active], s.max(axis=0, initial=0.0))

    def rows(self):
        for q in np.flatnonzero(self.best.max(axis=0) > 0):
            yield 0, q, None, None, self.best[0][q], self.best[1][q] if len(self.best) > 2 else 0.0, 0, self.best[-1][q]


class Top:
    """The k best labels (texts or files) per question by score and bonus, best text each; ties to the smaller label."""

    def __init__(self, questions: int, k: int, by: str, kind: int, hints: np.ndarray | None = None, larger_text: bool = True):
        self.k, self.by, self.kind, self.hints, self.larger = k, by, kind, hints, larger_text
        self.found: list[dict] = [{} for _ in range(questions)]
        self.least = np.full(questions, -np.inf)

    def add(self, block: Block, active, signals, final, labels) -> None:
        total = final if self.hints is None else np.round(final + labels["bonus"][:, self.hints[active]], 9)
        hit = (final > 0) & (total >= self.least[active])
        names, ids, files = labels[self.by], labels["id"], labels["file"]
        for j in np.flatnonzero(hit.any(axis=0)):
            q = active[j]
            found = self.found[q]
            for i in np.flatnonzero(hit[:, j]):
                old = found.get(names[i])
                one = (final[i, j], ids[i])
                if old is None or one[0] > old[1] or (one[0] == old[1] and (one[1] > old[2]) == self.larger):
                    found[names[i]] = (total[i, j], *one, files[i], *[s[i, j] for s in signals])
            if len(found) > 4 * self.k:
                self._prune(q)

    def _prune(self, q: int) -> None:
        kept = sorted(self.found[q].items(), key=lambda x: (-x[1][0], x[0]))[: self.k]
        self.found[q] = dict(kept)
        if len(kept) == self.k:
            self.least[q] = kept[-1][1][0]

    def rows(self):
        for q, found in enumerate(self.found):
            self._prune(q)
            for _, final, text, name, *signals in self.found[q].values():
                yield self.kind, q, text, name, signals[0], signals[1] if len(signals) > 1 else 0.0, 0, final


class Wanted:
    """The m best texts of every (question, label) pair asked for: rows carry the questions that want them."""

    least = None

    def __init__(self, m: int, kind: int, by: str = "file", larger_text: bool = False):
        self.m, self.kind, self.by, self.larger = m, kind, by, larger_text
        self.found: dict = {}

    def add(self, block: Block, active, signals, final, labels) -> None:
        place = {q: j for j, q in enumerate(active)}
        for i, wanted in enumerate(labels["wanted"]):
            for q in wanted or ():
                j = place[q]
                if final[i, j] > 0:
                    self.found.setdefault((q, labels[self.by][i]), []).append((final[i, j], labels["id"][i], labels["file"][i], *[s[i, j] for s in signals]))
        for key, rows in self.found.items():
            if len(rows) > self.m:
                rows.sort(key=lambda r: r[1], reverse=self.larger)
                rows.sort(key=lambda r: -r[0])
                del rows[self.m :]

    def rows(self):
        for (q, _), rows in self.found.items():
            for final, text, name, *signals in rows:
                yield self.kind, q, text, name, signals[0], signals[1] if len(signals) > 1 else 0.0, 0, final


class Better:
    """How many texts, and how many files by their best text, beat a given score and label per question."""

    least = None

    def __init__(self, texts: tuple | None, files: tuple | None):
        self.texts, self.files = texts, files
        n = len((texts or files)[0])
        self.count, self.whole, self.open = np.zeros(n, np.int64), np.zeros(n, np.int64), {}
        self.last, self.beaten = None, np.zeros(n, bool)

    @staticmethod
    def _beats(final: np.ndarray, names: list, score: np.ndarray, label: list) -> np.ndarray:
        out = final > score
        for i, j in np.argwhere(final == score):
            out[i, j] = final[i, j] > 0 and label[j] is not None and names[i] < label[j]
        return out

    def add(self, block: Block, active, signals, final, labels) -> None:
        if self.texts is not None:
            self.count += self._beats(final, labels["id"], *self.texts).sum(axis=0)
        if self.files is None:
            return
        beats = self._beats(final, labels["file"], *self.files)
        for i, (name, whole) in enumerate(zip(labels["file"], labels["whole"])):
            if not whole:
                for q in np.flatnonzero(beats[i]):
                    self.open[q, name] = True
                continue
            if name != self.last:
                self._close()
                self.last = name
            self.beaten |= beats[i]

    def _close(self) -> None:
        self.whole += self.beaten
        self.beaten[:] = False

    def rows(self):
        self._close()
        for q in np.flatnonzero(self.count):
            yield 10, q, None, None, 0.0, 0.0, self.count[q], 0.0
        for q in np.flatnonzero(self.whole):
            yield 11, q, None, None, 0.0, 0.0, self.whole[q], 0.0
        for q, name in self.open:
            yield 12, q, None, name, 0.0, 0.0, 1, 0.0


class Sums:
    """Per file the sum of final scores and bonuses of its texts: the k best files, wanted ones, and parts of cut files."""

    least = None

    def __init__(self, questions: int, k: int, hints: np.ndarray):
        self.k, self.hints, self.questions = k, hints, questions
        self.top: list[list] = [[] for _ in range(questions)]
        self.low = np.full(questions, -np.inf)
        self.kept: list = []
        self.name = None

    def add(self, block: Block, active, signals, final, labels) -> None:
        shown = np.where(final > 0, final + labels["bonus"][:, self.hints], 0.0)
        for i, (name, part, whole, text) in enumerate(zip(labels["file"], labels["part"], labels["whole"], labels["id"])):
            if (name, part) != self.name:
                self._close()
                n = self.questions
                self.name, self.whole, self.ask = (name, part), whole, set()
                self.sum, self.n, self.best, self.text = np.zeros(n), np.zeros(n, np.int64), np.zeros((3, n)), np.full(n, None, object)
            self.ask.update(labels["wanted"][i] or ())
            self.sum += shown[i]
            self.n += final[i] > 0
            better = final[i] > self.best[0]
            for q in np.flatnonzero((final[i] == self.best[0]) & (final[i] > 0)):  # a tie goes to the larger text id
                better[q] = text > self.text[q]
            self.text[better] = text
            for row, values in zip(self.best, (final, *signals)):
                row[better] = values[i, better]

    def _row(self, q: int) -> tuple:
        return self.sum[q], self.name[0], self.n[q], self.text[q], self.best[1, q], self.best[2, q]

    def _close(self) -> None:
        if self.name is None:
            return
        hit = self.n > 0
        if not self.whole:
            self.kept += [(q, self._row(q)) for q in np.flatnonzero(hit)]
            return
        self.kept += [(q, self._row(q)) for q in self.ask if hit[q]]
        for q in np.flatnonzero(hit & (np.round(self.sum, 9) >= self.low)):
            if q not in self.ask:
                self.top[q].append(self._row(q))
                if len(self.top[q]) > 4 * self.k:
                    self._prune(q)

    def _prune(self, q: int) -> None:
        self.top[q] = sorted(self.top[q], key=lambda r: (-np.round(r[0], 9), r[1]))[: self.k]
        if len(self.top[q]) == self.k:
            self.low[q] = np.round(self.top[q][-1][0], 9)

    def rows(self):
        self._close()
        for q in range(self.questions):
            self._prune(q)
        for q, (total, name, n, text, v, b) in [*self.kept, *[(q, row) for q, rows in enumerate(self.top) for row in rows]]:
            yield 20, q, text, name, v, b, n, total


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield pa.Table.from_batches([batch.slice(at, BLOCK)])


def _pass(shared, make: Callable, mixer: Mixer, schema: list[str], types: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights: dict[str, Weights] = shared.value
        questions = next(iter(weights.values())).questions
        reducers = make()
        every = np.arange(questions)
        for rows in _arrays(batches):
            block = Block(rows, weights)
            labels = {c: rows[c].to_pylist() for c in ("id", "file", "part", "whole", "wanted") if c in rows.column_names}
            if "bonus" in rows.column_names:
                labels["bonus"] = np.array(rows["bonus"].to_pylist(), float)
            active = every
            ranked = [r for r in reducers if not isinstance(r, Wanted)]
            if all(r.least is not None for r in ranked):  # a question no text of the block can matter to is left out
                needed = np.zeros(questions, bool)
                needed[[q for asks in labels.get("wanted", ()) for q in asks or ()]] = True
                if ranked:
                    reach = mixer.mix(block.bounds(weights)) + (labels["bonus"].max() if "bonus" in labels else 0.0) + 10.0**-mixer.digits
                    needed |= reach >= np.min([r.least for r in ranked], axis=0)
                active = np.flatnonzero(needed)
            if len(active):
                signals = block.scores(weights, active)
                final = mixer.mix(signals, active)
                for r in reducers:
                    r.add(block, active, signals, final, labels)
        found = [row for r in reducers for row in r.rows()]
        columns = list(zip(*found)) or [[] for _ in schema]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], schema)

    return run


@dataclass
class Index:
    """Texts ready for passes with one block of questions."""

    texts: DataFrame
    names: list
    asked: DataFrame
    shared: object
    signals: list[str]
    shares: list[float]
    digits: int
    id_type: str
    file_type: str
    qid: str
    hints: np.ndarray | None = None
    peaks: list[np.ndarray] | None = None

    def scan(self, make: Callable[[], list], wanted: DataFrame | None = None, by: str = "file") -> DataFrame:
        """Rows (qid, kind, id, file, v, b, n, score) of the reducers; ``wanted`` has (qid, label) pairs for them."""
        rows = self.texts
        if wanted is not None:
            pairs = wanted.join(F.broadcast(self.asked), self.qid).groupBy(F.col("label").alias(by)).agg(F.collect_set("_q").alias("wanted"))
            if is_small(pairs := settle(pairs)):  # texts stay where they are
                rows = rows.join(F.broadcast(pairs), by, "left")
            else:
                rows = rows.join(pairs, by, "left").repartition("file", "part").sortWithinPartitions("file", "part")
        schema = f"kind int, _q int, id {self.id_type}, file {self.file_type}, v double, b double, n long, score double"
        arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "long": pa.int64()}
        names = [f.split()[0] for f in schema.split(", ")]
        types = [arrow[f.split()[1]] for f in schema.split(", ")]
        mixer = Mixer(self.shares, self.peaks, self.digits)
        found = rows.mapInArrow(_pass(self.shared, make, mixer, names, types), schema)
        return found.join(F.broadcast(self.asked), "_q").drop("_q")

    def shares_of(self) -> tuple[Column, Column]:
        """Signals over their peaks, of rows of ``scan`` after ``fit_peaks``."""
        return tuple(F.when(F.col(p) > 0, F.col(s) / F.col(p)).otherwise(F.lit(0.0)) for s, p in (("v", "pv"), ("b", "pb")))

    def fit_peaks(self) -> Index:
        """The first pass: each signal's largest value per question, so that later passes can mix them."""
        n, signals = len(self.names), len(self.signals)
        found = self.scan(lambda: [Peaks(n, signals)]).groupBy(self.qid).agg(F.max("v").alias("v"), F.max("b").alias("b")).toPandas()
        at = {q: i for i, q in enumerate(self.names)}
        peaks = [np.zeros(n) for _ in self.signals]
        for q, v, b in zip(found[self.qid], found["v"], found["b"]):
            peaks[0][at[q]] = v
            if signals > 1:
                peaks[1][at[q]] = b
        self.peaks = peaks
        found = [(i, q, *[float(p[i]) for p in peaks], *[0.0] * (2 - signals)) for i, q in enumerate(self.names)]
        self.asked = self.asked.sparkSession.createDataFrame(found, f"_q int, {self.qid} {dict(self.asked.dtypes)[self.qid]}, pv double, pb double")
        return self


def _parts(texts: DataFrame) -> DataFrame:
    """part and whole: files of more than ``PART`` texts are cut."""
    large = texts.groupBy("file").agg(F.count("*").alias("_n")).filter(F.col("_n") > PART)
    cut = texts.join(broadcast_if_small(settle(large)), "file", "left")
    part = F.coalesce(F.pmod(F.xxhash64("id"), F.ceil(F.col("_n") / PART)), F.lit(0)).cast("int")
    return cut.withColumn("part", part).withColumn("whole", F.col("_n").isNull()).drop("_n")


def question_blocks(queries: DataFrame, qid: str) -> list[DataFrame]:
    """The questions in blocks of a bounded number and weight."""
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("ask") * 3), F.lit(0)).alias("w")).first()
    blocks = max(1, -(-size["n"] // MAX_QUERIES), -(-size["w"] // MAX_WEIGHTS))
    if blocks == 1:
        return [queries]
    return [b for i in range(blocks) if not (b := queries.filter(F.pmod(F.xxhash64(qid), F.lit(blocks)) == i)).isEmpty()]


def index(
    texts: DataFrame, queries: DataFrame, *, signals: list[str], id_col: str, text_col: str, qid: str, query_col: str, file_col: str | None = None,
    shares: list[float] = [1.0], digits: int = 6, bonus: list[Column] | None = None, hint: Column | None = None, k1: float = BM25_K1, b: float = BM25_B,
    stored: bool = False,
) -> list[Index]:
    """One index per block of questions: texts with the values of ``signals`` (one or two).

    ``bonus`` are per-text amounts, of which ``hint`` (an integer per question) picks one.
    ``stored`` texts are read again where they are needed; others are kept first.
    """
    base = texts.select(F.col(id_col).alias("id"), F.col(file_col or id_col).alias("file"), F.coalesce(text_col, F.lit("")).alias("text"), *([F.array(*bonus).alias("bonus")] if bonus else []))
    base = _parts(base) if stored else settle(_parts(base))
    asked = settle(queries.select(qid, F.coalesce(query_col, F.lit("")).alias("ask"), (hint if hint is not None else F.lit(0)).alias("hint")))
    grams = None
    if set(signals) - {TERMS}:  # the texts' grams don't depend on the questions
        table = gram_table(base, "text")
        if table.count() <= gramrows.MAX_GRAMS:
            held = table.toArrow()
            known = GramTable(*(held[c].to_numpy() for c in ("hi", "lo", "df")))
            grams = base.count(), known, base.sparkSession.sparkContext.broadcast(known)
        else:
            base = settle(base.withColumn("tid", F.monotonically_increasing_id()))
            size = base.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("letters")).first()
            grams = (*size, block_grams(worded_blocks(base, "tid", "text", size["letters"])))
    return [_index(base, part, grams, signals, qid, shares, digits, k1, b) for part in question_blocks(asked, qid)]


def _index(base: DataFrame, queries: DataFrame, grams: tuple | None, signals: list[str], qid: str, shares: list[float], digits: int, k1: float, b: float) -> Index:
    spark = base.sparkSession
    rows = queries.select(qid, "hint").toPandas()  # one block of questions
    names = rows[qid].tolist()
    texts, weights, steps, terms = base, {}, [], None
    for name in sorted(signals):
        if name == TERMS:
            wanted = query_terms(queries, qid, "ask").toPandas()
            terms = sorted(set(wanted["term"]))
            steps.append((_term_codes(spark.sparkContext.broadcast(pa.array(terms, pa.large_string()))), [("terms", "binary", pa.binary()), ("_dl", "int", pa.int32())]))
        else:
            texts, weights[name], step = _grams(texts, grams, queries, qid, name)
            steps.append((step, [(name, "binary", pa.binary()), ("_square", "double", pa.float64())]))
    keep = [c for c in ("id", "file", "part", "whole", "bonus") if c in base.columns]
    texts = _together(settle(_coded(texts, keep, steps).sortWithinPartitions("file", "part")))
    for name in signals:
        if name == TERMS:
            weights[name] = _terms(texts, wanted, terms, qid, names, k1, b)
            norm = F.lit(1.0)
        else:
            weights[name] = Weights.of(*weights[name], names, name == GRAMS_QUERY)
            norm = F.col("_square") if name == GRAMS_QUERY else F.sqrt("_square")
        texts = texts.withColumn(f"{name}_norm", norm)
    asked = spark.createDataFrame([(i, q) for i, q in enumerate(names)], f"_q int, {qid} {dict(queries.dtypes)[qid]}")
    kinds = dict(base.dtypes)
    return Index(texts, names, asked, spark.sparkContext.broadcast({s: weights[s] for s in signals}), signals, shares, digits, kinds["id"], kinds["file"], qid, rows["hint"].to_numpy())


def _together(texts: DataFrame) -> DataFrame:
    """Texts of which a whole file, or its part, lies in one partition: files that some partitions share are brought together, many such with all others."""
    at = texts.select("file", F.spark_partition_id().alias("_p")).groupBy("file").agg(F.min("_p").alias("_a"), F.max("_p").alias("_b"))
    spread = settle(at.filter("_a < _b").select(F.col("file").alias("_file")))
    n = spread.count()
    if n > max(SPREAD, 2 * texts.rdd.getNumPartitions()):
        return settle(texts.repartition("file", "part").sortWithinPartitions("file", "part"))
    if not n:
        return texts
    far = F.col("file").eqNullSafe(F.col("_file"))
    moved = settle(texts.join(F.broadcast(spread), far, "left_semi").repartition("file", "part").sortWithinPartitions("file", "part"))
    return texts.join(F.broadcast(spread), far, "left_anti").unionByName(moved)


def _coded(texts: DataFrame, keep: list[str], steps: list[tuple]) -> DataFrame:
    """``keep`` and the columns that each step makes of a piece of texts (lower case, _low; without accents, _folded); texts are read once."""
    made = [column for _, columns in steps for column in columns]
    schema = ", ".join([f"{c} {dict(texts.dtypes)[c]}" for c in keep] + [f"{c} {kind}" for c, kind, _ in made])
    types = [t for _, _, t in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in pieces(batches, "_folded"):
            found = [pa.array(column, t) for column, t in zip((column for step, _ in steps for column in step(rows)), types)]
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in keep], *found], [*keep, *[c for c, _, _ in made]])

    rest = [c for c in texts.columns if c not in keep and c not in ("text", "tid")]
    low = F.lower("text")
    return texts.select(*keep, *rest, low.alias("_low"), strip_accents(low).alias("_folded")).mapInArrow(run, schema)


def _term_codes(known):
    def step(rows: pa.RecordBatch) -> tuple[list, np.ndarray]:
        words, text = index_terms(rows.column("_folded"))
        code = pc.index_in(words, known.value)
        hit = pc.is_valid(code).to_numpy(zero_copy_only=False)
        room = max(len(known.value), 1)
        key, tf = np.unique(text[hit] * room + pc.drop_null(code).to_numpy(), return_counts=True)
        return pack(rows.num_rows, key // room, key % room, tf), np.bincount(text, minlength=rows.num_rows).astype(np.int32)

    return step


def _terms(texts, wanted, units, qid, names, k1, b):
    """BM25: saturation of each question term in the text.  What the corpus says comes from the texts' counted terms."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(units), np.int64)
        for batch in batches:
            df += np.bincount(unpack(batch.column("terms").to_pylist())[1], minlength=len(units))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["code", "n"])

    total = texts.agg(F.count("*").alias("n"), F.avg("_dl").alias("dl")).first()
    freq = texts.select("terms").mapInArrow(held, "code int, n long").groupBy("code").agg(F.sum("n").alias("df")).toPandas()  # at most the questions' terms
    df = dict(zip((units[c] for c in freq["code"]), freq["df"]))
    rows = wanted[wanted["term"].isin(df)]
    rows = rows.assign(df=[df[t] for t in rows["term"]])
    idf = np.log(1 + (total["n"] - rows["df"] + 0.5) / (rows["df"] + 0.5)).astype(float)
    rows = rows.assign(q=rows[qid], u=rows["term"], w=rows["qtf"] * idf * (k1 + 1))
    average = max(total["dl"] or 0.0, 1e-6)
    weights = Weights.of(rows, units, names)
    weights.saturation = Saturation(k1, b, average)
    return weights


def _grams(texts, grams, queries, qid, name):
    """Cosine of TF-IDF n-grams; all grams of a text enter its norm, only the questions' grams stay.

    Returns the texts, the questions' weights with their grams, and the step that makes codes and the square of the norm of a piece of texts.
    """
    n, letters, seen = grams
    wanted, with_query = settle(gram_counts(queries, qid, "ask")), name == GRAMS_QUERY
    if tabled := isinstance(letters, GramTable):
        asked = wanted.select(F.col(qid).alias("q"), F.col("gram").alias("u"), "tf").toPandas()
        at = letters.found(asked["u"].tolist())
        asked["df"] = np.where(at >= 0, letters.df[at] if len(letters.df) else 0, 0)
    else:
        freq = settle(seen.join(broadcast_if_small(wanted.select("gram").distinct()), "gram", "left_semi").select("gram", "df").distinct())
        asked = wanted.join(freq, "gram", "left").select(F.col(qid).alias("q"), F.col("gram").alias("u"), "tf", F.coalesce("df", F.lit(0)).alias("df")).toPandas()
    if not with_query:
        asked = asked[asked["df"] > 0]
    log = lambda top, extra: np.log((top + n) / (extra + asked["df"].to_numpy(float))) + 1
    plain = log(2, 1) if with_query else log(1, 1)
    asked = asked.assign(idf=log(2, 2) if with_query else plain)
    asked["qw"] = asked["tf"] * asked["idf"]
    norm = np.sqrt((asked["qw"] ** 2).groupby(asked["q"]).transform("sum"))
    asked["w"], asked["s"] = asked["qw"] / norm * asked["idf"], asked["idf"] ** 2 - plain**2
    asked = asked[asked["df"] > 0]
    units = asked[["u", "df"]].drop_duplicates().sort_values(["df", "u"], ascending=[False, True])["u"].tolist()  # frequent ones have small codes
    top = 2 if with_query else 1
    if tabled:
        places = letters.found(units)
        order = np.argsort(places)
        shared = texts.sparkSession.sparkContext.broadcast((places[order], order.astype(np.int32)))
        return texts, (asked, units), _gram_codes(seen, shared, n + top)
    codes = texts.sparkSession.createDataFrame(list(zip(units, range(len(units)))), "gram string, code int")
    idf = F.log((F.lit(top) + n) / (F.lit(1) + F.col("df"))) + 1
    rated = seen.join(F.broadcast(codes), "gram", "left").select("_block", "number", idf.alias("idf"), "code")
    return with_grams(worded_blocks(texts, "tid", "text", letters), rated, name).withColumnRenamed("_square", "_given"), (asked, units), _given_codes(name)


def _square(square: np.ndarray) -> np.ndarray:
    return np.where(square > 0, square, 1.0)


def _gram_codes(table, shared, top: int):
    """Codes and norms of texts by the table of all grams."""

    def step(rows: pa.RecordBatch) -> tuple[list, np.ndarray]:
        hi, lo, runs = gramrows._grams_of(rows.column("_low"))
        place, (known, codes) = table.value.places(hi, lo), shared.value
        idf = np.log(top / (1 + table.value.df[place].astype(float))) + 1
        at = np.minimum(np.searchsorted(known, place), max(len(known) - 1, 0))
        code = np.where(known[at] == place, codes[at], -1) if len(known) else np.full(len(place), -1)
        square, packed = np.zeros(rows.num_rows), []
        for low, high, text, number, tf in runs:
            square[low:high] = np.bincount(text - low, (tf * idf[number]) ** 2, high - low)
            own = code[number]
            asked = own >= 0
            packed += _packed(high - low, text[asked] - low, own[asked], tf[asked])
        return packed, _square(square)

    return step


def _given_codes(name: str):
    """Codes and norms that ``with_grams`` has found."""

    def step(rows: pa.RecordBatch) -> tuple[list, np.ndarray]:
        lists = rows.column(name)
        flat = lists.flatten()
        packed = _packed(rows.num_rows, pc.list_parent_indices(lists).to_numpy(), flat.field("code").to_numpy(), flat.field("x").to_numpy())
        return packed, _square(pc.fill_null(rows.column("_given"), 0.0).to_numpy())

    return step


def _packed(texts: int, text: np.ndarray, code: np.ndarray, count: np.ndarray) -> list[bytes]:
    bits, count = int(count.max(initial=1)).bit_length(), count.astype(np.int64)
    room = int(code.max(initial=0)).bit_length()
    key = text.astype(np.int64) << room + bits | code.astype(np.int64) << bits | count
    key.sort()
    return pack(texts, key >> room + bits, key >> bits & (1 << room) - 1, key & (1 << bits) - 1)


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def best_texts(indexes: list[Index], k: int) -> DataFrame:
    """(qid, kind 1, id, file, v, b, n, score): at most k rows per question and task, the k best texts among them."""
    return union([ix.scan(lambda n=len(ix.names): [Top(n, k, "id", 1)]) for ix in indexes])


def peak_scores(indexes: list[Index]) -> DataFrame:
    """(qid, v): the best raw value of the first signal, for questions that reach any text."""
    found = union([ix.scan(lambda n=len(ix.names), s=len(ix.signals): [Peaks(n, s)]) for ix in indexes])
    return found.groupBy(indexes[0].qid).agg(F.max("v").alias("v"))
