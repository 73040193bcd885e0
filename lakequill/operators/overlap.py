"""Best texts by how many words of a question occur anywhere in them.

Which words of the texts hold a question's word is known per distinct word.
Texts are dealt into blocks; that knowledge comes to the blocks that have the
word, and a task counts a block's texts against the questions and hands on at
most k of them per question.  No row exists per text and question, nor per text
and word of a question.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import settle
from .containment import contains_pairs
from .ranking import top_k

#: Letters of a block, least letters that are worth one, entries of texts by questions' words held at once, and most words of a run's questions.
LETTERS, FEW_LETTERS, CELLS, WEIGHTS = 4_000_000, 250_000, 1 << 22, 1_000_000


def overlap_top_k(texts: DataFrame, asked: DataFrame, *, id_col: str, words_col: str, qid: str, token: str, k: int) -> DataFrame:
    """(qid, id, score, rank) of the ``k`` texts that hold most of a question's words, ties to the smaller id.

    ``texts`` is (id, array of distinct words), ``asked`` (qid, token); rows of
    one id are one text, and a word asked twice counts twice.
    """
    kept = settle(texts.select(F.col(id_col).alias("id"), F.col(words_col).alias("words")))
    letters = kept.agg(F.coalesce(F.sum(F.octet_length(F.array_join("words", " "))), F.lit(0))).first()[0]
    spread = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-letters // LETTERS), min(4 * spread, -(-letters // FEW_LETTERS)))
    dealt = kept.withColumn("_block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    held = settle(dealt.select("_block", F.explode("words").alias("word")).distinct())
    vocabulary = held.select("word").distinct().withColumn("_w", F.col("word"))
    weights = settle(asked.groupBy(F.col(qid).alias("qid"), F.col(token).alias("token")).agg(F.count("*").alias("n")))
    inside = settle(contains_pairs(vocabulary, weights.select("token").distinct(), hid="word", hay_col="_w", nid="token", needle_col="token", width=3))
    runs = max(1, -(-weights.count() // WEIGHTS))
    found = None
    for run in range(runs):  # questions of a bounded weight at a time
        part = weights if runs == 1 else weights.filter(F.pmod(F.xxhash64("qid"), F.lit(runs)) == run)
        best = _best(dealt, held, inside, part, k)
        found = best if found is None else found.unionByName(best)
    ranked = top_k(found, ["qid"], [F.desc("score"), F.asc("id")], k)
    return ranked.select(F.col("qid").alias(qid), F.col("id").alias(id_col), "score", "rank")


def _best(dealt: DataFrame, held: DataFrame, inside: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    spark = dealt.sparkSession
    rows = sorted(weights.collect(), key=lambda r: repr(r["qid"]))  # one run's questions
    names = list(dict.fromkeys(r["qid"] for r in rows))
    tokens = {t: i for i, t in enumerate(dict.fromkeys(r["token"] for r in rows))}
    first = {q: i for i, q in reversed(list(enumerate(r["qid"] for r in rows)))}
    shared = spark.sparkContext.broadcast((np.array([tokens[r["token"]] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64), np.array([first[q] for q in names], np.int64)))
    numbered = spark.createDataFrame(list(tokens.items()), "token string, code int")
    asks = spark.createDataFrame(list(enumerate(names)), f"_q int, qid {dict(weights.dtypes)['qid']}")
    per_word = inside.join(F.broadcast(numbered), "token").groupBy("word").agg(F.collect_list("code").alias("codes"))  # at most the letters of a word, squared
    known = held.join(per_word, "word").select("_block", "word", "codes")
    kind = dict(dealt.dtypes)["id"]

    def count(texts: pa.Table, words: pa.Table) -> pa.Table:
        codes, times, start = shared.value
        empty = pa.table({"_q": pa.array([], pa.int32()), "id": texts["id"].slice(0, 0), "score": pa.array([], pa.int64())})
        if not words.num_rows or not texts.num_rows:
            return empty
        names = texts["id"].combine_chunks()
        names = (names.chunk(0) if isinstance(names, pa.ChunkedArray) else names).dictionary_encode(null_encoding="encode")
        ids = pc.array_sort_indices(names.dictionary, null_placement="at_start").to_numpy()  # text i is the i-th by id
        place = np.empty(len(ids), np.int64)
        place[ids] = np.arange(len(ids))
        text = place[names.indices.to_numpy()]
        lists = texts["words"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        row = pc.index_in(lists.flatten(), value_set=words["word"].combine_chunks())
        hit = pc.is_valid(row)
        row, text = row.filter(hit).to_numpy(), text[pc.list_parent_indices(lists).filter(hit).to_numpy()]
        every = words["codes"].combine_chunks()
        every = every.chunk(0) if isinstance(every, pa.ChunkedArray) else every
        flat, cut = every.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(every).to_numpy())])
        by = np.argsort(text, kind="stable")
        row, text = row[by], text[by]
        step, best = max(1, CELLS // len(codes)), []
        for low in range(0, len(ids), step):
            high = min(low + step, len(ids))
            a, b = np.searchsorted(text, [low, high])
            sizes = cut[row[a:b] + 1] - cut[row[a:b]]
            entry = np.arange(sizes.sum()) + np.repeat(cut[row[a:b]] - np.cumsum(sizes) + sizes, sizes)
            has = np.zeros((high - low, int(codes.max()) + 1), np.int64)
            has[np.repeat(text[a:b] - low, sizes), flat[entry]] = 1
            score = np.add.reduceat(has[:, codes] * times, start, axis=1)
            for q in range(score.shape[1]):
                at = np.flatnonzero(score[:, q])
                at = at[np.argsort(-score[at, q], kind="stable")[:k]]
                best += [(q, low + i, s) for i, s in zip(at.tolist(), score[at, q].tolist())]
        best.sort(key=lambda r: (r[0], -r[2], r[1]))
        top, last, n = [], None, 0
        for q, i, s in best:
            n = n + 1 if q == last else 1
            last = q
            if n <= k:
                top.append((q, i, s))
        at = pa.array([int(ids[i]) for _, i, _ in top], pa.int64())
        return pa.Table.from_arrays([pa.array([q for q, _, _ in top], pa.int32()), names.dictionary.take(at), pa.array([s for *_, s in top], pa.int64())], ["_q", "id", "score"])

    found = dealt.groupBy("_block").cogroup(known.groupBy("_block")).applyInArrow(count, f"_q int, id {kind}, score long")
    return found.join(F.broadcast(asks), "_q").select("qid", "id", "score")
