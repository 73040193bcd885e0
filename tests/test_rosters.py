"""Rosters and sentences are read once per text, blanks are collapsed as the plain pattern does."""

import random
import re

from pyspark.sql import functions as F

from lakequill.functions.text import BLANK, collapse_spaces
from lakequill.operators.answering import extract_sentences
from lakequill.operators.layout import project_blocks

TEXTS = [
    "Project 1: x\nMembers: An, Bo; , .;: and Cy + 2 SV here\nProject 2 + 3 : y\n Members : ; .\n[Page 2] Project 4: Thành viên: A và B and C",
    "no projects", "", None, "project 7:members:  Z ,\tY",
]


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_and_their_cost(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc int, text string")
    found = project_blocks(docs, "doc", "text")
    assert sorted(tuple(r) for r in found.collect()) == [(0, "1", "An, Bo; , .;: and Cy + 2 SV here", 3), (0, "4", "A và B and C", 3), (4, "7", "Z , Y", 2)]
    scored = found.withColumn("score", F.col("member_count") + F.when(F.contains("label", F.lit("+")), F.col("member_count")).otherwise(0)).filter("score > 1")
    assert _plan(scored).count("Thanh vien") == 1


def test_sentences_are_keyed_once(spark):
    blocks = spark.createDataFrame([(1, 0, "a", "Cats sleep. Dogs bark loud!\nBirds"), (1, 1, "b", "Dogs bark."), (2, 0, "a", None), (3, 0, "c", "Cats")], "qid int, pos int, relative_path string, text string")
    asked = spark.createDataFrame([(1, "Do dogs bark?", "x"), (2, "Who?", "x"), (4, "None", "x")], "qid int, question string, answer_type string")
    found = extract_sentences(blocks, asked)
    got = {r.qid: (r.answer, r.evidences, r.score) for r in found.collect()}
    assert got[1] == ("Dogs bark loud!", ["a"], 2) and got[2][1:] == ([], 0) and got[4][1:] == ([], 0) and set(got) == {1, 2, 4}
    plan = _plan(found.select("qid", "score", "evidences"))
    assert plan.count("lower(trim(regexp_replace(coalesce(lambda") + plan.count("lower(trim(regexp_replace(coalesce(_sentence") <= 1


def test_blanks(spark):
    letters, dice = " \t\n\r\x0b\x0c\x1c\x1f\x85      　!~a\x7f\x00é\U0001f600", random.Random(5)
    texts = ["".join(dice.choice(letters) for _ in range(dice.randrange(12))) for _ in range(4000)] + [" a  b ", "a b", "", " ", "  x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.trim(F.regexp_replace("t", f"{BLANK}+", " "))
    assert rows.filter(collapse_spaces(F.col("t")) != plain).count() == 0
    blank = re.compile("[\\s\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
    assert [r[0] for r in rows.select(collapse_spaces(F.col("t"))).collect()] == [blank.sub(" ", t).strip(" ") for t in texts]
