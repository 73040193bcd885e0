"""Column functions against plain Python on small literals."""

import pytest
from pyspark.sql import functions as F

from lakequill.functions import answers as A
from lakequill.functions import paths as P
from lakequill.functions import questions as Q
from lakequill.functions import text as T


def values(spark, column, *inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_match_key_keeps_inner_spaces_and_folds(spark):
    got = values(spark, T.match_key, "Đường  Phố", "a , b", "Café_Ünï/x*.CSV", "中文 abc", None)
    assert got == ["duong pho", "a   b", "cafe_uni/x*.csv", "中文 abc", ""]


def test_tokens_drop_single_characters(spark):
    assert values(spark, T.tokens, "A bc, d-e f/g.txt 中文") == [["bc", "d-e", "f/g.txt", "中文"]]


def test_has_word_allows_plural_only(spark):
    got = values(spark, lambda c: T.has_word(T.match_key(c), "hinh", "slot"), "chính", "hình", "slots", "slotted")
    assert got == [False, True, True, False]


def test_paths(spark):
    got = values(spark, lambda c: F.struct(P.basename(c), P.stem(P.basename(c)), P.extension(c), P.modality(c)), "a\\b\\C.d.CSV", ".hidden", "x/y.png")
    assert [tuple(r) for r in got] == [("C.d.CSV", "C.d", ".csv", "table"), (".hidden", ".hidden", "", "unknown"), ("y.png", "y", ".png", "image")]


@pytest.mark.parametrize(
    "answer,question,expected",
    [
        ("0.86421", "rounded to two decimal places", "0.86"),
        ("0.865", "What is the mean, rounded to 2 decimal places?", "0.86"),
        (" yes ", "", "Yes"),
        ("No.", "", "No"),
        ("The answer is C", "Pick\nA. x\nB. y\nC. z\nD. w", "C"),
        ("b", "", "B"),
        ("1,234 items", "How many items?", "1234"),
        ("1,234 items", "Name it", "1,234 items"),
        ("12.50", "What percentage, with %?", "12.5%"),
        ("![Label](pic.png)", "", "Label (pic.png)"),
        ("[](pic.png) and **bold**", "", "pic.png and bold"),
        ("", "", "Not enough data to answer."),
        ("not enough data to answer.", "", "Not enough data to answer."),
        ("Answer: Paris", "", "Paris"),
        ("rome", "Reply in uppercase", "ROME"),
    ],
)
def test_normalize_answers(spark, answer, question, expected):
    df = spark.createDataFrame([(answer, question, "exact_match")], "answer string, question string, answer_type string")
    assert A.normalize_answers(df).first()["answer"] == expected


def test_options_and_lists(spark):
    q = "Closest?\nA. 10 kg\nB) 25\nC. none"
    df = spark.createDataFrame([(q, "24%"), (q, "None"), ("no options", "7")], "q string, a string")
    assert [r[0] for r in df.select(A.choose_option(F.col("q"), F.col("a"))).collect()] == ["B", "C", "7"]
    got = values(spark, A.text_list, '["a, b", "c"]', "[x, 'y']", "nan", "“a”, “b”")
    assert got == [["a, b", "c"], ["x", "y"], [], ["a", "b"]]


def test_question_profile(spark):
    rows = [
        ("1", "What is the average balance in Credit.csv?", "exact_match"),
        ("2", "How many images in number_image/* show a digit, 2 decimal places?", ""),
        ("3", "Hãy cho tôi biết chính sách", ""),
        ("4", "Did the revenue grow in talk.mp4?", ""),
    ]
    p = {r["qid"]: r for r in Q.profile(spark.createDataFrame(rows, "qid string, question string, answer_type string")).collect()}
    assert p["1"]["explicit_file_hints"] == ["Credit.csv"] and p["1"]["modality_hint"] == "table"
    assert p["2"]["wildcard_patterns"] == ["number_image/*"] and p["2"]["format_instructions"]["decimals"] == "2"
    assert p["3"]["language"] == "vi" and p["3"]["modality_hint"] != "image"
    assert p["4"]["format_instructions"]["binary"] == "true" and p["4"]["modality_hint"] == "audio"
    assert len(p["2"]["keywords"]) <= 30


def test_clean_structure(spark):
    assert values(spark, T.clean_structure, "a\x00b  c \r\nd\n\n\n\n\ne  ") == ["ab c\nd\n\n\ne"]


def test_repair_mojibake(spark):
    from lakequill.functions.text import repair_mojibake

    plain = ["", "plain", "café", "Ünïcode ñ", "xin chào các bạn", "日本語", "a\u0080b", "Ã", "Â©", "é" * 20_000, "👍 ok"]
    rows = [(t, t) for t in plain if not t.startswith("Â")] + [(t.encode().decode("latin-1"), t) for t in plain] + [(None, None)]
    got = spark.createDataFrame(rows, "broken string, want string").select(repair_mojibake(F.col("broken")).alias("got"), "want").collect()
    for r in got:
        assert r["got"] == r["want"]


def test_key_drops_what_the_published_pattern_drops(spark):
    from lakequill.fixed_values import MATCH_KEY_DROP, VIETNAMESE_LETTERS
    from lakequill.functions.questions import _VIETNAMESE
    from lakequill.functions.text import _DROP

    letters = [chr(n) for n in [*range(1, 0xD800), *range(0xE000, 0x20000)]]
    rows = ["".join(f"a {c}{c} -{c}!z" for c in letters[at : at + 256]) for at in range(0, len(letters), 256)] + letters[:0x2000]
    texts = spark.createDataFrame([(r,) for r in rows], "t string")
    assert texts.filter(F.regexp_replace("t", _DROP, " ") != F.regexp_replace("t", MATCH_KEY_DROP, " ")).count() == 0
    assert texts.filter(F.col("t").rlike(_VIETNAMESE) != F.col("t").rlike(f"[{VIETNAMESE_LETTERS}]")).count() == 0


def test_key_is_made_once(spark):
    """A text inlined into every test and branch was folded dozens of times per question."""
    from lakequill.functions.questions import language

    plan = spark.range(1).select(F.col("id").cast("string").alias("q")).select(language(F.col("q")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("lower(") <= 4  # 50 before
