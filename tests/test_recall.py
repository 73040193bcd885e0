"""Expected sources resolved to files, and recall of ranked lists."""

from lakequill.operators.recall import expand_expected, recall_report, recall_summary

FILES = [("a/One.csv",), ("b/one.csv",), ("b/two.txt",), ("b\\deep\\three.txt",)]
EXPECTED = [(1, "A\\one.CSV"), (1, "x/two.txt"), (2, "*.txt"), (2, "deep/*"), (3, "gone.pdf"), (3, "ONE.csv"), (4, "no*such"), (5, " "), (5, None)]


def test_expected_sources(spark):
    got = {tuple(r) for r in expand_expected(spark.createDataFrame(EXPECTED, "qid int, source string"), spark.createDataFrame(FILES, "path string")).collect()}
    three = "b\\deep\\three.txt"
    assert got == {(1, "a/One.csv"), (1, "b/two.txt"), (2, "b/two.txt"), (2, three), (3, "gone.pdf"), (3, "b/one.csv")}


def test_recall(spark):
    asked = spark.createDataFrame([(i,) for i in range(1, 7)], "qid int")
    found = spark.createDataFrame([(1, "b/two.txt", 2), (1, "z", 1), (2, "b/deep/three.txt", 1), (2, "b/two.txt", 4), (6, "z", 1)], "qid int, relative_path string, rank int")
    report = recall_report(asked, found, spark.createDataFrame(EXPECTED, "qid int, source string"), spark.createDataFrame(FILES, "path string"))
    rows = {r.qid: (r.kind, r.expected, r.found_total, r.first_rank, r.recall_1, r.recall_5, r.recall_full, r.returned_empty) for r in report.collect()}
    assert rows == {
        1: ("answerable", 2, 1, 2, 0.0, 0.5, 0.5, False), 2: ("answerable", 2, 2, 1, 0.5, 1.0, 1.0, False), 3: ("answerable", 2, 0, None, 0.0, 0.0, 0.0, True),
        4: ("answerable", 0, 0, None, 0.0, 0.0, 0.0, True), 5: ("unanswerable", 0, 0, None, None, None, None, True), 6: ("unanswerable", 0, 0, None, None, None, None, False),
    }
    means = {r.kind: (r.questions, r.recall_full, r.mrr, r.fully_covered, r.returned_empty) for r in recall_summary(report).collect()}
    assert means == {"answerable": (4, 0.375, 0.375, 0.25, 0.5), "unanswerable": (2, None, None, None, 0.5)}
