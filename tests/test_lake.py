"""Files in a temporary folder: readers, manifest, retries, tables, sinks, a whole run, streaming."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lakequill.operators import answering as O
from lakequill.operators import layout as L
from lakequill.operators import tables as T
from lakequill.operators.tableqa import long_cells
from lakequill.plans import answering
from lakequill.providers.base import HashingEmbedder, Providers, encode, judge
from lakequill.sources import lake, sinks, tabular
from lakequill.streaming.ingest import ingest


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


DOCX = zipped({"word/document.xml": '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc>'
               '<w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
PPTX = zipped({"ppt/slides/slide1.xml": '<s xmlns:a="a"><sp><a:p><a:r><a:t>First</a:t></a:r></a:p></sp></s>', "ppt/slides/slide2.xml": "<s/>"})
EPUB = zipped({"META-INF/container.xml": '<c><rootfile full-path="o/p.opf"/></c>', "o/p.opf": '<p xmlns:dc="dc"><dc:title>Book</dc:title><item href="c.xhtml" media-type="application/xhtml+xml"/></p>',
               "o/c.xhtml": "<html><script>x()</script><p>Chapter &amp; verse</p></html>"})
XLSX = zipped({"xl/workbook.xml": '<w xmlns:r="r"><sheet name="S1" r:id="i1"/></w>', "xl/_rels/workbook.xml.rels": '<r><Relationship Id="i1" Target="worksheets/sheet1.xml"/></r>',
               "xl/sharedStrings.xml": "<s><si><t>Name</t></si><si><t>Score</t></si><si><t>Ann</t></si></s>",
               "xl/worksheets/sheet1.xml": '<w><row><c r="A1" t="inlineStr"><is><t>A title</t></is></c></row><row><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c></row>'
               '<row><c r="A3" t="s"><v>2</v></c><c r="B3"><v>9</v></c></row></w>'})
SQL = "CREATE TABLE marks (id INTEGER, name VARCHAR(10), mark DECIMAL(4,1));\nINSERT INTO marks VALUES (1, 'O''Neil', 8.5), (2, 'B; (x)', NULL);"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("lake")
    (root / "sub").mkdir()
    files = {
        "a.txt": "Xin chào".encode("utf-8-sig"), "sub/b.csv": b"Report\nid,name,score\n1,ann,5\n2,bob,7\nbad,row,with,more\n", "c.docx": DOCX, "d.pptx": PPTX,
        "e.epub": EPUB, "f.xlsx": XLSX, "g.sql": SQL.encode(), "h.html": b"<p>Hi <b>you</b></p><style>p{}</style>", "i.pdf": b"%PDF", "j.xyz": b"?",
        "k.docx": b"not a zip", "l.txt": "caf\xe9".encode("latin-1"),
    }
    for name, data in files.items():
        (root / name).write_bytes(data)
    return str(root)


def test_manifest_and_retry(spark, folder):
    rows = {r["relative_path"]: r for r in lake.build_manifest(spark, folder).collect()}
    assert len(rows) == 12
    status = {p: r["status"] for p, r in rows.items()}
    assert status["i.pdf"] == status["k.docx"] == "error" and status["j.xyz"] == "skipped"
    assert rows["a.txt"]["content"] == "Xin chào" and rows["l.txt"]["content"] == "café"
    assert rows["c.docx"]["content"] == "Hello\na | b" and "[Slide 1]\nFirst" in rows["d.pptx"]["content"]
    assert rows["e.epub"]["content"] == "Chapter & verse" and rows["e.epub"]["metadata"]["title"] == "Book"
    assert rows["h.html"]["content"] == "Hi you" and rows["g.sql"]["metadata"]["table_names"] == "marks"
    assert rows["sub/b.csv"]["columns"] == ["id", "name", "score"] and rows["f.xlsx"]["sheet_names"] == ["S1"]
    again = lake.retry_failed(lake.build_manifest(spark, folder), lake.scan(spark, folder), folder, extensions=(".pdf",), readers={".pdf": lambda p, b: "pdf text"})
    fixed = {r["relative_path"]: r for r in again.collect()}
    assert len(fixed) == 12 and fixed["i.pdf"]["content"] == "pdf text" and fixed["k.docx"]["status"] == "error"


def test_tables_in_files(spark, folder):
    files = lake.scan(spark, folder).filter("path like '%.csv' or path like '%.xlsx'")
    cells = tabular.table_cells(files).cache()
    csv = cells.filter("path like '%.csv'").first()["path"]
    assert [tuple(r) for r in tabular.frame_of(cells, csv, "b").orderBy("id").collect()] == [("1", "ann", "5"), ("2", "bob", "7")]
    xlsx = cells.filter("path like '%.xlsx'").first()["path"]
    assert [tuple(r) for r in tabular.frame_of(cells, xlsx, "S1").collect()] == [("Ann", "9")]
    big = tabular.read_csv(spark, f"{folder}/sub/b.csv")
    assert sorted(tuple(r)[:3] for r in big.filter("rejected is null").collect()) == [("1", "ann", "5"), ("2", "bob", "7")]
    assert big.filter("rejected is not null").count() == 1
    dump = tabular.dump_cells(spark.createDataFrame([("g", SQL)], "path string, content string"))
    rows = [tuple(r["cells"]) for r in dump.orderBy("row_no").collect()]
    assert rows == [("id", "name", "mark"), ("1", "O'Neil", "8.5"), ("2", "B; (x)", None)]


def test_header_rules(spark):
    rows = F.lit([["Note"], ["(ppm)", "(ppm)", "(ppm)"], ["gene", "value", "p"], ["A", "1", "2"]])
    one = spark.range(1)
    assert [r for r in one.select(F.transform(rows, tabular.is_sheet_header)).first()[0]] == [False, False, True, False]
    assert one.select(tabular.csv_header_at(F.lit([["t"], ["a", "b"], ["1", "2"]]))).first()[0] == 1
    listed = one.select(tabular.table_of(F.lit([["BRD8"], ["DHX15"], ["SSB"]]), F.lit(True)).alias("t")).first()["t"]
    assert (list(listed["header"]), [list(r) for r in listed["body"]]) == (["value"], [["BRD8"], ["DHX15"], ["SSB"]])
    for label in ("gene", "no digit", "name"):
        assert not one.select(tabular.is_list_header(F.lit(label))).first()[0]


def test_every_row_of_a_long_csv(spark, tmp_path):
    (tmp_path / "long.csv").write_text("id,name\n" + "".join(f"{i},n{i}\n" for i in range(200)) + "1,2,3\n9\n")
    (tmp_path / "semi.csv").write_text("id;name\n1;a\n2;b\n")
    (tmp_path / "list.csv").write_text("BRD8\n" + "".join(f"G{i}\n" for i in range(40)))
    rows = {r["relative_path"]: r for r in lake.build_manifest(spark, str(tmp_path)).collect()}
    lines = rows["long.csv"]["content"].splitlines()
    assert len(lines) == 202 and lines[200] == "199,n199" and lines[201] == "9,"
    assert rows["semi.csv"]["columns"] == ["id", "name"] and rows["list.csv"]["content"].splitlines()[:2] == ["value", "BRD8"]
    cells = tabular.table_cells(lake.scan(spark, str(tmp_path)).filter("path like '%.csv'"))
    long = cells.filter("path like '%long.csv'")
    assert long.filter("row_no > 0 and not rejected").count() == 201 and [list(r["cells"]) for r in long.filter("rejected").collect()] == [["1", "2", "3"]]
    assert cells.filter("path like '%list.csv'").count() == 42
    big = tabular.read_csv(spark, str(tmp_path / "long.csv"))
    assert big.filter("rejected is null").count() == 201 and big.filter("rejected is not null").count() == 1
    assert [tuple(r)[:2] for r in tabular.read_csv(spark, str(tmp_path / "semi.csv")).orderBy("id").collect()] == [("1", "a"), ("2", "b")]


def test_paths_on_other_stores(spark):
    at = lambda path, root: spark.range(1).select(lake.below(F.lit(path), root)).first()[0]
    assert at("s3a://lake/data/sub/a.txt", "s3a://lake/data") == "sub/a.txt"
    assert at("file:///srv/lake/a.txt", "file:/srv/lake") == "a.txt"
    assert at("hdfs://host:8020/x/y.csv", "hdfs://host:8020/x/") == "y.csv"
    assert lake.qualified(spark, "/tmp") == "file:/tmp"


def test_unreadable_workbook_is_a_row(spark):
    files = spark.createDataFrame([("x.xlsx", bytearray(b"not a zip"))], "path string, content binary")
    row = tabular.table_cells(files).first()
    assert row["rejected"] and row["sheet"] is None


def test_question_sheet_with_late_header(spark):
    cells = spark.createDataFrame(
        [("p", "s", 0, ["Title", None, None]), ("p", "s", 1, ["STT", "Question", "Data Sources"]), ("p", "s", 2, ["7", "What?", '["a.txt"]']), ("p", "s", 3, ["8", " ", ""])],
        tabular.CELLS,
    )
    assert [(r["id"], r["question"], r["expected_sources"]) for r in tabular.question_table(cells).collect()] == [("7", "What?", ["a.txt"])]


def test_sinks(spark, tmp_path):
    paths = spark.createDataFrame([("ảnh/a b.png",), ("anh/a_b.png",), ("x.txt",)], "p string")
    safe = sinks.safe_paths(paths, "p")
    got = dict(tuple(r) for r in safe.collect())
    assert len(set(got.values())) == 3 and all(v.isascii() for v in got.values()) and got["x.txt"] == "x.txt"
    found = dict(tuple(r) for r in sinks.rewrite_paths(spark.createDataFrame([("a b.png",), ("x.txt",), ("zz",)], "e string"), "e", safe).collect())
    assert found["a b.png"] == got["ảnh/a b.png"] and found["zz"] == "zz"
    chunks = spark.createDataFrame([("c1", "hello"), ("c2", "world")], "chunk_id string, text string")
    vectors = encode(chunks, "text", HashingEmbedder()).select("chunk_id", "embedding")
    store = str(tmp_path / "index")
    sinks.save_index(vectors, chunks, store, "dense", "m")
    assert sinks.load_index(spark, chunks, store, "dense", "m").count() == 2
    assert sinks.load_index(spark, chunks.withColumn("text", F.lit("xxxxx")), store, "dense", "m") is None
    board = sinks.log_run(spark.createDataFrame([("a|b", 0.5)], "tag string, score double"), str(tmp_path / "log"), ["score"])
    assert "a\\|b" in board


def test_table_golden_cases(spark):
    df = spark.createDataFrame([(20, "HN"), (30, "HCM"), (40, "HN")], "age int, city string")
    assert T.answer_table(df, "What is the mean age?").result.first()["value"] == 30.0
    assert T.query_views({"df": df}, "SELECT count(*) AS n FROM df WHERE city = 'HN'").first()["n"] == 2
    for bad in ("DROP TABLE df", "INSERT INTO df VALUES (1, 'x')", "import os"):
        with pytest.raises(ValueError):
            T.query_views({"df": df}, bad)
    genes = spark.createDataFrame([(f"G{i}",) for i in range(15)], "BRD8 string")
    assert T.answer_table(genes, "How many significant genes are there?").result.first()["value"] == 16.0
    samples = spark.createDataFrame([("s1", "Endometrioid", "CNV_HIGH"), ("s2", "Serous", "CNV_HIGH")], "idx string, hist string, cnv string")
    facts = spark.createDataFrame([("s1", "CDK12"), ("s1", "SMARCA4"), ("s1", "XYZ"), ("s2", "TP53")], "sample_id string, protein string")
    drugs = spark.createDataFrame([("CDK12",), ("smarca4",), ("TP53",)], "gene_name string")
    found = T.join_chain(samples, "idx", [F.lower("hist").contains("endometrioid")], facts, "sample_id", "protein", drugs, "gene_name")
    assert " and ".join(r["item"] for r in found.collect()) == "CDK12 and SMARCA4"


def test_rosters(spark):
    text = "Project 5: X\nMembers: a + b, c and d + 2 SV mới\nObjective: y\nProject 7+8: Y\nMembers: e, f, g\n"
    blocks = L.project_blocks(spark.createDataFrame([("d", text)], "doc string, text string"), "doc", "text")
    assert {(r["label"], r["member_count"]) for r in blocks.collect()} == {("5", 4), ("7+8", 3)}
    assert L.largest_project(blocks, favour_combined=True).first()["answer"] == "7"
    rows = spark.createDataFrame([("5", True, ["a"] * 7), ("2", True, ["b"] * 2), ("9", False, ["c"] * 9)], "project_no string, is_core boolean, members array<string>")
    assert tuple(L.roster_extreme(rows, "max").first()) == ("7", "5") and tuple(L.roster_extreme(rows, "min").first()) == ("2", "2")


def test_judge_only_touches_its_rows(spark):
    rows = spark.createDataFrame([("llm_judge", "q", "a", "b"), ("exact_match", "q", "a", "b")], "answer_type string, question string, predicted_answer string, groundtruth string")
    got = [r["judge_verdict"] for r in judge(rows, lambda p: '{"verdict": "maybe"}').collect()]
    assert got == ["incorrect", None]


def test_whole_run(spark, tmp_path):
    files = spark.createDataFrame(
        [("docs/notes.txt", "The AXIOM roadmap meeting chose blue. Nothing else."), ("docs/other.txt", "Bananas are yellow fruit.")], "p string, t string"
    )
    from lakequill.sources.manifest import catalogue

    manifest = catalogue(files, F.col("p"), F.col("t"))
    asked = spark.createDataFrame([("1", "What did the AXIOM roadmap meeting choose?", "llm_judge")], "qid string, question string, answer_type string")
    result = answering.run(asked, manifest)
    row = result.submission.first()
    assert "chose blue" in row["answer"] and "docs/notes.txt" in row["evidences"]
    assert O.submission_violations(result.submission, manifest).isEmpty()
    answering.write(result, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/retrieval_debug")).count() == 1
    model = Providers(complete=lambda p: '{"answer": "blue", "evidences": ["docs/notes.txt", "made/up.txt"]}')
    row = answering.run(asked, manifest, providers=model).submission.first()
    assert (row["answer"], row["evidences"]) == ("blue", '["docs/notes.txt"]')


def test_table_answers_come_before_sentences(spark, tmp_path):
    (tmp_path / "Credit.csv").write_text("id,name,balance,city\n1,ann,10,Hue\n2,bob,20,Vinh\n3,cat,60,Hue\n")
    (tmp_path / "notes.txt").write_text("The average balance of notes is nothing to speak of.")
    manifest = lake.build_manifest(spark, str(tmp_path))
    files = lake.scan(spark, str(tmp_path)).filter("path like '%.csv'")
    cells = tabular.table_cells(files.withColumn("path", lake.below(F.col("path"), lake.qualified(spark, str(tmp_path)))))
    asked = spark.createDataFrame(
        [("1", "What is the average balance in Credit.csv?", "exact_match"), ("2", "In Credit.csv, what is the total balance for Hue?", "exact_match"),
         ("3", "In Credit.csv, which name has the highest balance?", "exact_match"), ("4", "How many rows has Credit.csv?", "exact_match")],
        "qid string, question string, answer_type string",
    )
    result = answering.run(asked, manifest, cells=long_cells(cells))
    got = {r["id"] if "id" in r else r["qid"]: r["answer"] for r in (x.asDict() for x in result.answers.collect())}
    assert got == {"1": "30", "2": "70", "3": "cat", "4": "3"}


def test_streaming_ingest_reads_each_file_once(spark, tmp_path):
    root, store = tmp_path / "in", tmp_path / "store"
    root.mkdir()
    (root / "a.txt").write_text("first")
    for _ in range(2):
        q = ingest(spark, str(root), str(store), str(tmp_path / "cp"))
        q.awaitTermination(60)
        (root / "b.txt").write_text("second")
    rows = spark.read.parquet(str(store / "manifest")).select("content").collect()
    assert sorted(r[0] for r in rows) == ["first", "second"]


def test_only_a_missing_path_counts_as_empty(spark, tmp_path):
    assert not sinks.exists(spark, str(tmp_path / "nothing"))
    assert sinks.read_json_or(spark, str(tmp_path / "nothing"), "a int").count() == 0
    (tmp_path / "bad.parquet").write_text("this is no parquet file")
    with pytest.raises(Exception):
        sinks.exists(spark, str(tmp_path / "bad.parquet"))
