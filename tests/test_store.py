"""Stored vectors are encoded once; folders and names that questions quote."""

import numpy as np

from lakequill.operators.direct import named_in_question, path_names, quoted_groups
from lakequill.providers.base import HashingEmbedder, encode
from lakequill.sources import vectorstore as V


def Only(*known):  # noqa: N802  a class made here travels to the workers by value
    """Encodes the listed texts and fails for any other."""

    class Model:
        def embed(self, texts):
            assert set(texts) <= set(known), texts
            return HashingEmbedder().embed(texts)

    return Model()


def test_only_new_texts_are_encoded(spark, tmp_path):
    folder, model = str(tmp_path), "some/model v1"
    rows = lambda *t: spark.createDataFrame(list(enumerate(t)), "id int, text string")
    values = lambda df: {r.id: np.array(r.embedding).round(6).tolist() for r in df.collect()}
    first, later = rows("a b", "c d", "a b", "", None), rows("a b", "c d e", "", None, "c d")
    assert V.stored_vectors(spark, folder, model).collect() == []
    assert V.refresh(first, "text", Only("a b", "c d", ""), folder, model) == 3
    assert V.refresh(first, "text", Only(), folder, model) == 0
    got = V.encode_stored(later, "text", Only("c d e"), folder, model)
    assert got.columns == ["id", "text", "embedding"]
    assert values(got) == values(encode(later, "text", HashingEmbedder()))
    assert V.stored_vectors(spark, folder, model).count() == 4
    assert V.refresh(rows("a b"), "text", Only("a b"), folder, "some-model v1") == 1  # another model has vectors of its own
    assert V.refresh(rows(), "text", Only(), folder, model) == 0


def test_folders_and_names(spark):
    files = spark.createDataFrame([("Báo cáo/2024/a.csv",), ("Báo cáo/b.csv",), ("x\\2024\\c d.txt",), ("notes.md",), (None,)], "relative_path string")
    asked = spark.createDataFrame(
        [(1, 'Files of "bao cao"?'), (2, 'What is in "Báo cáo/2024"?'), (3, "All of '2024'?"), (4, 'Is "otes" there?'), (5, "Nothing quoted: notes"), (6, None), (7, '"" and "nowhere"')], "qid int, question string"
    )
    got = {(r.qid, r.path) for r in quoted_groups(asked, path_names(files)).collect()}
    a, b, c = "Báo cáo/2024/a.csv", "Báo cáo/b.csv", "x\\2024\\c d.txt"
    assert got == {(1, a), (1, b), (2, a), (3, a), (3, c)}
    named = {(r.qid, r.path) for r in named_in_question(asked, files).collect()}
    assert {(4, "notes.md"), (5, "notes.md"), (1, a), (1, b), (2, a), (2, b), (3, a), (3, c)} <= named
    assert not {q for q, _ in named} & {6}
    assert path_names(files.limit(0)).collect() == []
