"""License scans against a plain re-implementation, and their defined results."""

import re

from lakequill.llm.license_scan import BACK, BLOCK, GRANT, NAME, RULES, SPAN, Rule, digest, scan_licenses

TEXTS = [
    "Licensed under the Apache License, Version 2.0.", None, "", "gnu", "mit license cc by-nc 4.0 x gnu general public license version 3 or later. see MIT License",
    "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: MPL-2.0", "the new bsd license and the bsd license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "GNU Lesser General Public License v2.1 only, gplv3 or lgplv2 1",
    "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "cc by cc by cc by-sa 4.0", "licence é apache license٠ apache license", "Neither the name of the A B nor the names of its contributors may be used to endorse or promote products",
    "available under terms of the creative commons attribution sharealike 3.0 unported license", "mit" * 3 + " mit licensee MIT license mit\tlicense\x00mit license", "pad " * 300 + "released under the mit license",
]


def _plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = []
    for i, word in enumerate(words):
        for n, r in enumerate(RULES):
            if r.keyword != word:
                continue
            hit = re.match(f"(?:{r.pattern}) ", " ".join(words[i : i + SPAN]) + " ")
            lead = re.search(f"(?:^| )({r.before})$", " ".join(words[max(0, i - BACK) : i]) + " ") if r.before else re.match("()", "")
            if hit and lead:
                found.append((i - lead[1].count(" "), i + hit[0].count(" "), r.priority, n, r.label, r.base))
    free = [
        d for d in found
        if not any(o[2] <= d[2] and o[0] <= d[0] and o[1] >= d[1] and (o[1] - o[0] > d[1] - d[0] or (o[:2] == d[:2] and o[2:4] < d[2:4])) for o in found)
    ]
    return len(words), sorted(free), sorted(d for d in found if d[5])


def test_against_plain(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(3, "gnu")], "doc_id long, text string")
    rows = scan_licenses(docs).collect()
    assert len(rows) == len(TEXTS) + 1
    for row in rows:
        words, free, base = _plain(row.text)
        assert row.licenses.n_words == words
        assert [tuple(d)[:6] for d in row.licenses.found] == free
        assert [tuple(d) for d in row.licenses.base] == base
        for d in row.licenses.found:
            assert len(d.words.split(" ")) == d.end - d.start


def test_labels(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in scan_licenses(docs).select("doc_id", *digest()).collect()}
    assert (got[0].base_labels, got[0].labels, got[0].score) == ("apache", "apache,apache-2.0", 0.95)
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].labels, got[1].score) == (0, 0, None, "", 0.0)
    assert got[6].labels == "mpl-2.0" and got[8].labels == "mit" and got[10].labels == "gpl,gpl-2.0-or-later"
    assert (got[11].n_base, got[11].first_word, got[11].last_word) == (3, 0, 4)


def test_many_detections_in_one_text(spark):
    rules = [Rule("long", GRANT, "a b c"), Rule("short", NAME, "b"), Rule("end", NAME, "c"), Rule("all", NAME, "a b")]
    n = 3 * BLOCK
    docs = spark.createDataFrame([(1, "a b c b " * n)], "doc_id long, text string")
    found = scan_licenses(docs, rules=rules).first().licenses.found
    assert [d.label for d in found] == ["long", "short"] * n


def test_clashing_names_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "mit license", "x", 2, 3)], "doc_id long, text string, licenses string, _words int, `a.b` int")
    row = scan_licenses(docs).first()
    assert row.licenses.n_words == 2 and row["_words"] == 2 and row["a.b"] == 3
    assert scan_licenses(docs.limit(0)).count() == 0


def test_no_shuffle_and_no_python(spark, data):
    plan = scan_licenses(spark.read.parquet(f"{data}/documents.parquet")).select("doc_id", *digest())._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
