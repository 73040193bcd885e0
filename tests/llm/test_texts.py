"""Text operators against brute force, and their defined results."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lakequill.llm import bpe, quality
from lakequill.llm.html_extract import extract_text, fit, main_texts, parse, train
from lakequill.llm.intervals import equal_starts
from lakequill.llm.line_dedup import drop_recurring_lines
from lakequill.llm.mixing import mix_sources
from lakequill.llm.substring_dedup import cut_repeats
from lakequill.llm.url_filter import filter_urls, split_url

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# URL filter

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("x.org", "/fr/a", "block"), ("x.org", "/fr/a", "allow"), (None, "/", "block")]
URLS = [
    None, "", "no scheme/net/", "http://net/", "http://NET/x", "http://net", "http://a.net?q=/", "https://example.net/en/1", "https://www.example.net/en/1#f", "https://badexample.net/en/1", "https://example.net/english",
    "http://example.com/de/a://b", "http://m.example.com/de/", "http://example.com/de", "ftp://x.org/fr/abc", "ftp://y.x.org/fr/b", "ftp://y.x.org/fr/b", "http://ÄB.Net/ü", "://net/", "http:///net/", "http://net:80/", "http://.net/", "http://a/b\nc/net/",
]


def _judge(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h + p), v, h + p) for h, p, v in RULES if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2], max(fits)[1]) if fits else (host, path, None, "allow")


def test_filter_urls(spark):
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(URLS)], "page_id int, url string, h string").withColumn("path", F.lit("old")).repartition(3)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(pages, rules).collect()}
    assert got == {i: _judge(u) for i, u in enumerate(URLS)}
    assert {r["verdict"] for r in filter_urls(pages, rules.limit(0)).collect()} == {"allow"}
    assert filter_urls(pages.limit(0), rules).collect() == []


def test_many_listed_urls(spark):
    rules = spark.range(3000).select(F.concat(F.lit("h"), "id", F.lit(".example.org")).alias("host"), F.lit("/").alias("path"), F.lit("block").alias("verdict"))
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://www.h"), "id", F.lit(".example.org/a")).alias("url"))
    assert filter_urls(pages, rules).filter("verdict = 'block'").count() == 3000


def test_split_url_is_native(spark):
    host, path = split_url(F.lit("http://A.b/c?d"))
    assert tuple(spark.range(1).select(host, path).first()) == ("a.b", "/c")


# quality

def test_quality_learns_and_scores_everything(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 9)))
    rows, labels = [], []
    for i in range(300):
        good = " ".join(word() for _ in range(rng.randrange(5, 200)))
        bad = rng.choice([lambda: " ".join(word().upper() + "!!" for _ in range(40)), lambda: " ".join([word()] * 60), lambda: " | ".join(word() + "%%%" for _ in range(50))])()
        rows.append((i, good if i % 3 else bad))
        labels.append((i, 1 if i % 3 else 0))
    rows += [(1000, None), (1001, ""), (1002, "word " * 100_000), (None, "a b c")]
    labels += [(0, None), (5, 7), (None, 1), (77_777, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    ranker = quality.fit(docs, marks.filter(~quality.held_out(F.col("doc_id"))))
    got = quality.score(docs, ranker).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == int(r["score"] >= quality.CUT) for r in got)
    truth = dict(labels[:300])
    right = [r["predicted"] == truth[r["doc_id"]] for r in got if r["doc_id"] is not None and r["doc_id"] < 300]
    assert np.mean(right) > 0.97
    kept = quality.reject_poor(docs, marks)
    assert kept.columns == docs.columns and 190 <= kept.count() <= 215


def test_quality_without_pairs(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in quality.score(docs, quality.fit(docs, none)).collect()] == [1.0, 1.0]
    ones = spark.createDataFrame([(1, 0)], "doc_id long, quality int")
    assert [r["predicted"] for r in quality.score(docs, quality.fit(docs, ones)).collect()] == [0, 0]
    assert quality.score(docs.limit(0), quality.fit(docs, none)).collect() == []


def test_bounded_sample(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    marks = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    seen = []
    original = quality.fit_ranker
    quality.fit_ranker = lambda f, y, **k: seen.append(len(y)) or original(f, y, **k)
    try:
        quality.fit(docs, marks, max_labelled=500)
    finally:
        quality.fit_ranker = original
    assert 350 < seen[0] < 650


# BPE

def test_bpe_equals_tiktoken(spark):
    ranks = bpe.read_ranks(PATH)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = [None, "", " ", "\n\n  a", "it's we'll", "a" * 3000, "你好世界" * 300, "x" * bpe.LONG, "é" * 250, "👍🏽 ٣٤ é́", "<|endoftext|>", "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(3000))]
    texts += [" ".join("".join(rng.choice("aeiourstnlé ") for _ in range(rng.randrange(1, 14))) for _ in range(200)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("old")).repartition(3)
    coded = bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    for r in bpe.decode(coded, PATH).collect():
        want = plain.encode_ordinary(r["text"] or "")
        assert list(r["ids"]) == want and bytes(r["decoded"]) == (r["text"] or "").encode()
    for r in bpe.encode_and_check(docs, PATH, public_tokenizers.PATTERN).collect():
        want = np.array(plain.encode_ordinary(r["text"] or ""), "<u4")
        assert (r["coded"]["n_tokens"], r["coded"]["ids_sha256"]) == (len(want), hashlib.sha256(want.tobytes()).hexdigest())
        assert r["coded"]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest() and list(r["coded"]["ids"]) == want.tolist()
    assert bpe.encode(docs.limit(0), PATH, public_tokenizers.PATTERN).collect() == []
    odd = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [(r["decoded"]) for r in bpe.decode(odd, PATH).orderBy("doc_id").collect()] == [None, b""]


def test_codec_streams_and_forgets():
    ranks = bpe.read_ranks(PATH)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    keep, stream = bpe._KEEP, bpe._STREAM
    bpe._KEEP, bpe._STREAM = 50, 100
    try:
        texts = ["some words again " * 40, "x y z " * 400_000, "other words " * 90]
        for text, stretches in zip(texts, codec.each(iter(texts))):
            blob = b"".join(ids for s in stretches for ids, _ in s)
            assert np.frombuffer(blob, "<u4").tolist() == plain.encode_ordinary(text)
    finally:
        bpe._KEEP, bpe._STREAM = keep, stream


# mixing

def _mixed(rows):
    sizes = {}
    for i, t, s in rows:
        sizes.setdefault(s, []).append(len((t or "").encode().split()))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    cap = {s: 2 * sum(sizes[s]) for s in order}
    left, open_, target = 1.5 * sum(map(sum, sizes.values())), set(order), {}
    while True:
        level = left / sum(w[s] for s in open_) if open_ else 0
        full = {s for s in open_ if level * w[s] > cap[s]}
        if not full:
            return {**target, **{s: level * w[s] for s in open_}}, {s: sum(sizes[s]) for s in order}
        for s in full:
            target[s] = cap[s]
            left -= cap[s]
        open_ -= full


@pytest.mark.parametrize("bucket_rows", [4096, 3])
def test_mix_sources(spark, bucket_rows):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 50)), rng.choice(["a", "a", "a", "B", "é", "z", None])) for i in range(300)]
    rows += [(1000, None, "a"), (1001, "", "none"), (1002, "w \x0b w\x1cw w", "z"), (None, "one two", "B"), rows[0], rows[0]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"sid": F.lit(1), "bucket": F.lit("b"), "size": F.lit("old")}).repartition(4)
    got = mix_sources(frame, bucket_rows=bucket_rows).collect()
    target, source_size = _mixed(rows)
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r["size"] == len((r["text"] or "").encode().split()) and r["source_size"] == source_size[r["source"]]
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"] and (r["sid"], r["bucket"]) == (1, "b")
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s in target:
        assert abs(taken[s] - target[s]) <= 0.5
    again = mix_sources(frame.repartition(2), bucket_rows=7).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mix_sources(frame.limit(0)).collect() == []


# lines

def test_drop_recurring_lines(spark):
    body = lambda i: f"own text {'abcdefghij'[i % 10]} of document {'qrstuvwxyz'[i // 10]} that nobody else has in this form at all " * 3
    rows = [(i, f"All rights reserved.\n{body(i)}\nSigned by user{i} on day {i * 7} of the year\nshort\n") for i in range(8)]
    rows += [(20 + i, f"{body(20 + i)}\nonly in three documents here") for i in range(3)]
    rows += [(40 + i, "a text that was copied as a whole\nwith every line of it again") for i in range(6)]
    rows += [(90, None), (91, ""), (92, "\n\n"), rows[0], (None, "All rights reserved.\n" + body(77))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"line": F.lit(1), "_lines": F.lit("x"), "n_lines": F.lit(9)}).repartition(5)
    got = {(r["doc_id"], r["text"]): r for r in drop_recurring_lines(docs).collect()}
    assert drop_recurring_lines(docs).count() == len(rows)
    for i in range(8):
        r = next(r for (k, _), r in got.items() if k == i)
        assert r["text"] == f"{body(i)}\nshort\n" and (r["n_lines"], r["n_dropped"]) == (5, 2) and (r["line"], r["_lines"]) == (1, "x")
    for i in (20, 21, 22, 40, 45):
        r = next(r for (k, _), r in got.items() if k == i)
        assert r["n_dropped"] == 0 and r["text"] == dict(rows)[i]
    assert (got[90, None]["n_lines"], got[91, ""]["n_lines"], got[92, "\n\n"]["n_lines"]) == (0, 0, 3)
    assert (None, body(77)) in got
    assert drop_recurring_lines(docs.limit(0)).collect() == []


def test_recurring_lines_stay_only_where_they_are_first(spark):
    notice = "All rights reserved by the owners of this place.\nNo part of it may be copied without their written consent."
    rows = [(i, f"{notice}\nown {w}") for i, w in enumerate("abcdefgh")]  # mostly boilerplate, copies of nothing
    rows += [(40 + i, "a text that was copied as a whole\nwith every line of it again") for i in range(6)]
    rows += [(None, f"{notice}\nown z"), (60, notice)]
    got = sorted(((r["doc_id"], r["text"], r["n_dropped"]) for r in drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"), keep_first="doc_id").collect()), key=str)
    want = [(0, rows[0][1], 0), *[(i, f"own {w}", 2) for i, w in enumerate("abcdefgh") if i], *[(i, t, 0) for i, t in rows[8:14]], (None, "own z", 2), (60, "All rights reserved by the owners of this place.", 1)]
    assert got == sorted(want, key=str)


def test_long_lines_recur_from_two_documents_on(spark):
    long = lambda n: " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(n))
    rows = [(1, f"{long(50)}\nown a"), (2, f"own b\n{long(50)}"), (3, f"{long(49)}\nown c"), (4, f"own d\n{long(49)}"), (5, f"{long(60)} 17\nown e"), (6, f"{long(60)} 18\nown f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in drop_recurring_lines(docs, keep_first="doc_id", long_tokens=50).collect()}
    assert got == dict(rows) | {2: "own b", 6: "own f"}


# HTML

def test_extract_given_pages(spark, data):
    import html as htmllib
    import re

    pages = spark.read.parquet(f"{data}/pages.parquet")
    for r in extract_text(pages, fit(pages)).collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        blocks = [htmllib.unescape(re.sub(r"<br>", " ", b)) for b in re.split(r"</?(?:p|h1)>", inner)]
        blocks = [" ".join(re.sub(r"<[^>]*>", "", b).split()) for b in blocks]
        assert r["text"] == "\n\n".join(b for b in blocks if b)


def test_extract_other_pages(spark, data):
    prose = "A long paragraph of the story, with commas, stops and all that readers expect; it goes on for a while. " * 3
    html = f"""<html><head><title>T</title><script>var x = "<p>no</p>";</script></head><body><header><a href=/>Site</a></header>
    <div id="main-menu" class="menu"><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></div><div class="cookie-notice"><p>We use cookies.</p></div>
    <div class="article-body"><h1>Title &amp; more</h1><p>{prose}<br>end &eacute;<p>{prose}<div class="advert"><p>Buy this now, it is cheap.</p></div><p>{prose}</p><!-- <p>hidden</p> --></div>
    <aside class="sidebar"><p>Other things you may like.</p><a href=c>c</a></aside><form><label>Name</label><input><button>Send</button></form>
    <section id="comments"><div class="comment"><p>I liked it, and here is what I think of it in many words, more than one line.</p></div></section><footer>&copy; 2020</footer>"""
    pages = spark.read.parquet(f"{data}/pages.parquet").union(spark.createDataFrame([(900, "u", None), (901, "u", "")], "page_id long, url string, html string"))
    forest = fit(pages)
    want = "Title & more\n\n" + " ".join((prose + " end é").split()) + "\n\n" + " ".join(prose.split()) + "\n\n" + " ".join(prose.split())
    assert main_texts([html], forest) == [want]
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "plain"), (4, "<p"), (5, "<div>" * 3000 + "x")], "text int, html string")
    assert [r["text"] for r in extract_text(odd, forest).limit(2).collect()] == ["", ""]
    assert extract_text(odd, forest).count() == 5 and extract_text(odd.limit(0), forest).collect() == []
    assert train([]).probability(np.zeros((2, 34))).tolist() == pytest.approx([0.999, 0.999])


@pytest.mark.parametrize("html, want", [
    ("<article><p title=it's>Hello world one</p><p>it's two</p><p>three</p></article>", ["Hello world one", "it's two", "three"]),
    ("<article><p class=foo'>Hello</p><p a='x>y' b=\"'\">two</p></article>", ["Hello", "two"]),
    ("<p '>a</p><p x = \"1>2\" y>b</p><p z=\"never>c", ["a", "b", "c"]), ("<p/ q=a/b>a<br/>b</p>", ["a b"]), ("a < b and c > d", ["a < b and c > d"]),
    ("plain text, no markup", ["plain text, no markup"]), ("<b>Bold</b> and <a href=x>link</a> text<br>more", ["Bold and link text more"]),
    ("<html><body><p>in</p></body></html>after", ["in", "after"]), ("<p " + "a" * 5000, []),
])
def test_parse_attributes_and_bare_text(html, want):
    assert [w for _, w in parse(html).blocks] == want


def test_plain_pages_are_kept_whole(spark, data):
    forest = fit(spark.read.parquet(f"{data}/pages.parquet"))
    assert main_texts(["plain text", "<b>Bold</b> and <a href=x>link</a> text<br>more", "<html><body>only &amp; body</body></html>"], forest) == ["plain text", "Bold and link text more", "only & body"]


def test_parse_is_lenient():
    page = parse("<ul><li>a<li>b &lt;<b>c</ul>d<p>e<p>f</b><script>x<y</script>g<br>h</x>")
    assert [w for _, w in page.blocks] == ["a", "b <c", "d", "e", "fg h"]


# substrings

def _cut(rows):
    least = {}
    for i, t in rows:
        raw, k = (t or "").encode(), 1 << 62 if i is None else i
        for p in range(len(raw) - 49):
            least[raw[p : p + 50]] = min(k, least.get(raw[p : p + 50], 1 << 63))
    out = []
    for i, t in rows:
        raw, k = (t or "").encode(), 1 << 62 if i is None else i
        off = np.zeros(len(raw), bool)
        for p in range(len(raw) - 49):
            if least[raw[p : p + 50]] < k:
                off[p : p + 50] = True
        spans = int((off & ~np.r_[False, off[:-1]]).sum()) if len(raw) else 0
        out.append((i, len(raw), int(off.sum()), spans, bytes(np.frombuffer(raw, np.uint8)[~off])))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"hot_blocks": 1}, {"bucket_bytes": 50}])
def test_cut_repeats(spark, options, monkeypatch):
    rng = random.Random(4)
    base = "".join(rng.choice("ab ") for _ in range(3000))
    rows = [(0, None), (1, ""), (None, base[:400]), (None, base[:300]), (5, base[100:900]), (5, base[100:900]), (5, base[500:1200]), (7, "x" * 49), (8, "x" * 50), (9, "x" * 300), (3, "x" * 120), (12, base[:60] + "é" + base[60:200])]
    for s in range(40):
        rows.append((20 + s, base[rng.randrange(2500) :][: rng.randrange(400)] + "".join(rng.choice("abc") for _ in range(30)) + base[rng.randrange(2500) :][: rng.randrange(400)]))
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"block": F.lit(1), "runs": F.lit("x")}).repartition(7)
    found = cut_repeats(frame, **options).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in found), key=str) == _cut(rows)
    for r in found:
        assert sum(r["span_sizes"]) == r["n_removed"] and len(r["span_starts"]) == r["n_spans"]
    assert cut_repeats(frame.limit(0)).collect() == []


def test_intervals_equal_strings():
    rng = np.random.default_rng(5)
    for n, depth in ((300, 3), (500, 9), (64, 1), (1, 4)):
        text = np.r_[rng.integers(1, 4, n - 1), 0]
        order, interval = equal_starts(text, depth)
        of = np.empty(n, int)
        of[order] = interval
        whole = [p for p in range(n - depth + 1) if 0 not in text[p : p + depth]]
        for a in whole[:60]:
            for b in whole[:200]:
                assert (of[a] == of[b]) == (text[a : a + depth] == text[b : b + depth]).all()
