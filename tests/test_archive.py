"""Expressions and operators of the archive part on cases worked out by hand, and against small models in plain Python."""

import hashlib
import html.parser
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright import options
from pagewright.functions import page, text, url, viewers
from pagewright.operators import crawl, derive, scan
from pagewright.plans.workspace import Workspace
from pagewright.sources import archive


def one(spark, expression, **columns):
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} string" for c in columns)).select(expression.alias("x")).first()["x"]


def model_despace(s):
    """The letter-spacing rule, read as a scanner: a phrase at each place, else one character."""
    marks = lambda c: 0x300 <= ord(c) <= 0x36F
    spaces = " \t  "

    def cluster(i):
        if i >= len(s) or not s[i].isalpha():
            return None
        j = i + 1
        while j < len(s) and marks(s[j]):
            j += 1
        return s[i:j], j

    def phrase(i):
        if i and s[i - 1].isalpha() or cluster(i) is None:
            return None
        first, at = cluster(i)
        words, singles = [[first]], 0
        while True:
            j = at
            while j < len(s) and s[j] in spaces:
                j += 1
            nxt = cluster(j)
            if j == at or nxt is None:
                break
            if j - at == 1:
                if nxt[1] < len(s) and s[nxt[1]].isalpha():
                    break
                words[-1].append(nxt[0])
                singles += 1
            else:
                words.append([nxt[0]])
            at = nxt[1]
        total = sum(map(len, words))
        good = singles >= 2 and first.lower() not in ("и", "о") and (max(map(len, words)) >= 4 or len(words) > 1 and total >= 5)
        return (" ".join("".join(w) for w in words), at) if good else None

    out, i = [], 0
    while i < len(s):
        found = phrase(i)
        if found:
            out.append(found[0])
            i = found[1]
        else:
            out.append(s[i])
            i += 1
    return "".join(out)


def test_letter_spacing_against_a_scanner(spark):
    r = random.Random(4)
    data = ["".join(r.choice("абиоИ    \t.́1x\n") for _ in range(r.randint(0, 24))) for _ in range(4000)] + ["с л о в о"] * 2 + ["а " * 9000]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(data)], "i int, t string").select("i", text.despace(F.col("t")).alias("d")).collect()
    for row in got:
        assert row["d"] == model_despace(data[row["i"]])


def test_letter_spacing_of_one_script(spark):
    """A phrase with a letter of the script is joined as without it, others stay."""
    data = ["A A A A A A", "с л о в о", "с л o в о", "x y z w  с л о в о", "A B C D, с л о в о", "W o r t", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(data)], "i int, t string")
    got = {r["i"]: (r["c"], r["a"]) for r in rows.select("i", text.despace(F.col("t"), text.CYRILLIC).alias("c"), text.despace(F.col("t")).alias("a")).collect()}
    for i, t in enumerate(data):
        whole = None if t is None else model_despace(t)
        assert got[i] == ({0: t, 4: "A B C D, слово", 5: t}.get(i, whole), whole)


def test_markdown_fragments(spark):
    for source, want in [("<p>О<b>к</b>оло  , да</p>", "Ок оло, да"), ("<ul><li>a<li>b</ul>", "- a\n- b"), ("<tr><td>1</td><td>2</td></tr>", "1 | 2 |"), ("x<script>y</script>z", "xz"), ("a<i>b</i>c", "a b c"), ("a\r\nb&nbsp; c", "a\n\nb  c"), ("( a ) « b »", "(a) «b»")]:
        assert one(spark, page.markdown_body(F.col("t")), t=source) == want


def test_plain_body_and_sample(spark):
    assert one(spark, page.plain_body(F.col("t")), t="# a --- b\n\n---\n\nbody  x\n") == "b --- body x"
    assert one(spark, text.sample(F.col("t"), 3), t="abcd") == "abc…"
    assert one(spark, text.sample(F.col("t"), 0), t="abcd") == ""


def test_links_agree_with_a_parser(spark, small):
    class Anchors(html.parser.HTMLParser):
        def __init__(self):
            super().__init__()
            self.found = []

        def handle_starttag(self, tag, attrs):
            if tag == "a" and dict(attrs).get("href") is not None:
                self.found.append(dict(attrs)["href"])

    rows = spark.read.parquet(f"{small}/pages.parquet").select("html", page.hrefs(F.col("html")).alias("h")).collect()
    for r in rows:
        parser = Anchors()
        parser.feed(r["html"])
        assert r["h"] == [h for h in parser.found if not h.startswith(("#", "mailto:", "javascript:"))]


def test_stems_are_stable(spark):
    r = random.Random(6)
    data = [("".join(r.choice("ab._-/ё ?%") for _ in range(r.randint(0, 12))),) for _ in range(500)]
    df = spark.createDataFrame(data, "t string").select(url.text_stem(F.col("t")).alias("a"), url.scan_text_stem(F.col("t")).alias("b"), text.clean_ws(F.col("t")).alias("c"))
    for r in df.select("a", url.text_stem(F.col("a")).alias("a2"), "b", url.scan_text_stem(F.col("b")).alias("b2"), "c", text.clean_ws(F.col("c")).alias("c2")).collect():
        assert r["a"] == r["a2"] and r["c"] == r["c2"] and len(r["b2"]) <= len(r["b"])


def test_scope_and_options():
    assert url.Scope.of("https://User@S.test:8080/sec/#x") == url.Scope("s.test", "https://s.test/", "/sec")
    with pytest.raises(ValueError):
        url.Scope.of("ftp://s.test/")
    assert options.parse_status_list(" 403, ,404 ,403") == (403, 404)
    with pytest.raises(ValueError):
        options.parse_status_list("4x")
    assert options.parse_effort("Tortoise") == 9
    with pytest.raises(ValueError):
        options.parse_effort("snail")
    with pytest.raises(ValueError):
        options.ScanOptions(iip="x")
    with pytest.raises(ValueError):
        url.excluded_by(None, ("(",))


def test_image_predicates(spark):
    for x, want in [("https://x/y/page-1.JPEG", True), ("https://elib.rgo.ru/safe-view/1/0/3", True), ("https://x/about.html", False), ("https://x/a?Image=1", True)]:
        assert one(spark, url.looks_like_image(F.col("t")), t=x) is want


def test_stem_of_a_tile_source(spark):
    base = "https://h/iipsrv.fcgi?IIIF=/var/data/ABC/6633009/6633010_doc1_B09C.tiff"
    assert one(spark, url.iiif_stem(F.col("t")), t=base) == "6633010_doc1_B09C.tiff"
    assert one(spark, viewers.stem(F.col("t")), t=base + "/info.json") == "6633010_doc1_B09C.tiff"


def test_blit_is_clipped():
    canvas = np.zeros((4, 4, 3), np.uint8)
    piece = np.full((3, 3, 3), 9, np.uint8)
    scan.blit(canvas, piece, 2, 2)
    scan.blit(canvas, piece, 9, 9)
    scan.blit(canvas, piece, -2, -2)
    assert canvas[2, 2, 0] == canvas[3, 3, 0] == canvas[0, 0, 0] == 9 and canvas[1, 1, 0] == canvas[0, 3, 0] == 0


def test_missing_codecs_say_so():
    for encode in (scan.encode_jpeg, scan.encode_jxl):
        try:
            assert encode(np.zeros((2, 2, 3), np.uint8))
        except RuntimeError as e:
            assert "not installed" in str(e)


def test_state_file_round_trip(spark, tmp_path):
    old = tmp_path / "state.json"
    old.write_text(json.dumps({"queue": ["u1", "u2"], "downloaded": ["u0"], "failed": {"u3": "HTTP 500"}}))
    state = archive.read_state(spark, str(old))
    assert {(r["url"], r["status"], r["reason"]) for r in state.collect()} == {("u1", "queued", None), ("u2", "queued", None), ("u0", "downloaded", None), ("u3", "failed", "HTTP 500")}
    made = json.loads(archive.state_document(state).first()["value"])
    assert made == {"queue": ["u1", "u2"], "seen": ["u0", "u1", "u2", "u3"], "downloaded": ["u0"], "failed": {"u3": "HTTP 500"}, "skipped": {}}


def test_raw_archive(spark, tmp_path):
    import zstandard

    (tmp_path / "b.html").write_bytes("<p>ё".encode())
    (tmp_path / "a.html.zst").write_bytes(zstandard.ZstdCompressor().compress(b"<p>zst"))
    (tmp_path / "C.HTML").write_bytes(b"\xff")
    (tmp_path / "a.html").write_bytes(b"old")
    (tmp_path / "x.txt").write_bytes(b"no")
    got = {r["file_name"]: (r["file_stem"], r["html"]) for r in archive.raw_pages(spark, str(tmp_path)).collect()}
    assert got == {"b.html": ("b", "<p>ё"), "a.html.zst": ("a", "<p>zst"), "C.HTML": ("C.HTML", "�"), "a.html": ("a", "old")}
    assert [r["file_name"] for r in archive.raw_pages(spark, str(tmp_path), 2).collect()] == ["C.HTML", "a.html"]
    assert {r["html"] for r in archive.latest(archive.raw_pages(spark, str(tmp_path))).filter("file_stem = 'a'").collect()} == {"<p>zst"}


def test_crawl_with_saved_pages_does_not_count_them(spark):
    responses = spark.createDataFrame([(f"u{i}", 200, None) for i in range(5)], "url string, status int, error string")
    edges = spark.createDataFrame([(f"u{i}", 0, f"u{i + 1}") for i in range(4)], "src string, pos int, dst string")
    state = spark.createDataFrame([("u0", "queued", None, 0)], "url string, status string, reason string, enqueue_pos bigint")
    saved = spark.createDataFrame([("u0",), ("u1",)], "url string")
    out = crawl.crawl(state, responses, edges, Workspace(spark, "t"), limit=1, saved=saved).collect()
    assert {(r["url"], r["status"]) for r in out} == {("u0", "downloaded"), ("u1", "downloaded"), ("u2", "downloaded"), ("u3", "queued")}


def test_merge_of_states(spark):
    a = spark.createDataFrame([("u", "queued", None, 3), ("v", "failed", "x", 1)], "url string, status string, reason string, enqueue_pos bigint")
    b = spark.createDataFrame([("u", "downloaded", None, 5)], a.schema)
    assert {tuple(r) for r in crawl.merge(a, b).collect()} == {("u", "downloaded", None, 3), ("v", "failed", "x", 1)}


def test_manifest_with_outputs_off(spark):
    pages = spark.createDataFrame([("http://s.test/a/b", "<title>T</title>")], "url string, html string")
    derived = derive.derive(pages, url.own_scope(F.col("url")))
    on, off = derive.manifest(derived).first(), derive.manifest(derived, raw_html=False, content_html=False, zstd=True).first()
    assert tuple(on) == ("http://s.test/a/b", "T", "a.b", "content_html/a.b.html", "markdown/a.b.md", "raw/a.b.html", 0)
    assert tuple(off) == ("http://s.test/a/b", "T", "a.b", "", "markdown/a.b.md.zst", "", 0)


def test_letter_spacing_of_a_whole_table(spark, small):
    """Every document of the table by the scanner."""
    from pagewright import catalogue

    folder = small.replace("0.001", "0.01")
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    for r in catalogue.derazryadka_documents(spark, folder).collect():
        want = model_despace(texts[r["doc_id"]])
        assert (r["repaired_md5"], r["changed"]) == (hashlib.md5(want.encode()).hexdigest(), want != texts[r["doc_id"]]), r["doc_id"]
