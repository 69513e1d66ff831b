"""Whole runs of the two archivers, the steps that they are made of, and the native text expressions against plain models."""

import html
import os
import random
import re
import shutil
import struct
import subprocess
import sys
import zlib

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pagewright.functions import page
from pagewright.functions import url as u
from pagewright.operators import crawl, derive, run, scan
from pagewright.options import CrawlOptions, ScanOptions
from pagewright.plans import skew
from pagewright.plans.ranking import numbered
from pagewright.plans.workspace import Workspace
from pagewright.sources import archive


def test_entities(spark):
    texts = ["&amp;lt; &lt;b&gt;", "&#1071;&#x42F;&#x1F600;&eacute;&Eacute;&amp", "&nosuch; & &;", "&#0;&#xD800;&#x110000;&#99999999999;&#128;&#x9F;", "&notin;&hellip;&NotEqualTilde;", "plain", "", None, "&#x41 &#65;;"]
    got = [r["x"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", page.entities(F.col("t")).alias("x")).orderBy("i").collect()]
    one = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
    assert got == [None if t is None else one.sub(lambda m: html.unescape(m[0]), t) for t in texts]


def test_titles_links_and_markdown_read_all_references(spark):
    row = spark.createDataFrame([("http://s.test/", '<h1>A&#39;s caf&eacute; &#1071;</h1><p>&Agrave;&#x2014;x</p><a href="/a?b=1&#38;c=2">x</a>')], "url string, html string")
    got = derive.derive(row, tuple(map(F.lit, ("s.test", "http://s.test/", "/")))).select("title", "md", "links").first()
    assert got["title"] == "A's café Я" and "À—x" in got["md"] and got["links"] == ["http://s.test/a?b=1&c=2"]


def test_signs_of_tags_do_not_depend_on_the_way(spark):
    r = random.Random(1)
    pieces = ["<h1>", "</h1 >", "< H2 class=x>", "</ h2>", "<br/>", "<BR>", "<p", ">", "</p>", "</ P >", "<li >", "</tr>", "</td>", "</td x>", "< /tr>", "< / td>", "< /h1>", "</ TR >", "<b>", "</b>", "<pre>", "<h10>", "<tr>", "</center>", "<div>", "</div>", "text", " ", "\n", "<", "a < b", "<p\n>", "</\np>", "<p/x>", "<h3-x>"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 9))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    steps = F.col("t")
    for pattern, sign in page.MARKS:
        steps = F.regexp_replace(steps, pattern, sign)
    wrong = df.select("t", page._signed(F.col("t")).alias("a"), F.regexp_replace(steps, "(?s)<[^>]+>", " ").alias("b")).filter("a != b").collect()
    assert not wrong, wrong[:3]


def test_decoding_leaves_the_session_as_it_was(spark):
    before = [spark.conf.get(k, None) for k in page.SESSION]
    responses = spark.createDataFrame([("a", 200, "text/html; charset=koi8-r", bytes([0xF0]), None), ("b", 500, None, b"x", None)], "url string, status int, content_type string, body binary, error string")
    got = derive.fetched(responses.select("url").unionByName(spark.createDataFrame([("c",)], "url string")), responses)
    assert [spark.conf.get(k, None) for k in page.SESSION] == before
    assert {r["url"]: (r["ok"], r["charset"], r["html"], r["body"] and bytes(r["body"])) for r in got.collect()} == {"a": (True, "KOI8-R", "П", b"\xf0"), "b": (False, None, None, b"x"), "c": (False, None, None, None)}


def test_bad_exclusion_patterns_fail_at_once(spark):
    with pytest.raises(ValueError):
        u.excluded_by(F.lit("x"), ("(?P<n>a)",))  # Python's own syntax, which the JVM does not know
    assert spark.range(1).select(u.excluded_by(F.lit("xay"), ("b", "[a&&[^b]]")).alias("x")).first()["x"] == "[a&&[^b]]"


SITE = {"http://s.test/": ["/a", "/b"], "http://s.test/a": ["/c"], "http://s.test/b": [], "http://s.test/c": ["/a"]}


def responses_of(spark, site, bad=()):
    rows = [(x, 500 if x in bad else 200, "text/html", ("<h1>" + x[-1] + "</h1>" + "".join(f'<a href="{h}">x</a>' for h in hs)).encode(), None) for x, hs in site.items()]
    return spark.createDataFrame(rows, "url string, status int, content_type string, body binary, error string")


def test_crawl_run(spark, tmp_path):
    out = str(tmp_path / "site")
    ws = Workspace(spark, "t")
    options = CrawlOptions("http://s.test/", out, limit=2, zstd=True)
    first = run.crawl_run(options, responses_of(spark, SITE), ws)
    assert first.progress.first()["downloaded"] == 2 and first.manifest.count() == 2
    again = run.crawl_run(CrawlOptions("http://s.test/", out), responses_of(spark, SITE, {"http://s.test/c"}), ws, archive.load_state(spark, out + "/state"))
    state = {r["url"]: r["status"] for r in again.state.collect()}
    assert state == {"http://s.test/": "downloaded", "http://s.test/a": "downloaded", "http://s.test/b": "downloaded", "http://s.test/c": "failed"}
    assert {r["url"] for r in spark.read.json(out + "/manifest").collect()} == set(list(SITE)[:3])
    assert spark.read.json(out + "/progress").first()["failed"] == 1
    third = run.crawl_run(CrawlOptions("http://s.test/", out, retry_failed=True), responses_of(spark, SITE), ws, archive.load_state(spark, out + "/state"))
    assert third.manifest.count() == 1 and {r["status"] for r in third.state.collect()} == {"downloaded"}
    with pytest.raises(ValueError):
        run.crawl_run(CrawlOptions("http://other.test/"), responses_of(spark, SITE), ws, third.state)


def test_crawl_of_known_bad_urls(spark):
    rows = [("u1", "queued", None, 0), ("u1", "failed", "HTTP 500 for u1", -1), ("u2", "queued", None, 1), ("u2", "skipped", "x", -1), ("u3", "queued", None, 2)]
    state = spark.createDataFrame(rows, "url string, status string, reason string, enqueue_pos bigint")
    responses = spark.createDataFrame([(x, 200, None) for x in ("u1", "u2", "u3")], "url string, status int, error string")
    edges = spark.createDataFrame([], "src string, pos int, dst string")
    of = lambda **k: sorted((r["url"], r["status"]) for r in crawl.crawl(state, responses, edges, Workspace(spark, "t"), **k).collect())
    assert of() == [("u1", "downloaded"), ("u2", "skipped"), ("u3", "downloaded")]
    assert of(skip_failed=True) == [("u1", "failed"), ("u2", "skipped"), ("u3", "downloaded")]
    assert of(redownload=True) == [("u1", "downloaded"), ("u2", "downloaded"), ("u3", "downloaded")]


def test_crawl_merges_its_parts(spark, monkeypatch):
    monkeypatch.setattr(crawl, "MOST_PARTS", 2)
    edges = spark.createDataFrame([(f"u{i}", 0, f"u{i + 1}") for i in range(6)], "src string, pos int, dst string")
    state = spark.createDataFrame([("u0", "queued", None, 0)], "url string, status string, reason string, enqueue_pos bigint")
    responses = spark.createDataFrame([(f"u{i}", 200, None) for i in range(7)], "url string, status int, error string")
    got = crawl.crawl(state, responses, edges, Workspace(spark, "t")).collect()
    assert sorted((r["url"], r["enqueue_pos"]) for r in got) == [(f"u{i}", i) for i in range(7)]


E = "http://elib.rgo.ru"
PLAYER = r'{"iipServerURL":"https:\/\/c.test\/iip","imageDir":"\/d\/","objectData":"https:\/\/c.test\/o.json"}'
LIBRARY = [
    (E + "/handle/1/9", '<p class=pagination><a href="/handle/1/10">x</a><a href="?offset=20">x</a><a href="/handle/1/12">x</a>'), (E + "/handle/1/9?offset=20", '<p class=pagination><a href="/handle/1/11">x</a><a href="/handle/1/9?offset=20">x</a>'),
    (E + "/handle/1/10", '<a class="b button-primary" href="/safe-view/1/2/1/MDAyX1IucGRm">x</a>'), (E + "/safe-view/1/2/1/MDAyX1IucGRm", "setPagesCount(2)"), (E + "/handle/1/11", PLAYER), (E + "/handle/1/12", "<a class=button href=/safe-view/no>x</a>"), ("http://www.prlib.ru/item/5", PLAYER),
]
SAFE = [E + "/safe-view/1/2/1/MDAyX1IucGRmLzA=", E + "/safe-view/1/2/1/MDAyX1IucGRmLzE="]
PLAYED = ["https://c.test/iip?IIIF=/d/1.tif/info.json", "https://c.test/iip?IIIF=/d/2.tif/info.json"]


def library(spark):
    return spark.createDataFrame(LIBRARY, "url string, html string"), spark.createDataFrame([("https://c.test/o.json", '{"pgs":[{"f":"1.tif"},{"f":"2.tif"}]}')], "url string, body string")


def test_library_pages_lead_to_tasks(spark):
    pages, documents = library(spark)
    starts = spark.createDataFrame([(0, E + "/handle/1/9"), (1, "http://gone.test/handle/1/1")], "pos bigint, url string")
    got = scan.library_tasks(starts, pages, documents, Workspace(spark, "t")).orderBy("at").collect()
    assert [r["url"] for r in got] == [*SAFE, *PLAYED]
    with pytest.raises(RuntimeError):
        scan.collection_items(E + "/handle/1/9", pages, Workspace(spark, "t"), levels=1)


def test_scan_seeds_in_order(spark, tmp_path):
    pages, documents = library(spark)
    lines = spark.createDataFrame([(0, "http://l.test/1.jpg"), (1, E + "/handle/1/10"), (2, "# no"), (3, "t/8.jpg")], "pos bigint, value string")
    shown = spark.createDataFrame([("http://p.test/x/", '<img src="a.png"><img src="b.jpg">')], "url string, html string")
    options = ScanOptions(item=("http://www.prlib.ru/item/5",), page=("http://p.test/x/",), url_template="t/{n}.jpg", first=8, last=9, handle=(E + "/handle/1/9",))
    got = run.scan_seeds(options, pages.unionByName(shown), documents, Workspace(spark, "t"), lines).orderBy("enqueue_pos").collect()
    assert [r["url"] for r in got] == [*PLAYED, "http://p.test/x/a.png", "http://p.test/x/b.jpg", "t/8.jpg", "t/9.jpg", "http://l.test/1.jpg", *SAFE] and [r["enqueue_pos"] for r in got] == list(range(9))
    outright = ScanOptions(object_data="https://c.test/o.json", iip="i", image_dir="/q")
    assert [r["url"] for r in run.scan_seeds(outright, pages, documents, Workspace(spark, "t")).orderBy("enqueue_pos").collect()] == ["i?IIIF=/q/1.tif/info.json", "i?IIIF=/q/2.tif/info.json"]
    (tmp_path / "list.txt").write_text("# urls\n http://l.test/2.jpg \n\nhttp://l.test/1.jpg\n")
    listed = run.scan_seeds(ScanOptions(url_list=str(tmp_path / "list.txt")), pages, documents, Workspace(spark, "t"))
    assert [r["url"] for r in listed.orderBy("enqueue_pos").collect()] == ["http://l.test/2.jpg", "http://l.test/1.jpg"]
    with pytest.raises(ValueError):
        run.scan_seeds(ScanOptions(), pages, documents, Workspace(spark, "t"))


def packed(pixels):
    return b"\xff\xd8" + struct.pack("<HH", *pixels.shape[:2]) + pixels.tobytes()


def unpacked(data):
    if data[:2] != b"\xff\xd8":
        raise ValueError("decoding failed")
    return np.frombuffer(data[6:], np.uint8).reshape(*struct.unpack("<HH", data[2:6]), 3)


def refused(data):
    if len(data) > 50:
        raise ValueError("not to be kept as it is")
    return b"T" + data


def test_scan_run(spark):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import a test
    codecs = scan.Codecs(unpacked, packed, lambda pixels: b"X" + pixels.tobytes(), refused)
    whole = np.random.default_rng(1).integers(0, 255, (70, 100, 3), np.uint8)
    base = "https://c.test/iip?IIIF=/d/1.tif"
    infos = spark.createDataFrame([(base + "/info.json", '{"width":100,"height":70,"x":1}'), ("https://c.test/iip?IIIF=/d/2.tif/info.json", "broken")], "url string, body string")
    frames = [(f"{base}/{x},{y},{min(64, 100 - x)},{min(64, 70 - y)}/full/0/default.jpg", packed(whole[y : y + 64, x : x + 64])) for y in (0, 64) for x in (0, 64)]
    small, large = packed(whole[:3, :4]), packed(whole[:20, :20])
    bodies = spark.createDataFrame([*frames, ("http://h.test/small.jpg", small), ("http://h.test/large.jpg", large), ("http://h.test/bad.jpg", b"html" * 20), (base + "/full/max/0/default.jpg", large)], "url string, body binary")
    tasks = [base + "/info.json", "https://c.test/iip?IIIF=/d/2.tif/info.json", "http://h.test/small.jpg", "http://h.test/large.jpg", "http://h.test/bad.jpg", "http://h.test/gone.jpg"]
    seeds = spark.createDataFrame(list(enumerate(tasks)), "enqueue_pos bigint, url string")
    got = {r["url"]: r for r in run.scan_run(ScanOptions(tile=10, lossless=True, keep_raw=True, min_bytes=40), seeds, infos, bodies, codecs, Workspace(spark, "t")).collect()}
    assert bytes(got[tasks[0]]["raw"]) == packed(whole) and bytes(got[tasks[0]]["jxl"]) == b"X" + whole.tobytes() and (got[tasks[0]]["width"], got[tasks[0]]["height"], got[tasks[0]]["file_stem"]) == (100, 70, "1.tif")
    assert bytes(got[tasks[2]]["jxl"]) == b"T" + small and got[tasks[2]]["transcoded"]
    assert bytes(got[tasks[3]]["jxl"])[:1] == b"X" and not got[tasks[3]]["transcoded"]  # transcoding failed: through pixels
    errors = {x: got[x]["error"] for x in tasks if not got[x]["ok"]}
    assert set(errors) == {tasks[1], tasks[4], tasks[5]} and errors[tasks[5]] == "not captured: http://h.test/gone.jpg" and errors[tasks[4]] == "decoding failed"
    one = run.scan_run(ScanOptions(full_res=False, jxl=False, min_bytes=5000), seeds, infos, bodies, codecs, Workspace(spark, "t"), seeds.filter("enqueue_pos = 5")).collect()
    found = {r["url"]: r for r in one}
    assert len(found) == 5 and (found[tasks[0]]["width"], found[tasks[0]]["height"], found[tasks[0]]["jxl"]) == (20, 20, None) and bytes(found[tasks[0]]["raw"]) == large
    assert found[tasks[3]]["error"].startswith("response too small")


def test_images_of_files(spark, tmp_path):
    rgb = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + row.tobytes() for row in rgb))) + chunk(b"IEND", b"")
    (tmp_path / "a.png").write_bytes(png)
    (tmp_path / "b.png").write_bytes(b"no image")
    row = scan.images(spark, str(tmp_path)).collect()
    assert [(r["width"], r["height"], bytes(r["data"])) for r in row] == [(3, 2, rgb.tobytes())]


def test_hot_keys_are_spread(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST", 10)
    left = spark.range(500).select(F.when(F.col("id") < 400, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), "id")
    right = spark.createDataFrame([("hot", 1), ("450", 2)], "k string, v int")
    out = skew.spread_join(left, right, ["k"], left.groupBy("k").agg(F.count("*").alias("n")))
    assert out.count() == 500 and out.filter("v = 1").count() == 400 and out.filter("v = 2").count() == 1 and set(out.columns) == {"k", "id", "v"}
    assert skew.spread_join(left, right, ["k"], left.groupBy("k").agg(F.count("*").alias("n")), "inner").count() == 401


def test_numbered(spark):
    rows = numbered(spark.range(100).select((F.col("id") * 37 % 101).alias("x")).repartition(7), ["x"], "nth", Workspace(spark, "t"), 5).collect()
    assert [r["nth"] for r in sorted(rows, key=lambda r: r["x"])] == list(range(5, 105))


def test_without_the_llm_folders(tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "repo"
    shutil.copytree(here, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and o and set(o) <= set(q) and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
