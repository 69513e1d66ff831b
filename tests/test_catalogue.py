"""Every query of the catalogue that has an oracle agrees with it on the smallest tables."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pagewright import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    if isinstance(value, (int, float)):
        return f"{float(value):.9g}"
    return str(value)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_agrees_with_its_oracle(spark, small, duck, name):
    df = catalogue.QUERIES[name](spark, small)
    cols = sorted(df.columns)
    cur = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = sorted([plain(r[names.index(c)]) for c in cols] for r in cur.fetchall())
    assert sorted([plain(r[c]) for c in cols] for r in df.collect()) == want


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Pages of one URL captured several times, and words of single Latin letters."""
    spam = "<h1>{0}</h1><p>" + "A " * 12 + "reeder d d d d  e e e, B b b b b</p><p>{0}</p><a href='/x'>x</a>"
    urls = ["http://s.test/a", "http://s.test/a", "http://s.test/b#top", "http://s.test/b#top", "http://s.test/b", "https://t.test/", "http://s.test/a", "http://s.test/c?id=7"]
    folder = tmp_path_factory.mktemp("odd")
    rows = [{"page_id": i, "url": u, "html": spam.format(f"Page {i}").replace("'", '"')} for i, u in enumerate(urls)]
    pq.write_table(pa.Table.from_pylist(rows), folder / "pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["stream_manifest", "fetched_pages", "markdown_render", "offline_rebuild", "page_artefacts", "pages_manifest", "plain_sample"])
def test_agrees_on_repeated_urls_and_single_letters(spark, odd, name):
    test_agrees_with_its_oracle(spark, *odd, name)


@pytest.fixture(scope="module")
def nameless(tmp_path_factory):
    """Pages whose URL is missing or an asset, so that they have no normal form, among others."""
    urls = ["http://s.test/a", None, "http://s.test/x.pdf", "http://t.test/y.PNG", "http://s.test/b", None, "http://s.test/a"]
    return tables_of(tmp_path_factory.mktemp("nameless"), urls)


def tables_of(folder, urls):
    rows = [{"page_id": i, "url": u, "html": f"<h1>Page {i}</h1><p>text {i}</p><a href=\"/x\">x</a>"} for i, u in enumerate(urls)]
    pq.write_table(pa.Table.from_pylist(rows), folder / "pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["page_artefacts"])
def test_agrees_on_pages_without_a_normal_url(spark, nameless, name):
    test_agrees_with_its_oracle(spark, *nameless, name)


@pytest.mark.parametrize("name", ["pages_manifest", "page_artefacts"])
def test_agrees_on_what_is_no_url(spark, tmp_path, name):
    test_agrees_with_its_oracle(spark, *tables_of(tmp_path, ["http://s.test/a", "", "ftp://s.test/a", "nonsense", "mailto:x@y", "HTTP://S.test/b"]), name)


def test_queries_without_oracle_run(spark, small):
    for name in set(catalogue.QUERIES) - set(catalogue.ORACLES):
        assert catalogue.QUERIES[name](spark, small).count() > 0
