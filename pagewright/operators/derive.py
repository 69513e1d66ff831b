"""What a captured page yields: title, stem, content, Markdown, text, sample, links, manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import page as p
from pagewright.functions import text as tx
from pagewright.functions import url as u


def derive(pages: DataFrame, scope: tuple[Column, Column, Column], exclude: tuple[str, ...] = (), sample_chars: int = 220, script: str | None = None) -> DataFrame:
    """All columns of pages (url, html) and: norm_url, title, file_stem, content, md, plain, text_chars, sample, links.
    script: the only one whose letter spacing is repaired; without it, that of all.

    Columns that a query does not read are not computed."""
    # the page without comments, scripts and styles is a column of its own, so that title and links share it
    own = pages.withColumn("norm_url", u.normalize(F.col("url"), *scope)).withColumn("_bare", p.bare(F.col("html")))
    named = own.withColumn("file_stem", u.page_stem(F.col("norm_url"))).withColumn("title", F.coalesce(p.title(F.col("html"), F.col("_bare")), F.col("file_stem")))
    marked = named.withColumn("content", p.main_content(F.col("html"))).withColumn("md", p.markdown(p.markdown_body(F.col("content"), script), F.col("title"), F.col("norm_url")))
    plain = marked.withColumn("plain", p.plain_body(F.col("md")))
    return plain.withColumn("text_chars", F.length("plain").cast("bigint")).withColumn("sample", tx.sample(F.col("plain"), sample_chars)).withColumn("links", p.links(F.col("html"), F.col("norm_url"), scope, exclude, F.col("_bare"))).drop("_bare")


def edges(derived: DataFrame) -> DataFrame:
    """src, pos, dst of every link."""
    return derived.select(F.col("norm_url").alias("src"), F.posexplode("links").alias("pos", "dst"))


def manifest(derived: DataFrame, raw_html: bool = True, content_html: bool = True, zstd: bool = False) -> DataFrame:
    """Manifest records: paths of the artefacts by stem; a switched-off one is empty."""
    path = lambda on, folder, suffix: F.concat(F.lit(folder + "/"), F.col("file_stem"), F.lit(suffix)) if on else F.lit("")
    return derived.select(
        F.col("norm_url").alias("url"), "title", "file_stem", path(content_html, "content_html", ".html").alias("content_html"), path(True, "markdown", ".md.zst" if zstd else ".md").alias("markdown"), path(raw_html, "raw", ".html").alias("raw_html"), F.size("links").cast("bigint").alias("links_found")
    )


def fetched(frontier: DataFrame, responses: DataFrame, on: tuple[str, ...] = ("url",)) -> DataFrame:
    """The frontier with its responses (url, status, content_type, body, error): ok, and html, the decoded body of what is ok;
    body and content_type stay as they came. No response: a failed request. on: what tells requests apart, in both tables;
    more than the URL where one was captured several times, else each of its requests meets the responses of all."""
    got = frontier.join(responses, list(on), "left").withColumn("ok", F.coalesce(F.col("status").between(200, 299), F.lit(False)))
    with p.decoding(frontier.sparkSession):
        return got.withColumn("charset", F.when(F.col("ok"), p.charset(F.col("body"), F.col("content_type")))).withColumn("html", F.when(F.col("ok"), p.decoded(F.col("body"), F.col("content_type"))))
