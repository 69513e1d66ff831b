"""Raw page archives, list files, state files and manifests: sources and sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagewright import schemas


@F.pandas_udf(T.BinaryType())
def unzstd(frames: pd.Series) -> pd.Series:
    """Contents of zstd frames; a frame need not say its size."""
    import zstandard

    reader = zstandard.ZstdDecompressor()
    return frames.map(lambda b: None if b is None else reader.decompressobj().decompress(bytes(b)))


def zstd(level: int = 19):
    """Function of a binary column: one zstd frame a value."""

    @F.pandas_udf(T.BinaryType())
    def pack(values: pd.Series) -> pd.Series:
        import zstandard

        writer = zstandard.ZstdCompressor(level=level)
        return values.map(lambda b: None if b is None else writer.compress(bytes(b)))

    return pack


def raw_pages(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """file_name, file_stem, html of a folder's *.html and *.html.zst files (case does not matter) in the order of their names.

    The stem loses a lower-case suffix only. Bytes that are not UTF-8 become U+FFFD. Of x.html and x.html.zst, which share a
    stem, both have a row; the later name is the one to keep."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{[hH][tT][mM][lL],[hH][tT][mM][lL].[zZ][sS][tT]}").load(folder)
    name = F.substring_index("path", "/", -1)
    named = files.select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("file_name"), "content")
    if limit is not None:
        named = named.orderBy("file_name").limit(limit)
    packed = F.rlike("file_name", F.lit("(?i)\\.zst$"))
    body = F.coalesce(unzstd(F.when(packed, F.col("content"))), F.col("content"))
    stem = F.regexp_replace(F.regexp_replace("file_name", "\\.zst$", ""), "\\.html$", "")
    return named.select("file_name", stem.alias("file_stem"), F.make_valid_utf8(body.cast("string")).alias("html"))


def list_lines(spark: SparkSession, path: str) -> DataFrame:
    """pos, value of a text file's lines."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("pos"), "value")


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """A crawl state file as rows url, status, reason, enqueue_pos; missing parts are empty."""
    raw = spark.read.schema(schemas.CRAWL_STATE).json(path, multiLine=True)
    texts, pairs = F.array().cast("array<string>"), F.create_map().cast("map<string,string>")
    full = raw.select(*(F.coalesce(c, texts).alias(c) for c in ("queue", "seen", "downloaded")), *(F.coalesce(c, pairs).alias(c) for c in ("failed", "skipped")))
    none = F.lit(None).cast("string")
    queued = full.select(F.posexplode("queue").alias("pos", "url")).select("url", F.lit("queued").alias("status"), none.alias("reason"), F.col("pos").cast("bigint").alias("enqueue_pos"))
    done = full.select(F.explode("downloaded").alias("url")).select("url", F.lit("downloaded").alias("status"), none.alias("reason"), F.lit(-1).cast("bigint").alias("enqueue_pos"))
    out = queued.unionByName(done)
    for status in ("failed", "skipped"):
        out = out.unionByName(full.select(F.explode(status).alias("url", "reason")).select("url", F.lit(status).alias("status"), "reason", F.lit(-1).cast("bigint").alias("enqueue_pos")))
    return out


def write_state(state: DataFrame, folder: str) -> None:
    """A crawl state as JSON lines, one a URL, in as many files as it has partitions; it replaces the earlier one whole."""
    state.select("url", "status", "reason", "enqueue_pos").write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def load_state(spark: SparkSession, folder: str) -> DataFrame:
    """What write_state wrote."""
    return spark.read.schema(schemas.URL_STATE).json(folder)


#: URLs of a state that may become one document.
MOST_DOCUMENT = 1_000_000


def state_document(state: DataFrame) -> DataFrame:
    """One row, `value`: a small state as the compact JSON document of a checkpoint, for exchange; greater ones are refused."""
    if (n := state.count()) > MOST_DOCUMENT:
        raise ValueError(f"a state of {n} URLs is too large for one document; see write_state")
    of = lambda s: F.collect_list(F.when(F.col("status") == s, F.struct("enqueue_pos", "url", "reason")))
    lists = state.agg(*(F.sort_array(of(s)).alias(s) for s in ("queued", "downloaded", "failed", "skipped")), F.sort_array(F.collect_list("url")).alias("seen"))
    urls = lambda c: F.transform(c, lambda r: r["url"])
    pairs = lambda c: F.map_from_entries(F.transform(c, lambda r: F.struct(r["url"], F.coalesce(r["reason"], F.lit("")))))
    return lists.select(F.to_json(F.struct(urls(F.col("queued")).alias("queue"), "seen", urls(F.col("downloaded")).alias("downloaded"), pairs(F.col("failed")).alias("failed"), pairs(F.col("skipped")).alias("skipped"))).alias("value"))


def write_manifest(records: DataFrame, folder: str) -> None:
    """Append manifest records as JSON lines; the committer publishes whole files or none."""
    records.write.mode("append").option("ignoreNullFields", "false").json(folder)


def write_artefacts(derived: DataFrame, folder: str, kinds: tuple[str, ...] = ("html", "content", "md"), zstd_level: int | None = None) -> None:
    """One row a page, partitioned by host: raw page, content and Markdown as columns; zstd: Markdown as frames."""
    from pagewright.functions import url as u

    rows = derived.select(u.host(F.col("norm_url")).alias("host"), "norm_url", "file_stem", "title", *kinds)
    if zstd_level is not None and "md" in kinds:
        rows = rows.withColumn("md", F.encode("md", "utf-8"))
        rows = rows.mapInArrow(_packed("md", zstd_level), rows.schema)
    rows.write.mode("append").partitionBy("host").option("compression", "zstd").parquet(folder)


def _packed(column: str, level: int):
    """Rows with a binary column as zstd frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        writer = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            i = batch.schema.names.index(column)
            frames = [None if b is None else writer.compress(b) for b in batch.column(i).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary()) if k == i else c for k, c in enumerate(batch.columns)], batch.schema.names)

    return run


def latest(pages: DataFrame) -> DataFrame:
    """Of files that share a stem the one of the later name."""
    return pages.withColumn("_n", F.row_number().over(Window.partitionBy("file_stem").orderBy(F.desc("file_name")))).filter("_n = 1").drop("_n")
