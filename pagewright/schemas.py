"""Explicit schemas of the records that the engine reads and writes, as DDL."""

CRAWL_STATE = "queue ARRAY<STRING>, seen ARRAY<STRING>, downloaded ARRAY<STRING>, failed MAP<STRING,STRING>, skipped MAP<STRING,STRING>"
URL_STATE = "url STRING, status STRING, reason STRING, enqueue_pos BIGINT"
PAGE_MANIFEST = "url STRING, title STRING, file_stem STRING, content_html STRING, markdown STRING, raw_html STRING, links_found BIGINT"
OBJECT_DATA = "pgs ARRAY<STRUCT<f: STRING>>"
IMAGE_INFO = "width BIGINT, height BIGINT"
