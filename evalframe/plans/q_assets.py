"""Registered queries: image assets.

The page table stands in for an asset store: ``images/{page_id}.jpg`` holds the
page's bytes, and pages with ``page_id % 4 = 0`` are absent from the store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.functions import assets as E
from evalframe.operators import assets as A
from evalframe.plans import fixtures as fx
from evalframe.plans import oracles as O
from evalframe.plans.catalog import register
from evalframe.session import scratch_dir
from evalframe.sources import asset_listing as AL

BASE = "/data/assets"

_REFS_SQL = """
refs AS (
  SELECT page_id AS id,
         CASE WHEN page_id % 3 = 0 THEN 'images/' || CAST(page_id AS VARCHAR) || '.jpg'
              WHEN page_id % 5 = 0 THEN '/abs/images/' || CAST(page_id AS VARCHAR) || '.jpg'
              ELSE url END AS ref
  FROM pages),
store AS (
  SELECT '/data/assets/images/' || CAST(page_id AS VARCHAR) || '.jpg' AS path, encode(html) AS content
  FROM pages WHERE page_id % 4 <> 0)"""

_RESOLVED_SQL = """
CASE WHEN starts_with(ref, 'http://') OR starts_with(ref, 'https://') THEN ref
     WHEN starts_with(ref, '/') THEN ref ELSE '/data/assets/' || ref END"""


def refs(spark: SparkSession, sf: str) -> DataFrame:
    pg = fx.table(spark, sf, "pages")
    pid = F.col("page_id")
    rel = F.concat(F.lit("images/"), pid.cast("string"), F.lit(".jpg"))
    return pg.select(pid.alias("id"), F.when(pid % 3 == 0, rel)
                     .when(pid % 5 == 0, F.concat(F.lit("/abs/"), rel))
                     .otherwise(F.col("url")).alias("ref"))


def store(spark: SparkSession, sf: str) -> DataFrame:
    pg = fx.table(spark, sf, "pages").where(F.col("page_id") % 4 != 0)
    return pg.select(F.concat(F.lit(BASE + "/images/"), F.col("page_id").cast("string"), F.lit(".jpg")).alias("path"),
                     F.col("html").cast("binary").alias("content"))


def _resolved(spark, sf):
    r = refs(spark, sf)
    return r.withColumn("path", F.when(E.is_url("ref"), F.col("ref")).otherwise(E.resolve_path(F.lit(BASE), "ref")))


@register("is_url", O.with_(_REFS_SQL) + """
SELECT id, ref, starts_with(ref, 'http://') OR starts_with(ref, 'https://') AS is_url FROM refs""")
def is_url(spark: SparkSession, sf: str) -> DataFrame:
    return refs(spark, sf).select("id", "ref", E.is_url("ref").alias("is_url"))


@register("resolve_path", O.with_(_REFS_SQL) + f"SELECT id, {_RESOLVED_SQL} AS path FROM refs")
def resolve_path(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved(spark, sf).select("id", "path")


@register("missing_assets", O.with_(_REFS_SQL) + f"""
SELECT id, path FROM (SELECT id, {_RESOLVED_SQL} AS path FROM refs) r
WHERE NOT (starts_with(path, 'http://') OR starts_with(path, 'https://'))
  AND NOT EXISTS (SELECT 1 FROM store s WHERE s.path = r.path)""")
def missing_assets(spark: SparkSession, sf: str) -> DataFrame:
    """E3 against files: the store is written below a folder of its own, a
    hundred pages a directory, and listed in tasks; then the references are
    held against the names that the store's layout gives them."""
    root = scratch_dir(spark, "asset-store").removeprefix("file:")
    shard = F.concat(F.lit("/"), F.regexp_extract("path", r"(\d*?)\d{0,2}\.jpg$", 1), F.lit("/"), F.substring_index("path", "/", -1))
    AL.write_files(store(spark, sf).select(F.concat(F.lit(root), shard).alias("path"), "content"), root)
    files = A.read_assets(spark, root, glob="*.jpg", with_content=False)
    named = files.select(F.concat(F.lit(BASE + "/images/"), F.substring_index("path", "/", -1)).alias("path"))
    return A.missing_assets(_resolved(spark, sf).select("id", "path"), named).select("id", "path")


@register("data_url", "SELECT page_id AS id, 'data:image/jpeg;base64,' || to_base64(encode(html)) AS data_url FROM pages")
def data_url(spark: SparkSession, sf: str) -> DataFrame:
    return fx.asset_bytes(spark, sf).select("id", E.data_url("content").alias("data_url"))


@register("attach_images", O.with_(_REFS_SQL) + f"""
SELECT r.id, r.path, CASE WHEN s.content IS NOT NULL THEN 'data:image/jpeg;base64,' || to_base64(s.content) END AS data_url
FROM (SELECT id, {_RESOLVED_SQL} AS path FROM refs) r LEFT JOIN store s ON r.path = s.path""")
def attach_images(spark: SparkSession, sf: str) -> DataFrame:
    return A.attach_data_urls(_resolved(spark, sf).select("id", "path"), store(spark, sf)).select("id", "path", "data_url")


_DOC_IMG_SQL = """
doc_j AS (
  SELECT doc_id AS id, unnest(range(1, CAST(doc_id % 4 AS INTEGER) + 1)) AS j FROM documents WHERE doc_id % 5 <> 0),
doc_refs AS (
  SELECT id, j, 'img/' || CAST(id AS VARCHAR) || '_' || CAST(j AS VARCHAR) AS ref FROM doc_j),
doc_store AS (
  SELECT '/data/assets/' || ref AS path FROM doc_refs WHERE (id + j) % 3 <> 0)"""


def doc_store(spark: SparkSession, sf: str) -> DataFrame:
    ph = fx.placeholder_text(spark, sf)
    ex = ph.select("id", F.posexplode("images").alias("pos", "ref"))
    return ex.where((F.col("id") + F.col("pos") + 1) % 3 != 0).select(
        F.concat(F.lit(BASE + "/"), F.col("ref")).alias("path"))


@register("resolve_assets", O.with_(_DOC_IMG_SQL) + """
SELECT d.doc_id AS id,
       coalesce(string_agg(CASE WHEN r.ref IS NOT NULL THEN '/data/assets/' || r.ref END, ',' ORDER BY r.j), '') AS resolved,
       CAST(count(r.ref) - count(s.path) AS INTEGER) AS n_missing
FROM documents d LEFT JOIN doc_refs r ON r.id = d.doc_id
     LEFT JOIN doc_store s ON s.path = '/data/assets/' || r.ref
GROUP BY d.doc_id""")
def resolve_assets(spark: SparkSession, sf: str) -> DataFrame:
    ph = fx.placeholder_text(spark, sf).select("id", "images")
    out = A.resolve_assets(ph, doc_store(spark, sf), "id", "images", BASE)
    return out.select("id", F.array_join("resolved_images", ",").alias("resolved"), "n_missing")


@register("read_asset_files", """
SELECT page_id AS id, CAST(octet_length(encode(html)) + 1 AS BIGINT) AS length,
       'data:image/jpeg;base64,' || to_base64(encode(html || chr(10))) AS data_url
FROM pages""")
def read_asset_files(spark: SparkSession, sf: str) -> DataFrame:
    """A8 on real files: every page's bytes and a newline become one file, a
    hundred pages a directory; the files are listed and read in tasks, then
    encoded (E4)."""
    root = scratch_dir(spark, "asset-files").removeprefix("file:")
    pid = F.col("page_id")
    name = F.concat(F.lit(root + "/"), F.floor(pid / 100).cast("string"), F.lit("/"), pid.cast("string"), F.lit(".jpg"))
    AL.write_files(fx.table(spark, sf, "pages").select(name.alias("path"), F.concat("html", F.lit("\n")).cast("binary").alias("content")), root)
    files = A.read_assets(spark, root, glob="*.jpg")
    number = F.regexp_extract("path", r"(\d+)\.jpg$", 1).cast("long")
    return files.select(number.alias("id"), "length", E.data_url("content").alias("data_url"))


@register("attach_hot_image", """
SELECT d.doc_id AS id, '/data/assets/images/' || CAST(d.page AS VARCHAR) || '.jpg' AS path,
       md5('data:image/jpeg;base64,' || to_base64(encode(p.html))) AS data_url_digest
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE doc_id % 1000 END AS page FROM documents) d LEFT JOIN pages p ON p.page_id = d.page""")
def attach_hot_image(spark: SparkSession, sf: str) -> DataFrame:
    """A8 and E4 where a third of all items have one image: its references are
    found by a sketch and salted, its bytes carried once for each salt."""
    page = F.when(F.col("doc_id") % 3 == 0, F.lit(1)).otherwise(F.col("doc_id") % 1000)
    path = lambda c: F.concat(F.lit(BASE + "/images/"), c.cast("string"), F.lit(".jpg"))
    items = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), path(page).alias("path"))
    images = fx.table(spark, sf, "pages").select(path(F.col("page_id")).alias("path"), F.col("html").cast("binary").alias("content"))
    return A.attach_data_urls(items, images).select("id", "path", F.md5("data_url").alias("data_url_digest"))
