"""Asset operators: listing (A8), missing references (E3), resolution (J5),
and late attachment of bytes as data URLs.

Image bytes are the largest cells in the pipeline.  Joins run on the path
column only; bytes are joined once, last, right before the responder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.functions.assets import data_url, is_url, resolve_path
from evalframe.operators.skew import skew_join
from evalframe.sources import asset_listing as AL


def read_assets(spark: SparkSession, root: str, glob: str | None = None, with_content: bool = True) -> DataFrame:
    """File listing (``path``, ``length``, optionally ``content``) of all files
    below ``root`` whose name matches ``glob`` (A8).  Files are listed and read
    in tasks (``sources.asset_listing``); none of their names is held by the
    driver.  ``with_content=False`` opens no file."""
    files = AL.list_assets(spark, root, glob, content=with_content)
    return files.select("path", "length", *(["content"] if with_content else []))


def explode_refs(items: DataFrame, id_col: str, images_col: str, base_dir: str | None,
                 keep_empty: bool = False) -> DataFrame:
    """One row per (item, position, reference), resolved against ``base_dir``;
    URLs are kept as they are.  ``keep_empty`` keeps one null row for items
    without references."""
    ex = items.select(id_col, F.posexplode_outer(images_col).alias("pos", "ref"))
    if not keep_empty:
        ex = ex.where(F.col("ref").isNotNull())
    resolved = F.when(is_url("ref"), F.col("ref"))
    resolved = resolved.otherwise(resolve_path(F.lit(base_dir), "ref")) if base_dir is not None else resolved.otherwise(F.col("ref"))
    return ex.withColumn("path", F.when(F.col("ref").isNotNull(), resolved))


def missing_assets(refs: DataFrame, manifest: DataFrame, path_col: str = "path") -> DataFrame:
    """References with no file in the manifest (E3): ``left_anti`` on the path.

    Only the manifest's path column takes part, so no bytes shuffle.  URLs are
    not probed (no network); they are reported by ``is_url`` instead.
    """
    files = manifest.select(F.col(path_col).alias("_path")).distinct()
    local = refs.where(~is_url(path_col))
    return local.join(files, local[path_col] == files["_path"], "left_anti")


def resolve_assets(items: DataFrame, manifest: DataFrame, id_col: str = "id", images_col: str = "images",
                   base_dir: str | None = None) -> DataFrame:
    """Per item (``id_col`` is its key): resolved image paths in order, and how
    many are missing (J5).

    Paths are resolved within the item's row.  Only distinct local references
    are shuffled, once, to be held against the manifest (null and URL
    references cannot be in it); what comes back is a count for each item that
    misses a file, which AQE broadcasts if it is as small as it mostly is.
    The harness raised on the first missing file; ``n_missing`` reports it so a
    caller can fail or filter.
    """
    def resolved(ref: Column) -> Column:
        return F.when(is_url(ref), ref).otherwise(resolve_path(F.lit(base_dir), ref) if base_dir is not None else ref)

    paths = F.filter(images_col, lambda r: r.isNotNull())
    rows = items.select(id_col, F.coalesce(F.transform(paths, resolved), F.array().cast("array<string>")).alias("resolved_images"))
    local = F.filter("resolved_images", lambda p: ~is_url(p))
    counted = F.transform(F.array_distinct(local), lambda p: F.struct(
        p.alias("path"), F.size(F.filter(local, lambda q: q == p)).alias("times")))
    refs = rows.select(F.col(id_col).alias("_id"), F.explode(counted).alias("r")).select("_id", "r.path", "r.times")
    missing = missing_assets(refs, manifest).groupBy("_id").agg(F.sum("times").cast("int").alias("_n"))
    return (rows.join(missing, F.col(id_col).eqNullSafe(F.col("_id")), "left")
            .select(id_col, "resolved_images", F.coalesce("_n", F.lit(0)).alias("n_missing")))


def attach_data_urls(refs: DataFrame, assets: DataFrame, path_col: str = "path") -> DataFrame:
    """Join bytes onto references last and encode them (A8 + E4); the output
    carries the data URL and drops the raw bytes.  An image of very many
    references is salted (``skew_join``); its bytes are carried once a salt.
    A path is encoded before it is joined, once for all its references."""
    urls = assets.select(F.col("path").alias(path_col), F.when(F.col("content").isNotNull(), data_url("content")).alias("data_url"))
    return skew_join(refs, urls, path_col).select(*refs.columns, "data_url")
