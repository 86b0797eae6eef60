"""Catalogue of data sets: scan of a storage tree, content manifests, reconciliation and search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the catalogue.
SUPPORTED_VERSIONS = ["v2.0", "v2.1", "v3.0"]
SCANNED = ["name", "codebase_version", "readiness", "robot_type", "total_episodes", "total_frames", "total_tasks", "fps", "fingerprint", "scan_error"]


def _relative(path: Column, root: str) -> Column:
    """Path below the root; the file system adds its scheme in front of absolute paths."""
    base = root.rstrip("/") + "/"
    return F.substring(path, F.position(F.lit(base), path) + len(base), F.length(path))


def scan(spark: SparkSession, root: str, area: str, max_depth: int = 20, skipped: Sequence[str] = (".git", ".cache")) -> DataFrame:
    """One row per ``meta/info.json`` below ``root`` with header totals, readiness and fingerprint.

    Only header documents are opened; data directories are listed, not read. Hidden and incoming directories and those
    deeper than ``max_depth`` are skipped.
    """
    if not 1 <= max_depth <= 20:
        raise ValueError("scan depth must be within 1..20")
    def files():
        return spark.read.format("binaryFile").option("recursiveFileLookup", True)

    headers = files().option("pathGlobFilter", "info.json").load(root).select(_relative(F.col("path"), root).alias("_rel"), "content")
    headers = headers.filter(F.col("_rel").rlike("(^|/)meta/info[.]json$")).withColumn(
        "relative_path", F.regexp_replace("_rel", "/?meta/info[.]json$", ""))
    parts = F.split("relative_path", "/")
    hidden = F.exists(parts, lambda p: p.isin(list(skipped)) | p.startswith(".incoming-"))
    deep = F.when(F.col("relative_path") == "", 0).otherwise(F.size(parts)) >= max_depth
    headers = headers.filter(~hidden & ~deep)
    data = files().load(root).select(_relative(F.col("path"), root).alias("_rel")).filter(F.col("_rel").rlike("(^|/)data/")).select(
        F.regexp_replace("_rel", "(^|/)data/.*$", "").alias("relative_path")).distinct().withColumn("_data", F.lit(True))
    text = F.decode("content", "UTF-8")
    doc = F.try_parse_json(text)
    get = lambda key: F.try_variant_get(doc, f"$.{key}", "variant")
    kind = lambda key: F.schema_of_variant(get(key))
    whole = lambda key: F.when((kind(key) == "BIGINT") & (F.try_variant_get(doc, f"$.{key}", "bigint") >= 0), F.try_variant_get(doc, f"$.{key}", "bigint"))
    word = lambda key: F.when(kind(key) == "STRING", F.try_variant_get(doc, f"$.{key}", "string"))
    fps = F.try_variant_get(doc, "$.fps", "double")
    is_object = F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False))
    has_features = F.coalesce(kind("features").startswith("OBJECT"), F.lit(False))
    rows = headers.join(data, "relative_path", "left").select(
        F.lit(area).alias("storage_area"), "relative_path",
        F.when(F.col("relative_path") == "", F.lit(area)).otherwise(F.element_at(F.split("relative_path", "/"), -1)).alias("name"),
        word("codebase_version").alias("codebase_version"), is_object.alias("_object"), has_features.alias("_features"), F.coalesce("_data", F.lit(False)).alias("_data"),
        word("robot_type").alias("robot_type"), whole("total_episodes").alias("total_episodes"), whole("total_frames").alias("total_frames"),
        whole("total_tasks").alias("total_tasks"), F.when(kind("fps").rlike("^(BIGINT|DOUBLE|DECIMAL.*)$") & (fps > 0), fps).alias("fps"),
        F.sha2("content", 256).alias("fingerprint"))
    state = (
        F.when(~F.col("_object"), "invalid").when(~F.coalesce(F.col("codebase_version").isin(SUPPORTED_VERSIONS), F.lit(False)), "unsupported")
        .when(~F.col("_features"), "invalid").when(~F.col("_data"), "incomplete").otherwise("ready"))
    error = (
        F.when(~F.col("_object"), "header is not a JSON object").when(state == "unsupported", "unsupported or missing version")
        .when(~F.col("_features"), "header has no features object").when(~F.col("_data"), "no data files"))
    return rows.withColumn("readiness", state).withColumn("scan_error", error).drop("_object", "_features", "_data")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """``(path, size, sha256)`` of every file; hashing runs where the files are read.

    File listing follows Spark: names that start with a dot or an underscore are not seen.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(_relative(F.col("path"), root).alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def tree_hash(files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """SHA-256 over the path-sorted manifest lines, file count and total size per group.

    A chained hash is sequential by definition; it streams over the sorted lines without holding them.
    """
    keys = list(by) or ["_tree"]
    rows = files if by else files.withColumn("_tree", F.lit("all"))

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, digest, count, total = None, None, 0, 0
        for batch in batches:
            for *group, path, size, sha in batch[[*keys, "path", "size", "sha256"]].itertuples(index=False):
                if group != key:
                    if key is not None:
                        yield pd.DataFrame([[*key, digest.hexdigest(), count, total]], columns=[*keys, "tree_sha256", "file_count", "total_bytes"])
                    key, digest, count, total = group, hashlib.sha256(), 0, 0
                digest.update(f"{path}\0{size}\0{sha}\n".encode())
                count, total = count + 1, total + int(size)
        if key is not None:
            yield pd.DataFrame([[*key, digest.hexdigest(), count, total]], columns=[*keys, "tree_sha256", "file_count", "total_bytes"])

    schema = ", ".join(f"{k} string" for k in keys) + ", tree_sha256 string, file_count bigint, total_bytes bigint"
    ordered = rows.select(*[F.col(k).cast("string").alias(k) for k in keys], "path", "size", "sha256").repartition(*keys).sortWithinPartitions(*keys, F.encode("path", "UTF-8"))
    out = ordered.mapInPandas(stream, schema)
    return out if by else out.drop("_tree")


def reconcile(registry: DataFrame, found: DataFrame, trash: DataFrame, area: str, generation: int, now: Column) -> DataFrame:
    """Registry after one complete scan of an area: new rows, updates, and missing marks.

    Rows of newer generations and trashed rows stay as they are. ``registry`` has the scanned columns plus
    ``dataset_id, first_seen_at, last_seen_at, missing_since, last_scan_generation``.
    """
    keys = ["storage_area", "relative_path"]
    binned = trash.select("dataset_id", F.lit(True).alias("_trashed")).distinct()
    old = registry.join(binned, "dataset_id", "left").withColumn("_old", F.lit(True)).alias("o")
    new = found.filter(F.col("storage_area") == area).withColumn("_new", F.lit(True)).alias("n")
    rows = old.join(new, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")
    known, seen = F.col("o._old").isNotNull(), F.col("n._new").isNotNull()
    frozen = known & (F.coalesce("o._trashed", F.lit(False)) | (F.col("o.last_scan_generation") > generation) | (F.col("o.storage_area") != area))
    update = seen & ~frozen
    lost = known & ~seen & ~frozen & F.col("o.missing_since").isNull() & (F.col("o.last_scan_generation") < generation)
    touched = update | lost
    fields = [F.when(update, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in SCANNED]
    identity = F.coalesce(F.col("o.dataset_id"), F.sha2(F.concat_ws("/", F.col("n.storage_area"), F.col("n.relative_path")), 256))
    return rows.select(
        identity.alias("dataset_id"), *[F.coalesce(F.col(f"o.{k}"), F.col(f"n.{k}")).alias(k) for k in keys], *fields,
        F.coalesce(F.col("o.first_seen_at"), now).alias("first_seen_at"), F.when(update, now).otherwise(F.col("o.last_seen_at")).alias("last_seen_at"),
        F.when(update, F.lit(None)).when(lost, now).otherwise(F.col("o.missing_since")).alias("missing_since"),
        F.when(touched, F.lit(generation)).otherwise(F.col("o.last_scan_generation")).alias("last_scan_generation"))


def search(catalog: DataFrame, trash: DataFrame | None = None, area: str | None = None, readiness: str | None = None, include_missing: bool = False,
           text: str | None = None, sort: str = "name_asc", limit: int = 100, offset: int = 0) -> DataFrame:
    """Catalogue page: all predicates must hold, text matches literally and without case in name, path or robot type."""
    rows = catalog
    if trash is not None:
        rows = rows.join(trash.select("dataset_id").distinct(), "dataset_id", "left_anti")
    if area:
        rows = rows.filter(F.col("storage_area") == area)
    if readiness:
        rows = rows.filter(F.col("readiness") == readiness)
    if not include_missing:
        rows = rows.filter("missing_since is null")
    name = F.coalesce("display_name", "name") if "display_name" in catalog.columns else F.col("name")
    if text:
        hit = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))
        rows = rows.filter(hit(name) | hit(F.col("relative_path")) | hit(F.col("robot_type")))
    orders = {"name_asc": F.lower(name).asc(), "name_desc": F.lower(name).desc(), "newest": F.col("first_seen_at").desc(), "oldest": F.col("first_seen_at").asc()}
    if sort not in orders:
        raise ValueError(f"unknown sort {sort}")
    return rows.orderBy(orders[sort], "storage_area", "relative_path").offset(offset).limit(limit)


def counts(catalog: DataFrame) -> DataFrame:
    return catalog.agg(F.count("*").alias("datasets"), F.count_if(F.col("readiness") == "ready").alias("ready"),
                       F.count_if(F.col("storage_area") == "raw").alias("original"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files that differ between two manifests."""
    a, b = before.alias("a"), after.alias("b")
    rows = a.join(b, F.col("a.path") == F.col("b.path"), "full_outer")
    return rows.filter(~F.col("a.sha256").eqNullSafe(F.col("b.sha256")) | ~F.col("a.size").eqNullSafe(F.col("b.size"))).select(
        F.coalesce("a.path", "b.path").alias("path"), F.when(F.col("a.path").isNull(), "added").when(F.col("b.path").isNull(), "removed").otherwise("changed").alias("change"))
