"""Catalogue queries. Nations are data sets whose headers are written to disk and scanned again."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodica.operators import catalog, curate
from episodica.plans import tables as t
from episodica.plans.registry import query
from episodica.session import new_path
from episodica.sources.files import write_document

_ROOTS: dict[tuple[str, str], str] = {}

# One header per nation; the region decides what is wrong with it.
_DOCS = """cc AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1),
docs AS (SELECT n_nationkey, n_name, n_regionkey AS g, r_name, coalesce(n, 0) AS n, CASE n_regionkey WHEN 4 THEN '[' || coalesce(n,0) || ']' ELSE
  '{"codebase_version":"' || CASE n_regionkey WHEN 0 THEN 'v1.6' ELSE 'v3.0' END || '","robot_type":"' || r_name || '","total_episodes":' || coalesce(n,0) || ',"total_frames":' || coalesce(n,0)*30 ||
  ',"total_tasks":-1,"fps":30' || CASE WHEN n_regionkey = 1 THEN '' ELSE ',"features":{}' END || '}' END AS doc
  FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN cc ON k = n_nationkey)"""


def nation_docs(spark, sf):
    counts = t.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    region = t.table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    rows = t.table(spark, sf, "nation").join(region, "n_regionkey").join(counts, "n_nationkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    g = F.col("n_regionkey")
    good = F.concat(F.lit('{"codebase_version":"'), F.when(g == 0, "v1.6").otherwise("v3.0"), F.lit('","robot_type":"'), "r_name", F.lit('","total_episodes":'), "n",
                    F.lit(',"total_frames":'), F.col("n") * 30, F.lit(',"total_tasks":-1,"fps":30'), F.when(g == 1, "").otherwise(',"features":{}'), F.lit("}"))
    return rows.select("n_name", "n_regionkey", F.when(g == 4, F.concat(F.lit("["), "n", F.lit("]"))).otherwise(good).alias("doc"))


def tree(spark, sf):
    """Directory tree of the nation data sets, written once; each also has a copy the scan must not see."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _ROOTS:
        root = new_path(spark, "catalogue")
        for row in nation_docs(spark, sf).collect():  # one small document per data set
            write_document(spark, f"{root}/maker/{row.n_name}/meta/info.json", row.doc)
            write_document(spark, f"{root}/.incoming-{row.n_name}/{row.n_name}/meta/info.json", row.doc)
            if row.n_regionkey != 2:
                write_document(spark, f"{root}/maker/{row.n_name}/data/chunk-000/file-000.parquet", row.n_name)
        _ROOTS[key] = root
    return _ROOTS[key]


@query("s07_catalog_scan", f"""WITH {_DOCS} SELECT 'maker/' || n_name AS relative_path, n_name AS name, CASE WHEN g < 4 THEN CASE g WHEN 0 THEN 'v1.6' ELSE 'v3.0' END END AS codebase_version,
  CASE g WHEN 4 THEN 'invalid' WHEN 0 THEN 'unsupported' WHEN 1 THEN 'invalid' WHEN 2 THEN 'incomplete' ELSE 'ready' END AS readiness, CASE WHEN g < 4 THEN r_name END AS robot_type,
  CASE WHEN g < 4 THEN n END AS total_episodes, CASE WHEN g < 4 THEN n*30 END AS total_frames, CAST(NULL AS BIGINT) AS total_tasks, CASE WHEN g < 4 THEN 30.0::DOUBLE END AS fps, sha256(doc) AS fingerprint FROM docs""")
def s07(spark, sf):
    return catalog.scan(spark, tree(spark, sf), "raw").select(
        "relative_path", "name", "codebase_version", "readiness", "robot_type", "total_episodes", "total_frames", "total_tasks", "fps", "fingerprint")


@query("a30_library_counts", """SELECT count(*) AS datasets, count(*) FILTER (n_regionkey = 3) AS ready, count(*) AS original FROM nation""")
def a30(spark, sf):
    return catalog.counts(catalog.scan(spark, tree(spark, sf), "raw"))


_FILES = f"""{_DOCS}, files AS (SELECT 'maker/' || n_name || '/meta/info.json' AS path, doc AS body FROM docs
  UNION ALL SELECT 'maker/' || n_name || '/data/chunk-000/file-000.parquet', n_name FROM docs WHERE g <> 2)"""


@query("s08_content_manifest", f"""WITH {_FILES} SELECT path, CAST(strlen(body) AS BIGINT) AS size, sha256(body) AS sha256 FROM files""")
def s08(spark, sf):
    return catalog.manifest(spark, tree(spark, sf))


@query("s08_tree_hash", f"""WITH {_FILES} SELECT sha256(string_agg(path || chr(0) || strlen(body) || chr(0) || sha256(body) || chr(10), '' ORDER BY path)) AS tree_sha256,
  count(*) AS file_count, CAST(sum(strlen(body)) AS BIGINT) AS total_bytes FROM files""")
def s08_tree(spark, sf):
    return catalog.tree_hash(catalog.manifest(spark, tree(spark, sf)))


@query("v15_content_changed", f"""WITH {_FILES} SELECT path, CASE WHEN path LIKE '%info.json' THEN 'changed' ELSE 'removed' END AS change FROM files WHERE path LIKE 'maker/%'""")
def v15(spark, sf):
    before = catalog.manifest(spark, tree(spark, sf))
    kept = before.filter(~F.col("path").endswith(".parquet"))
    after = kept.withColumn("sha256", F.when(F.col("path").startswith("maker/"), F.reverse("sha256")).otherwise(F.col("sha256")))
    return catalog.changed(before, after)


# parts as the new scan, customers as the registry, customers in debt as trash
_REG = """reg AS (SELECT c_custkey AS id, 'p' || c_custkey*2 AS path, c_name AS name, c_nationkey AS gen, CASE WHEN c_mktsegment = 'MACHINERY' THEN '2020' END AS missing FROM customer),
new AS (SELECT 'p' || p_partkey AS path, p_name AS name FROM part),
j AS (SELECT coalesce(reg.path, new.path) AS relative_path, reg.path IS NOT NULL AS known, new.path IS NOT NULL AS seen, reg.name AS oname, new.name AS nname, gen, missing,
  coalesce(gen > 20 OR id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0), false) AS frozen FROM reg FULL JOIN new ON reg.path = new.path)"""


def registry(spark, sf):
    c = t.table(spark, sf, "customer")
    none = F.lit(None)
    return c.select(
        F.col("c_custkey").cast("string").alias("dataset_id"), F.lit("raw").alias("storage_area"), F.concat(F.lit("p"), F.col("c_custkey") * 2).alias("relative_path"), F.col("c_name").alias("name"),
        F.lit("v3.0").alias("codebase_version"), F.lit("ready").alias("readiness"), none.cast("string").alias("robot_type"), none.cast("bigint").alias("total_episodes"),
        none.cast("bigint").alias("total_frames"), none.cast("bigint").alias("total_tasks"), none.cast("double").alias("fps"), F.sha2("c_name", 256).alias("fingerprint"), none.cast("string").alias("scan_error"),
        F.lit("2019").alias("first_seen_at"), F.lit("2019").alias("last_seen_at"), F.when(F.col("c_mktsegment") == "MACHINERY", "2020").alias("missing_since"), F.col("c_nationkey").alias("last_scan_generation"))


@query("j18_catalog_reconcile", f"""WITH {_REG} SELECT relative_path, CASE WHEN seen AND NOT frozen THEN nname ELSE oname END AS name,
  CASE WHEN known THEN '2019' ELSE '2024' END AS first_seen_at, CASE WHEN seen AND NOT frozen THEN '2024' ELSE '2019' END AS last_seen_at,
  CASE WHEN seen AND NOT frozen THEN NULL WHEN known AND NOT seen AND NOT frozen AND missing IS NULL AND gen < 20 THEN '2024' ELSE missing END AS missing_since,
  CASE WHEN (seen AND NOT frozen) OR (known AND NOT seen AND NOT frozen AND missing IS NULL AND gen < 20) THEN 20 ELSE gen END AS last_scan_generation FROM j""")
def j18(spark, sf):
    none = F.lit(None)
    found = t.table(spark, sf, "part").select(
        F.lit("raw").alias("storage_area"), F.concat(F.lit("p"), "p_partkey").alias("relative_path"), F.col("p_name").alias("name"), F.lit("v3.0").alias("codebase_version"), F.lit("ready").alias("readiness"),
        none.cast("string").alias("robot_type"), none.cast("bigint").alias("total_episodes"), none.cast("bigint").alias("total_frames"), none.cast("bigint").alias("total_tasks"), none.cast("double").alias("fps"),
        F.sha2("p_name", 256).alias("fingerprint"), none.cast("string").alias("scan_error"))
    trash = t.table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").cast("string").alias("dataset_id"))
    out = catalog.reconcile(registry(spark, sf), found, trash, "raw", 20, F.lit("2024"))
    return out.select("relative_path", "name", "first_seen_at", "last_seen_at", "missing_since", "last_scan_generation")


def _parts(spark, sf):
    return t.table(spark, sf, "part").select(
        F.col("p_partkey").alias("dataset_id"), F.col("p_brand").alias("storage_area"), F.format_string("p%09d", "p_partkey").alias("relative_path"), F.col("p_name").alias("name"),
        F.col("p_type").alias("robot_type"), F.when(F.col("p_size") > 25, "ready").otherwise("incomplete").alias("readiness"),
        F.when(F.col("p_retailprice") > 1800, "2024").alias("missing_since"), F.lit("2019").alias("first_seen_at"))


@query("p09_catalog_query", """SELECT p_partkey AS dataset_id, p_name AS name FROM part WHERE p_size > 25 AND NOT p_retailprice > 1800 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount = 0.1 AND l_quantity = 50)
  AND (contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring')) ORDER BY lower(p_name), p_brand, p_partkey LIMIT 100""")
def p09(spark, sf):
    trash = t.table(spark, sf, "lineitem").filter("l_discount = 0.1 and l_quantity = 50").select(F.col("l_partkey").alias("dataset_id"))
    return catalog.search(_parts(spark, sf), trash, readiness="ready", text="RiNg").select("dataset_id", "name")


@query("t05_catalog_paging", """SELECT p_partkey AS dataset_id, p_name AS name FROM part WHERE NOT p_retailprice > 1800 ORDER BY lower(p_name) DESC, p_brand, p_partkey LIMIT 30 OFFSET 60""")
def t05(spark, sf):
    return catalog.search(_parts(spark, sf), sort="name_desc", limit=30, offset=60).select("dataset_id", "name")


# orders as export checks of their customers, line items as the jobs' outcomes
@query("j15_export_gate", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders WHERE o_orderpriority < '4'),
  j AS (SELECT l_orderkey, max(l_returnflag) AS flag, max(l_linestatus) AS ls, max(l_discount) AS d FROM lineitem GROUP BY 1)
  SELECT o_custkey AS dataset_id, o_orderstatus AS fingerprint, flag <> 'R' AND d > 0.02 AND ls = 'O' AND o_totalprice >= 100000 AS allowed FROM r JOIN j ON l_orderkey = o_orderkey WHERE k = 1""")
def j15(spark, sf):
    runs = t.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("dataset_id"), F.col("o_orderstatus").alias("fingerprint"), F.when(F.col("o_orderpriority") < "4", "export_gate").otherwise("full").alias("mode"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("run_no"), F.col("o_orderkey").alias("job_id"), F.when(F.col("o_totalprice") < 100000, "gone").alias("deleted_at"))
    jobs = t.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(
        F.when(F.max("l_returnflag") == "R", "failed").otherwise("succeeded").alias("status"), (F.max("l_discount") > 0.02).alias("passed"),
        F.max("l_linestatus").alias("policy"), F.lit("abc").alias("tree_sha256"))
    return curate.export_allowed(runs, jobs, "O")


@query("w10_latest_per_key", """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1""")
def w10(spark, sf):
    rows = t.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return curate.latest_runs(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("j16_snapshot_catalog", """SELECT n_name AS recipe_id, r_name AS dataset_id, n FROM nation JOIN region ON r_regionkey = n_regionkey JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey""")
def j16(spark, sf):
    """One recipe per nation on its region; its suppliers are the episodes."""
    nation = t.table(spark, sf, "nation").join(t.table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey")
    recipes = nation.select(F.col("n_name").alias("recipe_id"), F.col("n_name").alias("dataset_id"), F.lit("f").alias("fingerprint"), F.lit("all").alias("mode"), "r_name")
    known = t.table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("total_episodes"))
    cat = nation.join(known, "n_nationkey").select(F.col("n_name").alias("dataset_id"), F.lit("f").alias("fingerprint"), "total_episodes")
    none = t.table(spark, sf, "supplier").select(F.col("s_name").alias("dataset_id"), F.col("s_suppkey").alias("episode_index"), F.lit(1).alias("revision"))
    snap = curate.snapshot(recipes.drop("r_name"), cat, none, none)
    return snap.groupBy("recipe_id").agg(F.count("*").alias("n")).join(recipes.select("recipe_id", "r_name"), "recipe_id").select("recipe_id", F.col("r_name").alias("dataset_id"), "n")
