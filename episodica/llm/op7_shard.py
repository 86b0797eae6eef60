"""Sharding by a two-pass external shuffle.

Pass one scatters the records with a seeded hash into buckets of a bounded number of bytes and writes them. Pass two reads
one bucket at a time, permutes it by Fisher-Yates (Spark's ``shuffle``) and deals the permuted rows, bucket after bucket,
to the shards in turn; so the row counts of two shards differ by one at most (law ``rows``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from episodica.llm.common import broadcast_if_small
from episodica.session import new_path

BUCKET_BYTES = 8 << 20
GROUP = 1024


def size_of(text: str = "text"):
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def scatter(docs: DataFrame, seed: int, bucket_bytes: int) -> DataFrame:
    """The records with ``_bucket``, written in buckets. The row number in the hash parts repeated rows."""
    total = docs.agg(F.coalesce(F.sum(size_of()), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // bucket_bytes))
    row = F.xxhash64(F.lit(seed), F.monotonically_increasing_id())
    spread = docs.withColumn("_bucket", F.pmod(row, F.lit(n)).cast("int"))
    name = f"scatter_{uuid.uuid4().hex}"
    (spread.repartition(n, "_bucket").write.bucketBy(n, "_bucket").option("path", new_path(docs.sparkSession, name))
     .option("compression", "zstd").saveAsTable(name))
    return docs.sparkSession.table(name)


def shard(docs: DataFrame, shards: int = 8, seed: int = 11, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1), ``slot`` (its place in the shard) and ``bucket``.

    Every row gets one place, repeated rows and rows with null id or text too; an empty table gives no rows. Columns of
    ``docs`` may have any name except ``_bucket``; columns named ``shard``, ``slot`` or ``bucket`` are replaced.
    """
    kept = [c for c in docs.columns if c not in ("shard", "slot", "bucket")]
    rows = scatter(docs.select(*kept), seed, bucket_bytes)
    counts = rows.groupBy("_bucket").agg(F.count("*").alias("_n")).withColumn("_group", F.floor(F.col("_bucket") / GROUP))
    before = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)  # one row per 1024 buckets
    groups = counts.groupBy("_group").agg(F.sum("_n").alias("_m")).select(
        "_group", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_from"))
    inside = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(groups, "_group").select(
        "_bucket", (F.col("_from") + F.col("_in")).alias("_start"))
    gathered = rows.groupBy("_bucket").agg(F.collect_list(F.struct(*kept)).alias("_rows"))
    permuted = gathered.join(broadcast_if_small(starts), "_bucket").select(
        "_bucket", "_start", F.shuffle(F.array_sort("_rows"), F.lit(seed)).alias("_rows"))
    place = F.col("_start") + F.col("_at")
    return permuted.select("_bucket", "_start", F.posexplode("_rows").alias("_at", "_row")).select(
        *[F.col(f"_row.`{c}`").alias(c) for c in kept], F.pmod(place, F.lit(shards)).cast("int").alias("shard"),
        F.floor(place / shards).cast("bigint").alias("slot"), F.col("_bucket").alias("bucket"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; rows in slot order inside each file."""
    sharded.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
