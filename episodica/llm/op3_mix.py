"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash. A source that shall give ``target`` words takes each document ``floor(target / size)``
times and once more where the hash is at most the threshold of the source. The threshold is found without sorting: words
are summed by source and the 12 leading hash bits, the bucket that holds the budget is refined by the next 12 bits, and
only the rows of that last bucket are looked at one hash at a time. A smaller budget takes a subset of a larger one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.llm.common import WORD, broadcast_if_small
from episodica.operators.series import with_position
from episodica.session import materialize

HASH_BITS, LEVEL_BITS = 60, 12


def hash60(doc_id: Column, text: Column) -> Column:
    """The first 15 hex digits of an MD5 over id and text, so that SQL can follow it."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit("/"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``sizes(source, source_size)`` with ``target``: shares by weight, none above ``most`` times its size."""
    ranked = with_position(sizes.withColumn("_null", F.col("source").isNull()), [], ["_null", "source"], "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", weight.alias("_w"))
    budget = share * float(ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    rate, capped = 0.0, -1
    while True:  # each round fixes at least one more source at its cap
        full = F.col("source_size") * most <= F.col("_w") * rate
        n, used, free = ranked.agg(
            F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, F.col("source_size") * most)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("_w"))), F.lit(0.0))).first()
        if n == capped or not free:
            break
        capped, rate = n, max(0.0, budget - used) / free
    return ranked.select("source", "source_size", F.least(F.col("source_size") * most, F.col("_w") * rate).alias("target"))


def _boundary(rows: DataFrame, goals: DataFrame, shift: int) -> DataFrame:
    """The bucket of each source in which the running sum passes the budget; ``_base``: words before it."""
    sums = rows.groupBy("_src", F.shiftright("_h", shift).alias("_bucket")).agg(F.sum("size").alias("_sum"))
    upto = F.sum("_sum").over(Window.partitionBy("_src").orderBy("_bucket"))
    passed = (
        sums.withColumn("_upto", upto).join(broadcast_if_small(goals), "_src")
        .withColumn("_upto", F.col("_upto") + F.col("_base")).filter(F.col("_upto") > F.col("_budget"))
    )
    return passed.groupBy("_src", "_budget").agg(
        F.min("_bucket").alias("_bucket"), F.min(F.col("_upto")).alias("_end"),
        F.min_by("_sum", "_bucket").alias("_sum")).select("_src", "_budget", "_bucket", (F.col("_end") - F.col("_sum")).alias("_base"))


def _source_key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))


def _with_hash(docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    return docs.select(*columns, hash60(F.col("doc_id"), F.col("text")).alias("_h"), _source_key().alias("_src"))


def _copies() -> Column:
    return (F.col("_full") + F.when(F.col("_h") <= F.col("_limit"), 1).otherwise(0)).cast("int")


def limits(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """Sizes and hashes of all rows, and one row per source: its target, whole takes ``_full`` and hash threshold ``_limit``."""
    narrow = materialize(_with_hash(docs.withColumn("_size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")), [
        "doc_id", "source", F.col("_size").alias("size")]), "mix")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = materialize(targets(sizes, weights, share, most).withColumn(
        "_full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).select(
        _source_key().alias("_src"), "source_size", "target", "_full",
        (F.col("target") - F.col("_full") * F.col("source_size")).alias("_budget")), "mix_goals")

    shift = HASH_BITS - LEVEL_BITS
    first = _boundary(narrow, goals.select("_src", "_budget", F.lit(0).cast("bigint").alias("_base")), shift)
    edge = materialize(narrow.join(broadcast_if_small(first), "_src").filter(
        F.shiftright("_h", shift) == F.col("_bucket")).select("_src", "_h", "size", "_budget", "_base"), "mix_edge")
    starts = edge.select("_src", "_budget", "_base").distinct()
    second = _boundary(edge.select("_src", "_h", "size"), starts, shift - LEVEL_BITS)
    last = edge.select("_src", "_h", "size").join(broadcast_if_small(second), "_src").filter(
        F.shiftright("_h", shift - LEVEL_BITS) == F.col("_bucket")).groupBy("_src", "_budget", "_base", "_h").agg(F.sum("size").alias("size"))
    upto = F.col("_base") + F.sum("size").over(Window.partitionBy("_src").orderBy("_h"))
    steps = last.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("size"))
    # the first hash that passes the budget; it is taken if that comes nearer
    nearer = (F.col("_upto") - F.col("_budget")) < (F.col("_budget") - F.col("_before"))
    passing = steps.filter(F.col("_upto") > F.col("_budget")).groupBy("_src").agg(F.min_by(F.struct("_h", nearer.alias("_take")), "_h").alias("_e"))
    found = goals.join(passing, "_src", "left").select(
        "_src", "source_size", "target", "_full",
        # a source whose budget is never passed takes all of its rows once more
        F.when(F.col("_e").isNull(), F.when(F.col("_budget") > 0, F.lit(1 << HASH_BITS)).otherwise(F.lit(-1)))
        .when(F.col("_e._take"), F.col("_e._h")).otherwise(F.col("_e._h") - 1).cast("bigint").alias("_limit"))
    return narrow, materialize(found, "mix_limits")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, size, source_size, target, copies, taken``.

    ``size`` counts words; sources in code point order, null last, get ``weights`` in turn. A null or empty text has size 0
    and is taken as often as any other of its source. Rows equal in id and text have one hash and share their fate; the
    nearest reachable sum to the target is taken (the smaller one on a tie). An empty table gives no rows. Other columns of
    ``docs`` are not read.
    """
    narrow, found = limits(docs, weights, share, most)
    return narrow.join(broadcast_if_small(found), "_src").select(
        "doc_id", "source", "size", "source_size", "target", _copies().alias("copies"), (_copies() * F.col("size")).cast("bigint").alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix itself: ``docs`` with each row as often as it is taken (see ``mix``)."""
    _, found = limits(docs, weights, share, most)
    # the row travels as one value, so that none of its names can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), hash60(F.col("doc_id"), F.col("text")).alias("_h"), _source_key().alias("_src"))
    taken = rows.join(broadcast_if_small(found), "_src").withColumn("_copies", _copies()).filter("_copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")
