"""Names, split ranges, hashes and other text helpers."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from episodica.session import materialize

DELIMITER = " | "


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


@F.pandas_udf(StringType())
def _casefold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v.casefold(), na_action="ignore")


def clean_name(value: Column) -> Column:
    """NFKC form, trimmed, runs of white space collapsed to one blank."""
    return F.trim(F.regexp_replace(_nfkc(value), r"[\s\p{Z}]+", " "))


def name_key(value: Column) -> Column:
    """Case-insensitive comparison key of a cleaned name."""
    return _casefold(clean_name(value))


def name_problem(value: Column, limit: int = 100) -> Column:
    """Why a cleaned name is refused, or NULL."""
    return (
        F.when(value.isNull() | (F.length(value) == 0), "empty")
        .when(F.length(value) > limit, "too_long")
        .when(value.rlike(r"\p{Cc}"), "control_character")
    )


def split_range(value: Column) -> Column:
    """``"a:b"`` as a struct of bounds; NULL when the text has another form."""
    ok = value.rlike(r"^\d+:\d+$")
    return F.when(ok, F.struct(
        F.regexp_extract(value, r"^(\d+):", 1).try_cast("bigint").alias("start"),
        F.regexp_extract(value, r":(\d+)$", 1).try_cast("bigint").alias("end")))


def series_suffix(series: Column) -> Column:
    return F.element_at(F.split(series, r" \| "), -1)


def group_by_suffix(series: DataFrame) -> DataFrame:
    """Series sharing the part after the delimiter belong together; a lone one keeps its full name."""
    rows = series.select("series", series_suffix(F.col("series")).alias("suffix")).distinct()
    groups = rows.groupBy("suffix").agg(F.array_sort(F.collect_list("series")).alias("members"))
    return groups.select(
        F.when(F.size("members") == 1, F.get("members", F.lit(0))).otherwise(F.col("suffix")).alias("group"), "members")


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys; NULLs are kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def fingerprint(fields: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(fields), 256)


#: Length of the name parts that the index of column names holds; shorter patterns are looked up whole.
PART = 3


def _parts(name: Column, sizes: Sequence[int]) -> Column:
    """Distinct substrings of the given lengths."""
    def of_length(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - (n - 1), F.lit(1))), lambda i: F.substr(name, i, F.lit(n)))

    of = [of_length(n) for n in sizes]
    return F.array_distinct(F.filter(F.concat(*of), lambda x: F.length(x) > 0))


def containing(patterns: DataFrame, names: DataFrame) -> DataFrame:
    """``(pattern, name)`` for all names in which a pattern stands, through an inverted index of name parts.

    A pattern is looked up by its rarest part, so parts that all names share bring nothing together. An empty pattern
    stands in no name.
    """
    index = materialize(names.select("name", F.explode(_parts(F.col("name"), range(1, PART + 1))).alias("part")), "name_parts")
    counts = index.groupBy("part").agg(F.count("*").alias("_n"))
    asked = patterns.filter(F.length("pattern") > 0).select("pattern").distinct()
    short = F.length("pattern") < PART
    parts = asked.select("pattern", F.explode(F.when(short, F.array("pattern")).otherwise(_parts(F.col("pattern"), [PART]))).alias("part"))
    rarest = parts.join(counts, "part", "left").groupBy("pattern").agg(F.min_by("part", F.struct(F.coalesce("_n", F.lit(0)), F.col("part"))).alias("part"))
    return rarest.join(index, "part").filter(F.contains("name", "pattern")).select("pattern", "name")


def match_joints(joints: DataFrame, columns: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Column for each robot joint: exact suffix, alias table, arm or finger pattern, then substring.

    ``joints(joint)``, ``columns(ord, column)`` and ``aliases(suffix, joint)`` are name lists. Exact rules are equi-joins,
    the others go through an index of name parts; no list is compared with the other as a whole.
    """
    cols = columns.select("ord", "column", F.lower("column").alias("_low"), F.lower(F.trim(series_suffix(F.col("column")))).alias("_suffix"))
    low = F.lower("joint")
    arm = F.regexp_extract(low, r"^openarm_(left|right)_joint(\d+)$", 1)
    number = F.regexp_extract(low, r"^openarm_(left|right)_joint(\d+)$", 2)
    finger = F.regexp_extract(low, r"^openarm_(left|right)_finger_joint1$", 1)
    pattern = F.when(arm != "", F.concat(arm, F.lit("_joint_"), number))
    grip = F.when(finger != "", F.concat(finger, F.lit("_gripper")))
    names = joints.select("joint", low.alias("_j"), pattern.alias("_arm"), grip.alias("_grip"))
    found = [names.join(cols, F.col("_j") == F.col("_suffix")).select("joint", "ord", "column", F.lit(1).alias("_rank"))]
    if aliases is not None:
        known = cols.join(aliases.select(F.col("suffix").alias("_suffix"), F.lower("joint").alias("_alias")), "_suffix")
        found.append(names.join(known, F.col("_j") == F.col("_alias")).select("joint", "ord", "column", F.lit(2).alias("_rank")))
    asked = materialize(names.select("joint", F.explode(F.array_compact(F.array(
        F.when(F.col("_arm").isNotNull(), F.struct(F.lit(3).alias("rank"), F.lit("_suffix").alias("side"), F.col("_arm").alias("pattern"))),
        F.when(F.col("_grip").isNotNull(), F.struct(F.lit(4).alias("rank"), F.lit("_suffix").alias("side"), F.col("_grip").alias("pattern"))),
        F.when(~F.contains("_j", F.lit("finger_joint2")), F.struct(F.lit(5).alias("rank"), F.lit("_low").alias("side"), F.col("_j").alias("pattern")))))).alias("x")).select(
        "joint", "x.*"), "joint_patterns")
    for side in ("_suffix", "_low"):
        own = asked.filter(F.col("side") == side)
        hits = containing(own, cols.select(F.col(side).alias("name")).distinct())
        found.append(own.join(hits, "pattern").join(cols.withColumnRenamed(side, "name"), "name").select("joint", "ord", "column", F.col("rank").alias("_rank")))
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    # of several alias columns the later one wins, elsewhere the first
    order = F.struct("_rank", F.when(F.col("_rank") == 2, -F.col("ord")).otherwise(F.col("ord")))
    return every.groupBy("joint").agg(F.min_by("column", order).alias("column"), F.min("_rank").alias("rule"))
