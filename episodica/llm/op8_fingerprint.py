"""Document fingerprints from closed syncmers.

A text is a row of symbols: its words, or its characters where it has fewer than 256 code points. A run of ``k`` symbols
is an anchor if the smallest hash among its inner runs of ``s`` symbols is the first or the last of them. The choice looks
at nothing outside the run, so an edit changes only the anchors that it touches, and equal passages have equal anchors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.llm.common import broadcast_if_small
from episodica.operators.series import with_position
from episodica.session import materialize

SHORT = 256
#: (k, s) for words and for characters; 2 / (k - s + 1) of all runs are anchors.
WORDS, CHARS = (8, 2), (6, 3)


def _anchors(symbols: str, k: int, s: int) -> Column:
    """Array of ``(at, hash)`` over the hashes of a text's symbols; a text without any anchor gets one of the whole."""
    inner = F.transform(F.sequence(F.lit(0), F.size(symbols) - s), lambda i: F.xxhash64(*[F.get(F.col(symbols), i + j) for j in range(s)]))
    width = k - s + 1

    def chosen(start: Column) -> Column:
        ends = F.least(F.get(F.col(f"{symbols}_inner"), start), F.get(F.col(f"{symbols}_inner"), start + width - 1))
        middle = [F.get(F.col(f"{symbols}_inner"), start + j) for j in range(1, width - 1)]
        return ends <= F.least(*middle)

    starts = F.filter(F.sequence(F.lit(0), F.size(symbols) - k), chosen)
    anchors = F.transform(starts, lambda i: F.struct(i.alias("at"), F.hash(*[F.get(F.col(symbols), i + j) for j in range(k)]).alias("hash")))
    return inner, anchors


def with_anchors(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``: the anchors of the column ``text``, in text order; a null text counts as empty and has none."""
    body = F.lower(F.coalesce(F.col(text), F.lit("")))
    words = F.filter(F.split(body, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    short = F.length(body) < SHORT
    # every step is a column of its own: an expression inside a lambda would be computed again for each element
    out = df.withColumn("_body", body).withColumn("_short", short)
    out = out.withColumn("_symbols", F.when(F.col("_short"), F.filter(F.split("_body", ""), lambda c: c != "")).otherwise(words))
    out = out.withColumn("_sym", F.transform("_symbols", lambda w: F.xxhash64(w)))
    for kind, (k, s) in ((True, CHARS), (False, WORDS)):
        inner, anchors = _anchors("_sym", k, s)
        fits = (F.col("_short") == F.lit(kind)) & (F.size("_sym") >= k)
        out = out.withColumn("_sym_inner", F.when(fits, inner)).withColumn(
            f"_found_{kind}", F.when(fits, anchors))
    whole = F.array(F.struct(F.lit(0).alias("at"), F.hash("_body").alias("hash")))
    found = F.coalesce("_found_True", "_found_False", F.array().cast("array<struct<at:int,hash:int>>"))
    out = out.withColumn(name, F.when(F.size(found) > 0, found).when(F.col("_body") == "", found).otherwise(whole))
    return out.drop("_body", "_short", "_symbols", "_sym", "_sym_inner", "_found_True", "_found_False")


def hashes(anchors: Column) -> Column:
    """The distinct hashes of a fingerprint, 32 bits each."""
    return F.array_distinct(F.transform(anchors, lambda x: x["hash"]))


def likeness(left: Column, right: Column) -> Column:
    """Shared hashes over all hashes of two fingerprints (0 to 1); two empty ones are alike."""
    shared = F.size(F.array_intersect(left, right))
    either = F.size(left) + F.size(right) - shared
    return F.when(either == 0, F.lit(1.0)).otherwise(shared / either)


def shared_anchors(a: Column, b: Column) -> Column:
    """Positional matching: ``(hash, at_a, at_b)`` of the anchors that both texts have."""
    return F.flatten(F.transform(a, lambda x: F.transform(
        F.filter(b, lambda y: y["hash"] == x["hash"]),
        lambda y: F.struct(x["hash"].alias("hash"), x["at"].alias("at_a"), y["at"].alias("at_b")))))


def to_text(anchors: Column) -> Column:
    """The anchor hashes in text order, eight hex digits each."""
    return F.array_join(F.transform(anchors, lambda x: F.lpad(F.lower(F.hex(x["hash"].cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), " ")


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, n_chars, next_text, next_hashes``: beside each row the next document in order of id.

    Ids ascend, null last; after the last comes the first. Rows with one id share their next document; where an id has
    several texts, its smallest stands for it. Only ids are sorted over all rows. Texts are dealt out by id once; of the
    next text only its anchor hashes and the quarter that an edit needs travel on.
    """
    keys = ["_null", "_id"]
    # the id is put together again from its two keys, so that both readers of the dealt texts share one exchange
    body = docs.select(F.col("doc_id").isNull().alias("_null"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    sizes = body.groupBy(*keys).agg(F.max(F.floor(F.length("text") / 4)).alias("_need"))
    ranked = with_position(sizes, [], keys, "_rank")
    last = ranked.agg(F.max("_rank")).first()[0]
    follows = materialize(ranked.select(
        F.col("_null").alias("_own_null"), F.col("_id").alias("_own_id"), "_need", F.when(F.col("_rank") == F.lit(last), 0).otherwise(F.col("_rank") + 1).alias("_rank")).join(
        ranked.select(*keys, "_rank"), "_rank").drop("_rank"), "follows")
    dealt = body.repartition(*keys)
    one = dealt.groupBy(*keys).agg(F.min("text").alias("_text"))
    after = with_anchors(one.join(follows, keys).select("_own_null", "_own_id", "_need", "_text"), "_text", "next_anchors").select(
        F.col("_own_null").alias("_null"), F.col("_own_id").alias("_id"), F.substring(F.col("_text"), F.lit(1), F.col("_need").cast("int")).alias("next_text"), hashes(F.col("next_anchors")).alias("next_hashes"))
    return dealt.join(after, keys).select(
        F.when(~F.col("_null"), F.col("_id")).alias("doc_id"), "text", F.length("text").cast("bigint").alias("n_chars"), "next_text", "next_hashes")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text, anchors`` of every row; null text has no anchors; other columns are not read."""
    return with_anchors(docs.select("doc_id", "text"), "text", "anchors")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text (last quarter taken from the next document) and of the next document.

    Returns ``doc_id, n_chars, edited, anchors, edited_anchors, next_hashes``; see ``with_next`` for ties and nulls. An
    empty table gives no rows; an empty text is edited to itself.
    """
    rows = with_next(docs)
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(
        F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring(F.col("next_text"), F.lit(1), cut)))
    for text, name in (("text", "anchors"), ("edited", "edited_anchors")):
        rows = with_anchors(rows, text, name)
    return rows.select("doc_id", "n_chars", "edited", "anchors", "edited_anchors", "next_hashes")
