"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over eight consecutive words that ignores some of them, so a replaced word spoils only some seeds.
Items too short for these masks, so that allowed replacements could spoil every seed, have runs of words as seeds instead: one
more run than words may be replaced, so one run is whole.
Seeds of all benchmark items are joined with the seeds at every position of every document; around each hit, document and
item are laid side by side and the words that agree are counted.
"""

from __future__ import annotations

import math
from functools import cache
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.llm.common import BROADCAST_ROWS, broadcast_if_small
from episodica.session import materialize

#: Word offsets that a mask looks at.
MASKS = ((0, 1, 3, 4, 7), (0, 2, 3, 5, 7), (0, 1, 2, 6, 7))
#: Words of the shortest item that is looked for inside documents.
SPAN = 1
#: Words of all items up to which their texts are broadcast.
BROADCAST_WORDS = 2_000_000
#: Binary digits of the largest sieve.
SIEVE = 27


def words_of(text: str = "text") -> Column:
    """Lower-case words: runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


@cache
def masks_for(width: int, share: float) -> tuple[tuple[int, ...], ...]:
    """Masks of which one at least is intact wherever ``width`` aligned words agree in ``share`` of their places."""
    wrong = max(0, width - math.ceil(width * share))
    if wrong <= 3 and all(
            any(not spoilt.intersection(at + o for o in mask) for mask in MASKS for at in range(width - max(mask)))
            for spoilt in map(set, combinations(range(width), wrong))):
        return MASKS
    # one run more than wrong words; two lengths at most, which stand for all places
    parts = min(wrong + 1, width)
    return tuple(tuple(range(n)) for n in sorted({width // parts, -(-width // parts)}))


def _seeds(rows: DataFrame, keep: list[str], masks: list[tuple[int, ...]]) -> DataFrame:
    """``_at`` and ``_seed`` for every mask at every position; plain generators, so the words are never copied."""
    spans = [max(mask) + 1 for mask in masks]
    places = F.when(F.size("_words") >= min(spans), F.sequence(F.lit(0), F.size("_words") - min(spans)))
    # outer, so that no condition on the words is moved below the splitting and makes it run twice
    at = rows.withColumn("_places", places).select(*keep, "_words", F.explode_outer("_places").alias("_at")).filter("_at is not null")
    seeds = []
    for mask, span in zip(masks, spans):
        seed = F.xxhash64(F.lit(str(mask)), *[F.get(F.col("_words"), F.col("_at") + o) for o in mask])
        seeds.append(seed if span == min(spans) else F.when(F.col("_at") + span <= F.size("_words"), seed))
    out = at.select(*keep, "_words", "_at", F.explode(F.array(*seeds)).alias("_seed"))
    return out if len(set(spans)) == 1 else out.filter("_seed is not null")


def _item_seeds(texts: DataFrame, window: int, share: float) -> tuple[DataFrame, list[tuple[int, ...]]]:
    """``_seed, _key, _size, _item_at`` of all texts, and the masks in use."""
    # widths are at most ``window`` different ones
    width = F.least(F.lit(window), F.col("_size"))
    by_masks: dict[tuple[tuple[int, ...], ...], list[int]] = {}
    for row in texts.select(width.alias("n")).distinct().collect():
        by_masks.setdefault(masks_for(row.n, share), []).append(row.n)
    seeds = None
    for group, widths in by_masks.items() or [(MASKS, [])]:  # no items
        found = _seeds(texts.filter(width.isin(widths)), ["_key", "_size"], list(group)).select("_seed", "_key", "_size", F.col("_at").alias("_item_at"))
        seeds = found if seeds is None else seeds.unionByName(found)
    return seeds, sorted({mask for group in by_masks for mask in group}) or list(MASKS)


def _sieve(seeds: DataFrame, n: int) -> Column:
    """True where ``_seed`` may be one of ``seeds``, always where it is: a bit by its last digits, some 32 bits a seed, 16 MB at most."""
    bits = max(16, min(SIEVE, (32 * n - 1).bit_length()))
    place = F.col("_seed").bitwiseAND(F.lit((1 << bits) - 1))
    marks = seeds.select(place.alias("_p")).selectExpr("_p div 64 AS _word", "shiftleft(1L, CAST(_p % 64 AS INT)) AS _bits")
    none = seeds.sparkSession.range(1 << (bits - 6)).select(F.col("id").alias("_word"), F.lit(0).cast("bigint").alias("_bits"))
    words = marks.unionByName(none).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))

    def in_order(rows: DataFrame, at: Column, value: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), F.col(value).alias("value")))), lambda x: x["value"])

    blocks = words.groupBy(F.expr("_word div 1024").alias("_block")).agg(in_order(words, F.col("_word"), "_bits").alias("_words"))
    whole = blocks.agg(in_order(blocks, F.col("_block"), "_words")).scalar()
    word = F.get(F.get(whole, F.shiftright(place, 16).cast("int")), F.shiftright(place, 6).bitwiseAND(F.lit(1023)).cast("int"))
    return F.call_function("shiftrightunsigned", word, place.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def _diagonals(hits: DataFrame, window: int) -> DataFrame:
    """``doc_id, _key, _first, _part``: for each document, text and shift once, the words beside the text from its place ``_first`` on.

    ``hits`` holds ``_words`` of the document, ``_size`` and ``_shift``. Only the words beside the text leave the join; the
    rows go to the aggregation one by one, so a document with many hits is not held many times.
    """
    first = F.greatest(F.lit(0), -F.col("_shift"))
    length = F.least(F.col("_size"), F.size("_words") - F.col("_shift")) - first
    return hits.filter(length >= F.least(F.lit(window), F.col("_size"))).select(
        "doc_id", "_key", first.alias("_first"), F.slice("_words", first + F.col("_shift") + 1, length).alias("_part")).distinct()


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 12, share: float = 0.8) -> DataFrame:
    """``doc_id, item_id, matched``: pairs in which ``window`` consecutive aligned words agree in ``share`` of their places.

    ``matched`` is the largest number of agreeing words in such a window (of the whole item if that is shorter), however
    short the item is. Null or empty texts match
    nothing. Repeated document rows give one row per id and item, repeated item rows one per item id; other columns are not
    read. Every position of every document is looked up; nothing is left out. A task holds the words of one document at a time.
    """
    items = materialize(benchmark.select("item_id", words_of().alias("_words")).filter(F.size("_words") > 0).distinct(), "items")
    texts = items.select("_words").distinct().select("_words", F.xxhash64("_words").alias("_key"), F.size("_words").alias("_size"))
    seeds, masks = _item_seeds(texts, window, share)
    seeds = materialize(seeds, "seeds")
    n, shift = seeds.count(), (F.col("_at") - F.col("_item_at")).alias("_shift")
    rows = docs.select("doc_id", words_of().alias("_words"))
    if n <= BROADCAST_ROWS:
        hits = _seeds(rows, ["doc_id"], masks).join(F.broadcast(seeds), "_seed").select("doc_id", "_words", "_key", "_size", shift)
    else:  # seeds are shuffled without their documents, whose words then meet the shifts that were found
        row = F.xxhash64("doc_id", "text").alias("_row")
        looked = _seeds(docs.select(row, words_of().alias("_words")), ["_row"], masks).filter(_sieve(seeds, n)).select("_row", "_at", "_seed")
        found = materialize(looked.join(seeds.hint("merge"), "_seed").select("_row", "_key", "_size", shift).distinct(), "shifts")
        hits = docs.select("doc_id", row, words_of().alias("_words")).join(broadcast_if_small(found, BROADCAST_ROWS), "_row")
    beside = texts.select("_key", F.col("_words").alias("_item"))
    if (beside.agg(F.sum(F.size("_item"))).head()[0] or 0) <= BROADCAST_WORDS:
        beside = F.broadcast(beside)
    found = _diagonals(hits, window).join(beside, "_key").withColumn("_width", F.least(F.lit(window), F.size("_item")))

    # word by word along the diagonal of the hit, with the sum of the last ``_width`` places; the first, shorter sums are no larger than a whole one
    def agree(j: Column) -> Column:
        return F.when(F.get("_part", j) == F.get("_item", F.col("_first") + j), 1).otherwise(0)

    def last(a: Column, j: Column) -> Column:
        return a["last"] + agree(j) - F.when(j >= F.col("_width"), agree(j - F.col("_width"))).otherwise(0)

    best = F.aggregate(
        F.sequence(F.lit(0), F.size("_part") - 1), F.struct(F.lit(0).alias("last"), F.lit(0).alias("most")),
        lambda a, j: F.struct(last(a, j).alias("last"), F.greatest(a["most"], last(a, j)).alias("most")), lambda a: a["most"])
    near = found.filter(F.size("_part") >= F.col("_width")).select("doc_id", "_item", best.alias("matched"), "_width").filter(
        F.col("matched") >= F.ceil(F.col("_width") * F.lit(share)))
    pairs = near.groupBy("doc_id", "_item").agg(F.max("matched").alias("matched"))
    return pairs.join(items.withColumnRenamed("_words", "_item"), "_item").groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 12, share: float = 0.8) -> DataFrame:
    """``docs`` without the rows whose id has an overlap with the benchmark; rows with null id are kept unless one such row overlaps."""
    bad = materialize(overlaps(docs, benchmark, window, share).select("doc_id").distinct(), "leaks")  # found once
    return docs.alias("d").join(broadcast_if_small(bad).alias("x"), F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")), "left_anti")
