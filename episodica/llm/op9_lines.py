"""Line dedup by pairwise alignment.

Equal texts form one class; all of its documents but the first lose every line. Between classes, a line that several have
leads each later document to the first document that holds it, so a line held by n documents gives n - 1 pairs. The shortest runs
of neighbouring lines with enough words for a block lead to their first holder in the same way: every line of a shared block is
in one of them. Each pair
is aligned by patience diff: lines that are unique in both texts, in their longest common order, are anchors; blocks grow
from them over equal neighbours, and gaps without such lines have a longest common subsequence. Aligned blocks of enough words are deleted from the later document.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.session import materialize

MIN_WORDS = 5


def longest_common(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of ``a[a0:a1]`` and ``b[b0:b1]`` (Myers' shortest edit script by halving, memory
    linear in the lengths); items that only one side has are left out first."""
    both = set(a[a0:a1]) & set(b[b0:b1])
    at_a, at_b = ([k for k in range(lo, hi) if x[k] in both] for x, lo, hi in ((a, a0, a1), (b, b0, b1)))
    x, y = [a[k] for k in at_a], [b[k] for k in at_b]
    out: list[tuple[int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and x[i0] == y[j0]:
            out.append((at_a[i0], at_b[j0]))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and x[i1 - 1] == y[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((at_a[i1], at_b[j1]))
        if i0 == i1 or j0 == j1:
            continue
        if i1 - i0 == 1 or j1 - j0 == 1:  # one item on a side: its first equal
            match = next(((i, j) for i in range(i0, i1) for j in range(j0, j1) if x[i] == y[j]), None)
            if match:
                out.append((at_a[match[0]], at_b[match[1]]))
            continue
        i, j = _middle(x, y, i0, i1, j0, j1)
        todo += [(i0, i, j0, j), (i, i1, j, j1)]
    return out


def _middle(x: list[int], y: list[int], i0: int, i1: int, j0: int, j1: int) -> tuple[int, int]:
    """A place that a shortest edit script passes half-way. The ends of the two runs must differ."""
    n, m = i1 - i0, j1 - j0
    delta = n - m
    ahead, back = {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d, d + 1, 2):
            u = ahead.get(k + 1, -1) if k == -d or (k != d and ahead.get(k - 1, -1) < ahead.get(k + 1, -1)) else ahead.get(k - 1, -1) + 1
            while u < n and 0 <= u - k < m and x[i0 + u] == y[j0 + u - k]:
                u += 1
            ahead[k] = u
            if delta % 2 and abs(delta - k) <= d - 1 and u + back.get(delta - k, -1) >= n and 0 <= u <= n and 0 <= u - k <= m:
                return i0 + u, j0 + u - k
        for k in range(-d, d + 1, 2):
            u = back.get(k + 1, -1) if k == -d or (k != d and back.get(k - 1, -1) < back.get(k + 1, -1)) else back.get(k - 1, -1) + 1
            while u < n and 0 <= u - k < m and x[i1 - 1 - u] == y[j1 - 1 - (u - k)]:
                u += 1
            back[k] = u
            if delta % 2 == 0 and abs(delta - k) <= d and u + ahead.get(delta - k, -1) >= n and 0 <= u <= n and 0 <= u - k <= m:
                return i1 - u, j1 - (u - k)
    raise AssertionError("no middle")


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of two lists: unique common items in longest increasing order, grown over equal neighbours, then
    the gaps between them in the same way; a gap without such items by a longest common subsequence."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at_b = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
        common = [(i, at_b[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in at_b]
        if not common:
            pairs += longest_common(a, b, a0, a1, b0, b1)
            continue
        tails: list[int] = []
        ends: list[int] = []
        back = [-1] * len(common)
        for k, (_, j) in enumerate(common):
            at = bisect_left(tails, j)
            if at == len(tails):
                tails.append(j)
                ends.append(k)
            else:
                tails[at], ends[at] = j, k
            back[k] = ends[at - 1] if at else -1
        chain, k = [], ends[-1]
        while k >= 0:
            chain.append(common[k])
            k = back[k]
        last_i, last_j = a0, b0
        for i, j in reversed(chain):
            pairs.append((i, j))
            todo.append((last_i, i, last_j, j))
            last_i, last_j = i + 1, j + 1
        todo.append((last_i, a1, last_j, b1))
    return joined(a, b, sorted(pairs))


def joined(a: list[int], b: list[int], pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same alignment with whole runs moved over equal items up to the next run, then up to the one before, where they fit."""
    runs: list[list[int]] = []  # place in a, place in b, length
    for i, j in pairs:
        if runs and (runs[-1][0] + runs[-1][2], runs[-1][1] + runs[-1][2]) == (i, j):
            runs[-1][2] += 1
        else:
            runs.append([i, j, 1])
    for step in (-1, 1):
        out: list[list[int]] = []
        for i, j, n in runs[::step]:
            if out:
                x, y, m = out[-1]
                to_i, to_j = (x - n, y - n) if step < 0 else (x + m, y + m)
                if (to_i == i or to_j == j) and a[to_i:to_i + n] == b[to_j:to_j + n]:
                    out[-1] = [min(x, to_i), min(y, to_j), m + n]
                    continue
            out.append([i, j, n])
        runs = out[::step]
    return [(i + k, j + k) for i, j, n in runs for k in range(n)]


def blocks(pairs: list[tuple[int, int]]) -> Iterator[list[int]]:
    """Runs of aligned places that follow each other in both texts, as places of the second text."""
    run: list[tuple[int, int]] = []
    for i, j in pairs:
        if run and (run[-1][0] + 1, run[-1][1] + 1) != (i, j):
            yield [y for _, y in run]
            run = []
        run.append((i, j))
    if run:
        yield [y for _, y in run]


def deleted_places(first: list[int], later: list[int], words: list[int], min_words: int) -> list[int]:
    return [j for block in blocks(patience(first, later)) if sum(words[j] for j in block) >= min_words for j in block]


def _align(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, firsts, laters, words = (batch.column(c).to_pylist() for c in ("_later", "_first_lines", "_lines", "_words"))
            out_keys, out_places = [], []
            for key, first, later, count in zip(keys, firsts, laters, words):
                places = deleted_places(first, later, count, min_words)
                out_keys += [key] * len(places)
                out_places += places
            yield pa.RecordBatch.from_arrays([pa.array(out_keys, pa.binary()), pa.array(out_places, pa.int32())], ["_key", "_place"])
    return run


def run_ends(words: list[int], min_words: int) -> set[tuple[int, int]]:
    """First and last place of the shortest runs of two lines or more that have ``min_words``, from each line on and up to each
    line that is not blank. Every line of a block of enough words is in such a run of the block or has enough words alone."""
    filled = [k for k, n in enumerate(words) if n]
    out = set()
    total = low = 0
    for high, k in enumerate(filled):  # the longest start that is still enough, for each end
        total += words[k]
        while total - words[filled[low]] >= min_words:
            total -= words[filled[low]]
            low += 1
        if total >= min_words:
            out.add((filled[low], k))
    total = high = 0
    for low, k in enumerate(filled):
        while high < len(filled) and total < min_words:
            total += words[filled[high]]
            high += 1
        if total < min_words:
            break
        out.add((k, filled[high - 1]))
        total -= words[k]
    return {(x, y) for x, y in out if x < y}


def _runs(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hashes = [], []

            def out() -> pa.RecordBatch:
                at = pa.array(rows, pa.int64())
                return pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in ("_key", "_order")], pa.array(hashes, pa.int64())], ["_key", "_order", "_line"])

            for row, (lines, words) in enumerate(zip(batch.column("_lines").to_pylist(), batch.column("_words").to_pylist())):
                found = {hash(tuple(lines[x:y + 1])) for x, y in run_ends(words, min_words)}  # a hash of numbers is the same in every process
                rows += [row] * len(found)
                hashes += found
                if len(rows) > 50_000:
                    yield out()
                    rows, hashes = [], []
            yield out()
    return run


def text_key() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def lines_of() -> Column:
    return F.split(F.coalesce("text", F.lit("")), "\n", -1)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, n_lines, n_deleted, text``: every row of ``docs`` with its remaining lines.

    Lines are compared by hash without white space at their ends; blank lines match nothing by themselves. Documents are in order of id, null
    last. Rows equal in id and text count as one document and keep the same lines; an id with several texts is one document
    per text. Null text counts as empty. A block is deleted if it has ``min_words`` words. An empty table gives no rows.
    """
    rows = docs.select("doc_id", "text").withColumn("_key", text_key())
    narrow = materialize(rows.select("doc_id", "_key", F.transform(lines_of(), lambda x: F.xxhash64(F.regexp_replace(x, r"^\s+|\s+$", ""))).alias("_lines"), F.transform(
        lines_of(), lambda x: F.regexp_count(x, F.lit(r"\S+"))).alias("_words")), "lines")
    order = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))
    classes = materialize(narrow.groupBy("_key").agg(F.min(order).alias("_order"), F.first("_lines").alias("_lines"), F.first("_words").alias("_words")), "line_classes")
    lines = classes.select("_key", "_order", F.explode(F.arrays_zip("_lines", "_words")).alias("_l")).filter("_l._words > 0").select(
        "_key", "_order", F.col("_l._lines").alias("_line")).unionByName(
        classes.select("_key", "_order", "_lines", "_words").mapInArrow(_runs(min_words), "_key binary, _order bigint, _line bigint"))
    holders = lines.groupBy("_line").agg(F.min(F.struct("_order", "_key")).alias("_first"), F.max(F.struct("_order", "_key")).alias("_last")).filter(
        F.col("_first") != F.col("_last"))
    pairs = lines.join(holders, "_line").filter(F.col("_first._key") != F.col("_key")).select(
        F.col("_key").alias("_later"), F.col("_first._key").alias("_first")).distinct()
    sides = pairs.join(classes.select(F.col("_key").alias("_later"), "_lines", "_words"), "_later").join(
        classes.select(F.col("_key").alias("_first"), F.col("_lines").alias("_first_lines")), "_first")
    places = sides.select("_later", "_first_lines", "_lines", "_words").mapInArrow(_align(min_words), "_key binary, _place int")
    gone = materialize(classes.select("_key", "_order").join(
        places.groupBy("_key").agg(F.collect_set("_place").alias("_places")), "_key", "left"), "line_deletions")
    kept = F.filter(lines_of(), lambda x, i: ~F.array_contains(F.coalesce("_places", F.array().cast("array<int>")), i))
    copy = F.col("_order") != order  # an earlier document has the whole text
    out = rows.join(gone, "_key").withColumn("_kept", F.when(copy, F.array().cast("array<string>")).otherwise(kept))
    return out.select(
        "doc_id", F.size(lines_of()).cast("bigint").alias("n_lines"), (F.size(lines_of()) - F.size("_kept")).cast("bigint").alias("n_deleted"),
        F.array_join("_kept", "\n").alias("text"))
