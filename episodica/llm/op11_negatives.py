"""Hard negatives by an inverted multi-index.

Vectors are cut into two halves, each half has a codebook, and a pair of codes is a cell. The inner product of an anchor
with a row of a cell is at most the sum of two half bounds, each the product with the half's centre plus the anchor's half
norm times the radius of the code. An anchor visits cells in descending order of that sum (the multi-sequence heap over two
sorted lists) and stops when the next bound lies below what it still needs: its last kept score or the lower end of its
window. Then the result is certified, whatever the codebooks are; they only decide how early that happens.

Visits go in rounds of growing size. In a round, shards of the index (whole cells, large cells cut) meet the anchors that
visit one of their cells; every visited pair is scored exactly and each shard hands on a few best rows an anchor and window.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.session import materialize

#: Codes of a half, so the square of it is the most cells there can be.
CODES = 32
#: Rows that the codebooks are fitted on; radii, cells and scores cover all rows.
SAMPLE = 8192
#: Rows of an index shard, anchors of a group that meet it, and rows that an anchor visits in the first round.
SHARD, GROUP, FIRST = 16384, 1024, 4096
#: Growth of the rows visited from round to round.
GROWTH = 8
_NO_ID = np.iinfo(np.int64).max
_ROW = "uid long, vec_id long, label long, v array<long>"


def quantized(rows: DataFrame, scale: int = 256) -> DataFrame:
    """``uid, vec_id, label, v`` of the rows that take part, components multiplied by ``scale`` and rounded down."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    chosen = rows.select("vec_id", "label", "embedding").filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(whole, F.lit(False)))
    return chosen.select(
        F.monotonically_increasing_id().alias("uid"), F.coalesce(F.col("vec_id").cast("long"), F.lit(int(_NO_ID))).alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of long lists as a matrix; short rows end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of two integer matrices' rows, by doubles wherever no sum can leave their 53 bits."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 2.0 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, -_NO_ID, _NO_ID).astype(np.int64)


def codebook(rows: np.ndarray, codes: int, turns: int = 8) -> np.ndarray:
    """Centres of ``rows`` by Lloyd's steps from rows spread evenly over the sample."""
    centres = np.unique(rows, axis=0)
    centres = centres[np.linspace(0, len(centres) - 1, min(codes, len(centres))).astype(int)]
    for _ in range(turns):
        own = nearest(rows, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        count = np.bincount(own, minlength=len(centres))
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and the distance to it."""
    own = np.argmin((centres * centres).sum(1) - 2.0 * rows @ centres.T, axis=1)
    return own, np.sqrt(((rows - centres[own]) ** 2).sum(1))


class Index:
    """Codebooks, cells and shards of all rows. What the driver holds is bounded by ``CODES`` and ``SAMPLE``."""

    def __init__(self, rows: DataFrame, width: int):
        self.width, self.half = width, width // 2
        sample = rows.orderBy(F.xxhash64("v"), "uid").limit(SAMPLE).select("v").toArrow()
        fit = matrix(sample.column("v"), width).astype(np.float64)
        self.books = (codebook(fit[:, :self.half], CODES), codebook(fit[:, self.half:], CODES))
        placed = materialize(rows.mapInArrow(self._place, f"{_ROW}, cell int, d1 double, d2 double"), "cells")
        cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("d1").alias("r1"), F.max("d2").alias("r2")).orderBy("cell").collect()
        codes = len(self.books[1])
        self.sizes = np.zeros(len(self.books[0]) * codes, np.int64)
        self.radii = (np.zeros(len(self.books[0])), np.zeros(codes))
        for c in cells:
            self.sizes[c.cell] = c.n
            for radii, code, r in ((self.radii[0], c.cell // codes, c.r1), (self.radii[1], c.cell % codes, c.r2)):
                radii[code] = max(radii[code], r)
        self.starts = np.cumsum(self.sizes) - self.sizes
        places = rows.sparkSession.createDataFrame([(int(c), int(self.starts[c]), int(self.sizes[c])) for c in np.flatnonzero(self.sizes)], "cell int, _start long, _n long")
        shard = F.floor((F.col("_start") + F.pmod(F.xxhash64("uid"), F.col("_n"))) / SHARD)  # at most CODES * CODES rows are broadcast
        self.rows = materialize(placed.join(F.broadcast(places), "cell").select("uid", "vec_id", "label", "v", "cell", shard.alias("shard")), "shards")

    def __getstate__(self) -> dict:
        """What tasks need: all but the frame."""
        return {name: value for name, value in vars(self).items() if name != "rows"}

    def _place(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), self.width).astype(np.float64)
            (c1, d1), (c2, d2) = nearest(v[:, :self.half], self.books[0]), nearest(v[:, self.half:], self.books[1])
            cell = pa.array((c1 * len(self.books[1]) + c2).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, cell, pa.array(d1), pa.array(d2)], [*batch.schema.names, "cell", "d1", "d2"])

    def order(self, query: np.ndarray) -> Iterator[tuple[float, float, int]]:
        """Cells with their upper and lower bounds, by descending upper bound: the multi-sequence heap."""
        ups, downs = [], []
        for part, book, radii in ((query[:self.half], self.books[0], self.radii[0]), (query[self.half:], self.books[1], self.radii[1])):
            middle, reach = book @ part, np.sqrt((part * part).sum()) * radii
            slack = 1e-9 * (np.abs(book) @ np.abs(part) + reach) + 1e-3  # rounding of the bounds themselves
            ups.append(middle + reach + slack)
            downs.append(middle - reach - slack)
        first, second = np.argsort(-ups[0], kind="stable"), np.argsort(-ups[1], kind="stable")
        a, b = ups[0][first], ups[1][second]
        codes = len(b)
        heap, seen = [(-(a[0] + b[0]), 0, 0)], {0}
        while heap:
            bound, i, j = heapq.heappop(heap)
            yield -bound, downs[0][first[i]] + downs[1][second[j]], int(first[i]) * codes + int(second[j])
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(a) and y < codes and x * codes + y not in seen:
                    seen.add(x * codes + y)
                    heapq.heappush(heap, (-(a[x] + b[y]), x, y))

    def walk(self, rows_wanted: int):
        """``(uid, shard, cells, visited)`` of the next cells of each open anchor, up to ``rows_wanted`` rows or its end."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = {"uid": [], "shard": [], "cells": [], "visited": []}
                queries = matrix(batch.column("v"), self.width).astype(np.float64)
                columns = [batch.column(c).to_pylist() for c in ("uid", "need", "most", "visited")]
                for query, uid, need, most, visited in zip(queries, *columns):
                    by_shard, at, rows = {}, 0, 0
                    for at, (up, down, cell) in enumerate(self.order(query)):
                        if up < need or rows >= rows_wanted:
                            break
                        at += 1
                        if at <= visited or down > most or not self.sizes[cell]:
                            continue
                        rows += int(self.sizes[cell])
                        for shard in range(int(self.starts[cell]) // SHARD, int(self.starts[cell] + self.sizes[cell] - 1) // SHARD + 1):
                            by_shard.setdefault(shard, []).append(cell)
                    for shard, cells in by_shard.items():
                        for name, value in (("uid", uid), ("shard", shard), ("cells", cells), ("visited", at)):
                            out[name].append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["uid"], pa.int64()), pa.array(out["shard"], pa.int64()), pa.array(out["cells"], pa.list_(pa.int32())), pa.array(out["visited"], pa.int32())], list(out))
        return run


def _score(width: int, same: bool, take: int):
    """Best rows of one shard for one group of anchors: ``(query, window, score, vec_id, uid)``."""
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query", "window", "score", "vec_id", "uid"]
        empty = pa.table({n: pa.array([], pa.int32() if n == "window" else pa.int64()) for n in names})
        if not rows.num_rows or not queries.num_rows:
            return empty
        v, q = matrix(rows["v"], width), matrix(queries["v"], width)
        cell, label, uid, vec_id = (rows[c].to_numpy() for c in ("cell", "label", "uid", "vec_id"))
        q_uid, q_label, need, most = (queries[c].to_numpy() for c in ("uid", "label", "need", "most"))
        windows = list(zip(queries["windows"].to_pylist(), queries["lows"].to_pylist(), queries["highs"].to_pylist()))
        visited = queries["cells"].combine_chunks()
        visitor = np.repeat(np.arange(len(q)), np.diff(visited.offsets.to_numpy()))
        visited = visited.flatten().to_numpy()
        order = np.lexsort((visitor, visited))
        visited, visitor = visited[order], visitor[order]
        by_cell = np.lexsort((label, cell))
        places = np.searchsorted(cell[by_cell], np.unique(visited), side="left"), np.searchsorted(cell[by_cell], np.unique(visited), side="right")
        parts, held, best = [], 0, []

        def settle() -> None:
            """Of the rows met so far, keep those that are among the first ``take`` of a window."""
            nonlocal parts, held, best
            who, where, score = (np.concatenate(x) for x in zip(*best, *parts)) if best or parts else (np.zeros(0, np.int64),) * 3
            at = np.lexsort((uid[where], vec_id[where], -score, who))
            who, where, score = who[at], where[at], score[at]
            keep = np.zeros(len(who), bool)
            cuts = np.flatnonzero(np.diff(who, prepend=-1))
            for start, end in zip(cuts, [*cuts[1:], len(who)]):
                for low, high in zip(*windows[who[start]][1:]):
                    descending = -score[start:end]
                    first, last = np.searchsorted(descending, -high, "left"), np.searchsorted(descending, -low, "right")
                    keep[start + first:start + min(first + take, last)] = True
            best, parts, held = [(who[keep], where[keep], score[keep])], [], 0

        for c, start, end in zip(np.unique(visited), *places):
            who = visitor[np.searchsorted(visited, c, "left"):np.searchsorted(visited, c, "right")]
            here = by_cell[start:end]
            for group in (np.unique(q_label[who]) if same else [None]):
                own = who[q_label[who] == group] if same else who
                near = here[label[here] == group] if same else here
                for at in range(0, len(near), 4096):
                    some = near[at:at + 4096]
                    scores = products(q[own], v[some])
                    fits = (scores >= need[own][:, None]) & (scores <= most[own][:, None])
                    fits &= (q_uid[own][:, None] != uid[some]) if same else (q_label[own][:, None] != label[some])
                    i, j = np.nonzero(fits)
                    if len(i):
                        parts.append((own[i], some[j], scores[i, j]))
                        held += len(i)
                        if held > 1 << 20:
                            settle()
        settle()
        out = [[], [], [], [], []]
        who, where, score = best[0]
        cuts = np.flatnonzero(np.diff(who, prepend=-1))
        for start, end in zip(cuts, [*cuts[1:], len(who)]):
            for window, low, high in zip(*windows[who[start]]):
                descending = -score[start:end]
                first, last = np.searchsorted(descending, -high, "left"), np.searchsorted(descending, -low, "right")
                some = slice(start + first, start + min(first + take, last))
                n = some.stop - some.start
                if n > 0:
                    for part, value in zip(out, (np.full(n, q_uid[who[start]]), np.full(n, window, np.int32), score[some], vec_id[where[some]], uid[where[some]])):
                        part.append(value)
        return pa.table({n: np.concatenate(x) for n, x in zip(names, out)}) if out[0] else empty
    return run


def search(index: Index, queries: DataFrame, same: bool, take: int) -> DataFrame:
    """``(query, window, rank, score, vec_id, uid)``: the first ``take`` rows of every window of every query.

    ``queries(uid, label, v, windows, lows, highs)`` lists windows by number and both ends. With ``same`` other rows of the
    query's label are searched, else rows of other labels. Higher scores come first, ties by smaller id.
    """
    spark = queries.sparkSession
    groups = max(1, -(-queries.count() // GROUP))
    grouped = queries.withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(groups))).withColumn("visited", F.lit(0))
    grouped = grouped.withColumn("need", F.array_min("lows")).withColumn("most", F.array_max("highs"))
    open_ = materialize(grouped, "open")
    best, rows = spark.createDataFrame([], "query long, window int, score long, vec_id long, uid long, rank int"), FIRST
    by_rank = Window.partitionBy("query", "window").orderBy(F.desc("score"), "vec_id", "uid")
    while True:
        visits = materialize(open_.mapInArrow(index.walk(rows), "uid long, shard long, cells array<int>, visited int"), "visits")
        if visits.isEmpty():
            return best
        asked = open_.drop("visited").join(visits.drop("visited"), "uid")
        shards = asked.select("shard", "part").distinct()
        asked = asked.withColumnsRenamed({"shard": "_shard", "part": "_part"})
        met = index.rows.join(shards, "shard").groupBy("shard", "part").cogroup(asked.groupBy("_shard", "_part")).applyInArrow(
            _score(index.width, same, take), "query long, window int, score long, vec_id long, uid long")
        # few rows a shard and window come out; the window keeps its first rows before the shuffle as well
        both = best.drop("rank").unionByName(met).withColumn("rank", F.row_number().over(by_rank))
        best = materialize(both.filter(F.col("rank") <= take), "best")
        # a full window needs no score below its last one; a query that visited nothing is done
        last = best.filter(F.col("rank") == take).groupBy(F.col("query").alias("uid")).agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("_last"))
        seen = visits.groupBy("uid").agg(F.max("visited").alias("visited"))
        lows = F.zip_with("windows", "lows", lambda w, low: F.greatest(low, F.coalesce(F.col("_last")[w], low)))
        open_ = materialize(open_.drop("visited").join(seen, "uid").join(last, "uid", "left").withColumn("lows", lows).drop("_last").withColumn("need", F.array_min("lows")), "open")
        rows *= GROWTH


def hard_negatives(
    rows: DataFrame, anchors: Column, scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from ``rows(vec_id, embedding, label)``.

    ``anchors`` is a condition on ``vec_id``. An anchor's positives are its first other rows of the same label; a positive's
    negatives are the first rows of other labels whose score lies between ``low`` and ``high`` percent of the positive's.

    Rows with a null label, a null vector or a null or non-finite component take no part. A null id counts as the largest
    one and comes back as null. Every repeated row is a row of its own: an anchor excludes only itself. Vectors of different
    length are compared as if the shorter ended in zeros; an empty one scores 0. Equal scores order by id, then by position.
    A positive with a negative score, or without a fitting row, gives no row, and neither does an empty table. Labels are
    integers. Other columns are not read.
    """
    spark = rows.sparkSession
    vectors = materialize(quantized(rows, scale), "vectors")
    width = vectors.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    index = Index(vectors, max(int(width), 2))
    own = vectors.filter(anchors & (F.col("vec_id") != int(_NO_ID)))
    ends = [F.array(F.lit(-int(_NO_ID)).cast("long")).alias("lows"), F.array(F.lit(int(_NO_ID)).cast("long")).alias("highs")]
    near = search(index, own.select("uid", "label", "v", F.array(F.lit(0)).alias("windows"), *ends), same=True, take=positives)
    near = near.withColumn("_low", F.expr(f"({low} * score + 99) div 100")).withColumn("_high", F.expr(f"({high} * score) div 100")).filter("score >= 0 and _low <= _high")
    near = materialize(near, "positives")
    sides = near.groupBy(F.col("query").alias("uid")).agg(F.sort_array(F.collect_list(F.struct(F.col("rank").alias("w"), "_low", "_high"))).alias("_w"))
    asked = own.select("uid", "label", "v").join(sides, "uid").select(
        "uid", "label", "v", F.col("_w.w").alias("windows"), F.col("_w._low").alias("lows"), F.col("_w._high").alias("highs"))
    far = search(index, materialize(asked, "asked"), same=False, take=negatives)
    ids = own.select(F.col("uid").alias("query"), F.col("vec_id").alias("anchor_id"))
    known = near.select("query", F.col("rank").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = far.select("query", "window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(known, ["query", "window"]).join(ids, "query")
    given = {c: F.when(F.col(c) != int(_NO_ID), F.col(c)) for c in ("positive_id", "negative_id")}
    return found.withColumns(given).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
