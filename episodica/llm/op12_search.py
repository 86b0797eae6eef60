"""Ranked lexical search with a document FP-tree.

A document is cut down to the terms that some item asks for, written in one global order, rarest first. Documents of one
tree have nearly the same length, so their length normalisers ``m`` are close. Sorted by their term sequences they form a
trie whose paths are shared by documents with the same first terms. Every node knows, for its whole subtree, the largest
frequency of each term, the smallest ``m`` and the smallest id. From those follows the best score that any document below
can have for an item; a depth-first branch-and-bound per item leaves a subtree as soon as its bound cannot enter the item's
list. Where only a few documents are left on a path they are scored exactly.

Items are handled in blocks of bounded size, each against all documents; a task keeps only the best few of each item.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from episodica.session import materialize

#: Items of one block and characters of all its texts (a longer text is a block of its own): what the driver and each task hold.
ITEMS, ITEM_CHARS = 2048, 1 << 20
#: Documents of one tree, and documents on a path that are scored without further branches.
TREE, LEAF = 4096, 24
#: Weight parts of the score, in hundredths: the length normaliser is ``100 - B + B * n / mean length``.
B = 90
_NO_ID = np.iinfo(np.int64).max
# every byte that is no letter, digit or part of a character beyond ASCII becomes a blank; A-Z become a-z
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _cut_down(known: dict[bytes, int]):
    """``(doc_id, n, terms, tfs)``: all terms counted, those of the items kept by number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, terms, tfs = [], [], []
            for text in batch.column("text"):
                words = terms_of(text.as_py())
                found = Counter(filter(known.__contains__, words))
                n.append(len(words))
                terms.append([known[t] for t in found])
                tfs.append(list(found.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"])
    return run


class Tree:
    """FP-tree of documents in compressed form: rows sorted by term sequence, nodes as ranges of rows."""

    def __init__(self, doc_id: np.ndarray, m: np.ndarray, terms: list[np.ndarray], tfs: list[np.ndarray], vocabulary: int):
        order = sorted(range(len(doc_id)), key=lambda i: terms[i].astype(">u4").tobytes())
        self.doc_id, self.m = doc_id[order], m[order]
        self.terms = [terms[i] for i in order]
        sizes = np.array([len(t) for t in self.terms])
        self.ends = np.concatenate(([0], np.cumsum(sizes)))
        self.flat = np.concatenate(self.terms).astype(np.int64)
        self.tf = np.concatenate([tfs[i] for i in order]).astype(np.int64)
        self.gain = (1_000_000_000 * self.tf) // (1000 * self.tf + 8 * np.repeat(self.m, sizes))
        self.rows, self.children = [], []  # of each node: its range of documents; numbers of its children
        self._grow(0, len(order), 0)
        used = np.unique(self.flat)
        self.column = np.full(vocabulary, len(used))
        self.column[used] = np.arange(len(used))
        self.most_tf = np.zeros((len(self.rows), len(used) + 1), np.int32)
        self.least_m = np.zeros(len(self.rows), np.int64)
        self.least_id = np.zeros(len(self.rows), np.int64)
        for node in range(len(self.rows) - 1, -1, -1):  # children have larger numbers than their parent
            if self.children[node]:
                below = self.children[node]
                self.most_tf[node] = self.most_tf[below].max(0)
                self.least_m[node], self.least_id[node] = self.least_m[below].min(), self.least_id[below].min()
            else:
                start, end = self.rows[node]
                entries = slice(self.ends[start], self.ends[end])
                np.maximum.at(self.most_tf[node], self.column[self.flat[entries]], self.tf[entries].astype(np.int32))
                self.least_m[node], self.least_id[node] = self.m[start:end].min(), self.doc_id[start:end].min()

    def _grow(self, start: int, end: int, depth: int) -> None:
        """Nodes of the documents ``start`` to ``end``, which share their first ``depth`` terms."""
        todo = [(start, end, depth, -1)]
        while todo:
            start, end, depth, parent = todo.pop()
            node = len(self.rows)
            self.rows.append((start, end))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            if end - start <= LEAF:
                continue
            first, last = self.terms[start], self.terms[end - 1]
            same = min(len(first), len(last))
            differs = np.flatnonzero(first[depth:same] != last[depth:same])
            depth = depth + int(differs[0]) if len(differs) else same  # a path without branches is one node
            if depth == len(last):
                continue  # all have the same terms
            at = few = start
            while at < end:
                stop = self._run(at, end, depth)
                if stop - few > LEAF:  # neighbours with few documents are one leaf
                    if few < at:
                        todo.append((few, at, depth, node))
                    few = at
                if stop - few > LEAF:
                    todo.append((at, stop, depth + 1, node))
                    few = stop
                at = stop
            if few < end:
                todo.append((few, end, depth, node))

    def _run(self, start: int, end: int, depth: int) -> int:
        """End of the documents from ``start`` on with the same term at ``depth``; those that have none there come first."""
        own = self.terms[start][depth] if len(self.terms[start]) > depth else -1
        low, high = start + 1, end
        while low < high:
            middle = (low + high) // 2
            other = self.terms[middle][depth] if len(self.terms[middle]) > depth else -1
            low, high = (middle + 1, high) if other == own else (low, middle)
        return low

    def search(self, item: np.ndarray, weight: np.ndarray, weights: np.ndarray, best: list[tuple[int, int]], take: int) -> list[tuple[int, int]]:
        """``best``, the item's first ``(-score, doc_id)`` so far, with those of this tree. ``weights`` is zero beside the item's terms."""
        tf = self.most_tf[:, self.column[item]].astype(np.int64)
        bound = ((1_000_000_000 * tf) // np.maximum(1000 * tf + 8 * self.least_m[:, None], 1)) @ weight
        stack = [0]
        while stack:
            node = stack.pop()
            if bound[node] <= 0 or len(best) == take and (-int(bound[node]), int(self.least_id[node])) > best[-1]:
                continue
            below = self.children[node]
            if below:
                stack.extend(sorted(below, key=bound.__getitem__))  # the most promising one is met first
                continue
            start, end = self.rows[node]
            entries = slice(self.ends[start], self.ends[end])
            upto = np.concatenate(([0], np.cumsum(weights[self.flat[entries]] * self.gain[entries])))
            scores = upto[self.ends[start + 1:end + 1] - self.ends[start]] - upto[self.ends[start:end] - self.ends[start]]
            found = scores > 0
            if len(best) == take:
                found &= scores >= -best[-1][0]
            if found.any():
                best = sorted([*best, *zip((-scores[found]).tolist(), self.doc_id[start:end][found].tolist())])[:take]
        return best


def _trees(items: list[np.ndarray], weight: np.ndarray, place: np.ndarray, count: int, total: int, take: int):
    """Best documents of each item among a task's documents, tree by tree; ``place`` is a term's rank in the order."""
    by_rank = np.zeros(len(weight) + 1, np.int64)
    by_rank[place] = weight
    ranked = [place[i] for i in items]

    def search(rows: list[tuple], best: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
        doc_id, n, terms, tfs = zip(*rows)
        m = 100 - B + (B * np.array(n, np.int64) * count) // total
        ordered = [np.argsort(place[t]) for t in terms]
        tree = Tree(np.array(doc_id, np.int64), m, [place[t][o] for t, o in zip(terms, ordered)], [f[o] for f, o in zip(tfs, ordered)], len(weight))
        weights = np.zeros(len(weight) + 1, np.int64)
        for k, item in enumerate(ranked):
            weights[item] = by_rank[item]
            best[k] = tree.search(item, by_rank[item], weights, best[k], take)
            weights[item] = 0
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, rows = [[] for _ in items], []
        for batch in batches:
            ids = batch.column("doc_id").fill_null(int(_NO_ID)).to_numpy()
            terms, tfs = batch.column("terms"), batch.column("tfs")
            ends, flat, tf = terms.offsets.to_numpy(), terms.values.to_numpy(), tfs.values.to_numpy()
            for i, n in enumerate(batch.column("n").to_numpy()):
                rows.append((ids[i], n, flat[ends[i]:ends[i + 1]], tf[ends[i]:ends[i + 1]]))
                if len(rows) == TREE:
                    best, rows = search(rows, best), []
        if rows:
            best = search(rows, best)
        out = [(k, doc_id, -score) for k, found in enumerate(best) for score, doc_id in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["item", "doc_id", "score"])
    return run


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """Items in blocks of bounded size; the driver reads them partition by partition and holds one block."""
    held, chars = [], 0
    for item_id, text in items.toLocalIterator():
        if held and (len(held) == ITEMS or chars + len(text or "") > ITEM_CHARS):
            yield held
            held, chars = [], 0
        held.append((item_id, text))
        chars += len(text or "")
    if held:
        yield held


def _search_block(docs: DataFrame, items: list[tuple], take: int) -> DataFrame:
    spark = docs.sparkSession
    known: dict[bytes, int] = {}
    wanted = [np.array(sorted({known.setdefault(t, len(known)) for t in terms_of(text)}), np.int64) for _, text in items]
    rows = materialize(docs.mapInArrow(_cut_down(known), "doc_id long, n long, terms array<int>, tfs array<long>"), "restricted")
    count, total = rows.filter("n > 0").agg(F.count("*"), F.sum("n")).first()
    if not count:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    # one row a term of the block
    counted = rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    df = np.zeros(len(known), np.int64)
    for r in counted:
        df[r["term"]] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    place = np.empty(len(known), np.int64)
    place[np.lexsort((np.arange(len(df)), df))] = np.arange(len(df))
    # equal lengths meet in a tree; the id keeps one common length from filling one partition
    near = rows.filter(F.size("terms") > 0).repartitionByRange("n", "doc_id")
    found = near.mapInArrow(_trees(wanted, weight, place, int(count), int(total), take), "item int, doc_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))).filter(F.col("rank") <= take)
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(items)], "item int, item_id long")
    return ranked.join(F.broadcast(names), "item").select(
        "item_id", "rank", F.when(F.col("doc_id") != int(_NO_ID), F.col("doc_id")).alias("doc_id"), "score")


def ranked_search(docs: DataFrame, items: DataFrame, take: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``take`` highest-scoring documents above 0 of every item.

    Terms are runs of ASCII letters and digits and characters beyond ASCII, only A-Z lower-cased. With N documents that have
    a term, L terms in them, df documents holding a term, tf its occurrences in a document of n terms, the weight of a term is
    floor(1000 * ln((2 N + 2) / (2 df + 1))), m = 10 + (90 n N) div L, and a document's score the sum of weight * ((10^9 tf)
    div (1000 tf + 8 m)) over the item's distinct terms. Equal scores order by smaller id; a null id comes last.

    Null or empty texts have no terms: such documents are never found and not counted, such items have no rows. Repeated rows
    rank on their own; a repeated item is answered for each of its rows. Whole texts are read, however long. An empty table
    on either side gives no rows. Other columns are not read. Ids are integers.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    result = None
    for block in _blocks(items.select(F.col("item_id").cast("long").alias("item_id"), "text")):
        found = materialize(_search_block(docs, block, take), "ranked")
        result = found if result is None else result.unionByName(found)
    return result if result is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
