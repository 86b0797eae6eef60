"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

Both classes have discounted counts of their own for n-grams of the highest order and back off to one Kneser-Ney model of
the pooled counts, so an expression that is rare in both says nothing. All n-grams stay in Spark tables: continuation counts and
both classes' log-probabilities are found there by grouping. Distinct words get their scores in splits of neighbours that meet
their distinct n-grams, documents in splits of texts that meet their distinct words. A document is judged by the difference of
its toxic and ordinary log-likelihood per word, turned into a probability by a logistic curve that is fitted on labelled
documents that no count has seen.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.llm.charmodel import word_counts, words_of
from episodica.llm.common import broadcast_if_small, each, fold
from episodica.session import materialize, scratch

ORDER, DISCOUNT = 7, 0.75
#: Discount of a class: so many occurrences of an n-gram are left to the shared model, which both classes back off to.
RARE = 5
#: Labelled documents of fold 1 on which the logistic curve is fitted, at most.
CALIBRATION = 10_000
#: Distinct words that a counting task holds before it passes them on.
HELD_WORDS = 100_000
#: Characters and distinct words of a split of texts, n-grams of a split of words, about.
SPLIT, SPLIT_WORDS, SPELT = 32_000_000, 250_000, 1_000_000
#: Characters that a text counts for beside its own, as short ones take room as well.
ROW = 256
#: Buckets of words, at least; a bucket has the words of about ``SPLIT`` characters, those of each split once.
BUCKETS = 512
_CODEC = pa.Codec("zstd")


def _word_rows(words: dict[str, list[int]]) -> pa.RecordBatch:
    n = np.array(list(words.values()), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(n[:, 0]), pa.array(n[:, 1])], ["word", "n0", "n1"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words with their occurrences in both classes; a document that is not learned from has a null label."""
    held: dict[str, list[int]] = {}
    met: set[str] = set()  # words of documents without a label
    for batch in batches:
        for label, text in zip(batch.column("label").to_pylist(), each(batch.column("text"))):
            if label is None:
                for words in words_of(text):
                    met.update(words)
            else:
                for word, n in word_counts(text).items():
                    held.setdefault(word, [0, 0])[label] += n
            if len(held) + len(met) > HELD_WORDS:
                yield _word_rows(held | {w: (0, 0) for w in met if w not in held})
                held, met = {}, set()
    if held or met:
        yield _word_rows(held | {w: (0, 0) for w in met if w not in held})


def _spelt(words: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """The n-grams of the highest order of each word, which has marks in front and one behind: numbers of all n-grams in
    order, the distinct ones by number, the first place of each word."""
    numbers: dict[str, int] = {}
    found: list[int] = []
    first = np.zeros(len(words), np.int64)
    for at, word in enumerate(words):
        whole = "\x02" * (ORDER - 1) + word + "\x03"
        first[at] = len(found)
        found += [numbers.setdefault(whole[i:i + ORDER], len(numbers)) for i in range(len(word) + 1)]
    return np.array(found, np.int64), list(numbers), first


def _split_spelling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered words in splits of about ``SPELT`` n-grams: a row a split with its words, its distinct n-grams and their counts."""
    def out() -> pa.RecordBatch:
        words = [w for part in held for w in part.column("word").to_pylist()]
        ids, grams, first = _spelt(words)
        sizes = np.diff(np.append(first, len(ids)))
        n = [np.bincount(ids, np.repeat(np.concatenate([part.column(c).to_numpy() for part in held]), sizes), len(grams)).astype(np.int64) for c in ("n0", "n1")]
        return pa.RecordBatch.from_arrays(
            [pa.array([split], pa.int64()), pa.array([words], pa.list_(pa.string())), pa.array([grams], pa.list_(pa.string())),
             *[pa.array([x], pa.list_(pa.int64())) for x in n]], ["split", "words", "grams", "n0", "n1"])

    split = TaskContext.get().partitionId() << 32
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        ends = np.cumsum(np.fromiter((len(w) + 1 for w in batch.column("word").to_pylist()), np.int64, batch.num_rows))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = min(batch.num_rows, int(np.searchsorted(ends, before + SPELT - size)) + 1)
            held.append(batch.slice(at, stop - at))
            size += int(ends[stop - 1] - before)
            at = stop
            if size >= SPELT:
                yield out()
                split, held, size = split + 1, [], 0
    if held:
        yield out()


def _sum_words(spelt: pa.Table, known: pa.Table) -> pa.Table:
    """``word, ratio`` of one split's words from the scores of its n-grams; words without a scored n-gram are left out."""
    words = [w for part in spelt["words"].to_pylist() for w in part]
    ids, grams, first = _spelt(words)
    scores = np.zeros(len(grams))
    scores[known["id"].to_numpy()] = known["seen"].to_numpy()
    ratio = np.add.reduceat(scores[ids], first)
    kept = np.flatnonzero(ratio)
    return pa.table({"word": pa.array(words, pa.string()).take(pa.array(kept)), "ratio": pa.array(ratio[kept], pa.float64())})


def _zip(data: bytes) -> bytes:
    return len(data).to_bytes(4, "little") + _CODEC.compress(data, asbytes=True)


def _unzip(body: bytes) -> bytes:
    return _CODEC.decompress(body[4:], int.from_bytes(body[:4], "little"), asbytes=True)


def _planes(*numbers: np.ndarray) -> bytes:
    """Whole numbers byte by byte: all lowest bytes, then all second ones and so on."""
    return _zip(np.concatenate(numbers).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _numbers(body: bytes) -> np.ndarray:
    return np.frombuffer(_unzip(body), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def _packed(ids: list[np.ndarray], n: list[np.ndarray]) -> bytes:
    """Word numbers and counts of documents: how many each has, the gaps between its ascending numbers, the counts."""
    orders = [np.argsort(x) for x in ids]
    gaps = [np.diff(x[o], prepend=0) for x, o in zip(ids, orders)]
    return _planes(np.fromiter(map(len, ids), np.int64, len(ids)), *gaps, *[x[o] for x, o in zip(n, orders)])


def _unpacked(body: bytes, documents: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The document, number and count of each word."""
    all_ = _numbers(body)
    sizes, rest = all_[:documents], all_[documents:]
    gaps, n = rest[:len(rest) // 2], rest[len(rest) // 2:]
    upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(gaps)))
    first = np.cumsum(sizes) - sizes
    return np.repeat(np.arange(documents), sizes), upto[1:] - np.repeat(upto[first], sizes), n


def _splitter(buckets: int):
    """Texts in splits of about ``SPLIT`` characters or ``SPLIT_WORDS`` distinct words: a row a split with the words of its
    texts, which have numbers in the order they are met, and a row for the words of each bucket.

    The words of a bucket start at place ``at`` of the order by bucket and word, in which ``placed`` has their numbers."""
    def rows(split: int, keys: list[bytes], ids: list[np.ndarray], n: list[np.ndarray], words: list[str]) -> pa.RecordBatch:
        bucket = np.fromiter((crc32(w.encode()) % buckets for w in words), np.int64, len(words))
        by_word = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        order = by_word[np.argsort(bucket[by_word], kind="stable")]
        found, at = np.unique(bucket[order], return_index=True)
        runs = [_zip("\n".join([words[k] for k in order[i:j]]).encode()) for i, j in zip(at, np.append(at[1:], len(words)))]
        none = [None] * len(runs)
        return pa.RecordBatch.from_arrays(
            [pa.array([split] * (1 + len(runs)), pa.int64()), pa.array([keys, *none], pa.list_(pa.binary())), pa.array([_planes(order), *none], pa.binary()),
             pa.array([_packed(ids, n), *runs], pa.binary()), pa.array([None, *found.tolist()], pa.int32()), pa.array([None, *at.tolist()], pa.int64())],
            ["split", "keys", "placed", "body", "bucket", "at"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = TaskContext.get().partitionId() << 32
        size, keys, ids, n = 0, [], [], []
        numbers: dict[str, int] = defaultdict(count().__next__)
        for batch in batches:
            for key, text in zip(each(batch.column("key")), each(batch.column("text"))):
                words = word_counts(text)
                keys.append(key)
                ids.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                n.append(np.fromiter(words.values(), np.int32, len(words)))
                size += len(text) + ROW
                if size >= SPLIT or len(numbers) >= SPLIT_WORDS:
                    yield rows(split, keys, ids, n, list(numbers))
                    split, size, keys, ids, n = split + 1, 0, [], [], []
                    numbers = defaultdict(count().__next__)
        if keys:
            yield rows(split, keys, ids, n, list(numbers))
    return cut


def _look_up(runs: pa.Table, known: pa.Table) -> pa.Table:
    """The scores of the words of each run, one bucket at a time; words without a score have 0."""
    scores = dict(zip(known["word"].to_pylist(), known["ratio"].to_pylist()))
    bodies = []
    for body in runs["body"].to_pylist():
        words = _unzip(body).decode().split("\n")
        bodies.append(np.fromiter((scores.get(w, 0.0) for w in words), "<f4", len(words)).tobytes())
    return pa.table({"split": runs["split"], "at": runs["at"], "ratios": pa.array(bodies, pa.binary())})


def _sum_split(texts: pa.Table, known: pa.Table) -> pa.Table:
    """``key, a, b`` of the texts of one split from the scores of its words, added up in the order by bucket and word."""
    runs = sorted(zip(known["at"].to_pylist(), known["ratios"].to_pylist()))
    scores = np.frombuffer(b"".join(r for _, r in runs), "<f4").astype(np.float64)
    out = []
    for keys, placed, body in zip(*(texts[c].to_pylist() for c in ("keys", "placed", "body"))):
        place = np.zeros(len(scores), np.int64)
        place[_numbers(placed)] = np.arange(len(scores))
        document, words, n = _unpacked(body, len(keys))
        words = place[words]
        order = np.argsort((document << 32) + words)
        document, own, n = document[order], scores[words[order]], n[order].astype(np.float64)
        first = np.flatnonzero(np.diff(document, prepend=-1))  # documents without words have none
        if len(first):
            all_ = np.add.reduceat(n, first)
            a, b = (np.add.reduceat(x * n, first) / all_ for x in (own, np.maximum(own - 2.0, 0.0)))
            out.append(pa.table({"key": pa.array([keys[i] for i in document[first]], pa.binary()), "a": pa.array(a), "b": pa.array(b)}))
    return pa.concat_tables(out) if out else pa.table({"key": pa.array([], pa.binary()), "a": pa.array([], pa.float64()), "b": pa.array([], pa.float64())})


def _last(gram: str, n: int) -> Column:
    return F.substring(gram, -n, n)


def gram_scores(grams: DataFrame) -> DataFrame:
    """``gram, seen``: log-likelihood of an n-gram in class 1 less that in class 0, from all n-grams with counts ``n0, n1``.

    The shared model is Kneser-Ney of the pooled counts. A group is one context, so it has no more rows than there are letters.
    """
    tables = {}  # order -> n-grams of that order with the number of different letters in front of them
    longer = grams
    for size in range(ORDER - 1, 0, -1):
        longer = tables[size] = materialize(longer.groupBy(_last("gram", size).alias("gram")).agg(F.count("*").alias("kinds")), f"grams{size}")
    lower = tables[1].crossJoin(F.broadcast(tables[1].agg(F.sum("kinds").alias("_all")))).select(
        "gram", ((F.col("kinds") + 1.0) / (F.col("_all") + 1024.0)).alias("p"))

    def below(df: DataFrame, n: int) -> DataFrame:
        found = materialize(lower.select(F.col("gram").alias("_tail"), F.col("p").alias("_below")), f"lower{n - 1}")
        return df.withColumn("_tail", _last("gram", n - 1)).join(found, "_tail").drop("_tail")

    def context(n: int):
        return Window.partitionBy(F.substring("gram", 1, n - 1))

    for n in range(2, ORDER):
        at = context(n)
        lower = below(tables[n].withColumn("_sum", F.sum("kinds").over(at)).withColumn("_types", F.count("*").over(at)), n).select(
            "gram", ((F.greatest(F.col("kinds") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("_types") * F.col("_below")) / F.col("_sum")).alias("p"))
    at = context(ORDER)
    held = {k: F.least(F.col(f"n{k}"), F.lit(RARE)) for k in (0, 1)}
    top = grams.select("gram", "n0", "n1", F.count("*").over(at).alias("_types"), *[F.sum(f"n{k}").over(at).alias(f"_own{k}") for k in (0, 1)],
                       *[F.sum(held[k]).over(at).alias(f"_spare{k}") for k in (0, 1)])
    shared = (F.greatest(F.col("n0") + F.col("n1") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("_types") * F.col("_below")) / (F.col("_own0") + F.col("_own1"))

    def log_p(k: int) -> Column:
        own = F.greatest(F.col(f"_own{k}"), F.lit(1))
        weight = F.when(F.col(f"_own{k}") > 0, F.col(f"_spare{k}") / own).otherwise(1.0)
        return F.log((F.col(f"n{k}") - held[k]) / own + weight * F.col("_shared"))

    return below(top, ORDER).withColumn("_shared", shared).select("gram", (log_p(1) - log_p(0)).alias("seen"))


class Curve:
    """Logistic curve over the features of a document; without held-back examples half a nat per word divides."""

    def __init__(self):
        self.weights = np.array([4.0, 4.0, -2.0])

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression by Newton steps."""
        scale = np.where(x.std(0) > 1e-9, x.std(0), 1.0)
        z, w = x / scale, np.zeros(x.shape[1])
        ridge = np.diag([1e-4, 1e-4, 1e-6]) * len(y)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w / scale

    def probability(self, a: Column, b: Column) -> Column:
        u, v, w = (float(x) for x in self.weights)
        return 1 / (1 + F.exp(-F.least(F.greatest(a * u + b * v + w, F.lit(-30.0)), F.lit(30.0))))


def word_scores(rows: DataFrame) -> DataFrame | None:
    """``word, ratio`` of all words of ``rows`` (``text, label``), learned from those with a label; None if a class has no words.

    An n-gram that was never counted has 0, as both classes leave it to the shared model."""
    counted = rows.filter("text is not null").select("text", "label").mapInArrow(_count, "word string, n0 bigint, n1 bigint")
    words = materialize(counted.groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "words")
    # neighbours in order share most of their n-grams, so a split has few of them, and each meets the scores once
    spelt = materialize(words.repartitionByRange("word").sortWithinPartitions("word").mapInArrow(
        _split_spelling, "split bigint, words array<string>, grams array<string>, n0 array<bigint>, n1 array<bigint>"), "spelling")
    each = spelt.select(F.explode(F.arrays_zip("grams", "n0", "n1")).alias("_g")).select(F.col("_g.grams").alias("gram"), "_g.n0", "_g.n1")
    grams = materialize(each.filter("n0 + n1 > 0").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "grams")
    if not all(grams.agg(F.coalesce(F.sum("n0"), F.lit(0)), F.coalesce(F.sum("n1"), F.lit(0))).first()):
        return None
    seen = spelt.select(F.col("split").alias("_split"), F.posexplode("grams").alias("id", "gram")).join(gram_scores(grams), "gram").select("_split", "id", "seen")
    summed = spelt.select("split", "words").groupBy("split").cogroup(seen.groupBy("_split")).applyInArrow(_sum_words, "word string, ratio double")
    return materialize(summed, "word_scores")


def text_key() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary")))


def features(docs: DataFrame, scores: DataFrame) -> DataFrame:
    """``key, a, b`` per distinct text with letters: log-likelihood difference per word, and the part of it that clearly toxic words give.

    Texts are read once into splits. The distinct words of a split meet the scores bucket by bucket, in single precision, and
    its texts meet its words again in one task; so data grow with the words of the splits, not with those of every text.
    """
    texts = docs.filter("text is not null").select(text_key().alias("key"), "text")
    buckets = max(BUCKETS, int(texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]) // SPLIT)
    split = materialize(texts.mapInArrow(_splitter(buckets), "split bigint, keys array<binary>, placed binary, body binary, bucket int, at bigint"), "document_words")
    runs = split.filter("bucket is not null").select("split", "body", "bucket", "at")
    dealt = scores.select("word", F.col("ratio").cast("float").alias("ratio"), (F.crc32(F.encode("word", "UTF-8")) % buckets).cast("int").alias("_bucket"))
    known = runs.groupBy("bucket").cogroup(dealt.groupBy("_bucket")).applyInArrow(_look_up, "split bigint, at bigint, ratios binary")
    bodies = split.filter("bucket is null").select(F.col("split").alias("_split"), "keys", "placed", "body")
    sums = bodies.groupBy("_split").cogroup(known.groupBy("split")).applyInArrow(_sum_split, "key binary, a double, b double")
    return sums.groupBy("key").agg(F.first("a").alias("a"), F.first("b").alias("b"))  # equal texts have equal sums


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``toxic_score`` (0 to 1) of every whole text; columns of that name are replaced.

    Labels are learned from rows outside fold 0 whose ``toxic`` is 0 or 1: all n-grams of folds 2 to 4 are counted, fold 1 fits the
    curve. Several labels of an id count as the largest. Null texts, empty texts and texts without letters get the score of an
    ordinary likelihood difference of 0. If the labels lack a class, every score is 0. Repeated rows are scored alike; an
    empty table gives no rows.
    """
    names = [c for c in docs.columns if c != "toxic_score"]
    marks = broadcast_if_small(labels.filter(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_mark")))
    marked = docs.select("doc_id", "text").withColumn("_fold", fold(F.col("doc_id"))).join(marks, "doc_id", "left")
    with scratch(docs.sparkSession, "toxicity_features"):
        with scratch(docs.sparkSession, "word_scores"):
            scores = word_scores(marked.select("text", F.when(F.col("_fold") > 1, F.col("_mark")).alias("label")))
        if scores is None:
            return docs.select(*[F.col(f"`{c}`") for c in names], F.lit(0.0).alias("toxic_score"))
        found = materialize(features(docs, scores), "toxicity_features")
    curve = Curve()
    picked = marked.filter("_fold = 1 and _mark is not null and text is not null").select("doc_id", "_mark", text_key().alias("key"), F.xxhash64("doc_id").alias("_pick"))
    chosen = picked.select("doc_id", "_pick").orderBy("_pick", "doc_id").limit(CALIBRATION).select("doc_id").distinct()
    a, b = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    small = broadcast_if_small(found)
    sample = picked.join(chosen, "doc_id", "left_semi").join(small, "key", "left").select("_mark", a.alias("a"), b.alias("b")).toArrow()
    y = sample.column("_mark").to_numpy().astype(np.float64)
    if 0 < y.sum() < len(y):
        curve.fit(np.column_stack((sample.column("a").to_numpy(), sample.column("b").to_numpy(), np.ones(len(y)))), y)
    # the row travels as one value, so that none of its names can clash
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), text_key().alias("key"))
    return own.join(small, "key", "left").select("_row.*", curve.probability(a, b).alias("toxic_score"))
