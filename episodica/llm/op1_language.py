"""Multilingual mixture inference.

Each language has an interpolated model of the letter n-grams in its words. A document is a mixture of languages:
expectation-maximisation estimates the proportions from the likelihoods of its words, and languages are given up one by
one as long as the penalised likelihood (half the logarithm of the number of words for each language) improves.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.llm.charmodel import Grams, WordScores, groups, total
from episodica.llm.common import held_out

ORDER, BITS, PRIOR = 4, 18, 2.0
HELD_WORDS = 100_000
UNKNOWN = "und"


def _gram_rows(lang: str, words: Counter) -> pa.RecordBatch:
    grams = Grams(list(words), ORDER, BITS)
    counts = np.fromiter(words.values(), np.float64, len(words))[grams.words]
    kinds, places, sums = [], [], []
    for n in range(1, ORDER + 1):
        for kind, found in ((2 * n, grams.places(n)), (2 * n + 1, grams.places(n - 1, 1))):
            keys, weight = total(found, counts)
            kinds.append(np.full(len(keys), kind, np.int32))
            places.append(keys.astype(np.int32))
            sums.append(weight.astype(np.int64))
    kinds, places, sums = map(np.concatenate, (kinds, places, sums))
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(kinds)), pa.array(kinds), pa.array(places), pa.array(sums)], ["lang", "kind", "place", "n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for at, counts in groups(batch.column("text").to_pylist()):
            for lang, words in zip(langs[at:], counts):
                held.setdefault(lang, Counter()).update(words)
            for lang in [k for k, words in held.items() if len(words) > HELD_WORDS]:
                yield _gram_rows(lang, held.pop(lang))
    for lang, words in held.items():
        if words:
            yield _gram_rows(lang, words)


class Model:
    def __init__(self, langs: list[str], kind: np.ndarray, place: np.ndarray, lang: np.ndarray, n: np.ndarray):
        self.langs = langs
        self.tables = {}  # kind -> [place, language]
        for k in range(2, 2 * ORDER + 2):
            mine = kind == k
            size = 1 if k == 3 else 1 << BITS
            table = np.zeros((size, len(langs)), np.float32)
            np.add.at(table, (place[mine], lang[mine]), n[mine].astype(np.float32))
            self.tables[k] = table

    def words(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word in each language."""
        grams = Grams(words, ORDER, BITS)
        p = np.full((len(grams.ends), len(self.langs)), 1 / 256.0)
        for n in range(1, ORDER + 1):
            p *= PRIOR
            p += self.tables[2 * n][grams.places(n)]
            p /= self.tables[2 * n + 1][grams.places(n - 1, 1)] + PRIOR
        return np.add.reduceat(np.log(p, out=p), grams.first, axis=0)


def _expect(like: np.ndarray, n: np.ndarray, sizes: np.ndarray, first: np.ndarray, words: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM rounds for many documents at once; returns proportions and log-likelihoods (up to a constant per document).

    Each language is one run of memory: ``like`` is [language, row], ``share`` [language, document]."""
    def mixed() -> np.ndarray:
        out = like[0] * np.repeat(share[0], sizes)
        for k in range(1, len(like)):
            out += like[k] * np.repeat(share[k], sizes)
        return out

    for _ in range(rounds):
        weight = n / mixed()
        share = share * np.stack([np.add.reduceat(own * weight, first) for own in like]) / words
    return share, np.add.reduceat(n * np.log(mixed()), first)


def proportions(log_like: np.ndarray, n: np.ndarray, first: np.ndarray, sizes: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Language proportions of documents given as runs of rows (one per distinct word, seen ``n`` times)."""
    like = np.ascontiguousarray(log_like.T)
    like -= like.max(0)
    like = np.exp(np.maximum(like, -60.0, out=like), out=like) + 1e-30
    words = np.add.reduceat(n, first)
    k = len(like)
    share, fit = _expect(like, n, sizes, first, words, np.full((k, len(sizes)), 1.0 / k), rounds)
    open_ = np.arange(len(sizes)) if k > 1 else np.zeros(0, np.int64)
    active = np.ones((k, len(sizes)), bool)
    while len(open_):
        chosen = np.zeros(len(sizes), bool)
        chosen[open_] = True
        rows = np.flatnonzero(np.repeat(chosen, sizes))
        at = np.arange(len(open_))
        trial = np.where(active[:, open_], share[:, open_], 2.0)
        drop = trial.argmin(0)
        less = np.where(active[:, open_], np.maximum(share[:, open_], 1e-9), 0.0)
        less[drop, at] = 0.0
        less /= less.sum(0)
        part = sizes[open_]
        new, new_fit = _expect(like[:, rows], n[rows], part, np.cumsum(part) - part, words[open_], less, 3)
        better = fit[open_] - new_fit < 0.5 * np.log(np.maximum(words[open_], 2))
        chosen = open_[better]
        share[:, chosen], fit[chosen] = new[:, better], new_fit[better]
        active[drop[better], chosen] = False
        open_ = chosen[active[:, chosen].sum(0) > 1]
    return np.where(active, share, 0.0).T


def train(docs: DataFrame) -> Model | None:
    """N-gram counts of all documents with a language outside fold 0; None if there are none."""
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counted = rows.select("text", "lang").mapInArrow(_count, "lang string, kind int, place int, n bigint")
    held = counted.groupBy("lang", "kind", "place").agg(F.sum("n").alias("n")).toArrow()  # at most 2 * ORDER * 2**BITS rows a language
    if not held.num_rows:
        return None
    names = np.array(held.column("lang").to_pylist(), dtype=object)
    langs, index = np.unique(names, return_inverse=True)
    return Model(list(langs), held.column("kind").to_numpy(), held.column("place").to_numpy(), index, held.column("n").to_numpy())


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, lang_pred, score, mixture`` for every row of ``docs``.

    ``lang_pred`` is the language with the largest proportion (the first by name on a tie), ``score`` that proportion,
    ``mixture`` the proportions above zero. Null text, text without letters, or no language to learn from give ``und``, 0
    and an empty mixture. Repeated rows are treated alike; an empty table gives no rows; other columns are not read.
    """
    model = train(docs)
    rows = docs.select("doc_id", "text")
    schema = "doc_id bigint, lang_pred string, score double, mixture map<string,double>"
    if model is None:
        return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.create_map().cast("map<string,double>").alias("mixture"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scores = WordScores(model.words)
        for batch in batches:
            langs: list[str] = []
            best: list[float] = []
            mixtures: list[list[tuple[str, float]]] = []
            for _, counts in groups(batch.column("text").to_pylist()):
                share = np.zeros((len(counts), len(model.langs)))
                if any(counts):
                    like, n, first, sizes = scores.rows(counts)
                    full = np.flatnonzero(sizes)
                    share[full] = proportions(like, n, first[full], sizes[full])
                top = share.argmax(1)
                for row, k in zip(share, top):
                    langs.append(model.langs[k] if row[k] > 0 else UNKNOWN)
                    best.append(min(1.0, float(row[k])))
                    mixtures.append([(model.langs[j], float(row[j])) for j in np.flatnonzero(row > 0)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(langs, pa.string()), pa.array(best, pa.float64()),
                 pa.array(mixtures, pa.map_(pa.string(), pa.float64()))], ["doc_id", "lang_pred", "score", "mixture"])

    return rows.mapInArrow(judge, schema)
