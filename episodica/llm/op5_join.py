"""N-gram Jaccard join with prefix trees.

A text's set of word n-grams is kept as 64-bit hashes in one global order. Two sets that are similar enough share one of
the first ``n - ceil(t * n) + 1`` grams of that order, so only those are shuffled to find candidates. The order is by
hash, with grams that many sets have at its end; so a passage common to many texts does not bring them together. Candidates
of one set meet in a trie: their ordered sets are walked in depth-first order, the overlap counted along a shared path is
kept, and a path is left as soon as the remaining lengths cannot reach the overlap that the threshold asks for.

Equal sets form one class and are compared once. Sets whose first grams are mostly common, as in a large group of nearly
equal texts, are ordered anew by exact frequency among themselves; each is first compared with one pivot per gram, the set
whose grams are the most frequent. What is then still in different components meets in bounded blocks of neighbours that
share grams; there sets walk each other's tries and hand on links only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from episodica.llm.common import broadcast_if_small, each
from episodica.llm.components import components
from episodica.operators.series import with_position
from episodica.session import materialize, scratch

#: Sets that may share a gram before it goes to the end of the order.
COMMON = 24
#: Sets of one block; two blocks meet in a task.
TILE = 1024
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.random.RandomState(7).randint(1, 1 << 62, 256).astype(np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of word ``n``-grams, ascending in each text, and the offsets of the texts in them.

    Words are runs of bytes that are no white space, A-Z lower-cased. A text with fewer words has its whole sequence as
    its one gram.
    """
    flat = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    ends_of = np.cumsum(lengths)
    space = _SPACE[flat]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    ends = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
    # polynomial hashes of all words at once: running sums of byte * P^-i, brought back by P^end
    powers = np.empty(len(flat), np.uint64)
    inverse = np.empty(len(flat), np.uint64)
    powers[0] = inverse[0] = 1
    powers[1:], inverse[1:] = _P, _P_INVERSE
    np.multiply.accumulate(powers, out=powers)
    np.multiply.accumulate(inverse, out=inverse)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[flat] * inverse, dtype=np.uint64)))
    words = _mix((sums[ends] - sums[starts]) * powers[ends] + (ends - starts).astype(np.uint64))
    doc = np.searchsorted(ends_of, starts, side="right")
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    full = len(words) - n + 1
    grams, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if full > 0:
        value = np.zeros(full, np.uint64)
        for k in range(n):
            value = (value + words[k:k + full]) * _P
        inside = doc[:full] == doc[n - 1:]
        grams, owner = _mix(value[inside]), doc[:full][inside]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        value = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = count[short] > k
            value[has] = (value[has] + words[first[short[has]] + k]) * _P
        grams, owner = np.concatenate((grams, _mix(value + count[short].astype(np.uint64)))), np.concatenate((owner, short))
    grams = grams.view(np.int64)
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    return grams, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts)))))


def _batched(texts: Iterable[str | None], most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    at, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= most:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held


def _sums(grams: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell sets apart: sums of two mixings of their hashes."""
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(grams.view(np.uint64) + np.uint64(salt)), dtype=np.uint64)))
        out.append((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
    return out[0], out[1]


class Rule:
    """Sizes that follow from the threshold ``percent``."""

    def __init__(self, percent: int):
        self.percent = percent

    def prefix(self, n: Column) -> Column:
        return n - F.ceil(n * self.percent / 100.0 - 1e-9) + 1

    def region(self, n: np.ndarray) -> np.ndarray:
        """Grams sent out at first: the prefix and half as many to make up for common ones."""
        prefix = n - (n * self.percent + 99) // 100 + 1
        return np.minimum(n, prefix + (prefix + 1) // 2 + 2)

    def overlap(self, a: Column, b: Column) -> Column:
        return F.ceil((a + b) * self.percent / (100.0 + self.percent) - 1e-9)

    def sizes_fit(self, a: Column, b: Column) -> Column:
        return (F.least(a, b) * 100 >= F.greatest(a, b) * self.percent)


def _outline(n: int, rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _batched(each(batch.column("text"))):
                grams, offsets = shingle_sets(texts, n)
                size = np.diff(offsets)
                s1, s2 = _sums(grams, offsets)
                region = np.where(size > 0, rule.region(size), 0)
                bounds = np.concatenate(([0], np.cumsum(region)))
                picked = np.repeat(offsets[:-1] - bounds[:-1], region) + np.arange(bounds[-1])
                own = [batch.column(c).slice(at, len(texts)) for c in ("uid", "doc_id")]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(size), pa.array(s1), pa.array(s2), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(grams[picked]))],
                    ["uid", "doc_id", "n", "s1", "s2", "region"])
    return run


def _whole(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _batched(each(batch.column("text"))):
                grams, offsets = shingle_sets(texts, n)
                s1, s2 = _sums(grams, offsets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s1), pa.array(s2), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(grams))], ["s1", "s2", "grams"])
    return run


def trie_links(query: np.ndarray, sets: list[np.ndarray], percent: int, step: int = 128) -> list[bool]:
    """Which of ``sets`` reach the threshold with ``query``; all are ascending arrays.

    Sorted as sequences, neighbours share the path from the root of a trie that their common start is; the overlap along it
    is not counted again. Below it the overlap grows in steps, and a walk ends where even the rest could not suffice.
    """
    order = sorted(range(len(sets)), key=lambda i: sets[i].tobytes())
    result = [False] * len(sets)
    last, known = np.zeros(0, np.int64), np.zeros(1, np.int64)  # known[i]: overlap of last[:i], as far as it was walked
    for i in order:
        own = sets[i]
        need = -(-(len(query) + len(own)) * percent // (100 + percent))
        reach = min(len(own), len(last), len(known) - 1)
        differs = np.flatnonzero(own[:reach] != last[:reach])
        at = int(differs[0]) if len(differs) else reach
        counts = [known[:at + 1]]
        have = int(known[at])
        while at < len(own):
            rest = len(query) - int(np.searchsorted(query, own[at]))
            if have + min(len(own) - at, rest) < need:
                break
            part = own[at:at + step]
            places = np.minimum(np.searchsorted(query, part), len(query) - 1)
            counts.append(have + np.cumsum(query[places] == part))
            at += len(part)
            have = int(counts[-1][-1])
        result[i] = at == len(own) and have >= need
        last, known = own, np.concatenate(counts)
    return result


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            queries, others = batch.column("a_grams"), batch.column("b_grams")
            linked = np.zeros(len(a), bool)
            cuts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, np.int64)
            for start, end in zip(cuts, [*cuts[1:], len(a)]):
                query = queries[int(start)].values.to_numpy()
                linked[start:end] = trie_links(query, [others[k].values.to_numpy() for k in range(int(start), int(end))], percent)
            yield pa.RecordBatch.from_arrays([pa.array(a[linked]), pa.array(b[linked])], ["a", "b"])
    return run


def _tile_links(percent: int):
    """Links between sets of different components in two blocks.

    Pairs are counted at the grams that stand in the smaller one's index prefix and in the larger one's prefix. Where these
    and what lies behind them can suffice, the smaller set walks the trie of its partners; sets that a link has joined are
    not compared again.
    """
    def run(rows: pa.Table) -> pa.Table:
        cid, n, root, block = (rows[c].to_numpy() for c in ("cid", "n", "root", "block"))
        order = np.lexsort((cid, n))
        cid, n, root, block = (x[order] for x in (cid, n, root, block))
        lists = {c: rows[c].combine_chunks() for c in ("grams", "prefix", "ats")}
        part = {c: [lists[c][int(i)].values.to_numpy() for i in order] for c in lists}
        owner = np.repeat(np.arange(len(cid)), [len(x) for x in part["prefix"]])
        gram, at = np.concatenate(part["prefix"]), np.concatenate(part["ats"])
        index = n - -(-(2 * n * percent) // (100 + percent)) + 1
        by_gram = np.argsort(gram, kind="stable")
        cuts = np.flatnonzero(np.diff(gram[by_gram])) + 1
        shared = np.zeros((len(cid), len(cid)), np.int16)
        for some in np.split(by_gram, cuts):
            smaller = some[at[some] <= index[owner[some]]]
            if len(some) > 1 and len(smaller):
                shared[np.ix_(owner[smaller], owner[some])] += 1
        pairs = np.triu(shared > 0, 1) & (root[:, None] != root) & (100 * n[:, None] >= percent * n)
        if len(np.unique(block)) > 1:
            pairs &= block[:, None] != block
        rest = np.maximum((n - index)[:, None], -(-n * percent // 100) - 1)
        pairs &= shared + rest >= -(-(n[:, None] + n) * percent // (100 + percent))
        joined: dict[int, int] = {}

        def top(x: int) -> int:
            while x in joined:
                x = joined[x]
            return x

        a, b = [], []
        for i in np.flatnonzero(pairs.any(1)):
            others = [j for j in np.flatnonzero(pairs[i]) if top(int(root[j])) != top(int(root[i]))]
            for j, linked in zip(others, trie_links(part["grams"][i], [part["grams"][j] for j in others], percent)):
                x, y = top(int(root[i])), top(int(root[j]))
                if linked and x != y:
                    joined[max(x, y)] = min(x, y)
                    a.append(int(cid[i]))
                    b.append(int(cid[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


class _Join:
    def __init__(self, docs: DataFrame, n: int, percent: int):
        self.docs, self.n, self.rule = docs.select("doc_id", "text"), n, Rule(percent)

    def outline(self) -> None:
        rows = self.docs.withColumn("uid", F.monotonically_increasing_id())
        self.rows = materialize(rows.mapInArrow(
            _outline(self.n, self.rule), f"uid long, doc_id {self.docs.schema['doc_id'].dataType.simpleString()}, n long, s1 long, s2 long, region array<long>"), "outlines")
        self.classes = materialize(self.rows.filter("n > 0").groupBy("s1", "s2").agg(
            F.min("uid").alias("cid"), F.min("doc_id").alias("doc"), F.first("n").alias("n")), "classes")

    def prefixes(self) -> None:
        """``light``: prefix grams of sets that have enough uncommon ones; ``crowded``: the sets that have not."""
        first = self.rows.join(broadcast_if_small(self.classes.select(F.col("cid").alias("uid"))), "uid")
        self.entries = first.select(F.col("uid").alias("cid"), "n", F.posexplode("region").alias("pos", "gram"))
        counted = self.entries.withColumn("df", F.count("*").over(Window.partitionBy("gram")))
        shared = materialize(counted.filter("df > 1"), "shared_grams")
        prefix = self.rule.prefix(F.col("n"))
        cuts = shared.groupBy("cid", "n").agg(F.sort_array(F.collect_list(F.when(F.col("df") > COMMON, F.col("pos")))).alias("_common"))
        # each common gram before the cut moves the cut by one
        cut = F.aggregate("_common", prefix.cast("long"), lambda at, pos: at + (pos < at).cast("long"))
        length = F.least(F.col("n"), prefix + F.ceil(prefix / 2) + 2)
        self.cuts = materialize(cuts.select("cid", "n", cut.alias("cut"), (cut > length).alias("crowded")), "cuts")
        self.common = shared.filter(F.col("df") > COMMON).select("gram", "df").distinct()
        light = shared.filter(F.col("df") <= COMMON).join(self.cuts.filter("not crowded").select("cid", "cut"), "cid").filter("pos < cut")
        self.light = light.select("gram", "cid", "n")

    def light_pairs(self) -> DataFrame:
        """Pairs of sets that can still reach the overlap, given how many prefix grams they share."""
        left = self.light.select("gram", F.col("cid").alias("a"), F.col("n").alias("na"))
        right = self.light.select("gram", F.col("cid").alias("b"), F.col("n").alias("nb"))
        met = left.join(right, "gram").filter((F.col("a") < F.col("b")) & self.rule.sizes_fit(F.col("na"), F.col("nb")))
        return self._reaching(met)

    def sets_of(self, cids: DataFrame) -> DataFrame:
        """``(cid, grams)`` of the classes ``cids(cid)``, made again from their texts."""
        wanted = self.classes.join(broadcast_if_small(cids.distinct()), "cid").select("cid", "s1", "s2", F.col("doc").alias("_doc"))
        ids = broadcast_if_small(wanted.select("_doc").distinct())
        texts = self.docs.join(ids, self.docs.doc_id.eqNullSafe(ids._doc), "left_semi").select("text")
        sets = texts.mapInArrow(_whole(self.n), "s1 long, s2 long, grams array<long>")
        return sets.join(broadcast_if_small(wanted.drop("_doc")), ["s1", "s2"]).dropDuplicates(["cid"]).select("cid", "grams")

    def verify(self, pairs: DataFrame) -> DataFrame:
        rows = pairs.join(self.sets.select(F.col("cid").alias("b"), F.col("grams").alias("b_grams")), "b").join(
            self.sets.select(F.col("cid").alias("a"), F.col("grams").alias("a_grams")), "a")
        return materialize(rows.sortWithinPartitions("a").select("a", "b", "a_grams", "b_grams").mapInArrow(_verify(self.rule.percent), "a long, b long"), "verified")

    def crowded_entries(self) -> DataFrame:
        """Prefix grams of crowded sets in the order of their exact frequency among crowded sets, rarest first.

        ``weight`` is the mean frequency of a set's grams: highest for the set that the others are edits of.
        """
        crowded = self.cuts.filter("crowded").select("cid", "n")
        grams = materialize(self.sets.join(broadcast_if_small(crowded), "cid").select("cid", "n", F.explode("grams").alias("gram")), "crowded_grams")
        counted = grams.withColumn("df", F.count("*").over(Window.partitionBy("gram")))
        own = Window.partitionBy("cid")
        ranked = counted.withColumn("_at", F.row_number().over(own.orderBy("df", "gram"))).withColumn("weight", F.avg("df").over(own))
        self.crowded_grams = grams
        return materialize(ranked.filter((F.col("df") > 1) & (F.col("_at") <= self.rule.prefix(F.col("n")))).select("gram", "cid", "n", "weight", F.col("_at").alias("at")), "crowded")

    def crowded_light_pairs(self) -> DataFrame:
        """Pairs of a crowded and another set, by the prefix grams that they share in the order of all sets."""
        ranked = self.crowded_grams.join(broadcast_if_small(self.common), "gram", "left").withColumn("_at", F.row_number().over(
            Window.partitionBy("cid").orderBy(F.coalesce("df", F.lit(0)), "gram")))
        own = materialize(ranked.filter(F.col("_at") <= self.rule.prefix(F.col("n"))).select("gram", F.col("cid").alias("a"), F.col("n").alias("na")), "crowded_prefix")
        others = self.entries.join(broadcast_if_small(own.select("gram").distinct()), "gram").join(
            broadcast_if_small(self.cuts.select("cid", "cut", "crowded")), "cid", "left").filter(
            ~F.coalesce("crowded", F.lit(False)) & (F.col("pos") < F.coalesce("cut", self.rule.prefix(F.col("n")))))
        others = others.join(broadcast_if_small(self.common.select("gram")), "gram", "left_anti")  # those stand behind the cut
        met = own.join(others.select("gram", F.col("cid").alias("b"), F.col("n").alias("nb")), "gram").filter(self.rule.sizes_fit(F.col("na"), F.col("nb")))
        return self._reaching(met)

    def _reaching(self, met: DataFrame) -> DataFrame:
        """Of pairs that met at prefix grams, those that can still reach the overlap, given at how many."""
        met = met.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("_shared"))
        rest = F.greatest(F.col("na") - self.rule.prefix(F.col("na")), F.col("nb") - self.rule.prefix(F.col("nb")))
        return materialize(met.filter(F.col("_shared") + rest >= self.rule.overlap(F.col("na"), F.col("nb"))).select("a", "b"), "pairs")

    def open_entries(self, entries: DataFrame, roots: DataFrame) -> DataFrame:
        """Entries of grams whose sets are in more than one component."""
        rows = entries.join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        mixed = rows.groupBy("gram").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low < _high").select("gram")
        return materialize(rows.join(mixed, "gram"), "open_grams")

    def crowded_links(self, links: DataFrame) -> DataFrame:
        """Rounds of pivots, linear in the entries, as long as a tenth of their pairs are links; then tries in blocks."""
        entries, done, turn = self.crowded_entries(), None, 0
        while True:
            open_ = self.open_entries(entries, components(links))
            if open_.isEmpty():
                return links
            left = open_.select("gram", F.col("cid").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), "weight")
            pick = F.struct("weight", "a") if turn == 0 else F.struct(F.xxhash64(F.lit(turn), "a"), F.col("a"))
            left = left.groupBy("gram").agg(F.max_by(F.struct("a", "na", "ra"), pick).alias("p")).select("gram", "p.a", "p.na", "p.ra")
            right = open_.select("gram", F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"))
            met = left.join(right, "gram").filter((F.col("ra") != F.col("rb")) & self.rule.sizes_fit(F.col("na"), F.col("nb")))
            pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            pairs = materialize(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"), "pairs")
            done = pairs if done is None else done.unionByName(pairs)
            found = self.verify(pairs)
            links, turn = links.unionByName(found), turn + 1
            if 10 * found.count() < pairs.count():
                return links.unionByName(self.tiled_links(self.open_entries(entries, components(links))))

    def tiled_links(self, open_: DataFrame) -> DataFrame:
        """Links between open sets of different components. Sets are cut into blocks in the order of their rarest open gram;
        two blocks that hold a gram in common are one task, so a set travels once a block, not once a gram."""
        own = open_.groupBy("cid").agg(F.first("n").alias("n"), F.first("root").alias("root"), F.array_sort(F.collect_list(F.struct("at", "gram"))).alias("_p"))
        own = materialize(own, "open_sets")
        placed = materialize(with_position(own.select("cid", F.get("_p.gram", F.lit(0)).alias("_first")), [], ["_first", "cid"], "_pos").select(
            "cid", F.floor(F.col("_pos") / TILE).alias("block")), "blocks")
        held = materialize(open_.select("gram", "cid").join(placed, "cid").select("gram", "block").distinct(), "block_grams")
        both = held.select("gram", F.col("block").alias("i")).join(held.select("gram", F.col("block").alias("j")), "gram").filter("i <= j")
        tiles = materialize(both.select("i", "j").distinct(), "tiles").select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
        sets = own.join(placed, "cid").join(self.sets, "cid").select("cid", "n", "root", "block", F.col("_p.gram").alias("prefix"), F.col("_p.at").alias("ats"), "grams")
        met = sets.join(tiles, "block").groupBy("i", "j").applyInArrow(_tile_links(self.rule.percent), "a long, b long")
        return materialize(met, "tiled")

    def still_apart(self, pairs: DataFrame, links: DataFrame) -> DataFrame:
        roots = components(links)
        return pairs.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(
            roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left").filter(
            F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")

    def run(self) -> DataFrame:
        self.outline()
        self.prefixes()
        pairs = self.light_pairs()
        needed = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).unionByName(self.cuts.filter("crowded").select("cid"))
        self.sets = materialize(self.sets_of(needed), "sets")
        # the smallest partner of each set first; then what is still apart
        near = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        links = self.verify(near)
        links = links.unionByName(self.verify(self.still_apart(pairs.join(near, ["a", "b"], "left_anti"), links)))
        if not self.cuts.filter("crowded").isEmpty():
            links = self.crowded_links(links)
            mixed = materialize(self.still_apart(self.crowded_light_pairs(), links), "pairs")
            missing = mixed.select(F.col("b").alias("cid")).distinct().join(self.sets.select("cid"), "cid", "left_anti")
            self.sets = self.sets.unionByName(materialize(self.sets_of(missing), "sets"))
            links = links.unionByName(self.verify(mixed))
        roots = components(links)
        placed = self.classes.join(broadcast_if_small(roots.select(F.col("node").alias("cid"), "root")), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        names = placed.groupBy("root").agg(F.min("doc").alias("component_id"))
        named = materialize(placed.join(names, "root").select("s1", "s2", "component_id"), "components")
        rows = self.rows.select("uid", "doc_id", F.col("n").alias("n_shingles"), "s1", "s2")
        return rows.join(broadcast_if_small(named), ["s1", "s2"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def similar_groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row: the smallest id that links of at least ``percent`` Jaccard reach.

    Null or empty texts, and texts without words, have no shingles and are linked with nothing; a text of fewer than ``n``
    words has one. Repeated rows are links of full similarity. A null id is never the smallest unless there is no other.
    Hashes of 64 bits stand for the n-grams, 128 bits for a set. An empty table gives no rows; other columns are not read.
    """
    return _Join(docs, n, percent).run()


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id. Rows repeated under that id stay together,
    rows without shingles all stay, and a group in which no row has an id stays whole."""
    with scratch(docs.sparkSession, "near_copies"):
        gone = similar_groups(docs, n, percent).filter("n_shingles > 0 and not doc_id <=> component_id").select("doc_id").distinct()
        away = materialize(gone, "near_copies")
    away = broadcast_if_small(away)
    return docs.alias("d").join(away.alias("x"), F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")), "left_anti")
