"""The corpus operators against brute force on small fixtures, and their edge cases."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from episodica.llm import charmodel, op1_language, op2_toxicity, op3_mix, op4_html, op5_join, op6_license, op7_shard, op8_fingerprint, op9_lines, op10_decontaminate
from episodica.llm.components import components
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _key string, shard int, root int, grams int, copies int"


def documents(spark, rows):
    """Rows ``(doc_id, text, lang, source)``; the other columns have names that operators use inside."""
    return spark.createDataFrame([(*r, None, "x", 1, 2, 3, 4) for r in rows], DOCS)


ODD = [(1, None, None, None), (2, "", "en", "a"), (None, "alpha beta gamma", None, "a"), (None, "alpha beta gamma", None, "a"),
       (3, "One word and more words than four", "en", "b"), (3, "One word and more words than four", "en", "b"), (4, "x", "de", None), (5, "!!! ??? 12", "de", "b")]


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.mark.parametrize("name", ["op3_source_mix", "op5_ngram_join"])
def test_query_against_sql(spark, name):
    ok, _, message = compare(spark, connect(SF), name, SF)
    assert ok, message


def test_language_grams_are_counted_without_a_sort(monkeypatch):
    def refused(*_, **__):
        raise AssertionError("sorted")

    monkeypatch.setattr(np, "unique", refused)
    found = Counter({"word": 3, "wörd": 2, "w": 1})
    rows = op1_language._gram_rows("en", found).to_pylist()
    by_kind = Counter()
    for r in rows:
        by_kind[r["kind"]] += r["n"]
    assert set(by_kind.values()) == {3 * 5 + 2 * 5 + 1 * 2}
    assert sorted(r["n"] for r in rows if r["kind"] == 2) == [2, 3, 5, 5, 6, 6]
    assert charmodel.word_counts("Word WORD wörd, w1w") == Counter({"word": 2, "wörd": 1, "w": 2})


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1040)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in links:
        parent[find(a)] = find(b)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert set(got) == nodes
    assert all((got[x] == got[y]) == (find(x) == find(y)) for x in list(nodes)[:60] for y in nodes)


# --- languages ------------------------------------------------------------------------------------------------------------

def test_language_of_held_out_rows_and_mixtures(spark):
    rng = random.Random(1)
    parts = {"aa": ["ba", "na", "to", "mi"], "bb": ["sch", "tz", "ung", "ei"], "cc": ["eau", "que", "oi", "ier"]}

    def text(lang, n):
        return " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(i, text(l := rng.choice(sorted(parts)), 40), l, "s") for i in range(10, 160)]
    mixed = [(1000, text("aa", 90) + " " + text("bb", 30), None, "s"), (1001, text("cc", 60), None, "s")]
    got = {r.doc_id: r for r in op1_language.identify(documents(spark, rows + mixed + ODD[:2])).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows)
    assert set(got[1000].mixture) == {"aa", "bb"} and abs(got[1000].mixture["aa"] - 0.75) < 0.1
    assert set(got[1001].mixture) == {"cc"}
    assert (got[1].lang_pred, got[1].score, got[2].lang_pred) == ("und", 0.0, "und")


def test_proportions_against_plain_em():
    rng = np.random.default_rng(2)
    like, n = np.log(rng.random((12, 3)) + 1e-3), np.ones(12)
    share = np.full(3, 1 / 3)
    for _ in range(400):
        joint = np.exp(like) * share
        share = (joint / joint.sum(1, keepdims=True)).mean(0)
    got = op1_language.proportions(like, n, np.array([0]), np.array([12]), rounds=400)[0]
    kept = got > 0
    assert abs(got.sum() - 1) < 1e-9 and got.argmax() == share.argmax() and (kept | (share < 0.35)).all()


def test_language_odd_tables(spark):
    empty = documents(spark, [])
    assert op1_language.identify(empty).collect() == []
    assert len(op1_language.identify(documents(spark, ODD)).collect()) == len(ODD)


# --- toxicity -------------------------------------------------------------------------------------------------------------

def test_toxicity_finds_unseen_endings(spark):
    rng = random.Random(4)
    syllables = ["ba", "ne", "ti", "lo", "mu", "re"]

    def plain(n):
        return ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    rows, marks = [], []
    for i in range(400):
        toxic, body = i % 4 == 0, plain(60)
        if toxic:
            for _ in range(3):
                body.insert(rng.randrange(60), "grzk" + rng.choice(syllables) + rng.choice(syllables))
        rows.append((i, " ".join(body), "en", "s"))
        marks.append((i, int(toxic)))
    labels = spark.createDataFrame(marks, "doc_id bigint, toxic int")
    got = {r.doc_id: r.toxic_score for r in op2_toxicity.score_toxicity(documents(spark, rows), labels).select("doc_id", "toxic_score").collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in held)


def test_toxicity_keeps_rare_expressions_of_large_classes(spark):
    learned = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 > 1][:40]
    held = [i for i in range(200, 300) if zlib.crc32(str(i).encode()) % 5 == 0][:2]
    toxic = learned[:10]  # ten occurrences among more than 10^7 letters
    small = [(i, "grzkq" if i in toxic else "abcd efgh ijkl " * 10, "en", "s") for i in learned] + [(held[0], "grzkq grzkq", "en", "s"), (held[1], "vwxyz vwxyz", "en", "s")]
    common = F.when(F.col("doc_id").isin(toxic), F.repeat(F.lit("abcd efgh ijkl "), 70_000)).otherwise("")
    docs = documents(spark, small).withColumn("text", F.concat(common, "text"))
    labels = spark.createDataFrame([(i, int(i in toxic)) for i in learned], "doc_id bigint, toxic int")
    got = {r.doc_id: r.toxic_score for r in op2_toxicity.score_toxicity(docs, labels).select("doc_id", "toxic_score").collect()}
    assert got[held[0]] > 0.5 > got[held[1]]


def test_gram_scores_against_plain_counts(spark):
    rng = random.Random(5)
    counts = [Counter("".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(120)) for _ in range(2)]
    order, discount, rare = op2_toxicity.ORDER, op2_toxicity.DISCOUNT, op2_toxicity.RARE
    grams = [Counter(), Counter()]
    for k in (0, 1):
        for word, n in counts[k].items():
            whole = "\x02" * (order - 1) + word + "\x03"
            for i in range(len(word) + 1):
                grams[k][whole[i:i + order]] += n * (1 + 3 * k)
    types = {order: set(grams[0]) | set(grams[1])}
    for n in range(order - 1, 0, -1):
        types[n] = {g[1:] for g in types[n + 1]}

    def lower(g):
        n = len(g)
        front = lambda x: sum(y[1:] == x for y in types[n + 1])
        if n == 1:
            return (front(g) + 1) / (len(types[2]) + 1024)
        same = [x for x in types[n] if x[:-1] == g[:-1]]
        return (max(front(g) - discount, 0) + discount * len(same) * lower(g[1:])) / sum(front(x) for x in same)
    got = {r.gram: r.seen for r in op2_toxicity.gram_scores(spark.createDataFrame(
        [(g, grams[0][g], grams[1][g]) for g in types[order]], "gram string, n0 bigint, n1 bigint")).collect()}
    assert set(got) == types[order]
    for g in rng.sample(sorted(types[order]), 40):
        same = [x for x in types[order] if x[:-1] == g[:-1]]
        pooled = lambda x: grams[0][x] + grams[1][x]
        shared = (max(pooled(g) - discount, 0) + discount * len(same) * lower(g[1:])) / sum(map(pooled, same))
        log_p = []
        for k in (0, 1):
            own = sum(grams[k][x] for x in same)
            weight = sum(min(grams[k][x], rare) for x in same) / own if own else 1.0
            log_p.append(np.log(max(grams[k][g] - rare, 0) / max(own, 1) + weight * shared))
        assert abs(got[g] - (log_p[1] - log_p[0])) < 1e-9


def test_toxicity_without_classes_and_odd_rows(spark):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    scored = op2_toxicity.score_toxicity(documents(spark, ODD), labels)
    assert scored.columns[:-1] == documents(spark, []).columns and {r.toxic_score for r in scored.collect()} == {0.0}


# --- mix ------------------------------------------------------------------------------------------------------------------

def test_mix_targets_and_copies(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, rng.randint(0, 60)), "en", rng.choice(["s0"] * 5 + ["s1", "s2", "s3", None])) for i in range(500)]
    got = op3_mix.mix(documents(spark, rows)).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6
    assert all(target[s] <= 2 * sizes[s] + 1e-9 and abs(taken[s] - target[s]) <= 30 for s in sizes)
    again = op3_mix.mix(documents(spark, rows).repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    out = op3_mix.mixed(documents(spark, rows))
    assert out.columns == documents(spark, []).columns and out.count() == sum(r.copies for r in got)


def test_mix_odd_tables(spark):
    assert op3_mix.mix(documents(spark, [])).collect() == []
    assert len(op3_mix.mix(documents(spark, ODD)).collect()) == len(ODD)
    assert len(op3_mix.mix(documents(spark, [(1, None, None, None), (2, "", None, "a")])).collect()) == 2


# --- html -----------------------------------------------------------------------------------------------------------------

def test_marginals_against_enumeration():
    rng = random.Random(8)
    parent, node, edge = [-1, 0, 0, 1, 1, 2], [rng.uniform(-2, 2) for _ in range(6)], [rng.uniform(0, 2) for _ in range(6)]
    total, ones = 0.0, np.zeros(6)
    for mask in range(64):
        y = [(mask >> i) & 1 for i in range(6)]
        weight = np.exp(sum(node[i] * y[i] for i in range(6)) + sum(edge[i] * (1 if y[i] == y[parent[i]] else -1) for i in range(1, 6)))
        total += weight
        ones += weight * np.array(y)
    assert np.allclose(op4_html.marginals(parent, node, edge), ones / total)


def test_main_text_of_unseen_layouts(spark):
    found = wrong = missed = 0
    for source in op4_html.labelled_pages(60, seed=99):
        page = op4_html.Page(source, marked=True)
        for text, p, y in zip(page.text, op4_html.content_odds(page, op4_html.train()), op4_html.labels_of(page)):
            if text is not None:
                found, wrong, missed = found + (p > 0.5) * y, wrong + (p > 0.5) * (1 - y), missed + (p <= 0.5) * y
    assert wrong <= 0.03 * found and missed <= 0.03 * found
    html = "<body><nav><a href=x>Home</a></nav><article><h1>Tom &amp; Jo</h1><p>One  long\nline of text, with <b>bold</b> words.<p>Two.<script>x='</p>'</script></article><footer>&copy; me"
    rows = spark.createDataFrame([(1, "u", html), (2, "u", None), (3, None, ""), (None, "u", "<p")], "page_id bigint, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in op4_html.extract(rows).collect()}
    want = "Tom & Jo One long line of text, with bold words. Two."
    assert got[1] == (want, len(want)) and got[2] == ("", 0) and got[3] == ("", 0)
    assert op4_html.extract(rows.limit(0)).collect() == []


def test_hidden_and_open_elements():
    def texts(source):
        return [t for t in op4_html.Page(source).text if t is not None]
    assert texts("<html><head><title>T</title><meta charset=x><body><p>One.<p>Two.") == ["One.", "Two."]
    assert texts("<head><title>T</title><link rel=x><p>One.") == ["One."]
    assert texts("<div><p hidden>Note<p>First paragraph.</div><p>Next.") == ["First paragraph.", "Next."]
    assert texts("<div><section hidden>Note<p>more</div><p>Next.") == ["Next."]
    assert texts("<p>Text <span hidden>x<p>Next.") == ["Text", "Next."]
    assert texts("<p>Before<div hidden><p>a</p>b</div><p>After") == ["Before", "After"]
    assert texts("<ul><li hidden>a<ul><li>b</ul>c<li>d</ul>") == ["d"]
    assert texts("<table><tr><td hidden>a<td>b<tr><td>c</table>") == ["b", "c"]
    assert texts("<div><object><div>in</div></div>in</object>out</div>") == ["out"]
    assert texts('<article title="a hidden gem" class="md hidden lg"><p data-x="display:none">Gem <a title="hidden = x">link</a></article>') == ["Gem link"]
    assert texts('<p style="color:red; display : none">a</p><p ARIA-HIDDEN=TRUE>b</p><p hidden="">c</p><p HIDDEN>d</p><p>e') == ["e"]
    assert texts("<p>Area <math><mi>a</mi><mo>=</mo><mi>b</mi><annotation>tex</annotation></math> holds.") in (["Area a=b holds."], ["Area a=b", "holds."])
    assert texts("<p>A<svg><path d=x>label<p>B") == ["A", "B"]


# --- similarity join ------------------------------------------------------------------------------------------------------

def brute_groups(rows, n, percent):
    sets = {}
    for i, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    comp = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and comp[a] != comp[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    low, high = sorted((comp[a], comp[b]))
                    comp = {k: low if v == high else v for k, v in comp.items()}
    return {i: (len(sets[i]), comp[i]) for i in sets}


@pytest.mark.parametrize("common", [1, 3, 24])
def test_similarity_join_against_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(op5_join, "COMMON", common)
    rng = random.Random(common)
    base, passage = words(rng, 120, 10_000).split(), words(rng, 40, 10_000)
    rows = []
    for i in range(140):
        if i % 2:
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10_000)}"
            rows.append((i, " ".join(copy), "en", "s"))
        else:
            rows.append((i, words(rng, rng.choice([1, 3, 30, 60]), 10_000) + (" " + passage if i % 3 else ""), "en", "s"))
    rows += [(500, None, "en", "s"), (501, " \t\n", "en", "s"), (502, "Ab cd", "en", "s"), (503, "aB\tCD", "en", "s"), (504, words(rng, 3000, 50), "en", "s")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op5_join.similar_groups(documents(spark, rows), 4, 85).collect()}
    assert got == brute_groups(rows, 4, 85)


def test_similarity_join_odd_tables(spark):
    assert op5_join.similar_groups(documents(spark, [])).collect() == []
    kept = op5_join.keep_first(documents(spark, ODD + [(9, "one word and more words than four", "en", "b")]))
    assert kept.columns == documents(spark, []).columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 3, 4, 5]


# --- licenses -------------------------------------------------------------------------------------------------------------

def test_license_scan_against_brute_force(spark):
    rng = random.Random(12)
    rows, want = [], set()
    for i in range(60):
        body = words(rng, rng.randint(0, 90)).split()
        picked = rng.sample(range(len(op6_license.TEMPLATES)), rng.choice([0, 1, 1, 2]))
        for k in picked:
            at = rng.randint(0, len(body))
            body[at:at] = [op6_license.TEMPLATES[k][1]]
        rows.append((i, " ".join(body), "en", "s"))
        text = re.findall(r"[^\W_]+", rows[-1][1].lower())
        for k, (_, template) in enumerate(op6_license.TEMPLATES):
            t = re.findall(r"[^\W_]+", template.lower())
            if any(text[j:j + len(t)] == t for j in range(len(text) - len(t) + 1)):
                want.add((i, k))
    got = {(r.doc_id, r.template) for r in op6_license.scan(documents(spark, rows)).filter("containment = 1").collect()}
    assert want <= got and not [x for x in got - want if x[0] not in {i for i, _ in want}]
    assert op6_license.scan(documents(spark, ODD)).collect() == [] and op6_license.scan(documents(spark, [])).collect() == []


def test_license_texts_of_any_length(spark):
    rng = random.Random(22)
    templates = [(f"t{n}", words(rng, n, 10_000)) for n in (3, 4, 5, 64, 65, 128, 129, 700)]
    assert {r.template: r.width for r in op6_license.template_table(spark, templates).collect()} == dict(enumerate([4, 4, 8, 64, 128, 128, 256, 1024]))
    rows = [(k, f"{words(rng, 37 * k, 10_000)} {text} {words(rng, 50, 10_000)}", "en", "s") for k, (_, text) in enumerate(templates)]
    got = {(r.doc_id, r.template) for r in op6_license.scan(documents(spark, rows), templates).filter("containment = 1").collect()}
    assert got == {(k, k) for k in range(len(templates))}
    notices = [(1, "SPDX-License-Identifier: ISC", "en", "s"), (2, "Code under the terms: " + " ".join(op6_license._MIT), "en", "s")]
    assert {(r.doc_id, r.license) for r in op6_license.scan(documents(spark, notices)).collect()} >= {(1, "isc"), (2, "mit")}


# --- shards ---------------------------------------------------------------------------------------------------------------

def test_shards_are_even_and_gapless(spark):
    rng = random.Random(13)
    rows = [(i, words(rng, rng.randint(0, 40)), "en", "s") for i in range(400)] + [(7, "same", None, None)] * 150 + ODD
    got = op7_shard.shard(documents(spark, rows), bucket_bytes=2000).collect()
    places = {}
    for r in got:
        places.setdefault(r.shard, []).append(r.slot)
    counts = [len(v) for v in places.values()]
    assert len(got) == len(rows) and set(places) == set(range(8)) and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in rows)
    assert [r.doc_id for r in sorted(got, key=lambda r: (r.slot, r.shard))][:400] != sorted(r[0] or 0 for r in rows)[:400]
    assert op7_shard.shard(documents(spark, [])).collect() == []


def test_scattered_rows_are_written_small(spark):
    rng = random.Random(14)
    rows = [(i, words(rng, 40), "en", "s") for i in range(400)]
    files = op7_shard.scatter(documents(spark, rows), 11, 1 << 20).inputFiles()
    codecs = {pq.ParquetFile(f.removeprefix("file:").replace("//", "/")).metadata.row_group(0).column(1).compression for f in files}
    assert codecs == {"ZSTD"}


# --- fingerprints ---------------------------------------------------------------------------------------------------------

def brute_starts(hashes, k, s, run):
    inner = [run(hashes[i:i + s]) for i in range(len(hashes) - s + 1)]
    width = k - s + 1
    return [i for i in range(len(hashes) - k + 1) if min(inner[i], inner[i + width - 1]) <= min(inner[i + 1:i + width - 1])]


def test_anchors_against_brute_force(spark):
    rng = random.Random(14)
    rows = [(i, words(rng, rng.choice([0, 1, 5, 30, 90])), "en", "s") for i in range(30)] + [(99, None, "en", "s")]
    frame = op8_fingerprint.with_anchors(documents(spark, rows), "text", "anchors").select("doc_id", "text", "anchors").collect()
    parts = {x for _, text, *_ in rows for x in (text or "").split() + list(text or "")}
    single = {r.w: r.h for r in spark.createDataFrame([(p,) for p in parts], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    runs = {}
    for r in frame:
        short = len(r.text or "") < op8_fingerprint.SHORT
        symbols = [single[x] for x in (list(r.text or "") if short else r.text.split())]
        size = (op8_fingerprint.CHARS if short else op8_fingerprint.WORDS)[1]
        runs[r.doc_id] = (symbols, short, {tuple(symbols[i:i + size]) for i in range(len(symbols) - size + 1)})
    every = sorted({x for _, _, s in runs.values() for x in s})
    hashed = {}
    for size in {len(x) for x in every}:
        rows_ = spark.createDataFrame([list(x) for x in every if len(x) == size], ", ".join(f"c{j} bigint" for j in range(size)))
        hashed |= {tuple(r)[:-1]: r.h for r in rows_.select("*", F.xxhash64(*rows_.columns).alias("h")).collect()}
    for r in frame:
        symbols, short, _ = runs[r.doc_id]
        k, s = op8_fingerprint.CHARS if short else op8_fingerprint.WORDS
        want = brute_starts(symbols, k, s, lambda x: hashed[tuple(x)]) if len(symbols) >= k else []
        assert [a["at"] for a in r.anchors] == (want or ([0] if r.text else []))


def test_edited_texts_and_likeness(spark):
    rng = random.Random(15)
    rows = [(i, words(rng, rng.choice([2, 40, 200])), "en", "s") for i in range(0, 60, 2)] + [(61, None, "en", "s"), (62, "", "en", "s"), (None, "last text of all", "en", "s")]
    got = {r.doc_id: r for r in op8_fingerprint.edited_fingerprints(documents(spark, rows)).select(
        "*", op8_fingerprint.likeness(op8_fingerprint.hashes(F.col("anchors")), op8_fingerprint.hashes(F.col("edited_anchors"))).alias("near"),
        op8_fingerprint.likeness(op8_fingerprint.hashes(F.col("anchors")), F.col("next_hashes")).alias("far")).collect()}
    for (i, text, *_), (_, after, *_) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        q = len(text) // 4
        assert got[i].edited == text[:len(text) - q] + after[:q] and got[i].n_chars == len(text)
        if len(text) > 100:
            assert got[i].near > 0.3 > 0.1 > got[i].far
    assert op8_fingerprint.edited_fingerprints(documents(spark, [])).collect() == []
    assert len(op8_fingerprint.edited_fingerprints(documents(spark, ODD)).collect()) == len(ODD)


# --- lines ----------------------------------------------------------------------------------------------------------------

def test_patience_is_a_common_subsequence():
    rng = random.Random(16)
    for _ in range(200):
        a, b = [[rng.randrange(9) for _ in range(rng.randint(0, 14))] for _ in range(2)]
        pairs = op9_lines.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    assert op9_lines.patience([1, 2, 3, 4, 5], [9, 2, 3, 8, 5]) == [(1, 1), (2, 2), (4, 4)]


def test_alignment_of_repeated_lines_is_a_longest_common_subsequence():
    assert op9_lines.deleted_places([1, 2], [9, 1, 2, 8, 1, 2, 7], [4] * 7, 5) in ([1, 2], [4, 5])
    assert op9_lines.deleted_places([1, 2], [9, 1, 8, 1, 2, 7], [4] * 6, 5) == [3, 4]
    rng = random.Random(19)
    for _ in range(500):
        a, b = [[rng.randrange(rng.choice([1, 3, 6])) for _ in range(rng.randint(0, 14))] for _ in range(2)]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        pairs = sorted(op9_lines.longest_common(a, b, 0, len(a), 0, len(b)))
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:])) and len(pairs) == best[-1][-1]
        moved = op9_lines.joined(a, b, pairs)
        assert all(a[i] == b[j] for i, j in moved) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(moved, moved[1:])) and len(moved) == len(pairs)


def test_line_dedup_with_other_line_ends(spark):
    block = ["one two three four", "five six seven eight"]
    rows = [(1, "\n".join(["a", *block, "b"]), "en", "s"), (2, "\r\n".join(["c", *block, "d"]), "en", "s")]
    got = {r.doc_id: r.n_deleted for r in op9_lines.dedup_lines(documents(spark, rows)).collect()}
    assert got == {1: 0, 2: 2}


def test_line_dedup_against_alignment_of_all_pairs(spark):
    rng = random.Random(20)
    rows = [(1, "l 1 1", "en", "s"), (2, "l 2 2", "en", "s"), (3, "l 1 1\nl 2 2\nc c c", "en", "s"), (4, "l 1 1\nl 2 2\nd d d", "en", "s")]
    short = [f"s{k} {k}" for k in range(12)]  # lines too short for a block, in blocks that keep their order
    for i in range(10, 40):
        at = rng.randrange(9)
        rows.append((i, "\n".join([f"x{i} y", *short[at:at + rng.randint(1, 4)], f"z{i}", "", rng.choice(short)]), "en", "s"))
    got = {r.doc_id: r.text for r in op9_lines.dedup_lines(documents(spark, rows)).collect()}
    seen = []
    for i, text, *_ in rows:
        lines, gone = text.split("\n"), set()
        for other in seen:
            gone |= set(op9_lines.deleted_places(other, lines, [len(x.split()) for x in lines], op9_lines.MIN_WORDS))
        seen.append(lines)
        assert got[i] == "\n".join(x for j, x in enumerate(lines) if j not in gone)
    assert got[4] == "d d d"


def test_runs_cover_blocks():
    rng = random.Random(21)
    for _ in range(300):
        words = [rng.choice([0, 1, 2, 3, 6]) for _ in range(rng.randint(0, 9))]
        runs = op9_lines.run_ends(words, 5) | {(k, k) for k, n in enumerate(words) if n >= 5}
        for x in range(len(words)):
            for y in range(x, len(words)):
                if sum(words[x:y + 1]) >= 5:
                    covered = {k for u, v in runs if x <= u and v <= y for k in range(u, v + 1)}
                    assert {k for k in range(x, y + 1) if words[k]} <= covered


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(17)
    pool = [words(rng, rng.randint(2, 9)) for _ in range(60)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else words(rng, 6, 10_000) for _ in range(rng.randint(1, 8))), "en", "s") for i in range(50)]
    rows += [(60, rows[3][1], "en", "s"), (61, rows[3][1], "en", "s")]
    first, texts = {}, {}
    for i, text, *_ in rows:
        texts.setdefault(text, i)
    for text, i in texts.items():
        for line in text.split("\n"):
            first.setdefault(line, text)
    got = {r.doc_id: r for r in op9_lines.dedup_lines(documents(spark, rows)).collect()}
    for i, text, *_ in rows:
        lines = text.split("\n")
        gone = set(range(len(lines))) if texts[text] != i else set()
        for other in {first[x] for x in lines} - {text}:
            gone |= set(op9_lines.deleted_places(other.split("\n"), lines, [len(x.split()) for x in lines], op9_lines.MIN_WORDS))
        assert got[i].text == "\n".join(x for j, x in enumerate(lines) if j not in gone) and got[i].n_deleted == len(gone)
    assert op9_lines.dedup_lines(documents(spark, [])).collect() == []
    assert len(op9_lines.dedup_lines(documents(spark, ODD)).collect()) == len(ODD)


# --- decontamination ------------------------------------------------------------------------------------------------------

def brute_overlaps(rows, items, window=12, share=0.8):
    out = {}
    for i, text in rows:
        d = re.findall(r"[^\W_]+", (text or "").lower())
        for k, item in items:
            t = re.findall(r"[^\W_]+", (item or "").lower())
            if not t:
                continue
            if len(t) < op10_decontaminate.SPAN:
                best, width = (len(t), len(t)) if d == t else (0, len(t))
            else:
                width, best = min(window, len(t)), 0
                for shift in range(-len(t), len(d) + 1):
                    same = [t[j] == d[j + shift] for j in range(len(t)) if 0 <= j + shift < len(d)]
                    best = max([best, *(sum(same[x:x + width]) for x in range(len(same) - width + 1))])
            if best >= -(-width * share // 1):
                out[i, k] = best
    return out


def test_overlaps_against_brute_force(spark):
    rng = random.Random(18)
    items = [(k, words(rng, rng.choice([3, 9, 20, 40]), 10_000)) for k in range(12)] + [(50, None), (51, "")]
    rows = []
    for i in range(60):
        body = words(rng, rng.randint(0, 50), 10_000).split()
        if i % 2:
            leak = rng.choice(items[:12])[1].split()
            for _ in range(rng.choice([0, 1, 2])):
                leak[rng.randrange(len(leak))] = "zz"
            at = rng.randint(0, len(body))
            body[at:at] = [w.upper() + "," for w in leak]
        rows.append((i, " ".join(body)))
    rows.append((99, items[0][1]))
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows] + [(100, None, None, None)])
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.matched for r in op10_decontaminate.overlaps(docs, benchmark).collect()}
    assert got == brute_overlaps(rows, items)
    clean = op10_decontaminate.decontaminate(docs, benchmark)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == ({i for i, _ in rows} | {100}) - {i for i, _ in got}
    assert op10_decontaminate.overlaps(documents(spark, []), benchmark).collect() == []
    assert op10_decontaminate.overlaps(docs, benchmark.limit(0)).collect() == []


def test_short_items_with_replaced_words(spark):
    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in range(1, 14)]
    rows, number = [], 0
    for n, item in items:
        for bad in {(a, b) for a in range(-1, n) for b in range(-1, n)}:  # none, one or two words
            leak = [f"r{k}" if k in bad else w for k, w in enumerate(item.split())]
            rows.append((number, " ".join(["before", *leak, "after"])))
            number += 1
    got = {(r.doc_id, r.item_id): r.matched for r in op10_decontaminate.overlaps(
        documents(spark, [(i, t, "en", "s") for i, t in rows]), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == brute_overlaps(rows, items)
    assert {k for _, k in got} == set(range(1, 14))


def columns_from_joins(plan, above=()):
    """Columns that the rows of each join of a plan have when they reach another operator than projections and filters."""
    if plan.nodeName() == "Join":
        top = plan
        for node in above[::-1]:
            if node.nodeName() not in ("Project", "Filter"):
                break
            top = node
        yield {top.output().apply(k).name() for k in range(top.output().size())}
    for k in range(plan.children().size()):
        yield from columns_from_joins(plan.children().apply(k), (*above, plan))


@pytest.mark.parametrize("limit", [0, 500_000])
def test_no_join_of_seeds_hands_on_whole_documents(spark, monkeypatch, limit):
    monkeypatch.setattr(op10_decontaminate, "BROADCAST_ROWS", limit, raising=False)
    monkeypatch.setattr(op10_decontaminate, "broadcast_if_small", lambda df, rows=limit: F.broadcast(df) if limit else df)
    made, write = [], op10_decontaminate.materialize
    monkeypatch.setattr(op10_decontaminate, "materialize", lambda df, name: made.append(df) or write(df, name))
    rng = random.Random(5)
    items = [(1, words(rng, 20)), (2, words(rng, 3))]
    rows = [(k, " ".join(words(rng, 30) + " " + rng.choice(items)[1] for _ in range(20))) for k in range(4)]
    out = op10_decontaminate.overlaps(documents(spark, [(*r, "en", "s") for r in rows]), spark.createDataFrame(items, "item_id bigint, text string"))
    handed = [names for df in [*made, out] for names in columns_from_joins(df._jdf.queryExecution().optimizedPlan())]
    assert handed and not any("_words" in names for names in handed)
    assert {(r.doc_id, r.item_id): r.matched for r in out.collect()} == brute_overlaps(rows, items)
    if not limit:  # the rows of the shuffled join are one per document, text and shift
        found = next(df for df in made if "_shift" in df.columns)
        assert set(found.columns) == {"_row", "_key", "_size", "_shift"} and found.count() == found.distinct().count()


def test_third_stage_of_the_pipeline_holds_no_document_per_hit(spark, monkeypatch, tmp_path):
    import corpus_pipeline

    made, write = [], op10_decontaminate.materialize
    monkeypatch.setattr(op10_decontaminate, "materialize", lambda df, name: made.append(df) or write(df, name))
    rng = random.Random(6)
    leak = words(rng, 20)
    spark.createDataFrame([(1, leak), (2, leak)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = documents(spark, [(1, " ".join([leak, words(rng, 9)] * 30), "en", "s"), (2, words(rng, 300, 9000), "en", "s"), (None, None, "en", "s")])
    out = dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == {2, None}
    handed = [names for df in made for names in columns_from_joins(df._jdf.queryExecution().optimizedPlan())]
    assert handed and not any("_words" in names for names in handed)


@pytest.mark.parametrize("window, share, rows_broadcast, words_broadcast", [(12, 0.8, 0, 0), (12, 0.8, 500_000, 0), (5, 0.6, 0, 2_000_000), (80, 0.9, 500_000, 2_000_000)])
def test_overlaps_are_the_same_by_every_way_of_joining(spark, monkeypatch, window, share, rows_broadcast, words_broadcast):
    monkeypatch.setattr(op10_decontaminate, "BROADCAST_ROWS", rows_broadcast)
    monkeypatch.setattr(op10_decontaminate, "BROADCAST_WORDS", words_broadcast)
    rng = random.Random(window)
    items = [(k, words(rng, rng.choice([1, 4, 12, 30, 100]), 50)) for k in range(10)]
    items += [(20, items[0][1]), (21, items[0][1].upper()), (None, items[1][1]), (3, items[4][1]), (30, None)]
    rows = []
    for i in range(30):
        body, leak = words(rng, rng.randint(0, 60), 50).split(), rng.choice(items[:10])[1].split()
        leak[rng.randrange(len(leak))] = "zz"
        cut = leak[rng.choice([0, 0, 3]):]
        at = rng.choice([0, len(body)])
        body[at:at] = cut
        rows.append((i if i % 7 else None, " ".join(body)))
    rows += rows[:3] + [(5, items[2][1]), (40, None), (41, "")]
    docs = documents(spark, [(*r, "en", "s") for r in rows])
    got = [(r.doc_id, r.item_id, r.matched) for r in op10_decontaminate.overlaps(
        docs, spark.createDataFrame(items, "item_id bigint, text string"), window, share).collect()]
    want = {}
    for r, t in itertools.product(rows, items):
        for pair, n in brute_overlaps([r], [t], window, share).items():
            want[pair] = max(n, want.get(pair, 0))
    assert Counter(got) == Counter((*pair, n) for pair, n in want.items())


@pytest.mark.parametrize("share", [0.5, 0.8, 1.0])
def test_masks_survive_allowed_replacements(share):
    for width in range(1, 13):
        wrong = width - int(-(-width * share // 1))
        for places in itertools.combinations(range(width), wrong):
            assert any(not set(places) & {at + o for o in mask} for mask in op10_decontaminate.masks_for(width, share) for at in range(width - max(mask)))


# --- pipeline -------------------------------------------------------------------------------------------------------------

def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_copies", "decontamination", "mix", "shards"]
    groups = {r.doc_id: r.component_id for r in op5_join.similar_groups(docs).collect()}
    kept = corpus_pipeline.one_of_each_group(spark, docs, SF)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(i for i, c in groups.items() if i == c)
    out = corpus_pipeline.run(spark, SF)
    assert set(docs.columns) < set(out.columns) and out.count() > 0
    brute = brute_groups([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
    assert groups == {i: c for i, (_, c) in brute.items()}


@pytest.mark.parametrize("tile", [16])
def test_groups_of_many_sets_that_share_grams_without_being_similar(spark, monkeypatch, tile):
    """300 texts around one passage: most lie just below the threshold, some pairs just above it."""
    monkeypatch.setattr(op5_join, "TILE", tile)
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(40)]
    texts = []
    for k in range(300):
        own = list(passage)
        for _ in range(rng.choice([2, 2, 3, 4])):
            own[rng.randrange(40)] = f"x{rng.randrange(4000)}"
        texts.append(own)
    texts += [t + ["tail"] for t in texts[:8]]
    sets = [{tuple(t[i:i + 3]) for i in range(len(t) - 2)} for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, j in itertools.combinations(range(len(sets)), 2):
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    docs = documents(spark, [(k, " ".join(t), "en", "s") for k, t in enumerate(texts)])
    got = {r.doc_id: r.component_id for r in op5_join.similar_groups(docs, n=3, percent=80).collect()}
    assert got == {k: find(k) for k in range(len(texts))}
    assert 30 < len(set(got.values())) < 300


def test_document_sums_against_brute_force(spark, monkeypatch):
    """Scores of words added up text by text; splits are small here, copies and texts without words included."""
    monkeypatch.setattr(op2_toxicity, "SPLIT", 60)
    rng = random.Random(12)
    texts = [words(rng, rng.choice([1, 4, 40]), 30).replace("w", "wort").translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(60)]
    texts += texts[:5] + ["", "12 !!", None]
    known = {w: float(np.float32(rng.gauss(0, 3))) for t in texts[:40] for w in t.split() if rng.random() < 0.7}
    scores = spark.createDataFrame(list(known.items()), "word string, ratio double")
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    got = {bytes(r.key): (r.a, r.b) for r in op2_toxicity.features(docs, scores).collect()}
    import hashlib
    want = {}
    for t in texts:
        if t and t.split()[0].isalpha():
            own = [known.get(w, 0.0) for w in t.split()]
            want[hashlib.md5(t.encode()).digest()] = (sum(own) / len(own), sum(max(x - 2, 0) for x in own) / len(own))
    assert set(got) == set(want)
    for key, (a, b) in want.items():
        assert got[key] == (pytest.approx(a), pytest.approx(b))


def test_a_split_takes_texts_of_several_batches(monkeypatch):
    """Its words travel once, however few texts a batch has; sums of equal texts are equal to the last bit."""
    import types

    import pyarrow as pa
    monkeypatch.setattr(op2_toxicity, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 3)))
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["ab", "cd", "ef", "gh", "ij", "kl"]) for _ in range(n)) for n in (5, 1, 9, 30, 2, 7)] + ["", "1 2"]
    texts.append(texts[3])
    batches = [pa.table({"key": pa.array([b"%d" % i], pa.binary()), "text": [t]}).to_batches()[0] for i, t in enumerate(texts)]
    known = {w: float(np.float32(rng.gauss(0, 3))) for w in ("ab", "cd", "ef", "gh", "ij")}
    scored = pa.table({"word": list(known), "ratio": pa.array(list(known.values()), pa.float64())})
    cut = pa.Table.from_batches(op2_toxicity._splitter(4)(iter(batches)))
    is_text = pa.compute.is_null(cut["bucket"])
    assert cut.filter(is_text)["split"].to_pylist() == [3 << 32] and len(cut) == 1 + len({op2_toxicity.crc32(w.encode()) % 4 for w in (*known, "kl")})
    looked = op2_toxicity._look_up(cut.filter(pa.compute.invert(is_text)), scored)
    got = {r["key"]: (r["a"], r["b"]) for r in op2_toxicity._sum_split(cut.filter(is_text), looked).to_pylist()}
    assert got.pop(b"8") == got[b"3"]
    for i, t in enumerate(texts[:6]):
        own = [known.get(w, 0.0) for w in t.split()]
        assert got.pop(b"%d" % i) == (pytest.approx(sum(own) / len(own)), pytest.approx(sum(max(x - 2, 0) for x in own) / len(own))), t
    assert not got


def test_finished_tables_are_deleted(spark):
    """Scores and near copies leave one table each; the words, n-grams and sets they were made from are gone."""
    from pathlib import Path

    from episodica.session import shared_dir
    folder = Path(shared_dir(spark).removeprefix("file:"))
    docs = documents(spark, [(i, f"alpha beta gamma delta epsilon {'zeta' if i % 2 else 'eta'} {chr(97 + i)}", "en", "s") for i in range(12)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id bigint, toxic int")
    before = set(folder.iterdir())
    scored, kept = op2_toxicity.score_toxicity(docs, labels), op5_join.keep_first(docs)
    assert sorted(p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before) == ["near_copies", "toxicity_features"]
    assert scored.count() == 12 and kept.count() == 12


def test_word_scores_against_their_grams(spark, monkeypatch):
    """Splits of a few words give each word the sum over its n-grams, very long words and words of no label included."""
    monkeypatch.setattr(op2_toxicity, "SPELT", 50)
    rng = random.Random(21)
    order = op2_toxicity.ORDER
    rows = [(" ".join("".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(12)), rng.choice([0, 1, None])) for _ in range(60)]
    rows += [("ab" * 5000, 1), ("zzzzz", None), ("", 0), (None, 1)]

    def spelt(word):
        whole = "\x02" * (order - 1) + word + "\x03"
        return [whole[i:i + order] for i in range(len(word) + 1)]
    counts = {}
    for text, label in rows:
        for g in (g for w in (text or "").split() for g in spelt(w) if label is not None):
            counts.setdefault(g, [0, 0])[label] += 1
    seen = {r.gram: r.seen for r in op2_toxicity.gram_scores(spark.createDataFrame([(g, *n) for g, n in counts.items()], "gram string, n0 bigint, n1 bigint")).collect()}
    got = {r.word: r.ratio for r in op2_toxicity.word_scores(spark.createDataFrame(rows, "text string, label int")).collect()}
    every = {w for text, _ in rows for w in (text or "").split()}
    assert set(got) <= every and "zzzzz" in every
    for w in every:
        assert got.get(w, 0.0) == pytest.approx(sum(seen.get(g, 0.0) for g in spelt(w)), abs=1e-9)


def test_columns_with_the_names_that_operators_use(spark):
    """Extra columns called as the operators' own ones pass through unchanged."""
    names = ["a", "b", "key", "_row", "target", "source_size", "_h", "_src", "_limit", "_gone", "_bad", "_copies", "x", "d"]
    base = documents(spark, [(i, " ".join(f"word{chr(97 + i)}{j}" for j in range(30)), "en", "s") for i in range(10)]).drop("_key", "shard", "root", "grams", "copies")
    docs = base.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id bigint, toxic int")
    items = spark.createDataFrame([(1, " ".join(f"wordc{j}" for j in range(20)))], "item_id bigint, text string")
    outputs = {"toxicity": op2_toxicity.score_toxicity(docs, labels).drop("toxic_score"), "copies": op5_join.keep_first(docs), "leaks": op10_decontaminate.decontaminate(docs, items),
               "mix": op3_mix.mixed(docs)}
    for name, out in outputs.items():
        assert out.columns == docs.columns, name
        assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()}, name
    assert outputs["leaks"].count() == 9 and outputs["copies"].count() == 10
