"""Hard negatives, ranked search and url verdicts against brute force, and their edge cases."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.llm import op11_negatives, op12_search, op13_urls
from episodica.llm.queries import URL_RULES
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_ranked_search", "op13_url_verdicts"])
def test_query_against_sql(spark, name):
    ok, _, message = compare(spark, connect(SF), name, SF)
    assert ok, message


# --- hard negatives -------------------------------------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<double>, label int, uid string, cell int, shard int, query int, score string, v string"


def vectors(spark, rows):
    """The other columns have names that the operator uses inside."""
    return spark.createDataFrame([(*r, "x", 1, 2, 3, "y", "z") for r in rows], VECTORS)


def expected_negatives(rows, every):
    usable = [(k if k is not None else 1 << 62, [math.floor(256 * x) for x in e], label) for k, e, label in rows
              if e is not None and label is not None and all(x is not None and math.isfinite(x) for x in e)]

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))
    out = []
    for i, (key, v, label) in enumerate(usable):
        if key == 1 << 62 or key % every:
            continue
        others = sorted((-score(v, w), other, at, own) for at, (other, w, own) in enumerate(usable) if at != i)
        for minus, positive, _, _ in [o for o in others if o[3] == label][:5]:
            fits = [o for o in others if o[3] != label and 80 * -minus <= 100 * -o[0] <= 100 * -minus][:5]
            out += [(key, positive, rank, other, -minus, -s) for rank, (s, other, _, _) in enumerate(fits, 1)]
    return [(a, None if p == 1 << 62 else p, r, None if n == 1 << 62 else n, x, y) for a, p, r, n, x, y in out]


def found_negatives(spark, rows, every):
    got = op11_negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % every == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_negatives_with_odd_rows(spark):
    rng = random.Random(5)
    rows = [(k, [rng.gauss(0.3, 1) for _ in range(6)], rng.randrange(3)) for k in range(160)]
    rows += [(200, None, 1), (201, [None] * 6, 1), (202, [float("nan")] * 6, 1), (203, [float("inf")] * 6, 2), (204, [1.0] * 6, None), (205, [], 1), (206, [2.0, 1.0], 1)]
    rows += [(None, [1.0] * 6, 1), (300, [0.5] * 6, 0), (300, [0.5] * 6, 0), (301, [0.5] * 6, 1), (302, [0.5] * 6, 1)]  # ties and a repeated row
    assert found_negatives(spark, rows, 20) == sorted(expected_negatives(rows, 20), key=repr)


def test_negatives_of_nothing_and_of_one_group_of_copies(spark):
    assert found_negatives(spark, [], 2) == []
    rows = [(k, [1.0, 0.0], 0) for k in range(60)] + [(k, [0.9, 0.1], 1) for k in range(60, 90)]
    assert found_negatives(spark, rows, 30) == sorted(expected_negatives(rows, 30), key=repr)


def test_products_beyond_doubles():
    a, b = np.array([[1 << 30, 3]]), np.array([[1 << 30, 1], [-(1 << 30), 5]])
    assert op11_negatives.products(a, b).tolist() == [[(1 << 60) + 3, -(1 << 60) + 15]]


def test_cells_in_order_of_their_bounds(spark):
    rng = np.random.RandomState(2)
    rows = vectors(spark, [(k, [float(x) for x in rng.normal(size=8)], 1) for k in range(300)])
    index = op11_negatives.Index(op11_negatives.quantized(rows), 8)
    query = rng.normal(size=8) * 256
    cells = list(index.order(query))
    assert len(cells) == len(index.sizes) == len({c for _, _, c in cells})
    assert all(a[0] >= b[0] for a, b in zip(cells, cells[1:]))
    bounds = {c: (up, down) for up, down, c in cells}
    for row in index.rows.collect():  # no row scores above its cell's bound or below its lower one
        up, down = bounds[row.cell]
        assert down <= float(np.dot(query, row.v)) <= up


# --- ranked search --------------------------------------------------------------------------------------------------------

TEXTS = "doc_id bigint, text string, n bigint, terms string, item string, rank string, score string"


def terms(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not c.isalnum():
            out += [word] if word else []
            word = ""
        else:
            word += c.lower() if c.isascii() else c
    return out


def expected_ranking(docs, items):
    counted = [(k, Counter(t), len(t)) for k, t in ((k, terms(text)) for k, text in docs) if t]
    total = sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c, n in counted:
            m = 10 + 90 * n * len(counted) // total
            scores.append((-sum(math.floor(1000 * math.log((2 * len(counted) + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t]), doc))
        best = sorted(s for s in scores if s[0] < 0)[:10]
        out += [(item, rank, doc, -s) for rank, (s, doc) in enumerate(best, 1)]
    return sorted(out, key=repr)


def test_ranking_with_odd_rows(spark):
    rng = random.Random(4)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 90}" for _ in range(400)] + ["Ünï", "ünï", "ñ"]
    docs = [(k, rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(rng.choice([1, 5, 30, 200])))) for k in range(150)]
    docs += [(500 + k, "w1 w2 w3 W4 copy") for k in range(60)] + [(7, docs[7][1]), (800, None), (801, ""), (802, "!!! ...")]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 12])))) for k in range(25)]
    items += [(90, None), (91, ""), (92, "unseen"), (93, "Copy COPY w4"), (93, "Copy COPY w4")]
    got = op12_search.ranked_search(spark.createDataFrame([(*d, 1, "a", "b", "c", "d") for d in docs], TEXTS),
                                    spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1)))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected_ranking(docs, items)


def test_ranking_in_several_blocks_and_of_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c"), (2, "b c d"), (None, "c d e")], "doc_id bigint, text string")
    items = spark.createDataFrame([(k, t) for k, t in enumerate(["a", "b", "c", "e", "zz"])], "item_id bigint, text string")
    whole = sorted((tuple(r) for r in op12_search.ranked_search(docs, items).collect()), key=repr)
    assert (3, 1, None) in [r[:3] for r in whole]
    monkeypatch.setattr(op12_search, "ITEMS", 2)
    assert sorted((tuple(r) for r in op12_search.ranked_search(docs, items).collect()), key=repr) == whole
    assert op12_search.ranked_search(docs.limit(0), items).collect() == []
    assert op12_search.ranked_search(docs, items.limit(0)).collect() == []


@pytest.mark.parametrize("leaf", [1, 4, 24])
def test_tree_against_all_scores(monkeypatch, leaf):
    monkeypatch.setattr(op12_search, "LEAF", leaf)
    rng = np.random.RandomState(leaf)
    rows = []
    for doc in range(500):
        own = np.flatnonzero(rng.rand(40) < rng.rand() * 0.5)
        rows.append((doc // 2, int(rng.randint(10, 200)), own, rng.randint(1, 6, len(own))))
    rows += [(1000 + k, 50, np.array([3, 9, 11]), np.array([1, 1, 2])) for k in range(90)]
    doc_id, m, own, tf = zip(*rows)
    tree = op12_search.Tree(np.array(doc_id), np.array(m), list(own), list(tf), 40)
    for _ in range(20):
        item = rng.choice(40, rng.randint(1, 15), replace=False)
        weight = rng.randint(1, 9000, len(item))
        weights = np.zeros(41, np.int64)
        weights[item] = weight
        scores = [(-int(sum(weights[t] * (10 ** 9 * f // (1000 * f + 8 * length)) for t, f in zip(o, fs))), d) for d, length, o, fs in rows]
        assert tree.search(item, weight, weights, [], 10) == sorted(s for s in scores if s[0] < 0)[:10]


# --- url verdicts ---------------------------------------------------------------------------------------------------------

def test_rules_and_parts_of_urls(spark):
    urls = {
        "https://A.Example.NET/en/1?x=/de/": ("a.example.net", "/en/1", "example.net/en/", "allow"), "http://x.net/en/1": ("x.net", "/en/1", "net/", "block"),
        "http://net/": ("net", "/", "net/", "block"), "http://x.net": ("x.net", "", None, "allow"), "http://x.net?y": ("x.net", "", None, "allow"),
        "http://example.com/de/a#b": ("example.com", "/de/a", "example.com/de/", "block"), "http://notexample.com/de/a": ("notexample.com", "/de/a", None, "allow"),
        "http://a.org/fr/": ("a.org", "/fr/", "org/fr/", "allow"), "a.org/fr/": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "http://a.com/x?u=http://b.net/": ("a.com", "/x", None, "allow"), "://b.net//": ("b.net", "//", "net/", "block")}
    rows = [(k, u, "h", "p", "r", "v", "n") for k, u in enumerate(urls)]
    pages = spark.createDataFrame(rows + rows[:3], "page_id bigint, url string, host string, path string, rule string, verdict string, names string")
    got = op13_urls.judge_urls(pages, URL_RULES)
    assert got.count() == len(rows) + 3 and "names" in got.columns
    for r in got.collect():
        assert (r.host, r.path, r.rule, r.verdict) == urls[r.url], r.url
    assert op13_urls.judge_urls(pages.limit(0), URL_RULES).collect() == []


def test_templates_generalise_merge_and_reject(spark):
    labelled = [("h", f"/spam/{k}", "block") for k in range(40)] + [("h", f"/spam/{k}.html", None) for k in range(3)]
    others = [("h", f"/{section}/{section}{k}", None) for section in ("news", "blog", "wiki") for k in range(30)]
    good = [("h", f"/shop/{k}", "allow") for k in range(30)] + [("h", f"/rare{k}", None) for k in range(2)]
    long = [("g", "/a/b/c/d/e/f/" + str(k), "block") for k in range(9)] + [("g", "/a/b/c/d/x/y", None), ("", "", None)]
    got = op13_urls.template_tree(spark.createDataFrame(labelled + others + good + long, "host string, path string, label string")).collect()
    by = {(r.host, r.path): r for r in got}
    assert len(got) == len(by) == len(labelled + others + good + long)
    assert by["h", "/spam/1.html"].template == "h/spam/*" and by["h", "/spam/1.html"].purity >= op13_urls.REJECT
    assert by["h", "/news/news3"].template == "h/(blog|news|wiki)/*" and by["h", "/news/news3"].purity == 0.5
    assert by["h", "/shop/3"].purity < 0.2 and by["h", "/rare0"].purity < op13_urls.REJECT
    assert by["g", "/a/b/c/d/x/y"].template == "g/a/b/c/d/*" and by["g", "/a/b/c/d/x/y"].purity >= op13_urls.REJECT
    assert by["", ""].template == "" and by["", ""].purity == 0.5
