"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm import op1_language, op2_toxicity, op3_mix, op4_html, op5_join, op6_license, op7_shard, op8_fingerprint, op9_lines, op10_decontaminate, op11_negatives, op12_search, op13_urls
from episodica.llm.common import held_out, table


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op1_language.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = op2_toxicity.score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    score = F.col("toxic_score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_html.extract(table(spark, sf_dir, "pages"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_join.similar_groups(table(spark, sf_dir, "documents"), n=4, percent=85)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_license.scan(table(spark, sf_dir, "documents"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = op7_shard.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select(
        "doc_id", op7_shard.size_of().alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op8_fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))
    own, edited, hashes = F.col("anchors"), F.col("edited_anchors"), op8_fingerprint.hashes
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), op8_fingerprint.to_text(own).alias("fingerprint"),
        op8_fingerprint.to_text(edited).alias("edited_fingerprint"), op8_fingerprint.likeness(hashes(own), hashes(edited)).alias("near_edited"),
        op8_fingerprint.likeness(hashes(own), F.col("next_hashes")).alias("near_next"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_lines.dedup_lines(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return op11_negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The contract's rules.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op13_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_language_mixture, op2_toxicity_scores, op3_source_mix, op4_main_text, op5_ngram_join, op6_license_scan, op7_shards, op8_fingerprints,
    op9_line_dedup, op10_decontamination, op11_hard_negatives, op12_ranked_search, op13_url_verdicts, pipeline)}

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"



def _template_level(k: int) -> str:
    """The tables of level ``k`` of a template tree and ``a{k + 1}``, the urls below it."""
    def alike(c: str) -> str:
        apart = f"({c} / n - last_{c} / last_n)"
        both = f"(({c} + last_{c}) / (n + last_n))"
        return f"{apart} * {apart} * n * last_n <= 3.84::DOUBLE * (n + last_n) * {both} * (1 - {both})"
    lags = ", ".join(f"lag({c}) OVER o AS last_{c}" for c in ("n", "block", "allow", "ends"))
    sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("n", "block", "allow", "ends"))
    return f"""
c{k} AS (SELECT host, prefix, segs[{k + 1}] AS seg, count(*) AS n, sum(block) AS block, sum(allow) AS allow, sum(CAST(len(segs) = {k + 1} AS INT)) AS ends
    FROM a{k} WHERE len(segs) > {k} GROUP BY ALL),
t{k} AS (SELECT host, prefix, sum(n) AS total FROM c{k} GROUP BY ALL),
d{k} AS (SELECT host, prefix, CASE WHEN n >= 3 THEN seg ELSE '*' END AS branch, {sums} FROM c{k} GROUP BY ALL),
b{k} AS (SELECT d.host, d.prefix, CASE WHEN n * 50 >= total THEN branch ELSE '*' END AS branch, {sums} FROM d{k} d JOIN t{k} t ON d.host = t.host AND d.prefix = t.prefix GROUP BY ALL),
l{k} AS (SELECT *, {lags} FROM b{k} WINDOW o AS (PARTITION BY host, prefix ORDER BY block / n, allow / n, ends / n, branch)),
g{k} AS (SELECT *, sum(CASE WHEN last_n IS NULL OR NOT ({alike("block")} AND {alike("allow")} AND {alike("ends")}) THEN 1 ELSE 0 END)
    OVER (PARTITION BY host, prefix ORDER BY block / n, allow / n, ends / n, branch ROWS UNBOUNDED PRECEDING) AS class FROM l{k}),
m{k} AS (SELECT host, prefix, class, list_sort(list(branch)) AS br FROM g{k} GROUP BY ALL),
n{k} AS (SELECT host, prefix, unnest(br) AS branch, CASE WHEN list_contains(br, '*') THEN '*' WHEN len(br) = 1 THEN br[1] ELSE '(' || array_to_string(br, '|') || ')' END AS name FROM m{k}),
a{k + 1} AS (SELECT a.host, a.path, a.segs, a.block, a.allow, CASE WHEN len(segs) > {k} THEN a.prefix || '/' || coalesce(x.name, y.name) ELSE a.prefix END AS prefix
    FROM a{k} a LEFT JOIN n{k} x ON a.host = x.host AND a.prefix = x.prefix AND a.segs[{k + 1}] = x.branch
    LEFT JOIN n{k} y ON a.host = y.host AND a.prefix = y.prefix AND y.branch = '*')"""


ORACLES = {
    "op3_source_mix": f"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS.format(text="coalesce(text, '')")}) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || '/' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss FROM d GROUP BY source),
r AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM s),
k AS (SELECT *, row_number() OVER o AS i, (1.5 * (SELECT sum(ss) FROM s) - 2 * coalesce(sum(ss) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS rate FROM r WINDOW o AS (ORDER BY 2.0 * ss / w, source)),
l AS (SELECT rate FROM k WHERE 2.0 * ss > rate * w ORDER BY i LIMIT 1),
t AS (SELECT source, ss, least(2.0 * ss, w * coalesce((SELECT rate FROM l), 0))::DOUBLE AS target FROM r),
b AS (SELECT *, CASE WHEN ss > 0 THEN floor(target / ss) ELSE 0 END AS whole FROM t),
g AS (SELECT source, h, sum(size) AS size FROM d GROUP BY source, h),
c AS (SELECT g.source, h, size, sum(size) OVER (PARTITION BY g.source ORDER BY h) AS upto, target - whole * ss AS budget FROM g JOIN b ON g.source IS NOT DISTINCT FROM b.source),
p AS (SELECT source, min(h) AS h, arg_min(upto - budget < budget - (upto - size), h) AS take FROM c WHERE upto > budget GROUP BY source)
SELECT d.doc_id, d.size, b.ss AS source_size, b.target,
    CAST(d.size * (b.whole + CASE WHEN p.h IS NULL THEN CASE WHEN b.target - b.whole * b.ss > 0 THEN 1 ELSE 0 END
        WHEN d.h < p.h OR (p.take AND d.h = p.h) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN p ON d.source IS NOT DISTINCT FROM p.source""",
    "op5_ngram_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
g AS (SELECT DISTINCT doc_id, gram FROM (SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS gram FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) m ON m.x = w.doc_id""",
    "op11_hard_negatives": """
WITH v AS (SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.uid AS a, a.vec_id AS anchor_id, a.label = b.label AS same, b.uid AS b, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
    FROM v a JOIN v b ON a.uid <> b.uid WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, b) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.vec_id, s.b) AS INTEGER) AS rank,
    s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
    FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT * FROM n WHERE rank <= 5""",
    "op12_ranked_search": r"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
i AS (SELECT uid, item_id, unnest(list_distinct(t)) AS term FROM (SELECT row_number() OVER () AS uid, item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark)),
s AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS l FROM d WHERE len(t) > 0),
f AS (SELECT uid, doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT uid, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY uid, doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term),
r AS (SELECT i.uid, i.item_id, f.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // l)))) AS BIGINT) AS score
    FROM i JOIN f ON i.term = f.term JOIN w ON w.term = f.term CROSS JOIN s GROUP BY i.uid, i.item_id, f.uid, f.doc_id),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY uid ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT * FROM k WHERE rank <= 10""",
    "op13_url_verdicts": r"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p),
v AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS label FROM r),
s AS (SELECT DISTINCT host, path, label, CASE WHEN path = '' THEN [] ELSE string_split(substr(path, 2), '/') END AS l FROM v),
a0 AS (SELECT host, path, CASE WHEN len(l) > 5 THEN list_append(l[1:4], array_to_string(l[5:], '/')) ELSE l END AS segs,
    CAST(coalesce(label, '') = 'block' AS BIGINT) AS block, CAST(coalesce(label, '') = 'allow' AS BIGINT) AS allow, '' AS prefix FROM s),""" + ",".join(_template_level(k) for k in range(5)) + """,
u AS (SELECT host, prefix, CAST(count(*) AS BIGINT) AS urls, sum(block)::BIGINT AS b, sum(allow)::BIGINT AS al FROM a5 GROUP BY ALL),
j AS (SELECT host, prefix FROM u WHERE (b + 0.5::DOUBLE * (2.0::DOUBLE + 0.25::DOUBLE * (urls - (b + al)))) / ((b + al) + (2.0::DOUBLE + 0.25::DOUBLE * (urls - (b + al)))) >= 0.8::DOUBLE),
x AS (SELECT a5.host, a5.path FROM a5 JOIN j ON a5.host = j.host AND a5.prefix = j.prefix)
SELECT page_id, v.host, v.path, rule, coalesce(label, CASE WHEN x.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM v LEFT JOIN x ON v.host = x.host AND v.path = x.path""",
}
