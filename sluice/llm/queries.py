"""Thin registered queries: each applies one operator, with production
parameters, to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import chat_repair, collocations, decontamination, divergence, exact_topk, jump_sharding, nbest, order_minhash, packing, quality_rules, rule_ensemble, shared, token_files, url_trust

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn
    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@register("op1_token_files")
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = shared.folder(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), target, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_files.read_token_files(spark, target)


@register("op6_jump_sharding")
def op6_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = jump_sharding.assign_shards(docs, "doc_id", 8, ties=["text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@register("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, length=2048)


@register("op7_robust_outliers")
def op7_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    stats = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = quality_rules.judge(docs, keep_text=False)
    return judged.select("doc_id", *[quality_rules.stat(n).alias(n) for n in stats], F.col("__base_failed").alias("base_failed"),
                         F.col("__kept").alias("kept"), F.col("__distance").alias("distance"))


@register("op10_rule_ensemble")
def op10_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = rule_ensemble.fit(docs, table(spark, sf_dir, "labels"))
    scored = rule_ensemble.score(docs, model).select("doc_id", rule_ensemble.held_out("doc_id").alias("held_out"), F.col("__score").alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


@register("op2_exact_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
      FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20""")
def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return exact_topk.top_k(rows, rows.filter(F.col("vec_id") % 20 == 0), k=20, scale=64)


#: Fixed values of the contract: verdict, host and path prefix of each rule.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def _url_sql() -> str:
    """The URL query in SQL: rounds of integer mass unrolled as one subquery each."""
    unit, follow = url_trust.UNIT, url_trust.FOLLOW
    fits = lambda r: f"((host = '{r[1]}' OR host LIKE '%.{r[1]}') AND starts_with(path, '{r[2]}'))"
    longest = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    pick = lambda k: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r[1] + r[2] if k else r[0]}'" for r in longest) + " END"
    host = lambda c: f"coalesce(translate(regexp_extract({c}, '(?s)^.*?://([^/?#]*)', 1), '{url_trust._UPPER}', '{url_trust._LOWER}'), '')"
    scheme = "[A-Za-z][A-Za-z0-9+.-]*:"
    sql = f"""
WITH u AS (SELECT page_id, html, {host('url')} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
p AS MATERIALIZED (SELECT *, {pick(True)} AS rule, {pick(False)} AS kind FROM u),
l AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']([^"''<>]*)["'']', 1)) AS link FROM p),
h AS (SELECT src, CASE WHEN starts_with(link, '//') THEN {host("('x:' || link)")}
                       WHEN regexp_matches(link, '^{scheme}//') THEN {host('link')}
                       WHEN NOT regexp_matches(link, '^{scheme}') THEN src END AS dst FROM l),
e0 AS (SELECT src, dst, count(*) AS n FROM h WHERE dst <> '' GROUP BY ALL),
s0 AS (SELECT host, (count(*) FILTER (kind = 'allow') * {unit}) // count(*) AS s, (count(*) FILTER (kind = 'block') * {unit}) // count(*) AS b FROM p GROUP BY host),
seed AS MATERIALIZED (SELECT * FROM s0 UNION ALL SELECT DISTINCT dst, 0, 0 FROM e0 WHERE dst NOT IN (SELECT host FROM s0)),
e AS (SELECT * FROM e0 UNION ALL SELECT host, host, 1 FROM seed WHERE host NOT IN (SELECT src FROM e0)),
w AS MATERIALIZED (SELECT src, dst, (n * {unit}) // sum(n) OVER (PARTITION BY src) AS share FROM e),
m0 AS (SELECT host, s AS t, b AS d FROM seed)"""
    for k in range(url_trust.ROUNDS):
        sql += f""",
m{k + 1} AS MATERIALIZED (SELECT seed.host,
  (s * {100 - follow} + coalesce((SELECT CAST(sum((t * share) // {unit}) AS BIGINT) FROM w JOIN m{k} m ON m.host = w.src WHERE w.dst = seed.host), 0) * {follow}) // 100 AS t,
  (b * {100 - follow} + coalesce((SELECT CAST(sum((d * share) // {unit}) AS BIGINT) FROM w JOIN m{k} m ON m.host = w.dst WHERE w.src = seed.host), 0) * {follow}) // 100 AS d FROM seed)"""
    return sql + f"""
SELECT page_id, p.host, path, rule, coalesce(kind, CASE WHEN d - t >= {int(url_trust.THRESHOLD * unit)} THEN 'block' ELSE 'allow' END) AS verdict,
       CAST(t AS DOUBLE) / {unit} AS trust, CAST(d AS DOUBLE) / {unit} AS distrust
FROM p JOIN m{url_trust.ROUNDS} USING (host)"""


@register("op4_url_trust", _url_sql())
def op4_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_trust.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES)
    return judged.select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"),
                         F.col("__verdict").alias("verdict"), F.col("__trust").alias("trust"), F.col("__distrust").alias("distrust"))


@register("op3_order_minhash")
def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = order_minhash.classes(table(spark, sf_dir, "documents"))
    kept = (F.col("doc_id") == F.col("class_id")) & (F.col("node") == F.col("class_node"))
    return found.select("doc_id", "class_id", kept.alias("kept"))


@register("op8_nbest_pieces")
def op8_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbest.encode_nbest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), n=4, keep_ids=False)


@register("op5_chat_repair")
def op5_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair(table(spark, sf_dir, "conversations"))


#: Fixed values of the contracts: A-Z to lower case, and the words of the decontamination query.
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TEST_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@register("op13_decontamination", rf"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWERED}, '{_TEST_WORDS}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWERED}, '{_TEST_WORDS}') AS w FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item, CAST(least(len(w), 10) AS BIGINT) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS words
                     FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
p AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS words FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
h AS MATERIALIZED (SELECT r, k, i, item FROM p JOIN win USING (k, words)),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT r, k, i FROM h)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)""")
def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select("doc_id", F.col("__n_words").alias("n_words"), decontamination.n_hit().alias("n_hit"),
                        F.size("__items").cast("long").alias("n_items"), F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"),
                        (F.size("__runs") > 0).alias("contaminated"))


#: Fixed values of the audit's contract: terms, documents of a kept term, and shares.
_TERMS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


@register("op12_divergence_audit", rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWERED}, '{_TERMS}') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS MATERIALIZED (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS lc FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
lv AS (SELECT lang, count(*) AS v, sum(lc) AS ln FROM kept GROUP BY lang),
gn AS (SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce((SELECT sum(c) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0) AS n FROM g LEFT JOIN lv USING (lang)),
p AS MATERIALIZED (SELECT lang, source, term, coalesce(c, 0) AS c, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c, 0) + 1)) // CAST(n + v AS HUGEINT) AS p
      FROM gn JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (lc + 1)) // CAST(ln + v AS HUGEINT) AS q FROM kept JOIN lv USING (lang)),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
                 coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // y.p) FROM p x JOIN p y USING (lang, term) WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER w AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, item) QUALIFY part = 'pair' OR row_number() OVER w <= 200""")
def op12_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


#: Fixed values of the collocation query's contract: where pieces end, and words.
_PIECES, _PIECE_WORDS = r"[.,;:!?\x0A-\x0D]", r"[^\x20\x09]+"


@register("op11_collocations", rf"""
WITH p AS (SELECT lang, unnest(regexp_split_to_array(t, '{_PIECES}')) AS piece FROM (SELECT coalesce(lang, 'und') AS lang, {_LOWERED} AS t FROM documents)),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '{_PIECE_WORDS}') AS w FROM p),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM (
       SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, range(1, 6) sizes(m) WHERE len(w) >= m))
     GROUP BY ALL HAVING count(*) >= 100),
c AS MATERIALIZED (SELECT lang, m, phrase, f AS a FROM f WHERE m > 1),
kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.lang = c.lang AND x.m > c.m AND x.a >= c.a AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS ws, unnest(range(1, m)) AS k FROM kept),
s AS (SELECT c.lang, phrase, a, k, (SELECT f FROM f WHERE f.lang = c.lang AND f.phrase = array_to_string(ws[1:k], ' ')) AS l,
             (SELECT f FROM f WHERE f.lang = c.lang AND f.phrase = array_to_string(ws[k + 1:], ' ')) AS r, n FROM cuts c JOIN total USING (lang)),
scored AS (SELECT *, CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM s),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000""")
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.ranked(collocations.collocations(table(spark, sf_dir, "documents")))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
