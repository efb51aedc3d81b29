"""Queries of the training-data operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headcast.llm import bpe, decontaminate, language_id, lm_score, merkle, merkle_sql, minhash, quality_lm, quality_rules, runs, secrets, simhash, token_counts, url_filter

BPE_VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: The rules that URLs are judged by.
URL_RULES = (
    url_filter.Rule("com", "/en/", "block"),
    url_filter.Rule("example.com", "/en/7", "allow"),
    url_filter.Rule("net", "/de/", "allow"),
    url_filter.Rule("example.net", "/de/8", "block"),
    url_filter.Rule("org", "/es/", "block"),
)
#: What decides where no rule fits: words of unwanted hosts and paths.
URL_GLOBS = ("*casino*", "*-bets*", "*ads-track*", "*spam-*", "*/ads/*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), BPE_VOCABULARY, public_tokenizers.PATTERN)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(lm_score.remainder("doc_id", 4) == 2, F.lit(False)))
    return language_id.identify_languages(docs, language_id.sample_languages(docs.where(~F.col("held_out"))), keep=["doc_id", "held_out"])


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_report(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES, URL_GLOBS)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.mark_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination_report(marked)


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"))


def op10_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.find_periodic(table(spark, sf_dir, "documents"), tail=runs.id_tail())


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_simhash, op2_bpe, op3_quality, op4_token_counts, op5_language, op6_secrets, op7_urls, op8_decontaminate, op9_lm_score, op10_quality_lm, op11_minhash, op12_runs, op13_merkle)
    return {f.__name__: f for f in every}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op7_sql() -> str:
    rules = ", ".join(f"('{r.host}', '{r.path}', '{r.action}')" for r in URL_RULES)
    globs = " OR ".join(f"contains(host || path, '{g.strip('*')}')" for g in URL_GLOBS)
    return f"""WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
      parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), '{UPPER}', '{LOWER}') AS host, substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM cut),
      rules(rhost, rpath, action) AS (VALUES {rules}),
      fits AS (SELECT p.page_id, r.rhost || r.rpath AS rule, r.action, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rhost || r.rpath) DESC, r.rhost || r.rpath) AS n FROM parts p JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
      SELECT p.page_id, p.host, p.path, f.rule, CASE WHEN f.action IS NOT NULL THEN f.action WHEN {globs} THEN 'block' ELSE 'allow' END AS verdict FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.n = 1"""


def op8_sql(n: int = 10) -> str:
    words = lambda t: f"regexp_extract_all(translate(coalesce({t}, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH d AS (SELECT doc_id, {words("text")} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words("text")} AS w FROM benchmark),
      items AS (SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS s FROM (SELECT item, w, least({n}, len(w)) AS size, unnest(range(1, len(w) - least({n}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
      wins AS (SELECT doc_id, i, z.size, array_to_string(w[i:i + z.size - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) x, (SELECT DISTINCT size FROM items) z WHERE i + z.size - 1 <= len(w)),
      hits AS (SELECT w.doc_id, w.i, w.size, t.item FROM wins w JOIN items t ON t.size = w.size AND t.s = w.s),
      covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id),
      found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS list FROM hits GROUP BY doc_id)
      SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items, sha256(coalesce(f.list, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
      FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN found f USING (doc_id)"""


def op11_sql(size: int = 2) -> str:
    """Links by counting common shingles, components by reaching on from row to row."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+')"
    shingles = f"CASE WHEN len(w) < {size} THEN w ELSE list_distinct(list_transform(range(1, len(w) - {size} + 2), lambda i: array_to_string(w[i:i + {size} - 1], ' '))) END"
    return f"""WITH RECURSIVE d AS (SELECT rid, doc_id, {shingles} AS s FROM (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents)),
      posted AS (SELECT rid, len(s) AS n, unnest(s) AS x FROM d),
      common AS (SELECT a.rid AS i, b.rid AS j, a.n AS ni, b.n AS nj, count(*) AS c FROM posted a JOIN posted b ON a.x = b.x AND a.rid < b.rid AND 4 * a.n <= 5 * b.n AND 4 * b.n <= 5 * a.n GROUP BY ALL),
      links AS (SELECT i, j FROM common WHERE 100 * c >= 80 * (ni + nj - c)), edges AS (SELECT i, j FROM links UNION ALL SELECT j, i FROM links),
      reach AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, e.j FROM reach r JOIN edges e ON e.i = r.b),
      least AS (SELECT r.a AS rid, min(t.doc_id) AS component_id FROM reach r JOIN d t ON t.rid = r.b GROUP BY r.a)
      SELECT d.doc_id, len(d.s) AS n_shingles, l.component_id, d.doc_id IS NOT DISTINCT FROM l.component_id AS kept FROM d JOIN least l USING (rid)"""


def op6_sql() -> str:
    """Entropy is computed afresh for every window here; the query moves counts from window to window."""
    either = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    key = "|".join([*map(either, ("password", "passwd", "secret", "token")), either("api") + "_?" + either("key")])
    patterns = [f"({key})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", secrets.BASE[1][1], secrets.BASE[2][1], secrets.CANDIDATE]
    groups = [2, 0, 0, 0]
    parts = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS kind, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {g}) AS v, string_split_regex(t, '{p}') AS gap FROM texts" for k, (p, g) in enumerate(zip(patterns, groups))
    )
    allowed = " OR ".join(f"regexp_matches(v, '{p}')" for p in secrets.ALLOWED)
    level = "CASE " + " ".join(f"WHEN regexp_matches(v, '{c.members}') THEN {c.bits}" for c in secrets.CLASSES) + " END"
    names = "CASE kind " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate((*(b[0] for b in secrets.BASE), secrets.ENTROPY))) + " END"
    shown = f"string_agg({names} || ':' || s || ':' || e, ',' ORDER BY s, kind)"
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), parts AS ({parts}),
      spots AS (SELECT doc_id, kind, v[i] AS v, s, s + length(m[i]) AS e FROM (SELECT doc_id, kind, m, v, i, CAST(list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
        FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM parts))),
      base AS (SELECT * FROM spots WHERE kind < 3 AND (kind > 0 OR length(v) >= 6)),
      more AS (SELECT * FROM spots c WHERE kind = 3 AND NOT ({allowed}) AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.s < c.e AND c.s < b.e)
        AND list_max(list_transform(range(1, length(v) - 18), lambda i: list_aggregate(string_split(substr(v, i, 20), ''), 'entropy'))) >= {level}),
      every AS (SELECT doc_id, kind, s, e FROM base UNION ALL SELECT doc_id, kind, s, e FROM more)
      SELECT d.doc_id, coalesce(a.n_assign, 0) AS n_assign, coalesce(a.n_access, 0) AS n_access, coalesce(a.n_hex, 0) AS n_hex, sha256(coalesce(a.base, '')) AS base_sha256, coalesce(a.spans, '') AS spans FROM documents d LEFT JOIN (SELECT doc_id,
        count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex, {shown} FILTER (WHERE kind < 3) AS base, {shown} AS spans FROM every GROUP BY doc_id) a USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """The others have no SQL form (hashes, merges, iterated estimates, automata); tests/llm holds brute-force versions."""
    return {"op6_secrets": op6_sql(), "op7_urls": op7_sql(), "op8_decontaminate": op8_sql(), "op11_minhash": op11_sql(), "op13_merkle": merkle_sql.manifest_sql()}
