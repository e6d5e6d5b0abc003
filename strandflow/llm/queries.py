"""The queries of the corpus operators (opN_<name>) and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm import decontam, licenses, near_dup, packing, quality_ranker, quality_rules, token_counts, toxicity, url_filter, warc
from strandflow.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.store(table(spark, sf_dir, "documents"))
    base = ~quality_rules.passes("base")
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & quality_rules.passes("v1")).alias("kept"), "rule_bits",
    )


def rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1's ablation: what each rule of policy v1 rejects, and what it alone rejects."""
    return quality_rules.ablation(quality_rules.store(table(spark, sf_dir, "documents")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=3, held=1)
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), "score", "predicted")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_ranker.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=4, held=2)
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), "score", "predicted")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_quality_rules, rule_ablation, op2_toxicity, op3_url_filter, op4_token_counts, op5_decontamination, op6_warc_archive, op7_minhash_near_dup, op8_license_scan, op9_packing, op10_quality_ranking, pipeline]
    return {f.__name__: f for f in ops}


_BITS = " + ".join(f"CASE WHEN {cond} THEN {quality_rules.BIT[name]} ELSE 0 END" for name, cond in quality_rules.RULES)

_OP1 = rf"""
WITH m AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln FROM documents),
win AS (SELECT doc_id, i, w[i:i + 4] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM m)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM dup, range(5) AS r(j) GROUP BY doc_id),
x AS (
  SELECT m.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(regexp_replace(t, '[^!]', '', 'g')) AS BIGINT) AS n_exclaim,
    CAST(len(ln) AS BIGINT) AS n_lines, CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM m LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, CAST({_BITS} AS BIGINT) AS rule_bits FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (rule_bits & 3) <> 0 AS base_failed, rule_bits = 0 AS kept, rule_bits FROM b
"""

_ABLATION = f"WITH book AS ({_OP1}), rules(rule, bit) AS (VALUES {', '.join(f"('{n}', {b})" for n, b in quality_rules.BIT.items())}) SELECT rule, CAST(count_if(rule_bits & bit <> 0) AS BIGINT) AS failed, CAST(count_if(rule_bits = bit) AS BIGINT) AS only_this FROM rules, (SELECT rule_bits FROM book) GROUP BY rule"

_OP5 = r"""
WITH low(kind, id, t) AS (
  SELECT 0, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM documents
  UNION ALL SELECT 1, item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(t, '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM low),
item AS (SELECT id AS item_id, w, least(13, len(w)) AS m FROM w WHERE kind = 1 AND len(w) > 0),
iw AS (SELECT DISTINCT item_id, m, w[i:i + m - 1] AS k FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM item)),
dw AS (SELECT id AS doc_id, m, i, w[i:i + m - 1] AS k FROM (SELECT id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT DISTINCT m FROM item) WHERE kind = 0)),
hit AS (SELECT doc_id, item_id, i, m FROM dw JOIN iw USING (m, k)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM w LEFT JOIN pos ON pos.doc_id = w.id LEFT JOIN its ON its.doc_id = w.id WHERE kind = 0
"""

_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, {a}, 5) AS BIGINT) >> {s}) & 31 AS INT), 1)"
_BASE32 = " || ".join(_DIGIT.format(a=5 * i + 1, s=s) for i in range(8) for s in (15, 10, 5, 0))
_OP6 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS b, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY b) AS top FROM p)
SELECT page_id, CAST(strlen(b) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to FROM g
"""

_OP7 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 3], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (k) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT link.b, reach.r FROM reach JOIN link ON link.a = reach.doc_id),
comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN comp USING (doc_id) LEFT JOIN n ON n.doc_id = d.doc_id
"""

_KNOWN = ", ".join(f"('{s}', {i})" for i, s in licenses.SENTENCES.items())
_WIDER = licenses.contained()
_FIT = {n: f"regexp_matches(framed, '{licenses.pattern(ids)}')" for n, _, ids in licenses.RULES}
_ONLY = {n: " AND ".join([_FIT[n], *(f"NOT {_FIT[m]}" for m in _WIDER[n])]) for n in _FIT}
_LIST = lambda names: "array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN {_ONLY[n]} THEN '{v}' END" for n, v in names) + "], lambda x: x IS NOT NULL))), ',')"
_OP8 = rf"""
WITH known(s, id) AS (VALUES {_KNOWN}),
cut AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '{licenses.CUT}') AS c FROM documents),
said AS (SELECT doc_id, unnest(range(1, len(c) + 1)) AS i, trim(regexp_replace(lower(unnest(c)), '{licenses.OTHER}', ' ', 'g')) AS s FROM cut),
per AS (SELECT doc_id, count_if(s <> '') AS n_sentences, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY i) FILTER (id IS NOT NULL), '') AS sentence_ids FROM said LEFT JOIN known USING (s) GROUP BY doc_id),
f AS (SELECT *, ',' || sentence_ids || ',' AS framed FROM per)
SELECT doc_id, CAST(n_sentences AS BIGINT) AS n_sentences, sentence_ids, {_LIST([(n, n) for n, _, _ in licenses.RULES])} AS rules, {_LIST([(n, lic) for n, lic, _ in licenses.RULES])} AS licenses FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _OP1, "rule_ablation": _ABLATION, "op5_decontamination": _OP5, "op6_warc_archive": _OP6, "op7_minhash_near_dup": _OP7, "op8_license_scan": _OP8}
