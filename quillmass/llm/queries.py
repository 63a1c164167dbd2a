"""The registered queries of the ten operators, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, lines, media, packing, secrets, simhash, tokens, topk, urls
from .common import table

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"

#: Host names that sell, bet or track are made of two such words; paths that do have the two as directories.
FIRST = "adult ads affiliate bargain best bet bonus bulk buy cam casino cash cheap click coin coupon crypto dating deal diet download earn escort fast free gamble hot instant jackpot keygen lottery lucky mega payday pharma pills poker prize promo quick replica slots spam traffic warez win xxx".split()
SECOND = "bets bonus boost cards cash chat clicks club codes coins cracks deals dice exchange farm games gold leads links live loans market meds offer pay pills play prizes profit promo pump rewards rush sale shop slots spin sport store stream tips track video vip watches win x zone".split()

#: Production rules: the given host rules, and patterns by the rule above (some 5000).
RULES = urls.RuleSet(
    hosts=(
        urls.HostRule("allow", "org/"),
        urls.HostRule("block", "example.org/es/"),
        urls.HostRule("block", "example.org/en/1"),
        urls.HostRule("allow", "com/fr/"),
        urls.HostRule("block", "com/de/"),
    ),
    patterns=tuple(urls.PatternRule("block", shape.format(a, b)) for shape in ("{}-{}.", "/{}/{}/") for a in FIRST for b in SECOND),
)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    net = langid.train(documents.filter(~langid.held_out()))
    return langid.identify(documents, net)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES)


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokens.public_path(BYTE_BPE))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("secrets", lambda s: s["kind"].isin("assign", "access", "hex"))

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op9_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = tokens.encode_documents(table(spark, sf_dir, "documents"), tokens.public_path(WORD_BPE))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokens.public_path(BYTE_BPE))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_url_filters, op3_exact_top_k, op4_token_counts, op5_simhash, op6_line_dedup, op7_secret_scan, op8_media_columns, op9_bpe_automaton, op10_best_fit_packing)}

ORACLE_SQL = {
    "op2_url_filters": r"""
WITH cut AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM cut
), first AS (SELECT unnest(string_split('{FIRST}', ' ')) AS a, generate_subscripts(string_split('{FIRST}', ' '), 1) AS i
), second AS (SELECT unnest(string_split('{SECOND}', ' ')) AS b, generate_subscripts(string_split('{SECOND}', ' '), 1) AS j
), pattern AS (
  SELECT a || '-' || b || '.' AS p, 0 AS k, i, j FROM first, second UNION ALL SELECT '/' || a || '/' || b || '/', 1, i, j FROM first, second
), subject AS (SELECT DISTINCT host || path AS s FROM ruled
), hit AS (SELECT s, arg_min(p, (k * 1000 + i) * 1000 + j) AS method_rule FROM subject JOIN pattern ON contains(s, p) GROUP BY s
), patterned AS (SELECT ruled.*, hit.method_rule FROM ruled LEFT JOIN hit ON hit.s = host || path
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN method_rule IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, method_rule
FROM patterned
""".replace("{FIRST}", " ".join(FIRST)).replace("{SECOND}", " ".join(SECOND)),
    "op3_exact_top_k": """
WITH whole AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, generate_subscripts(embedding, 1) AS i, CAST(floor(1024 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x
  FROM embeddings
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0 GROUP BY 1, 2
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM scored
)
SELECT * FROM ranked WHERE "rank" <= 10
""",
}
