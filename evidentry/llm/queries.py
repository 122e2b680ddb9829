"""Registered queries of the operators of this package, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import chat, containment, hardneg, htmltext, itq, licenses, mixture, periodic, quality, simhash, substring, toxicity, urls
from .common import WORD


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labelled documents outside the held-out fifth."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(documents, table(spark, sf_dir, "labels"))
    return toxicity.scored(documents, model, score="score").select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixture.mix_report(table(spark, sf_dir, "documents")).drop("source")


# The rules of the query's contract.
URL_RULES = (urls.Rule("block", "net/"), urls.Rule("allow", "example.net/en/"),
             urls.Rule("block", "example.com/de/"), urls.Rule("allow", "org/fr/"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold 80 % or more of a benchmark item's five-word shingles, with the item."""
    return containment.leaking_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and group of every embedding."""
    return itq.embedding_groups(table(spark, sf_dir, "embeddings"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return htmltext.extract_text(table(spark, sf_dir, "pages"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that lose repeated lines or passages: what is left, and the spans cut."""
    cut = substring.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.where(F.size("removed") > 0).select("doc_id", "text", F.size("removed").alias("n_removed"), "removed")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    return simhash.simhash_groups(table(spark, sf_dir, "documents")).drop("fp")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all formatted conversations, and of one that quotes control strings."""
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    quoted = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", quoted), (-1, 1, "assistant", quoted)],
                                  "conv_id long, turn long, role string, text string")
    return chat.chat_digests(chat.format_chats(turns.unionByName(extra)))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence paragraphs of all documents and their families."""
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.train(spark))


def with_tandems(documents: DataFrame) -> DataFrame:
    """`documents` (doc_id, text), where every tenth by its hash repeats a stretch up to its end, as the contract has it."""
    hash_ = F.crc32(F.col("doc_id").cast("string"))
    words = documents.select("doc_id", "text", F.floor(hash_ / 10).alias("g"), F.when(
        hash_ % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"))
    first = F.col("g") % F.col("n")
    period = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))
    sized = (words.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, first).cast("int"))
        .withColumn("p", period.cast("int")))
    tail = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    changed = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(tail, F.lit(1), F.col("n") - F.col("a")))
    return sized.select("doc_id", F.when(F.col("n") > 0, F.array_join(changed, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents: how many, the longest one, digests of all and of the collapsed text."""
    runs = periodic.periodic_runs(with_tandems(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"),
                                                               r["period"].cast("string")), F.lit("\n")))
    return runs.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.back")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.short")).alias("period"), F.floor(1000 * F.col("best.length") / -F.col("best.short")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from trusted and unlabelled documents outside the held-out fifth."""
    scores = quality.scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), score="score")
    return scores.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth embedding."""
    rows = table(spark, sf_dir, "embeddings").where(
        "label is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    rows = rows.select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("long")).alias("vector"))
    return hardneg.hard_negatives(rows, F.col("vec_id") % 50 == 0, id="vec_id")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the URL filter that SQL can repeat: host, path, rule and, where there is one, its verdict."""
    judged = urls.judge(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("rule_verdict"))


_QUERIES = (op1_toxicity, op2_mixture, op3_url_filter, url_rules, op4_decontamination, op5_embedding_dedup, op6_html_extraction, op7_substring_dedup, op8_simhash, op9_chat_formatting, op10_license_scan,
            op11_periodic_runs, op12_quality, op13_hard_negatives)


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)
    run.__doc__, run.__name__ = query.__doc__, query.__name__
    return run


QUERIES = {q.__name__: _shipped(q) for q in _QUERIES}

#: Every pair of an anchor and another row is scored; the operator's result is the same.
_HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
  (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id))::INTEGER AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label
  AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 3
"""

_URL_RULES = """
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
r AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS rule_verdict
FROM r
"""

#: Every item is compared with every document by whole shingle sets, without signatures.
_LEAKS = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
ds AS (
  SELECT DISTINCT row, doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda k: array_to_string(w[k:k + 4], ' '))) AS s
  FROM d WHERE len(w) > 0),
its AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda k: array_to_string(w[k:k + 4], ' '))) AS s
  FROM i WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS item_shingles FROM its GROUP BY ALL),
m AS (SELECT row, doc_id, item_id, count(*) AS shared FROM ds JOIN its USING (s) GROUP BY ALL)
SELECT doc_id, item_id, shared, item_shingles, shared / item_shingles AS containment
FROM m JOIN n USING (item_id) WHERE 10 * shared >= 8 * item_shingles
"""

#: All pairs of vectors are compared.
_EMBEDDING_GROUPS = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS least FROM reach GROUP BY ALL),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY ALL),
g AS (
  SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.least, e.vec_id)) AS component_id
  FROM embeddings e LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id))
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM g
"""

#: The template's lengths are counted, escapes included; the formatted text itself is not built.
_CHAT = r"""
WITH t AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<s>[ROLE][/ROLE]</s>') + length(role || text)
    + len(regexp_extract_all(role, '[<\[]\\*/?(?:s>|INST\]|ROLE\])')) + len(regexp_extract_all(text, '[<\[]\\*/?(?:s>|INST\]|ROLE\])'))
  )::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

#: DuckDB SQL for the rows of a query, by its name.
ORACLE_SQL: dict[str, str] = {
    "url_rules": _URL_RULES, "op4_decontamination": _LEAKS, "op5_embedding_dedup": _EMBEDDING_GROUPS, "op9_chat_formatting": _CHAT,
    "op13_hard_negatives": _HARD_NEGATIVES}
