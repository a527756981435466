"""The corpus operators applied to their whole tables, and SQL for the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.conversation_repair import conversation_audits
from spindle.llm.digest_index import EXACT_SQL, exact_duplicates
from spindle.llm.html_text import main_texts
from spindle.llm.licences import SCAN_SQL, document_files, scan_licences
from spindle.llm.metric_join import near_vectors
from spindle.llm.mixing import MIX_SQL, WORD, mix
from spindle.llm.near_documents import near_documents
from spindle.llm.piece_encoding import encode_documents
from spindle.llm.quality import quality_scores
from spindle.llm.shared import table
from spindle.llm.token_alignment import aligned_documents
from spindle.llm.token_counts import document_tokens
from spindle.llm.topk import top_k
from spindle.llm.urls import LOWER, SOFT, SOFT_HITS, STRICT, UPPER, judge_urls

# The rules of the url query, (verdict, host and path).
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def word_tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def byte_tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def piece_model() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def op1_topk(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_near_documents(spark: SparkSession, folder: str) -> DataFrame:
    return near_documents(table(spark, folder, "documents"), size=2)


def op4_urls(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages"), RULES)


def op5_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return document_tokens(table(spark, folder, "documents"), word_tokenizer())


def op6_html(spark: SparkSession, folder: str) -> DataFrame:
    return main_texts(table(spark, folder, "pages"))


def op7_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))


def op8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return encode_documents(table(spark, folder, "documents"), piece_model())


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"))


def op10_licences(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licences(document_files(table(spark, folder, "documents")))


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return aligned_documents(table(spark, folder, "documents"), byte_tokenizer(), piece_model())


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults, by a checksum of conversation and turn: some
    rows lack, are empty, lack the ends of sentences, come twice or are said by
    the user. Nulls count as one space."""
    spaced = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat_ws(":", spaced["conv_id"], spaced["turn"]).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    rows = conversations.select("conv_id", "turn", spaced["role"].alias("role"), spaced["text"].alias("text"), kind.alias("kind")).where("kind <> 0")
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")


def op12_repair(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations")
    return conversation_audits(damaged(conversations), conversations)


def op13_exact(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(table(spark, folder, "documents"))


OPERATORS = (
    op1_topk,
    op2_quality,
    op3_near_documents,
    op4_urls,
    op5_tokens,
    op6_html,
    op7_near_vectors,
    op8_pieces,
    op9_mixing,
    op10_licences,
    op11_alignment,
    op12_repair,
    op13_exact,
)
QUERIES = {q.__name__: q for q in OPERATORS}

_VECTORS = "embedding IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0"

TOP_SQL = f"""
WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT for x in embedding] AS e FROM embeddings WHERE {_VECTORS}),
scores AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum([x[1] * x[2] for x in list_zip(q.e, v.e)])::BIGINT AS score
    FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scores QUALIFY rank <= 20
"""

# Nodes and links in both directions, to components.
_REACHED = """reached(node, other) AS (SELECT node, node FROM nodes UNION SELECT r.node, l.b FROM reached r JOIN links l ON r.other = l.a),
components AS (SELECT node, min(other) AS component_id FROM reached GROUP BY node)"""

NEAR_VECTORS_SQL = f"""
WITH RECURSIVE nodes AS (SELECT DISTINCT vec_id AS node FROM embeddings),
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE {_VECTORS} AND len([x for x in embedding if x <> 0]) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND len(p.e) = len(q.e) WHERE list_cosine_similarity(p.e, q.e) >= 0.9),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),
{_REACHED}
SELECT node AS vec_id, coalesce(n, 0) AS n_links, component_id, node = component_id AS kept FROM components LEFT JOIN counts ON node = a
"""

NEAR_DOCUMENTS_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id AS node, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
sets AS (SELECT node, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) END AS s FROM words),
nodes AS (SELECT node FROM sets),
pairs AS (SELECT p.node AS a, q.node AS b, len(p.s) AS m, len(q.s) AS n, len(list_intersect(p.s, q.s)) AS c FROM sets p JOIN sets q
    ON p.node < q.node AND len(p.s) > 0 AND len(q.s) > 0 AND 100 * least(len(p.s), len(q.s)) >= 80 * greatest(len(p.s), len(q.s))),
near AS (SELECT a, b FROM pairs WHERE 100 * c >= 80 * (m + n - c)),
links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
{_REACHED}
SELECT node AS doc_id, len(s)::BIGINT AS n_shingles, component_id, node = component_id AS kept FROM components JOIN sets USING (node)
"""


def _hits(terms) -> str:
    found = (rf"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::INTEGER" for t in terms)
    return f"({' + '.join(found)})"


def _rules_sql() -> str:
    cases = {"rule": [], "verdict": []}
    for verdict, text in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        host, _, path = text.partition("/")
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"
        cases["rule"].append(f"WHEN {fits} THEN '{text}'")
        cases["verdict"].append(f"WHEN {fits} THEN '{verdict}'")
    own = f"CASE WHEN strict_terms >= 1 OR soft_terms >= {SOFT_HITS} THEN 'block' ELSE 'allow' END"
    return f"CASE {' '.join(cases['rule'])} END AS rule, CASE {' '.join(cases['verdict'])} ELSE {own} END AS verdict"


URLS_SQL = f"""
WITH cut AS (SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    {_hits(STRICT)} AS strict_terms, {_hits(SOFT)} AS soft_terms FROM cut)
SELECT page_id, host, path, {_rules_sql()}, strict_terms, soft_terms FROM parts
"""

ORACLE = {
    "op1_topk": TOP_SQL,
    "op3_near_documents": NEAR_DOCUMENTS_SQL,
    "op4_urls": URLS_SQL,
    "op7_near_vectors": NEAR_VECTORS_SQL,
    "op9_mixing": MIX_SQL,
    "op10_licences": SCAN_SQL,
    "op13_exact": EXACT_SQL,
}
