"""Queries over documents, query logs, chunks and search."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tabularium.functions.text import strip
from tabularium.operators import chunking, labels, search, text_cleaning
from tabularium.plans.registry import query

WORD = r"[\p{L}\p{N}_]"
EDGE_START, EDGE_END = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
WS = r"[\s\x1c-\x1f\x{85}\p{Z}]"


def re2(pattern: str) -> str:
    r"""The pattern with Unicode word edges for an engine whose \b, \w, \s are ASCII only."""
    result = pattern
    if result.startswith(r"\b"):
        result = EDGE_START + result[2:]
    if result.endswith(r"\b"):
        result = result[:-2] + EDGE_END
    return result.replace(r"\w", WORD).replace(r"\s", WS).replace("'", "''")


def sql_hits(text: str, patterns) -> str:
    return "(" + " + ".join(f"regexp_matches({text}, '{re2(p)}')::INT" for p in patterns) + ")"


def sql_any(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, '{term}')" for term in terms) + ")"


STRIP = rf"'^{WS}+|{WS}+$', '', 'g'"
TRIMMED = f"regexp_replace(line, {STRIP})"
SPLIT_WORDS = rf"list_filter(string_split_regex(text, '{WS}+'), lambda w: w <> '')"

HEADERS = rf"""CASE WHEN len(string_split(text, chr(10))) <= 5 THEN text ELSE array_to_string(list_filter(
  string_split(text, chr(10)), lambda line, i: NOT ((i <= 2 OR i > len(string_split(text, chr(10))) - 2)
    AND length({TRIMMED}) < 20 AND (starts_with({TRIMMED}, 'Page ') OR regexp_matches({TRIMMED}, '^\p{{Nd}}+$')
    OR length({TRIMMED}) < 5))), chr(10)) END"""
PAGES = rf"""regexp_replace(regexp_replace(regexp_replace(text, '\n{WS}*\p{{Nd}}+{WS}*\n', chr(10), 'g'),
  '\n{WS}*Page{WS}+\p{{Nd}}+{WS}*\n', chr(10), 'gi'), '\n{WS}*\p{{Nd}}+{WS}*/{WS}*\p{{Nd}}+{WS}*\n', chr(10), 'g')"""
LAYOUT = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'),
  '\n[ \t]+', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')"""
CLEANED = f"""(SELECT doc_id, original, {LAYOUT} AS text FROM (SELECT doc_id, original, {PAGES} AS text FROM (
  SELECT doc_id, text AS original, {HEADERS} AS text FROM documents)))"""
CHUNKED = f"""(SELECT doc_id, original, text, CASE
  WHEN length(text) < 50 THEN CASE WHEN regexp_replace(text, {STRIP}) <> '' THEN [text] ELSE [] END
  WHEN len(pieces) > 0 THEN pieces WHEN regexp_replace(text, {STRIP}) <> '' THEN [regexp_replace(text, {STRIP})]
  ELSE [] END AS chunks FROM (SELECT doc_id, original, text, list_filter(list_transform(range(0, CASE WHEN len(words) <= 512
    THEN 1 ELSE 1 + ceil((len(words) - 512) / 462.0)::BIGINT END),
    lambda i: array_to_string(words[i * 462 + 1 : i * 462 + 512], ' ')), lambda p: length(p) >= 50) AS pieces
  FROM (SELECT doc_id, original, text, {SPLIT_WORDS} AS words FROM SOURCE)))"""


@query("remove_headers_footers", "C12", f"SELECT doc_id, {HEADERS} AS text FROM documents")
def _(t):
    return t.spread("documents").select("doc_id", text_cleaning.remove_headers_footers("text").alias("text"))


@query("remove_page_numbers", "C13", f"SELECT doc_id, {PAGES} AS text FROM documents")
def _(t):
    return t.spread("documents").select("doc_id", text_cleaning.remove_page_numbers("text").alias("text"))


@query("normalize_whitespace", "C14", rf"""
SELECT doc_id, {LAYOUT} AS layout,
  regexp_replace(regexp_replace(text, '{WS}+', ' ', 'g'), {STRIP}) AS flat FROM documents""")
def _(t):
    return t.spread("documents").select(
        "doc_id", text_cleaning.normalize_whitespace("text").alias("layout"),
        text_cleaning.normalize_whitespace("text", preserve_layout=False).alias("flat"))


@query("word_chunks", "C15, R6", f"""
SELECT doc_id, i - 1 AS chunk_index, doc_id || '_chunk_' || (i - 1) AS chunk_id, chunks[i] AS chunk,
  length(chunks[i]) // 4 AS token_count FROM (SELECT doc_id, chunks, unnest(range(1, len(chunks) + 1)) AS i
FROM {CHUNKED.replace("SOURCE", "(SELECT doc_id, text AS original, text FROM documents)")})""")
def _(t):
    return text_cleaning.chunk_table(t.spread("documents"), "doc_id", "text")


@query("clean_text_stats", "C16, C17", f"""
SELECT doc_id, length(original) AS original_length, length(text) AS final_length, len(chunks) AS chunks_created
FROM {CHUNKED.replace("SOURCE", CLEANED)}""")
def _(t):
    return text_cleaning.clean_documents(t.spread("documents"), "doc_id", "text").stats("text")


@query("clean_text_chunks", "C16", f"""
SELECT doc_id, len(chunks) AS chunks, md5(array_to_string(chunks, '|')) AS digest
FROM {CHUNKED.replace("SOURCE", CLEANED)}""")
def _(t):
    cleaned = text_cleaning.clean_documents(t.spread("documents"), "doc_id", "text").table
    chunks = text_cleaning.word_chunks("cleaned")
    return cleaned.select("doc_id", F.size(chunks).alias("chunks"), F.md5(F.array_join(chunks, "|")).alias("digest"))


@query("split_sentences", "R1", rf"""
SELECT doc_id, len(s) AS sentences, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, list_filter(
  list_transform(string_split_regex(text, '[.!?]+{WS}+'), lambda line: {TRIMMED}), lambda x: x <> '') AS s
FROM documents)""")
def _(t):
    parts = chunking.sentences("text")
    return t.spread("documents").select(
        "doc_id", F.size(parts).alias("sentences"), F.md5(F.array_join(parts, "|")).alias("digest"))


def _chunked(strategy):
    return lambda t: chunking.chunk_documents(t.spread("documents"), "doc_id", "text", strategy)


for _strategy, _row in (("sentence", "R2"), ("semantic", "R3"), ("fixed", "R4"), ("paragraph", "R5")):
    query(f"chunks_{_strategy}", f"{_row}, R6, S14")(_chunked(_strategy))


@query("chunks_per_resource", "R6, R16", f"""
SELECT source AS resource_id, sum(len(chunks))::BIGINT AS chunks, sum(list_sum(list_transform(chunks,
  lambda c: length(c) // 4)))::BIGINT AS tokens FROM {CHUNKED.replace("SOURCE",
    "(SELECT doc_id, text AS original, text FROM documents)")} JOIN (SELECT doc_id, source FROM documents) USING (doc_id)
GROUP BY ROLLUP (source)""")
def _(t):
    chunks = text_cleaning.chunk_table(
        t.spread("documents").withColumn("key", F.struct("doc_id", "source").cast("string")), "key", "text")
    owner = F.regexp_extract("key", r", (.*)\}$", 1)
    return search.corpus_statistics(chunks.select(owner.alias("resource_id"), "token_count"))


# ---- search ------------------------------------------------------------------------------------

@query("query_variations", "R7", rf"""
WITH q AS (SELECT conv_id, turn, text, list_filter(string_split_regex(lower(text), '{WS}+'), lambda w: w <> '') AS w
  FROM conversations WHERE role = 'user'),
s AS (SELECT *, {{'find': 'search', 'search': 'find', 'show': 'display', 'display': 'show', 'get': 'retrieve',
  'retrieve': 'get', 'data': 'information', 'information': 'data', 'document': 'file', 'file': 'document'}} AS syn,
  list_position(list_transform(w, lambda x: x IN ('find', 'search', 'show', 'display', 'get', 'retrieve', 'data',
    'information', 'document', 'file')), true) AS pos FROM q),
o AS (SELECT conv_id, turn, text, [text,
  array_to_string(list_transform(w, lambda x, i: CASE WHEN i = pos THEN CASE x WHEN 'find' THEN 'search'
    WHEN 'search' THEN 'find' WHEN 'show' THEN 'display' WHEN 'display' THEN 'show' WHEN 'get' THEN 'retrieve'
    WHEN 'retrieve' THEN 'get' WHEN 'data' THEN 'information' WHEN 'information' THEN 'data'
    WHEN 'document' THEN 'file' ELSE 'document' END ELSE x END), ' '),
  CASE WHEN starts_with(text, 'find') THEN 'what is' || text[5:]
    WHEN starts_with(text, 'what') THEN regexp_replace(text, 'what is', 'find')
    WHEN starts_with(text, 'show') THEN 'list' || text[5:]
    WHEN starts_with(text, 'how') THEN 'what is the process for' || text[4:] ELSE text END,
  array_to_string(list_filter(w, lambda x: x NOT IN ({", ".join(f"'{w}'" for w in search.STOP_WORDS)})), ' ')] AS opts
  FROM s),
f AS (SELECT conv_id, turn, list_filter(opts, lambda v, i: i = 1 OR (v <> '' AND v <> text)) AS v FROM o)
SELECT conv_id || '-' || turn AS query_id, i - 1 AS variation, v[i] AS query
FROM (SELECT conv_id, turn, v, unnest(range(1, len(v) + 1)) AS i FROM f)""")
def _(t):
    asked = t.spread("conversations").where("role = 'user'").select(
        F.concat_ws("-", "conv_id", "turn").alias("query_id"), "text")
    return search.query_variations(asked, "query_id", "text")


def vector_chunks(t):
    return t.spread("embeddings").select(
        F.col("label").alias("resource_id"), F.col("vec_id").alias("chunk_id"), "embedding")


def centroid_queries(t):
    """One query per label: the mean vector of the label."""
    cells = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vector = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"])
    return means.groupBy(F.col("label").alias("query_id")).agg(vector.alias("vector")).withColumn("variation", F.lit(0))


CENTROIDS = """(SELECT label AS query_id, list(x ORDER BY i) AS vector FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS x
  FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)"""
DISTANCES = f"""(SELECT query_id, e.label AS resource_id, e.vec_id AS chunk_id,
  list_sum(list_transform(list_zip(e.embedding, q.vector), lambda z: (z[1]::DOUBLE - z[2]) ** 2)) AS distance
  FROM embeddings e, {CENTROIDS} q)"""


def _semantic_sql(n: int, where: str = "true") -> str:
    return f"""(SELECT query_id, resource_id, chunk_id, distance, greatest(0.0, 1.0 - distance) AS relevance
FROM {DISTANCES} WHERE {where} QUALIFY row_number() OVER (PARTITION BY query_id
  ORDER BY distance, chunk_id) <= {n})"""


@query("nearest_per_collection", "R8", f"""
SELECT query_id, resource_id, chunk_id, round(distance, 6) AS distance FROM {DISTANCES}
QUALIFY row_number() OVER (PARTITION BY query_id, resource_id ORDER BY distance, chunk_id) <= 5""")
def _(t):
    found = search.nearest_chunks(centroid_queries(t), vector_chunks(t), 5)
    return found.select("query_id", "resource_id", "chunk_id", F.round("distance", 6).alias("distance"))


@query("semantic_search", "R8, R11", f"""
SELECT query_id, resource_id, chunk_id, round(relevance, 6) AS relevance FROM {_semantic_sql(10)}""")
def _(t):
    found = search.semantic_search(centroid_queries(t), vector_chunks(t), 10)
    return found.select("query_id", "resource_id", "chunk_id", F.round("relevance", 6).alias("relevance"))


@query("filtered_search", "R9", f"""
SELECT query_id, resource_id, chunk_id, round(relevance, 6) AS relevance
FROM {_semantic_sql(10, "resource_id IN (1, 3, 5)")}""")
def _(t):
    chunks = vector_chunks(t).where("resource_id IN (1, 3, 5)")
    found = search.semantic_search(centroid_queries(t), chunks, 10)
    return found.select("query_id", "resource_id", "chunk_id", F.round("relevance", 6).alias("relevance"))


# Search texts a user types: parameters of the search, not data.
SEARCH_TEXTS = ["find the data with a pattern", "Show and retrieve la document", "the was ation"]


def text_queries(t):
    typed = t.spark.createDataFrame(list(enumerate(SEARCH_TEXTS)), "query_id int, text string")
    return search.query_variations(typed, "query_id", "text")


TEXT_VARIATIONS = """(VALUES (0, 0, ['find', 'the', 'data', 'with', 'a', 'pattern']),
  (0, 1, ['search', 'the', 'data', 'with', 'a', 'pattern']), (0, 2, ['what', 'is', 'the', 'data', 'with', 'a', 'pattern']),
  (0, 3, ['find', 'data', 'pattern']), (1, 0, ['show', 'and', 'retrieve', 'la', 'document']),
  (1, 1, ['display', 'and', 'retrieve', 'la', 'document']), (1, 2, ['show', 'retrieve', 'la', 'document']),
  (2, 0, ['the', 'was', 'ation']), (2, 1, ['ation'])) v(query_id, variation, terms)"""
KEYWORD_HITS = f"""(SELECT query_id, variation, source AS resource_id, doc_id AS chunk_id,
  len(list_filter(terms, lambda w: contains(lower(text), w))) / len(terms) AS relevance
  FROM documents, {TEXT_VARIATIONS})"""


def _keyword_sql(n: int) -> str:
    return f"""(SELECT * FROM (SELECT * FROM {KEYWORD_HITS} WHERE relevance > 0
  QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY variation) = 1)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, chunk_id) <= {n})"""


def document_chunks(t):
    return t.spread("documents").select(F.col("source").alias("resource_id"), F.col("doc_id").alias("chunk_id"), "text")


@query("keyword_search", "R10, R11", f"""
SELECT query_id, resource_id, chunk_id, round(relevance, 6) AS relevance FROM {_keyword_sql(20)}""")
def _(t):
    found = search.keyword_search(text_queries(t), document_chunks(t), 20)
    return found.select("query_id", "resource_id", "chunk_id", F.round("relevance", 6).alias("relevance"))


def all_chunks(t):
    """Every document, with its vector where it has one."""
    return t.spread("documents").join(t.embeddings, F.expr("vec_id = doc_id"), "left").select(
        F.col("label").alias("resource_id"), F.col("doc_id").alias("chunk_id"), "embedding", "text")


LABELLED = [(label, 0, SEARCH_TEXTS[label % 3]) for label in range(10)]  # a search text for every label


@query("hybrid_search", "R12", f"""
WITH s AS (SELECT query_id, chunk_id, relevance, distance FROM (SELECT * FROM {DISTANCES.replace("AS distance", "AS distance")}
    WHERE chunk_id IN (SELECT doc_id FROM documents)) x,
    LATERAL (SELECT greatest(0.0, 1.0 - distance) AS relevance) y
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) <= 40),
k AS (SELECT label AS query_id, chunk_id, relevance FROM {KEYWORD_HITS} x JOIN range(10) l(label) ON x.query_id = label % 3
  WHERE variation = 0 AND relevance > 0 QUALIFY row_number() OVER (PARTITION BY label ORDER BY relevance DESC, chunk_id) <= 40)
SELECT query_id, chunk_id, round(relevance, 6) AS relevance FROM (
  SELECT coalesce(s.query_id, k.query_id) AS query_id, coalesce(s.chunk_id, k.chunk_id) AS chunk_id,
    coalesce(least(1.0, 1.2 * (0.7 * s.relevance + 0.3 * k.relevance)), s.relevance, k.relevance) AS relevance
  FROM s FULL JOIN k ON s.query_id = k.query_id AND s.chunk_id = k.chunk_id)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, chunk_id) <= 20""")
def _(t):
    texts = t.spark.createDataFrame(LABELLED, "query_id int, variation int, query string")
    found = search.hybrid_search(centroid_queries(t), texts, all_chunks(t), 20)
    return found.select("query_id", "chunk_id", F.round("relevance", 6).alias("relevance"))


@query("mmr_search", "R13")
def _(t):
    return search.mmr_search(centroid_queries(t), all_chunks(t), 5)


@query("text_similarity", "R14", rf"""
WITH pairs AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS earlier
  FROM conversations),
w AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '{WS}+'), lambda x: x <> '')) AS a,
  list_distinct(list_filter(string_split_regex(lower(earlier), '{WS}+'), lambda x: x <> '')) AS b
  FROM pairs WHERE earlier IS NOT NULL)
SELECT conv_id, turn, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0
  ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS similarity FROM w""")
def _(t):
    from tabularium.functions.ordered import with_previous
    turns = t.spread("conversations").select("conv_id", "turn", "text")
    paired = with_previous(turns, ["conv_id"], "turn", {"earlier": "text"}, 1024).where("earlier IS NOT NULL")
    return paired.select("conv_id", "turn", F.round(search.text_similarity("text", "earlier"), 6).alias("similarity"))


@query("hits_by_resource", "R15", f"""
SELECT resource_id, count(*) AS hits, round(max(relevance), 6) AS best,
  round(count(*) FILTER (relevance > 0.8) / count(*), 6) AS strong_share FROM {_semantic_sql(10)} GROUP BY resource_id""")
def _(t):
    grouped = search.hits_by_resource(search.semantic_search(centroid_queries(t), vector_chunks(t), 10))
    return grouped.withColumns({c: F.round(c, 6) for c in ("best", "strong_share")})


@query("delete_chunks", "R17", """
SELECT vec_id AS chunk_id, label AS resource_id FROM embeddings WHERE label NOT IN (
  SELECT label FROM embeddings GROUP BY label HAVING count(*) < 50)""")
def _(t):
    small = vector_chunks(t).groupBy("resource_id").count().where("count < 50").select("resource_id")
    return search.delete_resources(vector_chunks(t), small).select("chunk_id", "resource_id")


@query("keyword_containment", "P12", """
SELECT doc_id, (contains(lower(text), 'the')::INT + contains(lower(text), 'ation')::INT
  + contains(lower(text), 'la')::INT) / 3 AS score FROM documents
WHERE contains(lower(text), 'the') OR contains(lower(text), 'ation') OR contains(lower(text), 'la')""".replace(
    "AS score", "AS raw").replace("SELECT doc_id, (", "SELECT doc_id, round((").replace("/ 3 AS raw", "/ 3, 6) AS score"))
def _(t):
    scored = t.spread("documents").select("doc_id", labels.keyword_score("text", "the ation LA").alias("score"))
    return scored.where("score > 0").withColumn("score", F.round("score", 6))


# ---- labels ------------------------------------------------------------------------------------

ASKED = "(SELECT conv_id, turn, text, lower(text) AS q FROM conversations WHERE role = 'user')"


def asked(t):
    return t.spread("conversations").where("role = 'user'")


@query("query_type", "N1", f"""
SELECT conv_id, turn, CASE WHEN {sql_any('q', labels.METADATA_WORDS)} THEN 'metadata_query'
  WHEN a > 0 AND (s > 0 OR u > 0) THEN 'analytical' WHEN s > u THEN 'structured_data'
  WHEN u > s THEN 'unstructured_data' WHEN s > 0 AND u > 0 THEN 'mixed_data' ELSE 'structured_data' END AS type
FROM (SELECT *, {sql_hits('q', labels.STRUCTURED_PATTERNS)} AS s, {sql_hits('q', labels.UNSTRUCTURED_PATTERNS)} AS u,
  {sql_hits('q', labels.ANALYTICAL_PATTERNS)} AS a FROM {ASKED})""")
def _(t):
    return asked(t).select("conv_id", "turn", labels.query_type("text").alias("type"))


def _first_best_sql(source: str, patterns: dict, default: str | None) -> str:
    scores = ", ".join(f"{sql_hits('q', p)}" for p in patterns.values())
    names = ", ".join(f"'{n}'" for n in patterns)
    chosen = "[" + names + "][list_position(scores, list_max(scores))]"
    label = chosen if default is None else f"CASE WHEN list_max(scores) = 0 THEN '{default}' ELSE {chosen} END"
    return f"(SELECT *, {label} AS best, list_max(scores) AS top FROM (SELECT *, [{scores}] AS scores FROM {source}))"


INTENT_SIZES = "MAP {" + ", ".join(f"'{k}': {len(v)}" for k, v in labels.INTENT_PATTERNS.items()) + "}"
INTENTS = f"""(SELECT conv_id, turn, text, q, CASE WHEN top = 0 AND earlier THEN 'follow_up' ELSE best END AS intent,
  CASE WHEN top = 0 AND earlier THEN 0.7 ELSE top / {INTENT_SIZES}[best] END AS confidence, earlier FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 1 AS earlier
  FROM {_first_best_sql(ASKED, labels.INTENT_PATTERNS, None)}))"""


@query("query_intent", "N2", f"SELECT conv_id, turn, intent, round(confidence, 6) AS confidence FROM {INTENTS}")
def _(t):
    labelled = labels.with_intent(labels.user_queries(t.spread("conversations")), "text", F.col("has_history"))
    return labelled.select("conv_id", "turn", "intent", F.round("confidence", 6).alias("confidence"))


@query("analysis_type", "N3", f"""
SELECT conv_id, turn, best AS type FROM {_first_best_sql(ASKED, labels.ANALYSIS_PATTERNS, 'exploratory')}""")
def _(t):
    return asked(t).select("conv_id", "turn", labels.analysis_type("text").alias("type"))


@query("query_routing", "N4", f"""
SELECT conv_id, turn, best AS route, round(least(top / 3.0, 1.0), 6) AS route_confidence,
  CASE best WHEN 'analytical' THEN 'high' WHEN 'metadata_query' THEN 'low' WHEN 'conversational' THEN 'low'
  ELSE 'medium' END AS complexity FROM {_first_best_sql(ASKED, labels.ROUTING_PATTERNS, 'analytical')}""")
def _(t):
    routed = labels.with_routing(asked(t), "text")
    return routed.select("conv_id", "turn", "route", F.round("route_confidence", 6).alias("route_confidence"), "complexity")


def _match_list(patterns: list[str]) -> str:
    """Sorted distinct matches of the first group; doubled separators let neighbours have an edge each."""
    doubled = r"regexp_replace(q, '([^\p{L}\p{N}_-])', '\1\1', 'g')"
    found = ", ".join(f"regexp_extract_all({doubled}, '{re2(p)}', 1)" for p in patterns)
    return rf"list_sort(list_distinct(list_transform(list_concat({found}), lambda m: regexp_replace(m, '\s+', ' ', 'g'))))"


def _matches_sql(patterns: list[str]) -> str:
    return f"array_to_string({_match_list(patterns)}, ',')"


WHOLE_TEMPORAL = [rf"\b({p[2:-2]})\b" for p in labels.TEMPORAL_PATTERNS]
COMPARE_SQL = "list_concat(" + ", ".join(
    f"regexp_extract_all(q, '{re2(p)}', 2)" for p in labels.COMPARISON_PATTERNS) + ")"
IDENTIFIER_SQL = "coalesce(" + ", ".join(
    f"nullif(regexp_extract(text, '{re2(p)}', 1, 'i'), '')" for p in labels.IDENTIFIER_PATTERNS) + ", '')"


@query("extract_references", "N5", f"""
SELECT conv_id, turn, {_matches_sql(labels.ENTITY_PATTERNS)} AS entities, {_matches_sql(WHOLE_TEMPORAL)} AS times,
  array_to_string(list_sort(list_distinct({COMPARE_SQL})), ',') AS compared,
  {IDENTIFIER_SQL} AS identifier FROM (SELECT conv_id, turn, text, lower(text) AS q FROM conversations)""")
def _(t):
    return t.spread("conversations").select(
        "conv_id", "turn", F.array_join(labels.entities("text"), ",").alias("entities"),
        F.array_join(labels.temporal_references("text"), ",").alias("times"),
        F.array_join(labels.comparison_targets("text"), ",").alias("compared"),
        labels.record_identifier("text").alias("identifier"))


@query("needs_clarification", "N6", rf"""
SELECT conv_id, turn, (NOT earlier AND list_has_any(w, ['it', 'that', 'this', 'them', 'those', 'these']))
  OR (len(w) < 3 AND NOT {sql_any('q', labels.REQUEST_VERBS)}) OR len({_match_list(labels.ENTITY_PATTERNS)}) > 3 AS unclear
FROM (SELECT *, list_filter(string_split_regex(q, '{WS}+'), lambda x: x <> '') AS w FROM {INTENTS})""")
def _(t):
    queries = labels.user_queries(t.spread("conversations"))
    return queries.select("conv_id", "turn", labels.needs_clarification("text", F.col("has_history")).alias("unclear"))


SQL_LOG = """CASE event_type
  WHEN 'click' THEN 'SELECT sum(value), count(*) FROM clicks c JOIN users u ON c.user_id = u.id WHERE u.id = ' || user_id
  WHEN 'view' THEN 'select * from views order by ts -- user ' || user_id
  WHEN 'purchase' THEN 'SELECT a.id FROM a JOIN b ON a.id = b.id JOIN c ON b.id = c.id WHERE a.v > (SELECT max(v) FROM d WHERE e = ' || user_id || ') GROUP BY 1 ORDER BY 1'
  WHEN 'error' THEN 'DROP TABLE t; DELETE FROM users WHERE id = ' || user_id
  ELSE 'insert into signups values (' || user_id || ')' END"""


def sql_log(t):
    return t.events.select("event_id", F.expr(SQL_LOG).alias("statement"))


@query("sql_complexity", "N7", f"""
SELECT event_id, score, CASE WHEN score <= 2 THEN 'low' WHEN score <= 5 THEN 'medium' WHEN score <= 10 THEN 'high'
  ELSE 'very_high' END AS level FROM (SELECT event_id, CASE WHEN {sql_any('q', labels.AGGREGATE_TERMS)} THEN 2 ELSE 0 END
  + 3 * len(regexp_extract_all(q, '\\bjoin\\b')) + 2 * (len(regexp_extract_all(q, 'select')) - 1)
  + CASE WHEN contains(q, 'order by') THEN 1 ELSE 0 END + CASE WHEN {sql_any('q', labels.FILTER_TERMS)} THEN 1 ELSE 0 END
  AS score FROM (SELECT event_id, lower({SQL_LOG}) AS q FROM events))""")
def _(t):
    rated = sql_log(t).select("event_id", labels.sql_complexity("statement").alias("rated"))
    return rated.select("event_id", "rated.score", "rated.level")


def _unsafe_sql(text: str) -> str:
    cases = ", ".join(
        f"CASE WHEN regexp_matches({text}, '{re2(p)}', 'i') THEN '{p}' END" for p in labels.UNSAFE_SQL)
    return f"array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ' ')"


@query("unsafe_sql", "P11", f"SELECT event_id, {_unsafe_sql('q')} AS found FROM (SELECT event_id, {SQL_LOG} AS q FROM events)")
def _(t):
    return sql_log(t).select("event_id", F.array_join(labels.unsafe_sql("statement"), " ").alias("found"))


@query("unsafe_text", "P11", f"SELECT conv_id, turn, {_unsafe_sql('text')} AS found FROM conversations")
def _(t):
    return t.spread("conversations").select("conv_id", "turn", F.array_join(labels.unsafe_sql("text"), " ").alias("found"))


@query("blocked_sql", "P11", f"""
SELECT conv_id, turn, array_to_string(list_filter([{", ".join(
    f"CASE WHEN contains(upper(text), '{w}') THEN '{w}' END" for w in labels.BLOCKED_SQL)}], lambda x: x IS NOT NULL), ' ') AS found
FROM conversations""")
def _(t):
    return t.spread("conversations").select("conv_id", "turn", F.array_join(labels.blocked_sql("text"), " ").alias("found"))


def _persona_score(parts: dict) -> str:
    terms = [f"2 * contains(q, '{k.lower()}')::INT" for k in parts["keywords"]]
    terms += [f"contains(q, '{k.lower()}')::INT" for k in parts["indicators"]]
    return f"3 * {sql_hits('q', parts['patterns'])} + " + " + ".join(terms)


PERSONA_SCORES = ", ".join(_persona_score(p) for p in labels.PERSONAS.values())
PERSONA_NAMES = ", ".join(f"'{n}'" for n in labels.PERSONAS)


@query("query_persona", "N8", f"""
SELECT conv_id, turn, [{PERSONA_NAMES}][list_position(s, list_max(s))] AS persona,
  round(list_max(s) / greatest(list_sum(s), 1), 6) AS persona_confidence
FROM (SELECT conv_id, turn, [{PERSONA_SCORES}] AS s FROM (SELECT *, lower(text) AS q FROM conversations))""")
def _(t):
    labelled = labels.with_persona(t.spread("conversations"), "text")
    return labelled.select("conv_id", "turn", "persona", F.round("persona_confidence", 6).alias("persona_confidence"))


def _sector_score(parts: dict) -> str:
    terms = [f"2 * ((length(q) - length(replace(q, '{k}', ''))) // {len(k)})" for k in parts["keywords"]]
    terms += [f"3 * contains(q, '{k}')::INT" for k in parts["fields"]]
    terms += [f"contains(q, '{k}')::INT" for k in parts["metrics"]]
    return " + ".join(terms)


SECTOR_NAMES = ", ".join(f"'{n}'" for n in labels.SECTORS)
SECTOR_SCORES = ", ".join(_sector_score(p) for p in labels.SECTORS.values())
SECTOR_METRICS = ", ".join("[" + ", ".join(f"'{m}'" for m in p["metrics"]) + "]" for p in labels.SECTORS.values())
SECTOR_CHANCES = ", ".join("[" + ", ".join(f"'{m}'" for m in p["opportunities"]) + "]" for p in labels.SECTORS.values())
GENERIC_CASES = ", ".join(
    f"CASE WHEN {sql_any('q', terms)} THEN '{name}' END" for name, terms in labels.GENERIC_OPPORTUNITIES.items())


@query("document_sector", "N9, N10", f"""
SELECT doc_id, [{SECTOR_NAMES}][p] AS sector, list_max(s) AS sector_score,
  array_to_string(list_filter([{SECTOR_METRICS}][p], lambda m: contains(q, m)), ',') AS metrics,
  array_to_string(list_concat(list_filter([{GENERIC_CASES}], lambda x: x IS NOT NULL), [{SECTOR_CHANCES}][p]), ',')
    AS opportunities
FROM (SELECT doc_id, q, s, list_position(s, list_max(s)) AS p FROM (
  SELECT doc_id, q, [{SECTOR_SCORES}] AS s FROM (SELECT doc_id, lower(text) AS q FROM documents)))""")
def _(t):
    labelled = labels.with_sector(t.spread("documents"), "text")
    return labelled.select(
        "doc_id", "sector", "sector_score", F.array_join("sector_metrics", ",").alias("metrics"),
        F.array_join(labels.opportunities("text", F.col("sector")), ",").alias("opportunities"))


ERROR_CHAIN = "CASE " + " ".join(
    f"WHEN {sql_any('q', terms)} THEN '{name}'" for name, terms in labels.ERROR_CATEGORIES.items()) + " ELSE 'unknown' END"
SEVERITY_CHAIN = "CASE category " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in labels.ERROR_SEVERITIES.items()) + " ELSE 'low' END"


@query("error_statistics", "A23", f"""
SELECT category, {SEVERITY_CHAIN} AS severity, count(*) AS errors,
  round(count(*) FILTER (role = 'assistant') * 100.0 / count(*), 4)::DOUBLE AS recovery_rate
FROM (SELECT role, {ERROR_CHAIN} AS category FROM (SELECT role, lower(text) AS q FROM conversations)) GROUP BY category""")
def _(t):
    return labels.error_statistics(t.spread("conversations"), "text", F.col("role") == "assistant")


@query("missing_common_fields", "Q16", f"""
SELECT doc_id, array_to_string(list_filter([{", ".join(
    f"CASE WHEN NOT contains(q, '{f}') THEN '{f}' END" for f in labels.COMMON_FIELDS)}], lambda x: x IS NOT NULL), ',')
    AS missing, {sql_any('q', labels.TEMPORAL_WORDS)} AS has_temporal,
  {sql_any('q', labels.PERFORMANCE_WORDS)} AS has_performance, {sql_any('q', labels.GOAL_WORDS)} AS has_goals,
  {sql_any('q', labels.SKILL_WORDS)} AS has_skills FROM (SELECT doc_id, lower(text) AS q FROM documents)""")
def _(t):
    flags = [value.alias(name) for name, value in labels.presence_flags("text").items()]
    return t.spread("documents").select("doc_id", F.array_join(labels.missing_fields("text"), ",").alias("missing"), *flags)


@query("stripped_lines", "C1", f"""
SELECT conv_id, turn, regexp_replace(text, {STRIP}) AS text FROM conversations""")
def _(t):
    return t.spread("conversations").select("conv_id", "turn", strip("text").alias("text"))
