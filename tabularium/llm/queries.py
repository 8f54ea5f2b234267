"""Registered queries of the text operators and, where SQL can state them, their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.llm.code_search import nearest_codes, sign_code
from tabularium.llm.decontaminate import contamination
from tabularium.llm.licenses import THRESHOLD, TEMPLATES, license_matches, template_bigrams
from tabularium.llm.main_text import extract_main_text
from tabularium.llm.manifest import lower_ascii, merkle_manifest
from tabularium.llm.pieces import encode_pieces
from tabularium.llm.pseudonyms import pseudonyms
from tabularium.llm.quality import classify
from tabularium.llm.simhash import simhash_components
from tabularium.llm.suffix_dedup import repeated_bytes
from tabularium.llm.token_counts import token_counts
from tabularium.llm.toxicity import fit_toxicity, score_toxicity
from tabularium.llm.vector_codes import ENTRIES, PARTS, ROUNDS, compress
from tabularium.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
PII_KEY = "tabularium-demo-key"  # a deployment passes its own secret


def llm_query(sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[build.__name__] = lambda spark, folder: build(Tables(spark, folder))
        if sql:
            SQL[build.__name__] = sql
        return build

    return register


@llm_query()
def op4_simhash(t: Tables) -> DataFrame:
    return simhash_components(t.documents)


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item, len, array_to_string(w[i:i + len - 1], ' ') AS s FROM (
           SELECT item, w, least(len(w), 13) AS len, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len FROM wins),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
occ AS (SELECT a.doc_id, a.i, l.len, array_to_string(a.w[a.i:a.i + l.len - 1], ' ') AS s FROM pos a, lens l WHERE a.i + l.len - 1 <= len(a.w)),
m AS (SELECT o.doc_id, o.i, o.len, x.item FROM occ o JOIN wins x ON o.s = x.s AND o.len = x.len),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + len)) AS p FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)"""


@llm_query(OP9_SQL)
def op9_decontaminate(t: Tables) -> DataFrame:
    return contamination(t.documents, t.benchmark)


@llm_query()
def op6_quality(t: Tables) -> DataFrame:
    return classify(t.documents, t.labels).drop("text")


@llm_query()
def op7_pieces(t: Tables) -> DataFrame:
    rows = encode_pieces(t.documents.select("doc_id", "text"), PIECE_MODEL, dropout=0.1, seed=7)
    ids = F.col("piece_ids")
    return rows.select("doc_id", F.size(ids).cast("long").alias("n_pieces"), F.sha2(F.array_join(ids, " "), 256).alias("ids_sha256"), "lossless")


@llm_query()
def op8_pii(t: Tables) -> DataFrame:
    rows = pseudonyms(t.documents.select("doc_id", "text"), PII_KEY)
    return rows.select("doc_id", "text", F.size("pii_kinds").cast("long").alias("n_replaced"), "pii_kinds")


_TEMPLATE_ROWS = ", ".join("('{}', [{}])".format(name, ", ".join(f"'{x}'" for x in grams)) for name, grams in template_bigrams(TEMPLATES))
OP10_SQL = rf"""
WITH t(license, tb) AS (VALUES {_TEMPLATE_ROWS}),
u AS (SELECT doc_id, 'line' AS kind, unnest(string_split(coalesce(text, ''), chr(10))) AS unit FROM documents
      UNION ALL SELECT doc_id, 'paragraph', unnest(CASE WHEN regexp_matches(text, '\n[ \t\r]*\n') THEN regexp_split_to_array(text, '\n[ \t\r]*\n') ELSE [] END) FROM documents
      UNION ALL SELECT doc_id, 'text', coalesce(text, '') FROM documents),
w AS (SELECT row_number() OVER () AS k, doc_id, kind, regexp_extract_all(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM u),
b AS (SELECT k, doc_id, kind, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM w WHERE len(w) > 1),
s AS (SELECT k, doc_id, kind, license, 2.0 * len(list_intersect(b, tb)) / (len(b) + len(tb)) AS dice FROM b, t WHERE list_has_any(b, tb)),
m AS (SELECT k, doc_id, kind, license, dice, row_number() OVER (PARTITION BY k ORDER BY dice DESC, license DESC) AS r FROM s WHERE dice >= {THRESHOLD})
SELECT doc_id, license, count_if(kind = 'line') AS n_lines, count_if(kind = 'paragraph') AS n_paragraphs,
       bool_or(kind = 'text') AS whole_text, round(max(dice), 6) AS best_dice
FROM m WHERE r = 1 GROUP BY doc_id, license"""


@llm_query(OP10_SQL)
def op10_licenses(t: Tables) -> DataFrame:
    return license_matches(t.documents)


@llm_query()
def op2_token_counts(t: Tables) -> DataFrame:
    return token_counts(t.documents.select("doc_id", "text"), PIECE_MODEL).drop("text")


@llm_query()
def op3_main_text(t: Tables) -> DataFrame:
    rows = extract_main_text(t.pages.select("page_id", "url", "html"))
    return rows.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


_BITS = " + ".join(f"(CASE WHEN embedding[{i + 1}] > 0 THEN {1 << i}::HUGEINT ELSE 0 END)" for i in range(64))
OP5_SQL = f"""
WITH e AS (SELECT vec_id, {_BITS} AS code FROM embeddings WHERE embedding IS NOT NULL),
d AS (SELECT q.vec_id AS query_id, e.vec_id, bit_count(xor(q.code, e.code)) AS distance FROM e q, e WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(distance AS BIGINT) AS distance FROM r WHERE rank <= 10"""


@llm_query(OP5_SQL)
def op5_code_search(t: Tables) -> DataFrame:
    coded = t.embeddings.select("vec_id", sign_code("embedding").alias("code"))
    return nearest_codes(coded, coded.where("vec_id % 20 = 0"), k=10)


@llm_query()
def op1_suffix_dedup(t: Tables) -> DataFrame:
    return repeated_bytes(t.documents)


_LEVELS = 6  # of the SQL below: 16 ** 6 documents of a source, and as many sources
_CRC_NIBBLES = [
    0x00000000, 0x1DB71064, 0x3B6E20C8, 0x26D930AC, 0x76DC4190, 0x6B6B51F4, 0x4DB26158, 0x5005713C,
    0xEDB88320, 0xF00F9344, 0xD6D6A3E8, 0xCB61B38C, 0x9B64C2B0, 0x86D3D2D4, 0xA00AE278, 0xBDBDF21C,
]  # fixed values: the CRC-32 remainders of the sixteen half bytes


def crc32_sql(text: str) -> str:
    """CRC-32 of the ASCII text of a DuckDB expression, half byte by half byte."""
    half = "xor((c >> 4), [{}][(c & 15) + 1])".format(", ".join(f"{v}::BIGINT" for v in _CRC_NIBBLES))
    step = f"list_transform([list_transform([xor(c, b)], lambda c: {half})[1]], lambda c: {half})[1]"
    return f"xor(4294967295, list_reduce([4294967295] || list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT), lambda c, b: {step}))"


def _field_sql(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


def _tree_sql(name: str, leaves: str) -> tuple[str, str]:
    """Levels of the trees over ``leaves(g, pos, d)``: CTEs ``name0`` to ``name6`` (the runs of a level, with their digest)
    and the joins that add the siblings of a node at ``pos``."""
    parts, joins, below = [], [], leaves
    for k in range(_LEVELS):
        parts.append(
            f"{name}{k} AS (SELECT *, CASE WHEN done THEN kids[1] ELSE sha256(array_to_string(kids, '')) END AS d FROM (SELECT *, "
            f"len(kids) = 1 AND count(*) OVER (PARTITION BY g) = 1 AS done FROM (SELECT g, pos // 16 AS pos, list(d ORDER BY pos) AS kids "
            f"FROM {below} GROUP BY g, pos // 16)))"
        )
        joins.append(f"JOIN {name}{k} ON {name}{k}.g IS NOT DISTINCT FROM it.g AND {name}{k}.pos = it.pos // {16 ** (k + 1)}")
        below = f"{name}{k}"
    return ", ".join(parts), " ".join(joins)


def _climb_sql(name: str, start: str) -> tuple[str, str, str]:
    """Chained column definitions: folded digest and siblings through the levels of ``name``."""
    columns, folded, siblings = [], start, []
    for k in range(_LEVELS):
        slot = f"(it.pos // {16 ** k}) % 16"
        left, right = f"array_to_string({name}{k}.kids[1:{slot}], '')", f"array_to_string({name}{k}.kids[{slot} + 2:], '')"
        columns.append(f"CASE WHEN {name}{k}.done THEN {folded} ELSE sha256({left} || {folded} || {right}) END AS f{k}")
        siblings.append(f"{left} || {right}")
        folded = f"f{k}"
    return ", ".join(columns), folded, " || ".join(siblings)


def _manifest_sql() -> str:
    own, own_joins = _tree_sql("own", "leaves")
    top, top_joins = _tree_sql("top", "subs")
    own_columns, own_fold, own_siblings = _climb_sql("own", "it.t")
    top_columns, top_fold, top_siblings = _climb_sql("top", "it.t")
    fields = ["doc_id", "source", "lang", "n_chars"]
    leaf = " || ".join(_field_sql(c) for c in fields)
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH hashed AS (SELECT doc_id, source AS g, sha256({leaf} || {_field_sql("text")}) AS d,
  sha256({leaf} || CASE WHEN doc_id IS NOT NULL AND {crc32_sql("doc_id::VARCHAR")} % 5 = 0 THEN {_field_sql(lower)} ELSE {_field_sql("text")} END) AS t FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS pos FROM hashed),
{own},
subs AS (SELECT 'all' AS g, g AS name, d, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos FROM own{_LEVELS - 1}),
{top},
low AS (SELECT it.doc_id, it.g, it.d, {own_columns}, {own_fold} AS t, {own_siblings} AS siblings FROM leaves it {own_joins}),
it AS (SELECT low.doc_id, low.d AS leaf, low.t, low.siblings, subs.g, subs.pos, subs.d AS subroot FROM low JOIN subs ON low.g IS NOT DISTINCT FROM subs.name),
high AS (SELECT it.doc_id, it.leaf, it.subroot, top{_LEVELS - 1}.d AS root, it.siblings || {top_siblings} AS siblings, {top_columns}, {top_fold} AS folded FROM it {top_joins})
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM high"""


@llm_query(_manifest_sql())
def op12_manifest(t: Tables) -> DataFrame:
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    return merkle_manifest(t.documents, fields, "doc_id", "source", {"text": lower_ascii(F.col("text"))}, tampered).drop("n_siblings")


def _codes_sql() -> str:
    # a squared distance and an entry number in one integer: the smallest one is the nearest entry, ties to the lower
    nearest = (
        f"SELECT v.vec_id, v.label, v.p, any_value(v.x) AS x, min({ENTRIES} * list_sum(list_transform(range(1, len(v.x) + 1), "
        "lambda i: (v.x[i] - c.e[i]) * (v.x[i] - c.e[i])))::BIGINT + c.k) AS best FROM parts v JOIN {book} c USING (p) GROUP BY v.vec_id, v.label, v.p"
    )
    steps, book = [], "book0"
    for r in range(1, ROUNDS + 1):
        steps.append(f"near{r} AS ({nearest.format(book=book)})")
        steps.append(
            f"means{r} AS (SELECT p, k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS e FROM (SELECT p, best % {ENTRIES} AS k, i, sum(x[i])::BIGINT AS s, "
            f"count(*) AS n FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM near{r}) GROUP BY ALL) GROUP BY p, k)"
        )
        steps.append(f"book{r} AS (SELECT p, k, coalesce(m.e, b.e) AS e FROM {book} b LEFT JOIN means{r} m USING (p, k))")
        book = f"book{r}"
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, label, p, q[len(q) // {PARTS} * p + 1:len(q) // {PARTS} * (p + 1)] AS x FROM kept, range({PARTS}) r(p)),
book0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, x AS e FROM parts QUALIFY k < {ENTRIES}),
{", ".join(steps)},
last AS ({nearest.format(book=book)}),
rows AS (SELECT vec_id, label, string_agg(lower(printf('%02x', best % {ENTRIES})), '' ORDER BY p) AS code, sum(best // {ENTRIES})::BIGINT AS error FROM last GROUP BY vec_id, label),
books AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM {book})
SELECT vec_id, label, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM rows, books"""


@llm_query(_codes_sql())
def op13_vector_codes(t: Tables) -> DataFrame:
    return compress(t.embeddings)


@llm_query()
def op11_toxicity(t: Tables) -> DataFrame:
    held_out = lambda doc_id: F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0
    machine = fit_toxicity(t.documents, t.labels, lambda doc_id: ~held_out(doc_id))
    rows = score_toxicity(t.documents.select("doc_id", "text"), machine)
    return rows.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "witness"
    )
