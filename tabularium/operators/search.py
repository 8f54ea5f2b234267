"""Keyword, vector, hybrid and diversity-ranked search over a chunk table.

A search is one scan of the chunks: the few queries travel as literals, every task keeps its best
rows per query, and only those meet in the ranking shuffle. Larger query sets run in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabularium.functions.skew import join_checked
from tabularium.functions.text import jaccard, let, let_sql, quote, weight_sql, words
from tabularium.session import new_scratch

# Synonyms, stop words, prefixes and weights that must equal the reference's.
SYNONYMS = {
    "find": "search", "search": "find", "show": "display", "display": "show", "get": "retrieve", "retrieve": "get",
    "data": "information", "information": "data", "document": "file", "file": "document",
}
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was",
    "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should",
    "may", "might", "can", "must",
]
SEMANTIC_WEIGHT, KEYWORD_WEIGHT, BOTH_BOOST = 0.7, 0.3, 1.2
MMR_LAMBDA, MMR_POOL, HYBRID_POOL = 0.7, 3, 2

QUERY_BLOCK = 500


def query_variations(df: DataFrame, key: str, text: str) -> DataFrame:
    """Original query, one synonym swap, one reformulation, the query without stop words (if different)."""
    query = F.col(text)
    synonyms = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])

    def swap_first(tokens: Column) -> Column:
        known = F.transform(tokens, lambda w: F.map_contains_key(synonyms, w))
        return let(F.array_position(known, True), lambda first: F.array_join(
            F.transform(tokens, lambda w, i: F.when(i + 1 == first, synonyms[w]).otherwise(w)), " "))

    lowered = words(F.lower(query))
    swapped = let(lowered, swap_first)
    reformulated = (
        F.when(query.startswith("find"), F.regexp_replace(query, "^find", "what is"))
        .when(query.startswith("what"), F.regexp_replace(query, "(?s)^(.*?)what is", "$1find"))
        .when(query.startswith("show"), F.regexp_replace(query, "^show", "list"))
        .when(query.startswith("how"), F.regexp_replace(query, "^how", "what is the process for"))
        .otherwise(query)
    )
    keywords = F.array_join(F.filter(lowered, lambda w: ~w.isin(STOP_WORDS)), " ")
    options = F.array(query, swapped, reformulated, keywords)
    chosen = F.filter(options, lambda v, i: (i == 0) | ((v != "") & (v != query)))
    return df.select(key, F.posexplode(chosen).alias("variation", "query"))


def _literal(value) -> str:
    return quote(value) if isinstance(value, str) else str(value)


def _in_blocks(queries: DataFrame, run: Callable[[list[Row]], DataFrame], block: int = QUERY_BLOCK) -> DataFrame:
    """Run a search for about ``block`` queries at a time, so query literals stay bounded.

    All variations of a query stay in one block.
    """
    rows = queries.limit(block + 1).collect()
    if len(rows) <= block:
        return run(sorted(rows, key=lambda r: (str(r["query_id"]), r["variation"])))
    spark = queries.sparkSession
    path, part, n = new_scratch(spark, "search"), [], 0
    for row in queries.orderBy("query_id", "variation").toLocalIterator():
        if len(part) >= block and row["query_id"] != part[-1]["query_id"]:
            run(part).write.parquet(f"{path}/block={n}")
            part, n = [], n + 1
        part.append(row)
    run(part).write.parquet(f"{path}/block={n}")
    return spark.read.parquet(path).drop("block")


def _best(hits: DataFrame, n: int, *ties: str) -> DataFrame:
    ranking = W.partitionBy("query_id").orderBy(F.desc("relevance"), *ties, "chunk_id")
    return hits.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= n)


def _scan_vectors(chunks: DataFrame, rows: list[Row], n: int, per_resource: bool, types: dict[str, str]) -> DataFrame:
    """Distances of all chunks to a block of queries, already cut to the best per Arrow batch.

    A batch hands on its best ``n`` per query, or per query and resource.
    """
    chunks = chunks.where(F.col("embedding").isNotNull())
    vectors = [(r["query_id"], r["variation"], np.asarray(r["vector"], dtype=np.float64)) for r in rows]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            points = np.stack(batch["embedding"].to_numpy()).astype(np.float64)
            ids, owners = batch["chunk_id"].to_numpy(), batch["resource_id"].to_numpy()
            for query_id, variation, vector in vectors:
                distance = ((points - vector) ** 2).sum(axis=1)
                if per_resource:
                    order = np.lexsort((ids, distance))
                    keep = order[pd.Series(owners[order]).groupby(owners[order], sort=False).cumcount().to_numpy() < n]
                elif len(distance) > n:
                    # Ties with the n-th distance stay in; the ranking after the shuffle decides them.
                    keep = np.flatnonzero(distance <= np.partition(distance, n - 1)[n - 1])
                else:
                    keep = np.arange(len(distance))
                yield pd.DataFrame({"query_id": query_id, "variation": variation, "resource_id": owners[keep],
                                    "chunk_id": ids[keep], "distance": distance[keep]})

    schema = (f"query_id {types['query_id']}, variation int, resource_id {types['resource_id']}, "
              f"chunk_id {types['chunk_id']}, distance double")
    return chunks.select("resource_id", "chunk_id", "embedding").mapInPandas(scan, schema)


def _types(queries: DataFrame, chunks: DataFrame) -> dict[str, str]:
    return {"query_id": queries.schema["query_id"].dataType.simpleString()} | {
        c: chunks.schema[c].dataType.simpleString() for c in ("resource_id", "chunk_id")}


def nearest_chunks(queries: DataFrame, chunks: DataFrame, n: int) -> DataFrame:
    """Per query, variation and resource the ``n`` chunks of smallest squared distance.

    queries(query_id, variation, vector), chunks(resource_id, chunk_id, embedding).
    """
    types = _types(queries, chunks)
    ranking = W.partitionBy("query_id", "variation", "resource_id").orderBy("distance", "chunk_id")

    def run(rows: list[Row]) -> DataFrame:
        hits = _scan_vectors(chunks, rows, n, True, types)
        return hits.withColumn("__r", F.row_number().over(ranking)).where(F.col("__r") <= n).drop("__r")

    return _in_blocks(queries, run)


def semantic_search(queries: DataFrame, chunks: DataFrame, n: int) -> DataFrame:
    """Best ``n`` chunks per query over all its variations and resources.

    A chunk found by several variations keeps the hit of the earliest one. Without variations the best
    chunks overall are the best of the best per resource, so every batch hands on ``n`` rows per query.
    """
    types = _types(queries, chunks)
    relevance = F.greatest(F.lit(0.0), 1.0 - F.col("distance"))
    per_resource = W.partitionBy("query_id", "variation", "resource_id").orderBy("distance", "chunk_id")
    seen = W.partitionBy("query_id", "chunk_id").orderBy("variation")

    def run(rows: list[Row]) -> DataFrame:
        varied = len({r["query_id"] for r in rows}) < len(rows)
        hits = _scan_vectors(chunks, rows, n, varied, types)
        if varied:
            hits = hits.withColumn("__r", F.row_number().over(per_resource)).where(F.col("__r") <= n).drop("__r")
            hits = hits.withColumn("__s", F.row_number().over(seen)).where("__s = 1").drop("__s")
        return _best(hits.withColumn("relevance", relevance), n, "distance")

    return _in_blocks(queries, run)


def keyword_search(queries: DataFrame, chunks: DataFrame, n: int, text: str = "text") -> DataFrame:
    """Share of query terms that occur in the chunk; queries(query_id, variation, query).

    All variations are scored on the row, the earliest that hits is kept there, so only ranked rows move.
    """

    def run(rows: list[Row]) -> DataFrame:
        by_query: dict = {}
        for r in rows:
            terms = r["query"].lower().split()
            if terms:
                found = f"int({weight_sql('__body', terms, 1)})"
                hit = (f"named_struct('query_id', {_literal(r['query_id'])}, 'variation', {int(r['variation'])}, "
                       f"'relevance', found / {len(terms)})")
                by_query.setdefault(r["query_id"], []).append(let_sql(found, "found", f"IF(found > 0, {hit}, NULL)"))
        entries = ", ".join(f"coalesce({', '.join(hits)})" for hits in by_query.values())
        lowered = chunks.select("resource_id", "chunk_id", F.lower(F.col(text)).alias("__body"))
        hits = F.explode(F.expr(f"array_compact(array({entries}))"))
        return _best(lowered.select("resource_id", "chunk_id", hits.alias("hit")).select("hit.*", "resource_id", "chunk_id"), n)

    return _in_blocks(queries, run)


def hybrid_search(
    vector_queries: DataFrame, text_queries: DataFrame, chunks: DataFrame, n: int,
    semantic_weight: float = SEMANTIC_WEIGHT, keyword_weight: float = KEYWORD_WEIGHT,
) -> DataFrame:
    """Join the best ``2n`` of both searches; a chunk found by both gets the boosted weighted score."""
    semantic = semantic_search(vector_queries, chunks, n * HYBRID_POOL)
    keyword = keyword_search(text_queries, chunks, n * HYBRID_POOL)
    s = semantic.select("query_id", "chunk_id", "resource_id", F.col("relevance").alias("s"))
    k = keyword.select("query_id", "chunk_id", F.col("resource_id").alias("k_resource"), F.col("relevance").alias("k"))
    both = F.least(F.lit(1.0), BOTH_BOOST * (semantic_weight * F.col("s") + keyword_weight * F.col("k")))
    joined = s.join(k, ["query_id", "chunk_id"], "outer").select(
        "query_id", "chunk_id", F.coalesce("resource_id", "k_resource").alias("resource_id"),
        F.coalesce(both, "s", "k").alias("relevance"))
    return _best(joined, n)


def mmr_search(queries: DataFrame, chunks: DataFrame, n: int, trade_off: float = MMR_LAMBDA) -> DataFrame:
    """Re-rank the best ``3n`` chunks per query for diversity; chunks also carry ``text``.

    Each group holds at most ``3n`` rows, so one task per query is enough.
    """
    pool = semantic_search(queries, chunks, n * MMR_POOL)
    schema = (
        f"query_id {pool.schema['query_id'].dataType.simpleString()}, "
        f"chunk_id {pool.schema['chunk_id'].dataType.simpleString()}, relevance double, pick int, mmr double"
    )

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank").reset_index(drop=True)
        sets = [set(w) for w in group["words"]]
        relevance = group["relevance"].to_numpy()
        closest = np.zeros(len(group))
        open_rows, chosen, scores = list(range(1, len(group))), [0], [trade_off * relevance[0]]
        while open_rows and len(chosen) < n:
            for i in open_rows:
                closest[i] = max(closest[i], _overlap(sets[i], sets[chosen[-1]]))
            gain = [trade_off * relevance[i] - (1 - trade_off) * closest[i] for i in open_rows]
            best = int(np.argmax(gain))
            if gain[best] <= -1:
                break
            scores.append(gain[best])
            chosen.append(open_rows.pop(best))
        result = group.loc[chosen, ["query_id", "chunk_id", "relevance"]]
        return result.assign(pick=np.arange(1, len(chosen) + 1, dtype="int32"), mmr=scores)

    # only the texts of the pool are cut into words; the few pool rows go to the chunks, not the corpus to them
    found = join_checked(chunks.select("chunk_id", "text"), pool, ["chunk_id"])
    found = found.withColumn("words", F.coalesce(F.array_distinct(words(F.lower("text"))), F.array().cast("array<string>")))
    return found.drop("text").groupBy("query_id").applyInPandas(pick, schema)


def _overlap(a: set, b: set) -> float:
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def text_similarity(left: Column | str, right: Column | str) -> Column:
    """Jaccard similarity of the whitespace word sets."""
    sets = [F.array_distinct(words(F.lower(F.col(c) if isinstance(c, str) else c))) for c in (left, right)]
    return jaccard(*sets)


def hits_by_resource(hits: DataFrame, strong: float = 0.8) -> DataFrame:
    """Hits per resource, best relevance and share of strong hits."""
    return hits.groupBy("resource_id").agg(
        F.count(F.lit(1)).alias("hits"), F.max("relevance").alias("best"),
        (F.count_if(F.col("relevance") > strong) / F.count(F.lit(1))).alias("strong_share"))


def corpus_statistics(chunks: DataFrame) -> DataFrame:
    """Chunks per resource and, in the row without a resource, corpus totals."""
    return chunks.rollup("resource_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("tokens"))


def delete_resources(chunks: DataFrame, removed: DataFrame) -> DataFrame:
    """Chunks without those of removed resources."""
    return chunks.join(removed, "resource_id", "left_anti")

