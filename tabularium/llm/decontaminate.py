"""Benchmark passages in documents: prefix-filtered set join of word shingles. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabularium.functions.skew import join_checked
from tabularium.llm.common import cut, text_key

WINDOW = 13
SHINGLE = 3
MAX_LOCAL_SHINGLES = 500_000  # rows of three words: some 50 MB

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> Column:
    """Words of a text column after lower-casing A-Z; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_WORD), 0)


def _windows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct windows: ``words``, the ``items`` they occur in."""
    words = items.select(F.col(id_col).cast("string").alias("item"), words_of(text_col).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - WINDOW + 1, F.lit(1)))
    cuts = words.withColumn("i", F.explode(starts)).select("item", F.expr(f"slice(w, i, {WINDOW})").alias("words"))
    return cuts.groupBy("words").agg(F.collect_set("item").alias("items"))


def _shingles(words: str, size: int) -> Column:
    """Shingles of an array of words in order; an array of fewer words is one shingle."""
    last = F.greatest(F.size(words) - size + 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.slice(words, i, size))


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``(id, n_words, n_hit, n_items, items_sha256, contaminated)``, one row per row of ``docs``.

    A window is 13 consecutive words of an item, or the whole item if it has fewer words. A document word inside any
    occurrence of a window is hit; a document is contaminated if a word is hit and a twentieth of its words at least.

    A window is the set of its three-word shingles (a window of one or two words is one shingle). Shingles are ordered
    by how often they occur in the documents; as a window must be contained whole, its necessary prefix is the rarest
    one, and only that is joined. Length and position bounds follow from where the shingle stands in the window, and
    the shingles found around it are compared with the window's, which verifies every word. The documents are read once:
    each position that starts a shingle of some item becomes a small row; no text is shuffled.

    Null and wordless texts have no words and no hits. Items without words are ignored; items with a null id hit words
    but are not listed. Rows with equal ids each get a row.
    """
    windows = _windows(items, item_col, item_text).withColumn("sh", _shingles("words", SHINGLE))
    windows = cut(windows.withColumn("win", F.xxhash64("words")))
    known = windows.select(F.explode("sh").alias("s")).distinct()
    known = cut(known.select("s", F.size("s").alias("k"), F.row_number().over(W.orderBy("s")).alias("sid")))
    sizes = sorted(r["k"] for r in known.select("k").distinct().collect())  # 1, 2 or 3

    # one row per word position: the word and the two after it
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), words_of(text_col).alias("w"))
    n = F.size("w")
    after = [F.expr(f"slice(w, {i + 1}, size(w))") for i in range(1, SHINGLE)]
    rows = rows.select("rid", "id", n.alias("n"), F.posexplode_outer(F.arrays_zip(F.col("w").alias("w0"), *[a.alias(f"w{i}") for i, a in enumerate(after, 1)])))
    rows = rows.select("rid", "id", "n", "pos", *[F.col(f"col.w{i}").alias(f"w{i}") for i in range(SHINGLE)])
    for k in sizes:
        own = known.where(F.col("k") == k).select(*[F.col("s")[i].alias(f"w{i}") for i in range(k)], F.col("sid").alias(f"sid{k}"))
        rows = join_checked(rows, own, [f"w{i}" for i in range(k)], "left", MAX_LOCAL_SHINGLES)
    sids = [F.struct(F.lit(k).alias("k"), F.col(f"sid{k}").alias("sid")) for k in sizes]
    found = F.filter(F.array(*sids), lambda x: x["sid"].isNotNull()) if sids else F.array().cast("array<struct<k:int,sid:int>>")
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0  # each document keeps its first position, for its number of words
    rows = rows.withColumn("found", found).where((F.size("found") > 0) | first)
    rows = cut(rows.select("rid", "id", "n", "pos", F.explode_outer("found").alias("f")).select("rid", "id", "n", "pos", "f.k", "f.sid"))
    hits = rows.where("sid is not null")

    # the rarest shingle of each window, and where it stands there
    counts = hits.groupBy("sid").agg(F.count(F.lit(1)).alias("df"))
    ids = known.join(counts, "sid")  # shingles that no document has cannot start a match
    posted = windows.select("win", F.size("words").alias("len"), F.size("sh").alias("n_sh"), F.posexplode("sh").alias("off", "s"))
    posted = posted.join(ids, "s").select("win", "len", "n_sh", "off", "sid", "k", "df")
    whole = posted.groupBy("win", "len", "n_sh").agg(
        F.min(F.struct("df", "sid", "off")).alias("rare"),
        F.transform(F.array_sort(F.collect_list(F.struct("off", "sid"))), lambda x: x["sid"]).alias("sids"),
    ).where(F.size("sids") == F.col("n_sh"))
    prefix = whole.groupBy(F.col("rare.sid").alias("sid")).agg(F.collect_list(F.struct("win", "len", F.col("rare.off").alias("off"), "sids")).alias("wins"))

    # the shingles around each position, in one sort by document
    reach = WINDOW - SHINGLE
    around = W.partitionBy("rid", "k").orderBy("pos").rangeBetween(-reach, reach)
    context = hits.withColumn("near", F.collect_list(F.struct("pos", "sid")).over(around))
    candidates = join_checked(context, prefix, ["sid"], "inner", MAX_LOCAL_SHINGLES)
    start = lambda x: F.col("pos") - x["off"]
    same = lambda x: F.transform(
        F.filter("near", lambda p: (p["pos"] >= start(x)) & (p["pos"] < start(x) + F.size(x["sids"]))), lambda p: p["sid"]
    ) == x["sids"]
    fits = F.filter("wins", lambda x: (start(x) >= 0) & (start(x) + x["len"] <= F.col("n")) & same(x))
    matched = candidates.select("rid", F.explode(F.transform(fits, lambda x: F.struct(start(x).alias("start"), x["len"].alias("len"), x["win"].alias("win")))).alias("m"))
    matched = cut(matched.select("rid", "m.*"))

    # words hit: the union of the occurrences; items: those of the windows
    spans = matched.groupBy("rid", "start").agg((F.col("start") + F.max("len")).alias("stop"))
    earlier = F.max("stop").over(W.partitionBy("rid").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    n_hit = spans.withColumn("upto", F.coalesce(earlier, F.lit(0))).groupBy("rid").agg(
        F.sum(F.greatest(F.col("stop") - F.greatest("start", "upto"), F.lit(0))).alias("n_hit")
    )
    listed = join_checked(matched.select("rid", "win").distinct(), windows.select("win", "items"), ["win"], "inner", MAX_LOCAL_SHINGLES)
    listed = listed.groupBy("rid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    per_doc = rows.where(first).select("rid", "id", "n").distinct().join(n_hit, "rid", "left").join(listed, "rid", "left")
    n_words, hit = F.greatest(F.col("n"), F.lit(0)).cast("long"), F.coalesce("n_hit", F.lit(0)).cast("long")
    names = F.coalesce("items", F.array().cast("array<string>"))
    return per_doc.select(
        F.col("id").alias(id_col), n_words.alias("n_words"), hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), ((hit > 0) & (20 * hit >= n_words)).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated. The text alone decides, so ids may be null or repeated."""
    keyed = docs.withColumn("__key", text_key(text_col))
    gone = contamination(keyed, items, "__key", text_col).where("contaminated").select("__key").distinct()
    return keyed.join(gone, "__key", "left_anti").select(*[f"`{c}`" for c in docs.columns])
