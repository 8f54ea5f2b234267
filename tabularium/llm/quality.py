"""Quality classifier: document evidence combined with shrunken host and path posteriors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabularium.functions.skew import join_checked
from tabularium.llm.common import cut

TRAINING_ROWS = 20_000  # documented bound of the labelled sample; the lowest hashes of the id are taken
RIDGE = 1.0
FEATURES = 12


def features(text: str | None) -> list[float]:
    """Shares that tell prose from shouting, fragments, repetition and symbol noise; all are of the whole text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words, letters = data.split(), max(1, int(counts[65:91].sum() + counts[97:123].sum()))
    n, size = max(1, len(words)), max(1, len(data))
    symbols = int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum())
    plain = int(counts[44] + counts[46] + counts[39] + counts[45])
    same = sum(map(bytes.__eq__, words, words[1:]))
    lines = data.count(b"\n") + 1
    return [
        1.0, counts[65:91].sum() / letters, (symbols - plain) / size, counts[33] / size, counts[124] / size, same / n,
        len(set(words)) / n, np.log1p(n), size / n / 10, counts[46] / n, counts[48:58].sum() / size, lines / n,
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _features(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: [float(v) for v in features(x if isinstance(x, str) else None)])


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps: ``(weights, centre, scale)`` for standardised features."""
    centre, scale = x.mean(axis=0), x.std(axis=0)
    centre[0], scale[0] = 0.0, 1.0
    scale[scale == 0] = 1.0
    z, w = (x - centre) / scale, np.zeros(x.shape[1])
    ridge = RIDGE * np.eye(x.shape[1])
    ridge[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w, centre, scale


def document_evidence(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", training_rows: int = TRAINING_ROWS
) -> tuple[DataFrame, float]:
    """``docs`` with ``evidence``, and the log odds of the labels. Evidence: log likelihood ratio of good against bad, given the text alone.

    The model is trained on at most ``training_rows`` labelled documents, those with the lowest hash of the id; only
    their feature rows reach the driver. Without labels of both kinds the evidence is zero.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("__y"))
    known = known.orderBy(F.xxhash64(id_col), id_col).limit(training_rows)
    sample = docs.join(F.broadcast(known), id_col).select(id_col, "__y", _features(text_col).alias("x")).orderBy(id_col).limit(training_rows).toPandas()
    y = (sample["__y"].to_numpy(float) > 0).astype(float)
    if not len(y) or y.min() == y.max():
        return docs.withColumn("evidence", F.lit(0.0)), 0.0
    w, centre, scale = fit(np.stack(sample["x"].to_list()), y)
    base = float(np.log(y.mean() / (1 - y.mean())))

    @F.pandas_udf(T.DoubleType())
    def evidence(texts: pd.Series) -> pd.Series:
        x = np.array([features(t if isinstance(t, str) else None) for t in texts], float).reshape(-1, FEATURES)
        return pd.Series(((x - centre) / scale) @ w - base)

    return docs.withColumn("evidence", evidence(F.col(text_col))), base


def _logistic(x):
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(30.0)), F.lit(-30.0))))


def _strength(mean: float, between: float) -> float:
    """Prior weight in documents, by moments: how much groups differ beyond chance; between 1 and 10 000."""
    spread = mean * (1 - mean)
    return max(1.0, min(10_000.0, spread / max(between, spread / 10_000, 1e-12) - 1))


def site_priors(scored: DataFrame) -> DataFrame:
    """``(host, path, n, host_prior, path_prior)`` of ``scored(host, path, p)``: posterior shares of good documents.

    Documents count with their own probability. A host is shrunk towards the global share and a path towards its host;
    each prior weighs as many documents as the variance between the groups of that level suggests. All sums are
    combined before the shuffle, so a host with any share of the rows is one small row from each task. Of the group
    table only two rows of totals reach the driver.
    """
    paths = cut(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    share = F.col("hs") / F.col("hn")
    mean, between = hosts.agg(F.coalesce(F.sum("hs") / F.sum("hn"), F.lit(0.5)), F.coalesce(F.var_pop(share), F.lit(0.0))).first()
    weight = _strength(mean, between)
    inside = paths.join(hosts.withColumn("host_prior", (F.col("hs") + weight * mean) / (F.col("hn") + weight)), "host")
    off = F.col("s") / F.col("n") - share
    within = inside.agg(F.coalesce(F.avg(off * off), F.lit(0.0))).first()[0]
    weight = _strength(mean, within)
    return inside.select("host", "path", "n", "host_prior", ((F.col("s") + weight * F.col("host_prior")) / (F.col("n") + weight)).alias("path_prior"))


def classify(
    docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5
) -> DataFrame:
    """``docs`` with ``evidence``, ``host_prior``, ``path_prior``, ``quality_score`` and ``keep``.

    The score is the posterior of the document: the evidence of its text added to the log odds of its path's prior.
    Null host or path is a site of its own; null and empty texts are scored by their (empty) features. Every row of
    ``docs`` is returned once.
    """
    names = [c for c in docs.columns if c not in ("evidence", "host_prior", "path_prior", "quality_score", "keep")]
    scored, base = document_evidence(docs.select(names), labels, id_col, text_col)
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    scored = scored.withColumns({"__host": key(host), "__path": key(path)})
    own = _logistic(F.col("evidence") + base)
    priors = site_priors(scored.select(F.col("__host").alias("host"), F.col("__path").alias("path"), own.alias("p")))
    priors = priors.select(F.col("host").alias("__host"), F.col("path").alias("__path"), "host_prior", "path_prior")
    both = join_checked(scored, priors, ["__host", "__path"])
    prior = F.least(F.greatest("path_prior", F.lit(1e-6)), F.lit(1 - 1e-6))
    both = both.withColumn("quality_score", _logistic(F.col("evidence") + F.log(prior / (1 - prior))))
    both = both.withColumn("keep", F.col("quality_score") >= threshold)
    return both.select(*[F.col(f"`{c}`") for c in names], "evidence", "host_prior", "path_prior", "quality_score", "keep")


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their own columns."""
    names = docs.columns
    renamed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *[F.col(c) for c in dict.fromkeys([id_col, text_col, host, path])])
    return classify(renamed, labels, host, path, id_col, text_col).where("keep").select("row.*")
