"""Exact quantiles of whole columns without sorting or collecting a column.

A sketch brackets each wanted rank, one pass counts what lies in the bracket, and brackets that
still hold many rows are narrowed again. Only the few values of the final brackets are fetched.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000
FETCH_ROWS = 20_000


def _inside(low: float, high: float, value: Column) -> Column:
    return F.when(value.between(F.lit(low), F.lit(high)), value)


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], fetch_rows: int = FETCH_ROWS
) -> dict[tuple[str, float], float]:
    """{(column, p): quantile} with linear interpolation; nulls are ignored."""
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    wanted = [(c, p) for c in columns for p in probabilities]
    # (column, p) -> [low, high, rows below low, rows in bracket, rows in column]
    state: dict[tuple[str, float], list] = {}
    margin = 3 / ACCURACY
    first = numbers.agg(
        *[F.count(c).alias(f"n_{c}") for c in columns],
        *[F.percentile_approx(c, [x for p in probabilities
                                  for x in (max(0.0, p - margin), min(1.0, p + margin))], ACCURACY).alias(f"q_{c}")
          for c in columns],
    ).first()
    for c in columns:
        for i, p in enumerate(probabilities):
            if first[f"n_{c}"]:
                low, high = first[f"q_{c}"][2 * i], first[f"q_{c}"][2 * i + 1]
                state[c, p] = [low, high, 0, 0, first[f"n_{c}"]]

    def ranks(key) -> tuple[int, int, float]:
        position = key[1] * (state[key][4] - 1)
        return math.floor(position), math.ceil(position), position - math.floor(position)

    open_keys = list(state)
    while open_keys:
        counted = numbers.agg(*[
            x.alias(f"{name}_{j}") for j, key in enumerate(open_keys) for name, x in (
                ("below", F.count_if(F.col(key[0]) < F.lit(state[key][0]))),
                ("inside", F.count_if(F.col(key[0]).between(F.lit(state[key][0]), F.lit(state[key][1])))),
            )
        ]).first()
        wide = []
        for j, key in enumerate(open_keys):
            state[key][2], state[key][3] = counted[f"below_{j}"], counted[f"inside_{j}"]
            low_rank, high_rank, _ = ranks(key)
            if low_rank < state[key][2] or high_rank >= state[key][2] + state[key][3]:
                raise ArithmeticError(f"rank bracket of {key} missed its target")
            if state[key][3] > fetch_rows and state[key][0] < state[key][1]:
                wide.append(key)
        if not wide:
            break
        narrowed = numbers.agg(*[
            F.percentile_approx(
                _inside(state[key][0], state[key][1], F.col(key[0])),
                [max(0.0, (ranks(key)[0] - state[key][2]) / state[key][3] - margin),
                 min(1.0, (ranks(key)[1] + 1 - state[key][2]) / state[key][3] + margin)], ACCURACY,
            ).alias(f"q_{j}") for j, key in enumerate(wide)
        ]).first()
        open_keys = []
        for j, key in enumerate(wide):
            low, high = narrowed[f"q_{j}"]
            if (low, high) != (state[key][0], state[key][1]):
                open_keys.append(key)
            # An unchanged bracket is held by a few repeated values; they are counted per value below.
            state[key][0], state[key][1] = low, high

    fetch = [key for key in state if state[key][0] < state[key][1]]
    values: dict[tuple[str, float], list[tuple[float, int]]] = {
        key: [(state[key][0], state[key][3])] for key in state if key not in fetch
    }
    if fetch:
        cells = F.array_compact(F.array(*[
            F.when(F.col(c).between(F.lit(state[c, p][0]), F.lit(state[c, p][1])),
                   F.struct(F.lit(j).alias("j"), F.col(c).alias("v")))
            for j, (c, p) in enumerate(fetch)
        ]))
        rows = (
            numbers.select(F.explode(cells).alias("x")).groupBy("x.j", "x.v").count().orderBy("j", "v").collect()
        )
        for row in rows:
            values.setdefault(fetch[row["j"]], []).append((row["v"], row["count"]))

    def value_at(key, rank: int) -> float:
        seen = state[key][2]
        for value, count in values[key]:
            seen += count
            if rank < seen:
                return value
        raise ArithmeticError(f"rank {rank} of {key} is outside its bracket")

    result = {}
    for key in wanted:
        if key in state:
            low_rank, high_rank, share = ranks(key)
            low, high = value_at(key, low_rank), value_at(key, high_rank)
            result[key] = low + (high - low) * share
    return result
