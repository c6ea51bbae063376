"""Selections that depend on what was selected before.

They are inherently sequential, so what reaches the sequential part is first cut natively to what it can use: a pool of
the best per group, or per cell of rows that no rule tells apart. Its size depends on parameters, not on the data.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Penalty of a repeated source, most of a source, budget, dedup thresholds.
REPEAT_PENALTY, MOST_OF_SOURCE, TOKEN_BUDGET = 0.08, 2, 900
LEAST_TOKENS, SAME_SOURCE, ANY_SOURCE = 12, 0.82, 0.96
#: The best that a selection is made from.
POOL = 30


def repeats(a: Mapping, b: Mapping) -> bool:
    """The same id or text, or token sets that are too alike."""
    if a["id"] == b["id"] or a["norm"] == b["norm"]:
        return True
    x, y = a["set"], b["set"]
    if min(len(x), len(y)) < LEAST_TOKENS:
        return False
    alike = len(x & y) / len(x | y)
    return alike >= ANY_SOURCE or (a["source"] == b["source"] and alike >= SAME_SOURCE)


def diverse(items: Sequence[dict], k: int) -> list[dict]:
    """Up to k items: each turn takes the best after penalties that fits; what does not fit is passed over."""
    chosen: list[dict] = []
    left = list(items)
    while left and len(chosen) < k:
        used = sum(c["cost"] for c in chosen)
        times = {s: sum(c["source"] == s for c in chosen) for s in {i["source"] for i in left}}
        left.sort(key=lambda i: (-(i["base"] - REPEAT_PENALTY * times[i["source"]]), -i["similarity"], i["source"], i["id"]))
        fit = next((i for i in left if times[i["source"]] < MOST_OF_SOURCE and used + i["cost"] <= TOKEN_BUDGET and not any(repeats(i, c) for c in chosen)), None)
        if fit is None:
            break
        chosen.append(fit)
        left.remove(fit)
    return chosen


def pooled(scored: DataFrame, by: Sequence[str], pool: int = POOL) -> DataFrame:
    """The best ``pool`` rows of each group."""
    best = Window.partitionBy(*by).orderBy(F.desc("base"), F.desc("similarity"), "source", "id")
    return scored.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= pool)


def diverse_top(scored: DataFrame, by: Sequence[str], k: int = 3, pool: int = POOL) -> DataFrame:
    """by, id, rank. ``scored``: by, id, source, base, similarity, norm, tokens, cost. Each group's task gets ``pool``
    rows at most; the pool is taken after all rows are scored. A row over the budget alone can't be selected."""
    fit = pooled(scored, by, pool).where(F.col("cost") <= TOKEN_BUDGET)
    kinds = dict(scored.dtypes)

    def select(frame: pd.DataFrame) -> pd.DataFrame:
        items = [{**r, "set": set(r["tokens"])} for r in frame.to_dict("records")]
        picked = diverse(items, k)
        return pd.DataFrame({**{c: [i[c] for i in picked] for c in (*by, "id")}, "rank": range(1, len(picked) + 1)})

    return fit.groupBy(*by).applyInPandas(select, ", ".join(f"{c} {kinds[c]}" for c in (*by, "id")) + ", rank long")


def largest_remainder(total: int, ratios: Mapping[str, float]) -> dict[str, int]:
    """Whole parts of ``total``; what is left goes to the largest remainders, then in order."""
    raw = {k: total * v for k, v in ratios.items()}
    out = {k: math.floor(v) for k, v in raw.items()}
    order = sorted(ratios, key=lambda k: (-(raw[k] - out[k]), list(ratios).index(k)))
    for k in order[: total - sum(out.values())]:
        out[k] += 1
    return out


def with_capacity(total: int, weights: Mapping[str, float], capacities: Mapping[str, int]) -> dict[str, int]:
    """Shares of ``total`` by weight within capacities: rounds over those with room, whole shares first, then one each by
    the largest remainder."""
    out = dict.fromkeys(weights, 0)
    left = total
    names = list(weights)
    while left > 0:
        room = [k for k in names if out[k] < capacities.get(k, 0)]
        mass = sum(max(0.0, weights[k]) for k in room)
        if not room:
            break
        before = left
        if mass <= 0:
            for k in room[:left]:
                out[k] += 1
            left = total - sum(out.values())
            continue
        share = {k: before * max(0.0, weights[k]) / mass for k in room}
        for k in room:
            out[k] += min(capacities[k] - out[k], math.floor(share[k]))
        left = total - sum(out.values())
        for k in sorted(room, key=lambda k: (-(share[k] % 1), names.index(k))):
            if left > 0 and out[k] < capacities[k]:
                out[k] += 1
                left -= 1
        if left == before:
            break
    return out


def capped(candidates: DataFrame, caps: Mapping[str, int], total: int) -> DataFrame:
    """id and rank of the selection in order of priority under caps on the values of columns.

    ``candidates``: id, priority columns p1..p3 (ascending), and the capped columns. Rows that agree in all capped
    columns form a cell; of a cell no more than its least cap can be selected, so only so many reach the last task.
    """
    columns = list(caps)
    order = Window.partitionBy(*columns).orderBy("p1", "p2", "p3", "id")
    kept = candidates.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= min(total, *caps.values()))

    def select(frame: pd.DataFrame) -> pd.DataFrame:
        used: dict[tuple, int] = {}
        picked = []
        for r in frame.sort_values(["p1", "p2", "p3", "id"]).to_dict("records"):
            if len(picked) < total and all(used.get((c, r[c]), 0) < n for c, n in caps.items()):
                picked.append(r["id"])
                for c in columns:
                    used[c, r[c]] = used.get((c, r[c]), 0) + 1
        return pd.DataFrame({"id": picked, "rank": range(1, len(picked) + 1)})

    return kept.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(select, f"id {dict(candidates.dtypes)['id']}, rank long")
