"""Exact quantiles and most frequent values without holding a column's different values in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024  # of an interval, in each round of counting


def most_frequent(df: DataFrame, column: str):
    """Ties: the smallest value. None without any value."""
    top = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).count().orderBy(F.desc("count"), "v").first()
    return top["v"] if top else None


def quantiles(df: DataFrame, column: str, probs: list[float]) -> list[float] | None:
    """Linearly interpolated quantiles; None without any value. Each round counts the rows of an interval by equal parts
    of its range and goes on with the part that holds the wanted rank, from its least to its largest value."""
    x = df.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    n, lo, hi = x.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    at = [p * (n - 1) for p in probs]
    wanted = sorted({f(a) for a in at for f in (math.floor, math.ceil)})
    found: dict[int, float] = {}
    open_ = {r: (lo, hi, 0) for r in wanted}  # rank -> least and largest value of its interval, rows below
    while open_:
        spans = sorted({s[:2] for s in open_.values()})
        cases = F.coalesce(*(F.when(F.col("v").between(a, b), F.struct(F.lit(i).alias("i"), _part(a, b).alias("k"))) for i, (a, b) in enumerate(spans)))
        rows = x.select("v", cases.alias("s")).where("s is not null").groupBy("s.i", "s.k").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()
        parts: dict[int, list] = {}
        for r in sorted(rows, key=lambda r: (r["i"], r["k"])):
            parts.setdefault(r["i"], []).append(r)
        later = {}
        for rank, (a, b, below) in open_.items():
            for r in parts[spans.index((a, b))]:
                if rank < below + r["n"]:
                    break
                below += r["n"]
            if rank == below or r["a"] == r["b"]:
                found[rank] = r["a"]
            elif rank == below + r["n"] - 1:
                found[rank] = r["b"]
            else:
                later[rank] = (r["a"], r["b"], below)
        open_ = later
    return [found[math.floor(a)] + (found[math.ceil(a)] - found[math.floor(a)]) * (a - math.floor(a)) for a in at]


def _part(a: float, b: float):
    """The part of [a, b] in which a value lies: monotonous in the value, whatever rounding does."""
    return F.lit(0) if a == b else F.least(F.floor((F.col("v") / 2 - F.lit(a) / 2) / (F.lit(b) / 2 - F.lit(a) / 2) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def summary(df: DataFrame, column: str, how: str):
    """mean, median or mode of a column."""
    if how == "mean":
        return df.agg(F.avg(column)).first()[0]
    if how == "median":
        return (quantiles(df, column, [0.5]) or [None])[0]
    return most_frequent(df, column)
