"""Seeded choices that are the same on every run, on any partitioning, and in any SQL engine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODULUS = 1 << 31
STEPS = (1103515245, 1140671485, 1664525, 22695477)  # odd multipliers of the generator that makes one draw into many


def draw(rid: Column, seed: int = 0, stream: int = 0) -> Column:
    """A number below MODULUS for every row id: the first bits of the MD5 of the whole id, the seed and the stream, so
    choices of different seeds and streams are independent. Any SQL engine has MD5."""
    said = F.concat_ws(":", rid.cast("long").cast("string"), F.lit(str(seed)), F.lit(str(stream)))
    return F.pmod(F.conv(F.substring(F.md5(said.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(MODULUS))


def uniform(rid: Column, seed: int = 0, stream: int = 0) -> Column:
    return draw(rid, seed, stream) / F.lit(float(MODULUS))


def gaussian(rid: Column, seed: int = 0) -> Column:
    """The sum of twelve uniform numbers less six. Consecutive draws go through the generator again, so that they differ."""
    x, out = draw(rid, seed), F.lit(0.0)
    for k in range(12):
        x = F.pmod(x * F.lit(STEPS[k % len(STEPS)]) + F.lit(12345 + k * 7919), F.lit(MODULUS))
        out = out + x / F.lit(float(MODULUS))
    return out - F.lit(6.0)


def thresholds(df: DataFrame, rid: Column, counts: list[int], seed: int = 0, stream: int = 0) -> list[tuple[int, int]]:
    """For every count k, (u, id): the k-th smallest (draw, id). Two rounds of counting by ranges of the number, of
    65,536 rows at most each, find it; no row is sorted, and what is chosen is a filter."""
    u = draw(rid, seed, stream)
    high, low = (F.floor(u / 32768)).cast("int"), F.pmod(u, F.lit(32768)).cast("int")
    coarse = sorted((r["b"], r["count"]) for r in df.select(high.alias("b")).groupBy("b").count().collect())
    out: list[tuple[int, int]] = []
    wanted: dict[int, list[tuple[int, int]]] = {}
    for at, k in enumerate(counts):
        out.append((-1, 0))
        for b, n in coarse:
            if k <= 0:
                break
            if k <= n:
                wanted.setdefault(b, []).append((at, k))
                break
            k -= n
        else:
            out[at] = (MODULUS, 0) if k > 0 else out[at]
    if wanted:
        fine: dict[int, list] = {}
        for r in df.select(high.alias("b"), low.alias("c"), rid.alias("rid")).where(F.col("b").isin(list(wanted))).groupBy("b", "c").agg(F.count("*").alias("n"), F.min("rid").alias("least"), F.max("rid").alias("most")).collect():
            fine.setdefault(r["b"], []).append((r["c"], r["n"], r["least"], r["most"]))
        for b, asks in wanted.items():
            for at, k in asks:
                for c, n, least, most in sorted(fine[b]):
                    if k <= n:
                        value = b * 32768 + c
                        if k == n:
                            out[at] = (value, most)
                        elif k == 1:
                            out[at] = (value, least)
                        else:  # different ids with the same number
                            out[at] = (value, df.where(u == value).select(rid.alias("r")).orderBy("r").limit(k).agg(F.max("r")).first()[0])
                        break
                    k -= n
    return out


def chosen(rid: Column, threshold: tuple[int, int], seed: int = 0, stream: int = 0) -> Column:
    u, last = threshold
    n = draw(rid, seed, stream)
    return (n < F.lit(u)) | ((n == F.lit(u)) & (rid <= F.lit(last)))


def fractions(df: DataFrame, rid: Column, fracs: list[float], seed: int = 0, stream: int = 0) -> list[Column]:
    """Predicates that choose exactly floor(n * frac) rows each; a smaller fraction's rows are among a larger one's."""
    n = df.count()
    found = thresholds(df, rid, [int(n * f) for f in fracs], seed, stream)
    return [chosen(rid, t, seed, stream) for t in found]


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))
