"""Algorithms behind the diagnostics: KNN Shapley values and the search for bad slices."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelens.sources.readers import RID


CHUNK = 1024  # training rows that meet a test row at once
HELD = 1 << 23  # distances that a task holds at once


def knn_shapley(train: DataFrame, test: DataFrame, vector: str = "embedding", label: str = "label", k: int = 1) -> DataFrame:
    """(train, shapley): each training row's mean value for a K-nearest-neighbour classifier, exactly.

    For one test row with neighbours in order i = 1..n and hits m: the last is worth m/n, and each one differs from the
    next by (m_i - m_{i+1}) / K * min(K, i) / i. A suffix sum by test row gives all values.

    All pairs are looked at, but none of them is a row: the test rows are dealt to a few tasks, the training rows travel
    to each, and a task sums its test rows' values by training row. It holds the training rows and HELD distances."""
    import pyarrow as pa

    n = max(2, 2 * train.sparkSession.sparkContext.defaultParallelism)
    row = lambda df, side: df.select(F.lit(side).alias("side"), F.col(RID).alias("id"), F.col(vector).alias("v"), F.col(label).alias("y"))
    asked = row(test, 0).withColumn("at", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    known = row(train, 1).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    dealt = asked.unionAll(known).repartitionById(n, F.col("at")).sortWithinPartitions("side", "id").drop("at")

    def values(batches):
        sides: tuple = ([], [])
        for b in batches:
            side = b.column("side").to_numpy()
            cut = int(np.searchsorted(side, 1))
            for s, part in ((0, b.slice(0, cut)), (1, b.slice(cut))):
                if part.num_rows:
                    sides[s].append(part.select(["id", "v", "y"]))
        if not (sides[0] and sides[1]):
            return
        (_, q, qy), (ids, x, y) = (_columns(pa.Table.from_batches(s)) for s in sides)
        total, times = _worth(q, qy, x, y, k)
        for i in range(0, len(ids), 1 << 16):
            part = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(total[part]), pa.array(times[part])], names=["train", "s", "n"])

    parts = dealt.mapInArrow(values, "train long, s double, n long")
    return parts.groupBy("train").agg(F.when(F.sum("n") > 0, F.sum("s") / F.sum("n")).alias("shapley"))


def _columns(rows) -> tuple:
    """Ids, vectors as a matrix and labels as numbers of an Arrow table; NaN is what a row lacks."""
    v = rows.column("v").combine_chunks()
    sizes = np.diff(v.offsets.to_numpy()) if not v.null_count else np.array([len(a) if a is not None else 0 for a in v.to_pylist()])
    flat = v.flatten().to_numpy(zero_copy_only=False)
    flat = flat if flat.dtype in (np.float32, np.float64) else flat.astype(float)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        x = flat.reshape(len(sizes), width)
    else:
        x = np.full((len(sizes), width), np.nan, flat.dtype)
        x[np.arange(width) < sizes[:, None]] = flat
    return rows.column("id").to_numpy(), x, rows.column("y").to_pandas()


def _worth(q, qy, x, y, k: int) -> tuple:
    """Summed over the test rows q, by training row of x (in the order of their ids): its value, and how often it has one."""
    n, width = len(x), max(q.shape[1], x.shape[1])
    pad = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])), constant_values=np.nan) if m.shape[1] < width else m
    q, x = pad(q).astype(float), pad(x)
    lacks = bool(np.isnan(q).any()) or any(bool(np.isnan(x[c : c + CHUNK]).any()) for c in range(0, n, CHUNK))
    known, asked = y.notna().to_numpy(), qy.notna().to_numpy()
    y, qy = y.to_numpy(), qy.to_numpy()
    place = np.arange(1, n + 1)
    share = np.minimum(k, place) / place / k
    total, times = np.zeros(n), np.zeros(n, np.int64)
    at_once = max(1, min(64, HELD // n))
    for first in range(0, len(q), at_once):
        some = q[first : first + at_once]
        d = np.empty((len(some), n))
        for c in range(0, n, CHUNK):
            tile = np.ascontiguousarray(x[c : c + CHUNK].T, dtype=float)
            gap = np.empty_like(tile)
            for j, one in enumerate(some):
                np.subtract(tile, one[:, None], out=gap)
                np.multiply(gap, gap, out=gap)
                out = d[j, c : c + CHUNK]
                if lacks:  # what one of the two lacks counts nothing; a pair without anything in common comes last
                    none = np.isnan(gap)
                    gap[none] = 0
                    np.add.reduce(gap, axis=0, out=out)
                    out[none.all(axis=0)] = np.inf
                else:
                    np.add.reduce(gap, axis=0, out=out)  # place by place in their order, as SQL sums them
        np.sqrt(d, out=d)
        for j in range(len(some)):
            order = _ordered(d[j])
            hit = (y == qy[first + j])[order].astype(float)
            step = np.empty(n)
            if asked[first + j] and known.all():
                step[:-1] = (hit[:-1] - hit[1:]) * share[:-1]
                step[-1] = hit[-1] / n
                total[order] += np.cumsum(step[::-1])[::-1]
                times += 1
                continue
            hit[~known[order] if asked[first + j] else slice(None)] = np.nan
            after = np.append(hit[1:], np.nan)
            step = np.where(np.isnan(after), hit / n, (hit - after) * share)
            has = np.cumsum(~np.isnan(step[::-1]))[::-1] > 0
            total[order] += np.cumsum(np.nan_to_num(step[::-1]))[::-1]
            times[order] += has
    return total, times


def _ordered(d) -> np.ndarray:
    """Places by value, ties by place. Few are tied, so that the faster sort is mended where they are."""
    order = np.argsort(d)
    value = d[order]
    same = value[1:] == value[:-1]
    if same.any():
        run = np.cumsum(np.append(True, ~same))
        tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
        order[tied] = order[tied][np.lexsort((order[tied], run[tied]))]
    return order


def slice_finder(df: DataFrame, features: list[str], error: str, alpha: float = 0.95, min_support: int = 1, max_level: int = 2, k: int = 1) -> DataFrame:
    """The k slices of up to max_level features with the best score, if it is positive: features as columns (NULL where
    the slice leaves one open), size, error_sum, score. Missing values count as 'nan'. One grouping-sets aggregation."""
    df = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in features), F.col(error).cast("double").alias("_e")).where(F.col("_e").isNotNull())
    n, mean = df.agg(F.count("*"), F.avg("_e")).first()
    n, mean = n or 0, mean or 0.0
    sets = [[F.col(f"`{c}`") for c in s] for level in range(1, max_level + 1) for s in combinations(features, level)]
    columns = [F.col(f"`{c}`") for c in features]
    g = df.groupingSets(sets, *columns).agg(F.count("*").alias("size"), F.sum("_e").alias("error_sum"))
    score = F.lit(alpha) * (F.col("error_sum") / F.col("size") / F.lit(mean or 1.0) - 1) - F.lit(1 - alpha) * (F.lit(n) / F.col("size") - 1)
    g = g.select(*columns, "size", "error_sum", score.alias("score")).where((F.col("size") >= min_support) & (F.col("error_sum") > 0) & F.lit(mean > 0) & (F.col("score") > 0))
    return g.orderBy(F.desc("score"), *columns).limit(k)


def flipped_predictions(retrieved: DataFrame, changed: DataFrame) -> DataFrame:
    """Queries of which any retrieved document changed: an equi-join instead of a disjunction over the ranks."""
    return retrieved.join(changed.select(F.col(RID).alias("doc")).distinct(), "doc", "left_semi").select("query").distinct()
