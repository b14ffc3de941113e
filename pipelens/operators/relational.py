"""Filters, projections, joins, groups and splits. Predicates and assignments stay column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipelens.functions import expr as E
from pipelens.functions.hashing import chosen, thresholds
from pipelens.sources.readers import RID

HIDDEN = ("_rid", "_prov_", "_variant_")


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith(HIDDEN)]


def hidden_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(HIDDEN)]


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns, *hidden_columns(df))


def dropna(df: DataFrame, subset: list[str] | None = None, how: str = "any") -> DataFrame:
    return df.na.drop(how=how, subset=subset or data_columns(df))


def fillna(df: DataFrame, value) -> DataFrame:
    """Columns whose type can hold the value."""
    fits = {"bool": ("boolean",), "str": ("string",)}.get(type(value).__name__, ("int", "bigint", "double", "float", "smallint", "tinyint"))
    return df.select(*(E.fill(F.col(c), value).alias(c) if k in fits and c in data_columns(df) else F.col(c) for c, k in df.dtypes))


def replace(df: DataFrame, old, new) -> DataFrame:
    kinds = ("string",) if isinstance(old, str) else ("int", "bigint", "double", "float")
    return df.select(*(F.when(E.eq(F.col(c), old), F.lit(new)).otherwise(F.col(c)).alias(c) if k in kinds and c in data_columns(df) else F.col(c) for c, k in df.dtypes))


def sample(df: DataFrame, frac: float | None = None, n: int | None = None, seed: int = 0) -> DataFrame:
    """Exactly n rows, or round(count * frac), without replacement. No sort: the n-th smallest hash is found by counting."""
    n = n if n is not None else round(df.count() * frac)
    return df.where(chosen(F.col(RID), thresholds(df, F.col(RID), [n], seed)[0], seed))


def merge(left: DataFrame, right: DataFrame, on: list[str] | None = None, left_on: list[str] | None = None, right_on: list[str] | None = None, how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y"), sort: bool = False, left_index: bool = False, right_index: bool = False) -> DataFrame:
    """left_index and right_index take the row id for a side's key. Missing keys match missing keys. Equal key names become one column; other names in common get the suffixes.
    The rows' provenance columns of both sides are kept."""
    lk, rk = (on, on) if on else ([RID] if left_index else left_on, [RID] if right_index else right_on)
    shared = {a for a, b in zip(lk, rk, strict=True) if a == b}
    common = (set(left.columns) & set(right.columns)) - shared
    name = lambda c, s: c if c not in common else (f"_prov_{c.removeprefix('_prov_')}{s}" if c.startswith(HIDDEN) else c + s)
    a = left.select(*(F.col(c).alias(f"l {c}") for c in left.columns))
    b = right.select(*(F.col(c).alias(f"r {c}") for c in right.columns))
    joined = a.join(b, [F.col(f"l {x}").eqNullSafe(F.col(f"r {y}")) for x, y in zip(lk, rk, strict=True)], how)
    out = [(F.coalesce(F.col(f"l {c}"), F.col(f"r {c}")) if how in ("outer", "right", "full") and c in shared else F.col(f"l {c}")).alias(name(c, suffixes[0])) for c in left.columns]
    out += [F.col(f"r {c}").alias(name(c, suffixes[1])) for c in right.columns if c not in shared]
    joined = joined.select(*out)
    return joined.orderBy(*lk) if sort else joined


def semi(df: DataFrame, ids: DataFrame, on: str = RID) -> DataFrame:
    return df.join(ids.select(on).distinct(), on, "left_semi")


AGGREGATES = {
    "mean": F.mean, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "nunique": F.countDistinct, "median": F.median, "std": F.stddev_samp, "var": F.var_samp,
    "first": lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(RID))), "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(RID))), "size": lambda _: F.count(F.lit(1)),
}


def group_agg(df: DataFrame, keys: list[str], aggs: dict[str, tuple[str, str]]) -> DataFrame:
    """aggs: output name -> (column, function). Rows with a missing key are left out."""
    return df.dropna(subset=keys).groupBy(*keys).agg(*(AGGREGATES[f](c).alias(name) for name, (c, f) in aggs.items()))


def train_test_split(df: DataFrame, test_size: float = 0.25, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """ceil(n * test_size) rows are the test part, by a seeded hash of the row id: both parts are filters of one scan."""
    t = thresholds(df, F.col(RID), [math.ceil(df.count() * test_size)], seed, 1)[0]
    test = chosen(F.col(RID), t, seed, 1)
    return df.where(~test), df.where(test)


def drop_duplicates(df: DataFrame, subset: list[str]) -> DataFrame:
    """The row with the smallest id of each group stays; missing values make one group."""
    first = df.groupBy(*subset).agg(F.min(RID).alias("_first")).select("_first")
    return df.join(first, F.col(RID) == F.col("_first"), "left_semi")


def concat_columns(left: DataFrame, right: DataFrame) -> DataFrame:
    """Side by side, by row id."""
    return left.join(right.select(RID, *data_columns(right)), RID)


def changed_rows(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Ids of rows that differ in any of the columns."""
    other = new.select(RID, *(F.col(c).alias(f"new {c}") for c in columns))
    differ = F.lit(False)
    for c in columns:
        differ = differ | ~F.col(c).eqNullSafe(F.col(f"new {c}"))
    return old.join(other, RID).where(differ).select(RID)


def merge_predictions(old: DataFrame, changed: DataFrame, column: str = "prediction") -> DataFrame:
    """The old predictions, overwritten where there are new ones."""
    return old.join(changed.select(RID, F.col(column).alias("_new")), RID, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def similarity(a: Column, b: Column) -> Column:
    """1 - edits / longer length."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def fuzzy_merge(left: DataFrame, right: DataFrame, left_on: str, right_on: str, threshold: float = 0.6) -> DataFrame:
    """All pairs whose similarity is at least the threshold, repeated rows as often as they occur; the columns of both,
    suffixed where names are shared.

    No cross join: of two strings within d edits, one of d + 1 pieces of the first occurs in the second, at most d
    places off. Pieces and substrings meet by equality (with the first string's length), and the edits of what meets
    are counted. Strings too short for as many pieces meet by length alone. Equal rows travel once, with their number.
    """
    common = set(left.columns) & set(right.columns)
    a = left.select(*(F.col(c).alias(c + "_x" if c in common else c) for c in left.columns))
    b = right.select(*(F.col(c).alias(c + "_y" if c in common else c) for c in right.columns))
    ka, kb = (k + s if k in common else k for k, s in ((left_on, "_x"), (right_on, "_y")))
    if threshold <= 0:
        raise ValueError("a threshold of 0 matches everything")
    # d for a first string of length n: the other has n / threshold characters at most
    edits = f"cast(floor({1 - threshold} * floor(n / {threshold}) + 1e-9) as int)"
    counted = lambda df, key: df.where(F.col(key).isNotNull()).groupBy(*df.columns).agg(F.count("*").alias("_times"))
    a, b = counted(a, ka), counted(b, kb)
    la = a.select(F.struct("*").alias("l"), F.col(ka).alias("s"), F.char_length(ka).alias("n"))
    la = la.withColumn("d", F.expr(edits))
    keys = "if(n > d, transform(sequence(0, d), k -> struct(n as n, k as k, substring(s, cast(k * n div (d + 1) as int) + 1, cast((k + 1) * n div (d + 1) as int) - cast(k * n div (d + 1) as int)) as p)), array(struct(n as n, -1 as k, '' as p)))"
    la = la.select("l", "s", F.explode(F.expr(keys)).alias("key"))
    rb = b.select(F.struct("*").alias("r"), F.col(kb).alias("t"), F.char_length(kb).alias("m"))
    rb = rb.select("r", "t", "m", F.explode(F.expr(f"sequence(cast(ceil(m * {threshold} - 1e-9) as int), cast(floor(m / {threshold} + 1e-9) as int))")).alias("n")).withColumn("d", F.expr(edits))
    spans = """if(n > d, array_distinct(flatten(transform(sequence(0, d), k -> transform(
        sequence(greatest(cast(k * n div (d + 1) as int) - d, 0), greatest(cast(k * n div (d + 1) as int) - d, 0, least(cast(k * n div (d + 1) as int) + d, m - (cast((k + 1) * n div (d + 1) as int) - cast(k * n div (d + 1) as int))))),
        i -> struct(n as n, k as k, substring(t, i + 1, cast((k + 1) * n div (d + 1) as int) - cast(k * n div (d + 1) as int)) as p))))), array(struct(n as n, -1 as k, '' as p)))"""
    rb = rb.select("r", "t", F.explode(F.expr(spans)).alias("key"))
    met = la.join(rb, "key").where(similarity(F.col("s"), F.col("t")) >= threshold).select("l", "r").distinct()
    twice = met.withColumn("_", F.explode(F.expr("sequence(1L, l._times * r._times)")))
    return twice.select(*(F.col(f"l.`{c}`") for c in a.columns if c != "_times"), *(F.col(f"r.`{c}`") for c in b.columns if c != "_times"))


def top_k_again(found: DataFrame, changed: DataFrame, corpus: DataFrame, k: int = 4, vector: str = "embedding") -> DataFrame:
    """What top_k gives after some queries have changed: only these are looked up again."""
    return found.join(changed.select(F.col(RID).alias("query")), "query", "left_anti").unionByName(top_k(changed, corpus, k, vector))


TILE = 50_000  # vectors of a tile of queries or of the corpus, about


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 4, vector: str = "embedding", tiles: int | None = None) -> DataFrame:
    """(query, doc, distance, rank): every query's k nearest corpus rows by Euclidean distance, ties by id.

    Queries and corpus meet in pairs of tiles; numpy works out each pair's distances and hands on k rows a query, so
    what is shuffled grows with queries * tiles * k. Rows without a vector take no part.
    """
    import numpy as np
    import pandas as pd

    tiles = tiles or max(8, -(-max(corpus.count(), queries.count()) // TILE))
    q = queries.where(F.col(vector).isNotNull()).select(F.lit(0).alias("side"), F.col(RID).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(RID), F.lit(tiles)).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("b"))
    c = corpus.where(F.col(vector).isNotNull()).select(F.lit(1).alias("side"), F.col(RID).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.explode(F.expr(f"sequence(0L, {tiles - 1}L)")).alias("a"), F.pmod(F.xxhash64(RID), F.lit(tiles)).cast("int").alias("b"))

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf.side == 0], pdf[pdf.side == 1].sort_values("id")
        rows = []
        if len(left) and len(right):
            y, ids = np.stack(right.v.to_numpy()), right.id.to_numpy()
            for i, v in zip(left.id, left.v, strict=True):
                d = np.sqrt(((y - v) ** 2).sum(axis=1))
                best = np.lexsort((ids, d))[:k] if len(d) <= k else (lambda near: near[np.lexsort((ids[near], d[near]))][:k])(np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]))
                rows += [(i, ids[j], d[j]) for j in best]
        return pd.DataFrame(rows, columns=["query", "doc", "distance"])

    found = q.unionByName(c.select(*q.columns)).groupBy("a", "b").applyInPandas(nearest, "query long, doc long, distance double")
    w = Window.partitionBy("query").orderBy("distance", "doc")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
