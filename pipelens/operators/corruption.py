"""Data errors as column expressions over the row id, so that a variant's corruption is part of the shared plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipelens.functions.expr import let
from pipelens.functions.hashing import MODULUS, STEPS, fractions, gaussian, draw
from pipelens.sources.readers import RID

# Characters that are read for one another: fixed values.
LOOK_ALIKE = ("abeilosz", "àßéí1ø5ž")
TYPING = ("nbto", "mvrp")
FACTORS = (10, 100, 1000)


def scaling(c: Column, rid: Column, seed: int = 0, **_) -> Column:
    return c * F.element_at(F.array(*map(F.lit, FACTORS)), (F.pmod(draw(rid, seed, 2), F.lit(len(FACTORS))) + 1).cast("int"))


def missing(c: Column, rid: Column, **_) -> Column:
    return F.when(F.lit(False), c)


def broken_characters(c: Column, rid: Column, **_) -> Column:
    return F.translate(c, *LOOK_ALIKE)


def noise(c: Column, rid: Column, seed: int = 0, std: float = 1.0, times: float = 2.0, **_) -> Column:
    return c + F.lit(times * std) * gaussian(rid, seed)


def categorical_shift(c: Column, rid: Column, categories: list | None = None, **_) -> Column:
    """Every category becomes the next one in sorted order."""
    cats = sorted(categories or [])
    out = c
    if len(cats) > 1:
        chain = None
        for a, b in zip(cats, cats[1:] + cats[:1], strict=True):
            chain = F.when(c == a, F.lit(b)) if chain is None else chain.when(c == a, F.lit(b))
        out = chain.otherwise(c)
    return out


def typos(c: Column, rid: Column, seed: int = 0, **_) -> Column:
    """Look-alikes first; then one in sixteen characters is doubled, one in sixteen dropped, one in sixteen replaced by
    the next letter, by a hash of row and place."""
    chars = F.split(F.translate(c, *TYPING), "")
    # the generator's step of draw + i * 2654435, by powers of two: bits 16 to 19 of start + i * stride
    start, stride = draw(rid, seed, 3) * F.lit(STEPS[0]) + F.lit(12345), F.lit(2654435 * STEPS[0] % MODULUS)

    def one(x: Column, h: Column) -> Column:
        return F.when(h > 2, x).when(h == 0, F.concat(x, x)).when(h == 1, F.lit("")).when(x.between("a", "y"), F.char(F.ascii(x) + 1)).otherwise(x)

    def all_of(first: Column) -> Column:
        return F.array_join(F.transform(chars, lambda x, i: one(x, F.shiftright(first + i.cast("long") * stride, 16).bitwiseAND(15))), "")

    return let(start, all_of)


CORRUPTIONS: dict[str, Callable] = {"scaling": scaling, "missing_values": missing, "broken_characters": broken_characters, "gaussian_noise": noise, "categorical_shift": categorical_shift, "typos": typos}


def parameters(df: DataFrame, column: str, kind: str) -> dict:
    """What a corruption needs to know of the whole column."""
    if kind == "gaussian_noise":
        return {"std": df.agg(F.stddev_pop(column)).first()[0] or 0.0}
    if kind == "categorical_shift":
        return {"categories": [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().collect()]}
    return {}


def corrupt(df: DataFrame, column: str, kind, fraction: float, seed: int = 0) -> DataFrame:
    """Corrupts exactly floor(n * fraction) rows; those of a smaller fraction are among those of a larger one."""
    f = CORRUPTIONS[kind] if isinstance(kind, str) else kind
    hit = fractions(df, F.col(RID), [fraction], seed)[0]
    return df.withColumn(column, F.when(hit, f(F.col(column), F.col(RID), seed=seed, **parameters(df, column, kind if isinstance(kind, str) else ""))).otherwise(F.col(column)))


def permute(df: DataFrame, column: str, seed: int = 0) -> DataFrame:
    """The column's values change places among all rows: the row of place r by id gets the value of place r by hash.

    Places come from range partitioning and per-partition counts, so no window spans all rows in one task."""
    by_id = ranked(df.select(RID), [F.col(RID)]).select(RID, "place")
    by_hash = ranked(df.select(F.col(RID).alias("_other"), F.col(column).alias("_value")), [draw(F.col("_other"), seed), F.col("_other")]).select("_value", "place")
    return df.drop(column).join(by_id.join(by_hash, "place").select(RID, F.col("_value").alias(column)), RID).select(*df.columns)


def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with `place`, from 1, in the given total order."""
    from pyspark.sql import Window

    keys = {f"_k{i}": c for i, c in enumerate(order)}
    df = df.withColumns(keys)
    lows = df.select(F.floor(df["_k0"] / F.lit(1 << 16)).alias("b")).groupBy("b").agg(F.count("*").alias("n"))
    before = lows.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("b", "before")
    df = df.withColumn("b", F.floor(F.col("_k0") / F.lit(1 << 16)))
    place = F.row_number().over(Window.partitionBy("b").orderBy(*keys)) + F.col("before")
    return df.join(before, "b").withColumn("place", place).drop("b", "before", *keys)
