"""Column expressions that treat missing values as data frame libraries do, where SQL would give NULL."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(x: Any) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def eq(a, b) -> Column:
    return F.coalesce(as_column(a) == as_column(b), F.lit(False))


def ne(a, b) -> Column:
    """A missing value differs from everything, another missing value included."""
    return F.coalesce(as_column(a) != as_column(b), F.lit(True))


def lt(a, b) -> Column:
    return F.coalesce(as_column(a) < as_column(b), F.lit(False))


def le(a, b) -> Column:
    return F.coalesce(as_column(a) <= as_column(b), F.lit(False))


def gt(a, b) -> Column:
    return F.coalesce(as_column(a) > as_column(b), F.lit(False))


def ge(a, b) -> Column:
    return F.coalesce(as_column(a) >= as_column(b), F.lit(False))


COMPARE = {"=": eq, "!=": ne, "<": lt, "<=": le, ">": gt, ">=": ge}


def both(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(False)) & F.coalesce(b, F.lit(False))


def either(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))


def exclusive(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(False)) != F.coalesce(b, F.lit(False))


def invert(a: Column) -> Column:
    return ~F.coalesce(a, F.lit(False))


def isin(a: Column, values) -> Column:
    """Missing values are in a list only if the list holds None."""
    given = [v for v in values if v is not None]
    found = F.coalesce(a.isin(given), F.lit(False)) if given else F.lit(False)
    return found | a.isNull() if len(given) < len(list(values)) else found


def matches(a: Column, pattern: str) -> Column:
    """The pattern matches at the start."""
    return F.coalesce(a.rlike(f"^(?:{pattern})"), F.lit(False))


def contains(a: Column, pattern: str, regex: bool = True) -> Column:
    return F.coalesce(a.rlike(pattern) if regex else a.contains(pattern), F.lit(False))


def length(a: Column) -> Column:
    return F.char_length(a).cast("long")


def divide(a, b) -> Column:
    """NULL where the divisor is zero."""
    return F.try_divide(as_column(a).cast("double"), as_column(b).cast("double"))


ARITHMETIC = {"+": lambda a, b: as_column(a) + as_column(b), "-": lambda a, b: as_column(a) - as_column(b), "*": lambda a, b: as_column(a) * as_column(b), "/": divide}


def as_string(a: Column) -> Column:
    return F.coalesce(a.cast("string"), F.lit("nan"))


def astype(a: Column, kind: str) -> Column:
    return as_string(a) if kind in ("str", "string") else a.try_cast(kind)


def fill(a: Column, value) -> Column:
    return F.coalesce(a, F.lit(value))


def replace_values(a: Column, mapping: dict) -> Column:
    """Values that mapping has become what it says. Values may change their type if all of them are mapped."""
    out = None
    for k, v in mapping.items():
        test = a.isNull() if k is None else eq(a, k)
        out = F.when(test, F.lit(v)) if out is None else out.when(test, F.lit(v))
    if out is None:
        return a
    kinds = {type(v) for v in mapping.values() if v is not None} - {type(k) for k in mapping}
    return out.otherwise(a.cast("string") if kinds == {str} else a)


def binarize(a: Column, classes: list) -> list[Column]:
    """Two classes: one column, 1 for the last one. More: a column a class."""
    return [eq(a, classes[-1]).cast("int")] if len(classes) == 2 else [eq(a, c).cast("int") for c in classes]


def let(value: Column, body) -> Column:
    """body(value), the value being worked out once a row: a lambda that names a column works it out at every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
