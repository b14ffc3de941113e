"""Where outside models come in: embeddings, rewriting (spelling, translation) and prompts. A hook is a plain function over
a list of texts; it runs on Arrow batches, once for each different text, and never row by row. Offline stand-ins are here
for all of them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _distinct(texts: pd.Series, function: Callable) -> pd.Series:
    seen = texts.dropna().unique().tolist()
    return texts.map(dict(zip(seen, function(seen), strict=True)) if seen else {})


def rewrite(function: Callable[[list[str]], list[str]]) -> Callable[[Column], Column]:
    """A column function for texts that are put right or translated. Nulls stay."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return _distinct(texts, function).astype(object).where(texts.notna(), None)

    return run


def embed(function: Callable[[list[str]], list[list[float]]]) -> Callable[[Column], Column]:
    """A column function from texts to vectors. Nulls stay."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return _distinct(texts, lambda seen: [[float(x) for x in v] for v in function(seen)]).astype(object).where(texts.notna(), None)

    return run


def letter_pairs(size: int = 16) -> Callable[[list[str]], list[list[float]]]:
    """The offline embedding: counts of hashed pairs of characters."""

    def run(texts):
        out = []
        for t in texts:
            v = [0.0] * size
            for i in range(len(t) - 1):
                v[zlib.crc32(t[i : i + 2].encode("utf-8", "replace")) % size] += 1
            out.append(v)
        return out

    return run


def ask(df: DataFrame, template: str, function: Callable[[list[str]], list[str]], parse: Callable[[Column], Column], out: str = "answer") -> DataFrame:
    """df with out: the parsed answer to the prompt that the template makes of each row. Braces name string columns, a
    null counts as empty; equal prompts of a batch are asked once."""
    parts, rest = [], template
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(head), F.coalesce(F.col(name).cast("string"), F.lit(""))]
    prompt = F.concat(*parts, F.lit(rest))
    return df.withColumn(out, parse(rewrite(function)(prompt)))
