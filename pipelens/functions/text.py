"""Text functions of the example pipelines, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def clean(c: Column) -> Column:
    """Lower case, without links, digits and punctuation."""
    return F.trim(F.translate(F.regexp_replace(F.regexp_replace(F.lower(c), r"https?://[^\s]+", ""), "[0-9]+", ""), PUNCTUATION, ""))


def sentences(df: DataFrame, text: str, pattern: str = r"[.!?]\s+") -> DataFrame:
    """A row a sentence, with its place."""
    return df.select("*", F.posexplode(F.split(F.col(text), pattern)).alias("place", "sentence"))


def parse_image(c: Column, scale: float = 1.0) -> Column:
    """'1:2:3' as numbers divided by scale."""
    return F.transform(F.split(c, ":"), lambda x: x.try_cast("int") / F.lit(scale))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def word_features(a: Column, b: Column) -> dict[str, Column]:
    return {"levenshtein": F.levenshtein(a, b), "length_gap": F.abs(F.char_length(a) - F.char_length(b))}


def spell_fix(df: DataFrame, text: str, dictionary: DataFrame) -> DataFrame:
    """Words that the dictionary (wrong, right) lists are put right: each different word is looked up once."""
    words = df.select(F.explode(F.split(F.col(text), " ")).alias("wrong")).distinct().join(dictionary, "wrong")
    rid = "_rid"
    parts = df.select(rid, F.posexplode(F.split(F.col(text), " ")).alias("place", "wrong")).join(words, "wrong", "left")
    fixed = parts.groupBy(rid).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", F.coalesce("right", "wrong").alias("w")))), lambda x: x["w"]), " ").alias("_fixed"))
    return df.join(fixed, rid, "left").withColumn(text, F.coalesce("_fixed", text)).drop("_fixed")
