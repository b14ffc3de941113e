"""Sources: files, inline rows, records, series, random numbers, vector stores; and a text cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from pipelens.functions.hashing import uniform

RID = "_rid"
FILE_NAMES = 256 << 20  # characters of all files' names together up to which they are broadcast


def nan_to_null(df: DataFrame) -> DataFrame:
    """Not-a-number is a missing value everywhere downstream."""
    odd = {f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.select(*(F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if c in odd else F.col(c) for c in df.columns)) if odd else df


def with_rid(df: DataFrame, key: str | None = None, in_files: bool = False) -> DataFrame:
    """Adds `_rid`: the natural key if one is named; for Parquet files the place in them (the file's place in the sorted
    list of files, then the row's index), which doesn't depend on how the scan is dealt to tasks, and of which no two
    rows have the same; else Spark's increasing number, which holds for one frame whose scan is cut alike each time. Text
    files don't know their rows' places: name a key where ids have to outlast the frame."""
    if RID in df.columns:
        return df
    if key:
        return df.withColumn(RID, F.col(key).cast("long"))
    if in_files:
        return _place_in_files(df)
    return df.withColumn(RID, F.monotonically_increasing_id())


def _place_in_files(df: DataFrame) -> DataFrame:
    files = sorted(df.inputFiles())
    if len(files) < 2:
        return df.withColumn(RID, F.col("_metadata.row_index"))
    whole = lambda c: F.regexp_replace(c, "^([a-zA-Z0-9+.-]+):/+", "$1:/")  # noqa: E731  schemes are spelled in two ways
    table = df.sparkSession.createDataFrame(list(enumerate(files)), "_file long, _path string").select("_file", whole("_path").alias("_path"))
    table = F.broadcast(table) if sum(map(len, files)) < FILE_NAMES else table
    return df.withColumn("_path", whole("_metadata.file_path")).withColumn("_row", F.col("_metadata.row_index")).join(table, "_path").select(*df.columns, (F.shiftleft("_file", 34) + F.col("_row")).alias(RID))


def read_parquet(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    return nan_to_null(with_rid(spark.read.parquet(path), key, True))


def read_csv(spark: SparkSession, path: str, na_values: str = "?", sep: str = ",", schema: str | None = None, key: str | None = None, usecols: list[str] | None = None, header: bool = True) -> DataFrame:
    """A schema spares the extra pass that inference takes. Compression follows the file's suffix."""
    reader = spark.read.option("header", header).option("nullValue", na_values).option("sep", sep).option("ignoreLeadingWhiteSpace", True)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    df = df.select(*usecols) if usecols else df
    return with_rid(nan_to_null(df), key)


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows from the driver, numbered in their order."""
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{schema}, {RID} long")


def from_records(spark: SparkSession, path: str, record: str, schema: str) -> DataFrame:
    """JSON files that hold an array of records under `record` ('' for JSON lines)."""
    if not record:
        return with_rid(spark.read.schema(schema).json(path))
    whole = spark.read.option("multiLine", True).schema(f"{record} array<struct<{', '.join(':'.join(x.split()) for x in schema.split(','))}>>").json(path)
    return whole.select(F.posexplode(record).alias(RID, "r")).select("r.*", F.col(RID).cast("long").alias(RID))


def series(spark: SparkSession, values: list, kind: str, name: str = "_1") -> DataFrame:
    return inline(spark, [(v,) for v in values], f"`{name}` {kind}")


def random_numbers(spark: SparkSession, n: int, seed: int = 0, name: str = "array") -> DataFrame:
    """Seeded by row id: the same numbers on any partitioning."""
    return spark.range(n).select(uniform(F.col("id"), seed).alias(name), F.col("id").alias(RID))


def vector_store(corpus: DataFrame, text: str, embedding: str, *metadata: str) -> DataFrame:
    """A corpus to retrieve from: texts, their vectors, and metadata. It is a frame; no index is kept."""
    return corpus.select(RID, F.col(text).alias("texts"), F.col(embedding).alias("embedding"), *metadata)


class TextCache:
    """Outputs of an expensive text function, in a Parquet table keyed by the text's hash. Only unseen texts are computed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _stored(self) -> DataFrame | None:
        """None if nothing is stored so far; whatever else goes wrong is an error."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema("_in string, _out string").parquet(self.path).groupBy("_in").agg(F.first("_out").alias("_out")) if there else None

    def apply(self, df: DataFrame, text: str, out: str, compute) -> DataFrame:
        """compute: a column function to strings. Texts that are missing from the table are computed once each and
        appended. Two writers at once may both compute a text; readers take one of its rows."""
        known, texts = self._stored(), df.select(F.col(text).alias("_in")).where("_in is not null").distinct()
        new = texts if known is None else texts.join(known.select("_in"), "_in", "left_anti")
        new.select("_in", compute(F.col("_in")).alias("_out")).write.mode("append").parquet(self.path)
        return df.join(self._stored().select(F.col("_in").alias(text), F.col("_out").alias(out)), text, "left")
