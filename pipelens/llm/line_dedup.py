"""Line dedup: windows of three consecutive lines that occurred before are removed. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelens.llm._shared import col, fresh, materialise

WIDTH = 3


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs with its columns, the text without repeated passages, and n_lines and n_removed (long).

    A text is split at line feeds. Each run of three consecutive lines, one of which at least isn't blank, is hashed
    to 128 bits from the lines' 64-bit hashes; the first occurrence by (id, text hash, line number) stays, the lines
    of every later one go. An occurrence that overlaps the first one within its own document isn't a repetition.
    What is left keeps its order. A text of fewer than three lines has no window and stays as it is; so do null
    (n_lines 0) and empty texts. A null id orders first. Rows that agree in id and text are one document and come out
    alike. Columns named like ours are kept; ours then get a trailing underscore.

    The windows hold no text: 48 bytes a line are grouped by hash with map-side combining, joined back to the hashes
    that occur twice, and gathered by document. A passage in a third of all rows is a hot key of that join only,
    which adaptive skew joins split.
    """
    lines, hashes, key, cut, n_lines, n_removed = fresh(docs, "lines", "hashes", "key", "cut", "n_lines", "n_removed")
    keyed = docs.withColumn(key, F.struct(col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("h")))
    split = F.split(col(text_col), "\n", -1)
    per_doc = keyed.select(F.col(key).alias("doc"), F.transform(split, lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(F.trim(F.translate(x, "\t\r", "  "))) > 0).alias("said"))).alias("x")).where(F.size("x") >= WIDTH)
    windows = per_doc.select("doc", F.posexplode(F.expr(
        """transform(arrays_zip(slice(x, 1, size(x) - 2), slice(x, 2, size(x) - 2), slice(x, 3, size(x) - 2)),
             w -> struct(w.`0`.said or w.`1`.said or w.`2`.said as said, xxhash64(w.`0`.h, w.`1`.h, w.`2`.h) as h1, xxhash64(w.`2`.h, 7, w.`1`.h, 11, w.`0`.h) as h2))"""))).where("col.said").selectExpr("doc", "pos", "col.h1", "col.h2")
    windows, _ = materialise(windows, "windows")
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = windows.join(first, ["h1", "h2"]).where(~((F.col("doc").eqNullSafe(F.col("first.doc"))) & (F.col("pos") - F.col("first.pos") < WIDTH)))
    gone = later.groupBy("doc").agg(F.collect_set("pos").alias("starts"))
    gone = gone.select(F.col("doc").alias(cut), F.array_distinct(F.flatten(F.transform("starts", lambda p: F.array(*(p + i for i in range(WIDTH)))))).alias(hashes))
    joined = keyed.join(gone, F.col(key).eqNullSafe(F.col(cut)), "left").withColumn(lines, split)
    size = F.when(col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long")
    kept = F.expr(f"array_join(transform(array_except(sequence(0, size({lines}) - 1), {hashes}), i -> element_at({lines}, i + 1)), '\n')")
    out = {c: col(c) for c in docs.columns} | {text_col: F.when(F.col(hashes).isNull(), col(text_col)).otherwise(kept)}
    return joined.select(*(e.alias(c) for c, e in out.items()), size.alias(n_lines), F.coalesce(F.size(hashes), F.lit(0)).cast("long").alias(n_removed))


def digest(spark, docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = """
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents
), w AS (
  SELECT doc_id, text, pos, line AS a, lead(line, 1) OVER o AS b, lead(line, 2) OVER o AS c, lead(pos, 2) OVER o AS p2
  FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), v AS (
  SELECT * FROM w WHERE p2 IS NOT NULL AND (trim(translate(a, chr(9) || chr(13), '  ')) <> '' OR trim(translate(b, chr(9) || chr(13), '  ')) <> '' OR trim(translate(c, chr(9) || chr(13), '  ')) <> '')
), f AS (
  SELECT doc_id, pos, first_value(doc_id) OVER o AS fd, first_value(pos) OVER o AS fp
  FROM v WINDOW o AS (PARTITION BY a, b, c ORDER BY doc_id, pos)
), gone AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM f, (SELECT unnest([0, 1, 2]) AS k)
  WHERE NOT (doc_id = fd AND pos - fp < 3)
), kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, string_agg(line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL) AS t
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN CAST(length(coalesce(t, '')) AS BIGINT) END AS kept_chars, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
