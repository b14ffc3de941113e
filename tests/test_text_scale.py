"""Text features without a vocabulary on the driver or vectors as long as it, and typos that draw once a row."""

from collections import Counter
from math import log

import duckdb
import pytest
from pyspark.sql import functions as F

from pipelens import catalogue
from pipelens.operators import corruption, features
from pipelens.sources.readers import RID


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_count_vectorizer_counts_turns_of_one_key_together(spark, tmp_path):
    rows = [(1, 1, "ab ab cd"), (1, 1, "ab ef"), (1, 2, None), (2, 1, "x"), (None, 1, "ab ab"), (3, 2000, "gh gh gh"), (5, 0, "ij")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    df = catalogue.QUERIES["count_vectorizer"](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(db.execute(catalogue.ORACLE["count_vectorizer"]).fetchall(), key=key)


def test_idf_table_and_weights(spark):
    texts = {i: " ".join(["all"] * (i % 3) + [f"w{i % 7}", f"own{i}"]) for i in range(2000)} | {2000: "", 2001: "? !"}
    df = features.TermCounts(["text"]).apply(spark.createDataFrame(list(texts.items()), "id long, text string"))
    words = {i: Counter(x for x in s.split() if len(x) > 1) for i, s in texts.items()}
    assert {r["id"]: {x["term"]: x["n"] for x in r["counts"]} for r in df.collect()} == words
    idf = {w: log((1 + len(texts)) / (1 + n)) + 1 for w, n in Counter(w for c in words.values() for w in c).items()}
    made = features.TermIdf().fit(df)
    assert {r["term"]: r["idf"] for r in made.idf.collect()} == pytest.approx(idf)
    assert {r["id"]: r["square"] for r in made.squares(df, "id").collect()} == pytest.approx({i: sum((n * idf[w]) ** 2 for w, n in c.items()) for i, c in words.items()})


@pytest.mark.parametrize("name", ["tfidf_idf_values", "tfidf_weights"])
def test_vocabulary_stays_a_table(spark, sf, name):
    """No list of words from the driver, and no step's vector of the vocabulary's length in the plan."""
    df = catalogue.QUERIES[name](spark, sf)
    assert "LogicalRDD" not in plan(df) and "counts" not in dict(df.dtypes) and "ElementwiseProduct" not in plan(df) and "norm(" not in plan(df)
    assert "<lambda>" not in plan(df)


def test_typos_draw_once_a_row(spark):
    texts = ["", "the bone of a goat", "naïve 🙂 azAZ" * 40, None]
    df = spark.createDataFrame(list(enumerate(texts)), f"{RID} long, s string")
    out = df.select(RID, corruption.typos(F.col("s"), F.col(RID), 5).alias("t"), corruption.draw(F.col(RID), 5, 3).alias("u"))
    for r in out.collect():
        said = texts[r[RID]]
        made = []
        for i, x in enumerate((said or "").translate(str.maketrans(*corruption.TYPING))):
            h = ((r["u"] + i * 2654435) % 2**31 * corruption.STEPS[0] + 12345) % 2**31 // 65536 % 16
            made.append(x * 2 if h == 0 else "" if h == 1 else chr(ord(x) + 1) if h == 2 and "a" <= x <= "y" else x)
        assert r["t"] == (None if said is None else "".join(made))
    said = plan(df.select(corruption.typos(F.col("s"), F.col(RID), 5)))
    assert said.index("md5(") < said.index("lambdafunction(") or said.count("md5(") == 1
