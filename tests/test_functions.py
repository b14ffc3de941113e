"""Comparison semantics, seeded hashing, relational operators: the small known answers."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pipelens.functions import expr as E
from pipelens.functions import hashing
from pipelens.functions import text as T
from pipelens.functions.hashing import MODULUS, chosen, draw, fractions, thresholds
from pipelens.operators import relational as R
from pipelens.sources import readers
from pipelens.sources.readers import RID


def col(df, c):
    return [r[0] for r in df.orderBy(RID).select(c).collect()]


@pytest.fixture
def a(spark):
    return readers.inline(spark, [(0,), (2,), (4,), (None,)], "A long")


def test_missing_values_compare_as_frames_do(a):
    c = F.col("A")
    assert col(a, E.gt(c, 3)) == [False, False, True, False]
    assert col(a, E.ne(c, 2)) == [True, False, True, True] and col(a, E.ne(c, F.lit(None))) == [True] * 4
    assert col(a, E.eq(c, 2)) == [False, True, False, False]
    assert col(a, E.isin(c, [2, 4])) == [False, True, True, False] and col(a, E.isin(c, [None])) == [False, False, False, True]
    assert col(a, E.astype(c.cast("double"), "str")) == ["0.0", "2.0", "4.0", "nan"]
    assert col(a, E.fill(c, 0)) == [0, 2, 4, 0] and col(a, c + 2) == [2, 4, 6, None]
    assert col(a, E.divide(c, F.lit(0))) == [None] * 4
    assert col(a, E.invert(E.lt(c, 3))) == [False, False, True, True]


def test_strings_and_maps(spark):
    s = readers.series(spark, ["aa", "b", "ccc", ""], "string", "s")
    c = F.col("s")
    assert col(s, E.length(c)) == [2, 1, 3, 0]
    assert col(s, E.matches(c, "(a|c)*$")) == [True, False, True, True] == col(s, E.contains(c, "^(a|c)*$"))
    b = readers.series(spark, [True, False, True], "boolean", "b")
    assert col(b, E.replace_values(F.col("b"), {True: "x", False: "y"})) == ["x", "y", "x"]
    y = readers.series(spark, ["yes", "no", "no", "yes"], "string", "y")
    assert col(y, E.binarize(F.col("y"), ["no", "yes"])[0]) == [1, 0, 0, 1]
    assert col(readers.series(spark, ["1:2:3"], "string", "i"), T.parse_image(F.col("i"))) == [[1.0, 2.0, 3.0]]


def plain_draw(rid, seed=0, stream=0):
    return int(hashlib.md5(f"{rid}:{seed}:{stream}".encode()).hexdigest()[:8], 16) % MODULUS


def test_choices_are_exact_nested_and_independent(spark, monkeypatch):
    df = spark.range(20_000).withColumnRenamed("id", RID)
    far = [0, 1, 5 + (1 << 40), 5 + (2 << 40), -3]  # the whole id counts
    got = readers.inline(spark, [(i,) for i in far], "i long").select(draw(F.col("i"), 3, 1)).collect()
    assert [r[0] for r in got] == [plain_draw(i, 3, 1) for i in far]
    preds = fractions(df, F.col(RID), [0.0, 0.2, 0.5, 0.9, 1.0], 7)
    got = [{r[0] for r in df.where(p).collect()} for p in preds]
    assert [len(g) for g in got] == [0, 4000, 10_000, 18_000, 20_000] and got[1] < got[2] < got[3]
    order = sorted(range(20_000), key=lambda r: (plain_draw(r, 7), r))
    assert got[1] == set(order[:4000])
    other = {r[0] for r in df.where(fractions(df, F.col(RID), [0.2], 8)[0]).collect()}
    assert 600 < len(got[1] & other) < 1000  # of 4,000: another seed chooses other rows
    same = spark.range(6).withColumnRenamed("id", RID)
    monkeypatch.setattr(hashing, "draw", lambda rid, seed=0, stream=0: F.lit(7).cast("long"))  # all alike: the ids decide
    t = thresholds(same, F.col(RID), [0, 1, 3, 6])
    assert [same.where(chosen(F.col(RID), x)).count() for x in t] == [0, 1, 3, 6]


def test_frames(spark):
    df = readers.inline(spark, [(0, None, 2), (1, 2, 3), (4, None, 2), (9, 2, 3)], "A long, B long, C long")
    assert R.dropna(df).count() == 2 and R.project(df, ["A", "C"]).columns[:2] == ["A", "C"]
    assert col(R.fillna(df, 0), "B") == [0, 2, 0, 2] and col(R.replace(df, 2, 5), "B") == [None, 5, None, 5]
    assert R.sample(df, 0.5, seed=1).count() == 2 and R.drop_duplicates(df, ["B", "C"]).count() == 2
    tr, te = R.train_test_split(df)
    assert (tr.count(), te.count()) == (3, 1)
    g = R.group_agg(readers.inline(spark, [("A", 1), ("B", 2), ("A", 1), ("C", 3), ("B", 4), (None, 9)], "g string, v long"), ["g"], {"m": ("v", "mean"), "f": ("v", "first"), "l": ("v", "last")})
    assert sorted(map(tuple, g.collect())) == [("A", 1.0, 1, 1), ("B", 3.0, 2, 4), ("C", 3.0, 3, 3)]


def test_joins(spark):
    a = readers.inline(spark, [(0, 1), (2, 2), (4, 4), (8, 5), (5, 7)], "A long, B long")
    b = readers.inline(spark, [(1, 1), (2, 5), (3, 4), (4, 11), (5, None)], "B long, C long").drop(RID)
    assert sorted(map(tuple, R.merge(a, b, on=["B"]).select("A", "B", "C").collect()), key=str) == [(0, 1, 1), (2, 2, 5), (4, 4, 11), (8, 5, None)]
    out = R.merge(a.drop(RID), b, on=["B"], how="outer").collect()
    assert len(out) == 6 and {r["B"] for r in out} == {1, 2, 3, 4, 5, 7}
    n = readers.inline(spark, [(None, 1), (2, 2)], "k long, x long").drop(RID)
    assert R.merge(n, n, on=["k"]).count() == 2
    names = ["George Smiley", "Oliver Lacon", "Toby Esterhase", "Jim Prideaux", "Peter Guillam"]
    others = ["Peter Guillam", "Oliver LACON", "George SMILEY", "Claus Kretzschmar", "Konny Saks"]
    x = readers.series(spark, names, "string", "n").drop(RID)
    y = readers.series(spark, others, "string", "m").drop(RID)
    assert {tuple(r) for r in R.fuzzy_merge(x, y, "n", "m").collect()} == {(names[0], others[2]), (names[1], others[1]), (names[4], others[0])}


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.6, 0.75, 0.9, 1.0])
def test_fuzzy_join_loses_nothing(spark, threshold):
    import random

    rng = random.Random(11)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(0, 9))) for _ in range(60)})
    x = readers.series(spark, words, "string", "n").drop(RID)
    y = x.withColumnRenamed("n", "m")
    got = {tuple(r) for r in R.fuzzy_merge(x, y, "n", "m", threshold).collect()}
    want = {tuple(r) for r in x.crossJoin(y).where(R.similarity(F.col("n"), F.col("m")) >= threshold).collect()}
    assert got == want


def test_top_k_and_text_cache(spark, tmp_path):
    rows = [(i, [float(i), 0.0]) for i in range(30)]
    c = spark.createDataFrame(rows, "_rid long, embedding array<float>")
    got = R.top_k(c.where("_rid = 10"), c, 4).orderBy("rank").collect()
    assert [r["doc"] for r in got] == [10, 9, 11, 8]
    cache = readers.TextCache(spark, str(tmp_path / "c"))
    df = readers.series(spark, ["a", "b", "a", None], "string", "s")
    assert col(cache.apply(df, "s", "t", F.upper), "t") == ["A", "B", "A", None]
    assert col(cache.apply(df, "s", "t", lambda x: F.lit("new")), "t") == ["A", "B", "A", None]


def test_sources(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("a,b\n1,?\n2,z\n")
    df = readers.read_csv(spark, str(p))
    assert df.orderBy("a").select("a", "b").collect() == [(1, None), (2, "z")] and df.select(RID).distinct().count() == 2
    j = tmp_path / "x.json"
    j.write_text('{"data": [{"k": 1, "v": "p"}, {"k": 2, "v": "q"}]}')
    assert readers.from_records(spark, str(j), "data", "k long, v string").select("v").collect() == [("p",), ("q",)]
    assert readers.random_numbers(spark, 5, 1).collect() == readers.random_numbers(spark, 5, 1).repartition(3).orderBy(RID).collect()
    fixed = T.spell_fix(readers.series(spark, ["teh cat", "dog"], "string", "s"), "s", spark.createDataFrame([("teh", "the")], "wrong string, right string"))
    assert col(fixed, "s") == ["the cat", "dog"]
