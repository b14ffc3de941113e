"""Recording, patches, the optimiser, shadow diagnostics, edited pipelines."""

import pytest

from pipelens import api
from pipelens.analyses import shadow, whatif
from pipelens.operators import features as X
from pipelens.operators import models
from pipelens.plans.executor import Executor
from pipelens.plans.optimizer import MultiQuery, Rules, Variant, push_filters_up
from pipelens.plans.patches import RemoveNode, column_location
from pipelens.plans.plan import Op
from pipelens.plans.session import Session

TRAIN = [(0, 0, "no", "cat_a"), (0, 1, "no", "cat_a"), (0, 3, "yes", "cat_a"), (0, 4, "yes", "cat_b")]
TEST = [(0, 4, "yes", "cat_a"), (0, 3, "yes", "cat_b"), (0, 4, "yes", "cat_a"), (0, 3, "yes", "cat_b")]
SCHEMA = "A long, B long, target string, race string"


def mini(s, model=models.decision_tree, scaler=X.StandardScaler, extra=None, rows=TRAIN):
    train, test = s.frame(rows, SCHEMA), s.frame(TEST, SCHEMA)
    train, test = (f.assign(label=f["target"].label_binarize(["no", "yes"])) for f in (train, test))
    train, test = (extra(f) if extra else f for f in (train, test))
    train, test = train[["A", "B", "label"]], test[["A", "B", "label"]]
    train.fit(X.ColumnTransformer(scaler(["A", "B"])), model, "label").score(test)


def filtered(s):
    f = s.frame([(i, i % 7, i % 2) for i in range(80)], "A long, B long, label int")
    g = s.frame([(i, i * 2) for i in range(80)], "A long, C long")
    f = f[f["B"] != 3]
    j = f.merge(g, on="A")
    train, test = j.train_test_split(0.25, seed=2)
    train.fit(X.ColumnTransformer(X.StandardScaler(["A", "C"])), models.NearestCentroid, "label").score(test)


def plan(spark, f=mini, **o):
    s = Session(spark)
    f(s, **o)
    return s.plan


def test_recording_and_rerun(spark):
    p = plan(spark)
    assert Executor().scores([p]) == [{"accuracy": 1.0}]
    assert p.key(p.only(Op.PREDICT).id) == (q := plan(spark)).key(q.only(Op.PREDICT).id)
    assert p.only(Op.FIT).code[0].endswith("test_plans.py") and "digraph" in p.to_dot()
    s = Session(spark)
    f = s.frame([(1, 2.0), (2, None)], "a long, b double")
    g = f.assign(c=f["a"] / f["b"] + 1, d="x").dropna().fillna(0).replace("x", "y")[["a", "c", "d"]]
    h = g[(g["c"] >= 1) & ~g["a"].isin([7]) | (g["d"] == "q")]
    assert [tuple(r) for r in Executor().value(s.plan, h.node).select("a", "c", "d", "_prov_0").collect()] == [(1, 1.5, "y", 0)]


def test_fluent_sources(spark, tmp_path):
    code = "f = session.frame([(i, i % 2) for i in range(8)], 'x long, label int')\nfrom pipelens.operators import features as X, models\nf.fit(X.ColumnTransformer(X.StandardScaler(['x'])), models.Dummy, 'label').score(f)\nf.extract('rows')\n"
    r = api.on_pipeline(spark, code).execute()
    assert r.scores == {"accuracy": 0.5} and r.info["extracted"]["rows"].count() == 8
    (tmp_path / "p.py").write_text(code)
    assert api.on_pipeline(spark, str(tmp_path / "p.py")).without_provenance().execute().scores == r.scores
    assert api.on_previous(spark, r.extraction).execute().scores == r.scores


SHAPES = [
    (whatif.DataCorruption([("A", "scaling"), ("B", "scaling")], also_train=True), 7, 4),
    (whatif.DataCorruptionWithModels([("A", "scaling"), ("B", "scaling")], [("tree", models.decision_tree), ("dummy", models.Dummy)]), 14, 4),
    (whatif.DataCleaning({"B": whatif.ErrorType.DUPLICATES}), 2, 4),
    (whatif.DataCleaning({}), 1, 4),
    (whatif.DataCleaning({"A": whatif.ErrorType.NUM_MISSING}), 5, 4),
    (whatif.OperatorImpact(), 2, 5),
    (whatif.PermutationFeatureImportance(), 3, 2),
    (whatif.ModelVariants([("a", models.Dummy), ("b", models.logistic_regression)]), 3, 2),
    (whatif.DataFilterVariants({"f": ("B", lambda c: c > 0)}, add_dummy_model=True), 3, 3),
]


@pytest.mark.parametrize("analysis,rows,columns", SHAPES, ids=lambda x: type(x).__name__)
def test_report_shapes_and_optimised_equals_unoptimised(spark, analysis, rows, columns):
    p = plan(spark)
    fast = whatif.run(p, [analysis])[0][0]
    slow = whatif.run(p, [analysis], Rules(False, False, False, False, False))[0][0]
    assert len(fast) == rows and max(map(len, fast)) == columns and fast == slow


def test_variants_share_their_prefix(spark):
    p = plan(spark, filtered)
    ex = Executor()
    MultiQuery(p, Rules(fuse=False), ex).run([Variant({})] + whatif.ModelVariants([(str(i), models.Dummy) for i in range(3)]).variants(p, ex))
    assert ex.counters.built == len(p.nodes) + 3 * 4 and ex.counters.kept >= 1 and ex.counters.released == ex.counters.kept
    q = MultiQuery(p)
    q.run(whatif.DataCorruption([("C", "scaling")]).variants(p, q.executor))
    assert q.info["fused"] == 3 and q.info["separate"] == 1


def test_filters_move_above_shared_work(spark):
    p = plan(spark, filtered)
    f = next(n for n in p.of(Op.FILTER))
    moved = push_filters_up(p, [[f.id]], {f.id: 0.9})
    sel, join = moved.of(Op.FILTER)[0], moved.of(Op.JOIN)[0]
    assert join.id in moved.ancestors(sel.id) and Executor().scores([moved]) == Executor().scores([p])
    assert push_filters_up(p, [[f.id]], {f.id: 0.1}) is p  # too selective: the shared work would grow
    assert Executor().scores([RemoveNode(sel.id).apply(moved).pruned()]) == Executor().scores([RemoveNode(f.id).apply(p).pruned()])
    a = api.on_pipeline(spark, filtered).add_what_if(whatif.ModelVariants([(str(i), models.Dummy) for i in range(4)]))
    e = a.estimate()
    assert e["original"] <= e["shared"] < e["independent"]


def test_late_changes_stay_behind_what_does_not_touch_the_column(spark):
    p = plan(spark, filtered)
    assert column_location(p, "C", late=True) >= column_location(p, "C", late=False)


def test_edits_are_classified_and_reuse_results(spark):
    first = api.on_pipeline(spark, mini).execute()
    swapped = api.on_changed(spark, first.extraction, lambda s: mini(s, scaler=X.RobustScaler)).execute()
    assert swapped.changes.replacement == 1 and swapped.changes.too_many == 0 and swapped.changes.reused > 5
    assert swapped.scores == api.on_pipeline(spark, lambda s: mini(s, scaler=X.RobustScaler)).execute().scores
    added = api.on_changed(spark, first.extraction, lambda s: mini(s, extra=lambda f: f.fillna(0))).execute()
    assert added.changes.addition >= 1 and added.scores == first.scores
    same = api.on_changed(spark, first.extraction, mini).execute()
    assert same.changes.reexecuted == 0 and same.info["built"] == 0 or same.scores == first.scores
    edited = [*TRAIN[:3], (5, *TRAIN[3][1:])]
    assert api.on_changed(spark, first.extraction, lambda s: mini(s, rows=edited)).execute().changes.replacement == 1


def test_shadow_diagnostics(spark):
    def noisy(s):
        rows = [(float(i), (i >= 20) if i not in (3, 30) else (i < 20), "ab"[i % 2]) for i in range(40)]
        f = s.frame([(x, int(y), g) for x, y, g in rows], "x double, label int, race string")
        train, test = f[["x", "label"]].train_test_split(0.5, seed=1)
        train.fit(X.ColumnTransformer(X.StandardScaler(["x"])), lambda: models.Stump(0), "label").score(test)

    r = api.on_pipeline(spark, noisy).add_shadow(shadow.LabelErrors(batch=2, only_negative=True)).add_shadow(shadow.DataErrorRobustness(0.5)).add_shadow(shadow.FairnessSlices()).execute()
    assert r.shadows["LabelErrors"]["flipped"] <= 2 and "before" in r.shadows["LabelErrors"]
    x = r.shadows["DataErrorRobustness"]["x"]
    assert x["corrupted"] < x["before"] and x["fixed"] is not None
    assert "race" in str(r.shadows["FairnessSlices"]) or r.shadows["FairnessSlices"]["slice"] is None


def test_changed_rows_only_equals_a_full_run(spark):
    from pyspark.sql import functions as F

    p, ex = plan(spark, filtered), Executor()
    s = shadow._sides(p, ex)
    bad = s["test"].withColumn("C", F.when(F.col("_rid") % 3 == 0, F.col("C") * 100).otherwise(F.col("C")))
    from pipelens.operators.relational import changed_rows

    part = shadow.rescored(s, s["predicted"].select("_rid", "label", "prediction"), bad, changed_rows(s["test"], bad, ["C"]))
    whole = s["model"].predict(s["features"].apply(bad))
    key = lambda df: sorted((r["_rid"], r["prediction"]) for r in df.collect())
    assert key(part) == key(whole)
