"""What-if analyses: each turns a plan into variants and their scores into a report. The first row is the original."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import functions as F

from pipelens.functions.hashing import fractions
from pipelens.operators import cleaning, corruption, features, models, relational
from pipelens.plans.optimizer import MultiQuery, Variant
from pipelens.plans.patches import AddFilter, ChangeColumn, RemoveNode, ReplaceFrame, ReplaceModel, ReplaceTransformer, column_location, fits
from pipelens.plans.plan import Op, Plan
from pipelens.sources.readers import RID


class Analysis:
    """variants(plan, executor) says what to try; report(variants, scores) makes rows of it. Users may bring their own."""

    def variants(self, plan: Plan, executor) -> list[Variant]:
        raise NotImplementedError

    def report(self, variants: list[Variant], scores: list[dict]) -> list[dict]:
        return [v.labels | s for v, s in zip(variants, scores, strict=True)]


def corruption_changes(df, column: str, kind, shares, seed: int) -> list:
    """For every share, Column -> Column that corrupts so many of the rows of a frame like df. What has to be known of
    the frame is found once for all shares."""
    f = corruption.CORRUPTIONS[kind] if isinstance(kind, str) else kind
    known = corruption.parameters(df, column, kind if isinstance(kind, str) else "")

    def change(hit):
        return lambda c: F.when(hit, f(c, F.col(RID), seed=seed, **known)).otherwise(c)

    return [change(hit) for hit in fractions(df, F.col(RID), list(shares), seed)]


@dataclass
class DataCorruption(Analysis):
    """columns: [(column, kind or function)]. Each corrupts shares of the test rows, and of both sides if asked."""

    columns: list[tuple[str, Any]]
    percentages: tuple[float, ...] = (0.2, 0.5, 0.9)
    also_train: bool = False
    seed: int = 1
    models: list[tuple[str, Any]] = field(default_factory=list)

    def variants(self, plan, executor):
        out = [Variant({"column": None, "corruption_percentage": None})]
        for column, kind in self.columns:
            at = {s: column_location(plan, column, s) for s in (("test", "train") if self.also_train else ("test",))}
            changes = {s: corruption_changes(executor.keep(plan, i), column, kind, self.percentages, self.seed) for s, i in at.items()}
            for k, p in enumerate(self.percentages):
                change = {s: c[k] for s, c in changes.items()}
                labels = {"column": column, "corruption_percentage": p}
                patch = ChangeColumn(column, change["test"], f"corrupt {column} {kind} {p} {self.seed}")
                out.append(Variant(labels | {"_side": "test"}, [patch], (column, change["test"])))
                if self.also_train:
                    out.append(Variant(labels | {"_side": "both"}, [patch, ChangeColumn(column, change["train"], f"corrupt {column} {kind} {p} {self.seed} train", "train")]))
        if self.models:
            out = [Variant(v.labels | {"model": n}, [*v.patches, ReplaceModel(f, n)]) for n, f in self.models for v in out]
        return out

    def report(self, variants, scores):
        rows: dict = {}
        for v, s in zip(variants, scores, strict=True):
            labels = {k: x for k, x in v.labels.items() if k != "_side"}
            both = v.labels.get("_side") == "both"
            row = rows.setdefault(tuple(labels.items()), dict(labels))
            row |= {f"{k}_corrupt_{'train_and_test' if both else 'test_only'}": x for k, x in s.items()}
            if "_side" not in v.labels and self.also_train:
                row |= {f"{k}_corrupt_train_and_test": x for k, x in s.items()}
        return list(rows.values())


def DataCorruptionWithModels(columns, model_variants, percentages=(0.2, 0.5, 0.9), also_train=False, seed=1):  # noqa: N802
    """Every corruption with every model."""
    return DataCorruption(columns, percentages, also_train, seed, list(model_variants))


class ErrorType(Enum):
    NUM_MISSING = "numeric missing values"
    CAT_MISSING = "categorical missing values"
    OUTLIERS = "outliers"
    DUPLICATES = "duplicates"
    MISLABEL = "mislabelled"


CLEANERS = {
    ErrorType.NUM_MISSING: [("delete", "delete"), ("mean", "mean"), ("median", "median"), ("mode", "mode")],
    ErrorType.CAT_MISSING: [("delete", "delete"), ("mode", "mode"), ("dummy", "dummy")],
    ErrorType.OUTLIERS: [(f"{n}_{r}", (rule, r)) for n, rule in (("sd", "sd"), ("iqr", "iqr"), ("if", "if")) for r in ("mean", "median", "mode")],
    ErrorType.DUPLICATES: [("delete", None)],
    ErrorType.MISLABEL: [("confident_learning", None), ("shapley", None)],
}


@dataclass
class DataCleaning(Analysis):
    """columns: {column or None: ErrorType}; None is the label. methods: those to try, of CLEANERS (default: all).
    shapley_rows: training rows by which the Shapley method values all the others, chosen by hash; None takes all, at
    a cost of rows times rows."""

    columns: dict
    methods: list[str] | None = None
    shapley_rows: int | None = 100

    def variants(self, plan, executor):
        out = [Variant({"corrupted_column": None, "error": None, "cleaning_method": None})]
        for column, error in self.columns.items():
            for name, how in (x for x in CLEANERS[error] if self.methods is None or x[0] in self.methods):
                out.append(Variant({"corrupted_column": column, "error": error.value, "cleaning_method": name}, self._patches(plan, column, error, how, name)))
        return out

    def _patches(self, plan, column, error, how, name):
        said = f"clean {column} {error.name} {name}"
        if error in (ErrorType.NUM_MISSING, ErrorType.CAT_MISSING):
            fix = lambda train, df: cleaning.repair_missing(train, df, column, how)
            return [ReplaceFrame(fix, said)] + ([] if how == "delete" else [ReplaceFrame(fix, said, "test")])
        if error is ErrorType.OUTLIERS:
            fix = lambda train, df: cleaning.repair_outliers(train, df, column, *how)
            return [ReplaceFrame(fix, said), ReplaceFrame(fix, said, "test")]
        if error is ErrorType.DUPLICATES:
            return [ReplaceFrame(lambda train, df: relational.drop_duplicates(df, [column]), said)]
        n = plan.only(Op.FIT)
        inner, label = n.params["model"], n.params["label"]
        return [ReplaceModel(lambda: Doubted(inner, name, label, self.shapley_rows), said)]


class Doubted(models.Model):
    """Fits on the rows whose labels aren't doubted: by out-of-fold probabilities, or by negative Shapley values."""

    def __init__(self, inner, method: str, label: str, rows: int | None = 100):
        self.inner, self.method, self.rows = inner, method, rows

    def spec(self):
        return {"method": self.method, "rows": self.rows}

    def fit(self, df, label):
        if self.method == "shapley":
            from pyspark.ml.functions import vector_to_array

            from pipelens.operators.diagnostics import knn_shapley

            v = df.select(RID, label, vector_to_array("features").alias("_x"))
            few = v if self.rows is None else relational.sample(v, n=min(self.rows, v.count()), seed=3)
            bad = knn_shapley(v, few, "_x", label, 10).where("shapley < 0").select(F.col("train").alias(RID))
        else:
            bad = cleaning.confident_learning(df, label, models.proxy).where("doubted").select(RID)
        self._model = models.make(self.inner).fit(df.join(bad, RID, "left_anti"), label)
        return self

    def predict(self, df):
        return self._model.predict(df)


@dataclass
class OperatorImpact(Analysis):
    """Transformers become pass-through, constant imputation or one-hot; filters are left out. Encoders that a model
    can't do without, `dropna` and the filters that make the split stay."""

    transformers: bool = True
    selections: bool = True
    lines: list[int] | None = None

    def variants(self, plan, executor):
        out = [Variant({"operator_type": None, "operator_lineno": None, "operator_code": None, "strategy_description": None})]
        if self.transformers:
            for n in fits(plan):
                whole = n.params["transformer"]
                parts = whole.transformers if isinstance(whole, features.ColumnTransformer) else [whole]
                for i, t in enumerate(parts):
                    for name, other in self._instead(t):
                        swapped = features.ColumnTransformer(*(other if k == i else p.copy() for k, p in enumerate(parts)), output=getattr(whole, "output", "features"))
                        out.append(Variant(self._said("Transformer", n, type(t).__name__, name), [ReplaceTransformer(n.id, swapped, f"{type(t).__name__}[{i}] {name}")]))
        if self.selections:
            for ids in removable(plan):
                n = plan.nodes[ids[0]]
                out.append(Variant(self._said("Selection", n, n.description, "drop"), [RemoveNode(i) for i in ids]))
        return [v for v in out if self.lines is None or v.labels["operator_lineno"] in (None, *self.lines)]

    @staticmethod
    def _said(kind, n, code, how):
        return {"operator_type": kind, "operator_lineno": n.code[1] if n.code else None, "operator_code": code, "strategy_description": how}

    @staticmethod
    def _instead(t):
        if isinstance(t, (features.StandardScaler, features.RobustScaler, features.FunctionTransformer)):
            return [("passthrough", features.Passthrough(t.columns))]
        if isinstance(t, features.SimpleImputer) and t.strategy != "constant":
            return [("constant", features.SimpleImputer(t.columns, "constant"))]
        if isinstance(t, features.KBinsDiscretizer):
            return [("passthrough", features.Passthrough(t.columns)), ("one-hot", features.OneHotEncoder(t.columns))]
        return []


def removable(plan: Plan) -> list[list[int]]:
    """Filters that can be left out; the same filter on both sides goes together."""
    groups: dict[str, list[int]] = {}
    train = {a for m in plan.role("train rows") for a in plan.ancestors(m.id)}
    test = {a for m in plan.role("test rows") for a in plan.ancestors(m.id)}
    for n in plan.of(Op.FILTER):
        if n.params.get("dropna") or n.params.get("exact"):
            continue
        # two filters of one frame that lead to the two sides are the split itself
        siblings = [k for k in plan.children(n.parents[0]) if plan.nodes[k].op == Op.FILTER and k != n.id]
        if any((n.id in train) != (k in train) and (n.id in test) != (k in test) for k in siblings):
            continue
        mask = plan.nodes[n.parents[1]] if len(n.parents) > 1 else n
        groups.setdefault(f"{mask.description}{n.reads}{mask.params}", []).append(n.id)
    return list(groups.values())


@dataclass
class ModelVariants(Analysis):
    models: list[tuple[str, Any]]

    def variants(self, plan, executor):
        return [Variant({"model_variant": None})] + [Variant({"model_variant": n}, [ReplaceModel(f, n)]) for n, f in self.models]


@dataclass
class PermutationFeatureImportance(Analysis):
    """Test values of one feature change places."""

    restrict_to: list[str] | None = None
    seed: int = 1

    def variants(self, plan, executor):
        used = list(dict.fromkeys(c for n in fits(plan) for c in n.reads))
        out = [Variant({"column": None})]
        for c in self.restrict_to or used:
            at = column_location(plan, c, "test")
            out.append(Variant({"column": c}, [PermuteColumn(c, at, self.seed)]))
        return out


@dataclass(frozen=True)
class PermuteColumn:
    column: str
    at: int
    seed: int

    def apply(self, plan):
        n = plan.nodes[self.at]
        c, seed = self.column, self.seed
        only = {k for k in plan.children(self.at) if plan.nodes[k].params.get("role") != "train rows"}
        return plan.inserted_after(self.at, Op.JOIN, lambda df: corruption.permute(df, c, seed), only=only, params={"permute": c, "seed": seed}, description=f"permute {c}", columns=n.columns, reads=(c,), writes=(c,))[0]


@dataclass
class DataFilterVariants(Analysis):
    """filters: {name: (column, Column -> Column)}, each on training and test rows."""

    filters: dict
    add_dummy_model: bool = False

    def variants(self, plan, executor):
        out = [Variant({"filter_variant": None, "column": None})]
        out += [Variant({"filter_variant": n, "column": c}, [AddFilter(f, c, n), AddFilter(f, c, n, "train")]) for n, (c, f) in self.filters.items()]
        if self.add_dummy_model:
            out.append(Variant({"filter_variant": "dummy model", "column": None}, [ReplaceModel(models.Dummy, "dummy")]))
        return out


def run(plan: Plan, analyses: list[Analysis], rules=None) -> tuple[list[list[dict]], list[dict]]:
    """All analyses' variants as one workload. Returns the reports and how the workload was run."""
    from pipelens.plans.executor import Executor
    from pipelens.plans.optimizer import Rules, push_filters_up

    rules = rules or Rules()
    executor = Executor(share=rules.share_prefix)
    query = MultiQuery(plan, rules, executor)
    variants = [a.variants(plan, executor) for a in analyses]
    if rules.filter_delete_up and (gone := [[p.node for p in v.patches if isinstance(p, RemoveNode)] for vs in variants for v in vs if any(isinstance(p, RemoveNode) for p in v.patches)]):
        query.plan = push_filters_up(plan, gone, {})
    flat = [v for vs in variants for v in vs]
    if query.plan is not plan:  # moved filters have new ids
        flat = [v for a in analyses for v in a.variants(query.plan, executor)]
    scores = query.run(flat)
    out, at = [], 0
    for a, vs in zip(analyses, variants, strict=True):
        out.append(a.report(flat[at : at + len(vs)], scores[at : at + len(vs)]))
        at += len(vs)
    return out, [query.info]
