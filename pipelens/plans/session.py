"""Recording: frames and columns that build a plan as a pipeline function uses them. Nothing runs while recording."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pipelens.functions import expr as E
from pipelens.operators import metrics, models, relational
from pipelens.plans.plan import Op, Phase, Plan
from pipelens.sources import readers
from pipelens.sources.readers import RID

_HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _code() -> tuple | None:
    """File and span of the user's call, from the frame's instruction positions; no rewriting of the source."""
    f = sys._getframe(1)
    while f and f.f_code.co_filename.startswith(_HERE):
        f = f.f_back
    if f is None:
        return None
    for k, (line, end, col, end_col) in enumerate(f.f_code.co_positions()):
        if k == f.f_lasti // 2:
            return (f.f_code.co_filename, line, col, end, end_col)
    return (f.f_code.co_filename, f.f_lineno, None, None, None)


class Session:
    """One recording. Frames come from the session's sources."""

    def __init__(self, spark: SparkSession, provenance: bool = True):
        self.spark, self.plan, self.provenance, self.sources = spark, Plan(), provenance, 0

    def _add(self, op, parents, build, **more):
        return self.plan.add(op, [p.node for p in parents], build, code=_code(), **more).id

    def _source(self, build, what: dict, description: str) -> Frame:
        number, self.sources = self.sources, self.sources + 1
        # where a row comes from: an id of its own for each source
        made = (lambda: _traced(build(), number)) if self.provenance else build
        df = made()
        node = self.plan.add(Op.SCAN, (), made, params={"source": what, "number": number}, description=description, columns=tuple(relational.data_columns(df)), code=_code())
        return Frame(self, node.id, relational.data_columns(df))

    def read_parquet(self, path: str, key: str | None = None) -> Frame:
        return self._source(lambda: readers.read_parquet(self.spark, path, key), {"parquet": path, "identity": self._identity(path), "key": key}, os.path.basename(path))

    def read_csv(self, path: str, **options) -> Frame:
        return self._source(lambda: readers.read_csv(self.spark, path, **options), {"csv": path, "identity": self._identity(path), **options}, os.path.basename(path))

    def frame(self, rows: list[tuple], schema: str) -> Frame:
        return self._source(lambda: readers.inline(self.spark, rows, schema), {"rows": rows, "schema": schema}, "inline frame")

    def series(self, values: list, kind: str, name: str = "_1") -> Column_:
        f = self._source(lambda: readers.series(self.spark, values, kind, name), {"values": values, "kind": kind}, name)
        return f[name]

    def random(self, n: int, seed: int = 0) -> Frame:
        return self._source(lambda: readers.random_numbers(self.spark, n, seed), {"random": n, "seed": seed}, "random numbers")

    def wrap(self, df: DataFrame, name: str = "frame") -> Frame:
        """A frame made elsewhere: an opaque source, known by its plan."""
        return self._source(lambda: readers.with_rid(readers.nan_to_null(df)), {"frame": df.semanticHash()}, name)

    def _identity(self, path: str) -> list:
        """What changes when the files do, from the file system Spark reads by."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        s = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p)
        return [s.getModificationTime(), s.getLen()]


def _traced(df: DataFrame, number: int) -> DataFrame:
    return df.withColumn(f"_prov_{number}", F.col(RID))


class Column_:
    """A recorded column: an expression over its frame's columns."""

    def __init__(self, frame: Frame, node: int, reads: tuple[str, ...], name: str | None = None):
        self.frame, self.session, self.node, self.reads, self.name = frame, frame.session, node, reads, name

    def _new(self, op, parents, build, description, **params) -> Column_:
        reads = tuple(dict.fromkeys(c for p in parents for c in p.reads))
        return Column_(self.frame, self.session._add(op, parents, build, params=params, description=description, reads=reads), reads)

    def _two(self, other, f, symbol, swap=False) -> Column_:
        g = (lambda a, b: f(b, a)) if swap else f
        if isinstance(other, Column_):
            return self._new(Op.COMPUTE, (self, other), g, symbol, f=symbol, swap=swap)
        return self._new(Op.COMPUTE, (self,), lambda a: g(a, other), f"{symbol} {other!r}", f=symbol, value=other, swap=swap)

    def __eq__(self, o): return self._two(o, E.eq, "=")  # noqa: E704
    def __ne__(self, o): return self._two(o, E.ne, "!=")  # noqa: E704
    def __lt__(self, o): return self._two(o, E.lt, "<")  # noqa: E704
    def __le__(self, o): return self._two(o, E.le, "<=")  # noqa: E704
    def __gt__(self, o): return self._two(o, E.gt, ">")  # noqa: E704
    def __ge__(self, o): return self._two(o, E.ge, ">=")  # noqa: E704
    def __and__(self, o): return self._two(o, E.both, "&")  # noqa: E704
    def __or__(self, o): return self._two(o, E.either, "|")  # noqa: E704
    def __xor__(self, o): return self._two(o, E.exclusive, "^")  # noqa: E704
    def __add__(self, o): return self._two(o, E.ARITHMETIC["+"], "+")  # noqa: E704
    def __radd__(self, o): return self._two(o, E.ARITHMETIC["+"], "+", True)  # noqa: E704
    def __sub__(self, o): return self._two(o, E.ARITHMETIC["-"], "-")  # noqa: E704
    def __rsub__(self, o): return self._two(o, E.ARITHMETIC["-"], "-", True)  # noqa: E704
    def __mul__(self, o): return self._two(o, E.ARITHMETIC["*"], "*")  # noqa: E704
    def __rmul__(self, o): return self._two(o, E.ARITHMETIC["*"], "*", True)  # noqa: E704
    def __truediv__(self, o): return self._two(o, E.divide, "/")  # noqa: E704
    def __rtruediv__(self, o): return self._two(o, E.divide, "/", True)  # noqa: E704
    __hash__ = None

    def __invert__(self):
        return self._new(Op.COMPUTE, (self,), E.invert, "~", f="~")

    def _one(self, op, f, name, **params):
        return self._new(op, (self,), f, f"{name} {params or ''}".strip(), f=name, **params)

    def isin(self, values): return self._one(Op.COMPUTE, lambda a: E.isin(a, values), "isin", values=list(values))  # noqa: E704
    def astype(self, kind): return self._one(Op.COMPUTE, lambda a: E.astype(a, kind), "astype", kind=kind)  # noqa: E704
    def fillna(self, value): return self._one(Op.MAP, lambda a: E.fill(a, value), "fillna", value=value)  # noqa: E704
    def len(self): return self._one(Op.COMPUTE, E.length, "str.len")  # noqa: E704
    def match(self, pattern): return self._one(Op.COMPUTE, lambda a: E.matches(a, pattern), "str.match", pattern=pattern)  # noqa: E704
    def contains(self, pattern, regex=True): return self._one(Op.COMPUTE, lambda a: E.contains(a, pattern, regex), "str.contains", pattern=pattern, regex=regex)  # noqa: E704

    def replace(self, old, new=None):
        mapping = old if isinstance(old, dict) else {old: new}
        return self._one(Op.MAP, lambda a: E.replace_values(a, mapping), "replace", mapping=[list(x) for x in mapping.items()])

    def label_binarize(self, classes):
        return self._one(Op.MAP, lambda a: E.binarize(a, classes)[0], "label_binarize", classes=classes)

    def map(self, f: Callable[[Column], Column], name: str = "map"):
        return self._one(Op.MAP, f, name, function=f)


class Grouped:
    def __init__(self, frame: Frame, keys: list[str]):
        self.frame, self.keys = frame, keys

    def agg(self, **aggs: tuple[str, str]) -> Frame:
        number = self.frame.session.sources
        self.frame.session.sources += 1

        def build(df):
            out = relational.group_agg(df, self.keys, aggs)
            # groups are new rows: they get ids and a source of their own
            out = out.withColumn(RID, F.xxhash64(*self.keys))
            return _traced(out, number) if self.frame.session.provenance else out

        return self.frame._next(Op.AGGREGATE, (self.frame,), build, f"groupby {self.keys}, agg {aggs}", [*self.keys, *aggs], reads=tuple(self.keys), keys=self.keys, aggs={k: list(v) for k, v in aggs.items()})


class Frame:
    """A recorded frame."""

    def __init__(self, session: Session, node: int, columns: list[str]):
        self.session, self.node, self.columns, self.reads = session, node, list(columns), tuple(columns)

    def _next(self, op, parents, build, description, columns, reads=(), writes=(), phase=None, **params) -> Frame:
        node = self.session._add(op, parents, build, params=params, description=description, columns=tuple(columns), reads=tuple(reads), writes=tuple(writes), phase=phase)
        return Frame(self.session, node, columns)

    def __getitem__(self, what):
        if isinstance(what, str):
            return Column_(self, self.session._add(Op.PICK, (self,), lambda df: F.col(what), params={"column": what}, description=f"to [{what!r}]", reads=(what,)), (what,), what)
        if isinstance(what, list):
            return self._next(Op.PICK, (self,), lambda df: relational.project(df, what), f"to {what}", what, reads=what, columns_=what)
        return self._next(Op.FILTER, (self, what), lambda df, mask: df.where(mask), "selection", self.columns, reads=what.reads)

    def assign(self, **columns) -> Frame:
        out = self
        for name, value in columns.items():
            names = out.columns if name in out.columns else [*out.columns, name]
            if isinstance(value, Column_):
                out = out._next(Op.MAP, (out, value), lambda df, c, name=name: df.withColumn(name, c), f"modifies [{name!r}]", names, reads=value.reads, writes=(name,), column=name)
            else:
                out = out._next(Op.MAP, (out,), lambda df, name=name, value=value: df.withColumn(name, F.lit(value)), f"modifies [{name!r}]", names, writes=(name,), column=name, value=value)
        return out

    def dropna(self, subset=None, how="any") -> Frame:
        return self._next(Op.FILTER, (self,), lambda df: relational.dropna(df, subset, how), "dropna", self.columns, reads=subset or self.columns, subset=subset, how=how, dropna=True)

    def fillna(self, value) -> Frame:
        return self._next(Op.MAP, (self,), lambda df: relational.fillna(df, value), f"fillna {value!r}", self.columns, reads=self.columns, writes=self.columns, value=value)

    def replace(self, old, new) -> Frame:
        return self._next(Op.MAP, (self,), lambda df: relational.replace(df, old, new), f"replace {old!r} by {new!r}", self.columns, reads=self.columns, writes=self.columns, old=old, new=new)

    def sample(self, frac=None, n=None, seed=0) -> Frame:
        return self._next(Op.FILTER, (self,), lambda df: relational.sample(df, frac, n, seed), "sample", self.columns, frac=frac, n=n, seed=seed, exact=True)

    def merge(self, other: Frame, on=None, left_on=None, right_on=None, how="inner", suffixes=("_x", "_y"), sort=False) -> Frame:
        lk, rk = ([on] if isinstance(on, str) else on, [on] if isinstance(on, str) else on) if on else ([left_on] if isinstance(left_on, str) else left_on, [right_on] if isinstance(right_on, str) else right_on)

        def build(a, b):
            renamed = b.withColumnRenamed(RID, "_rid_right")
            out = relational.merge(a, renamed, None, lk, rk, how, suffixes, sort)
            rid = F.col(RID) if how in ("left", "inner") else F.coalesce(RID, "_rid_right")
            return out.withColumn(RID, rid).drop("_rid_right")

        shared = (set(self.columns) & set(other.columns)) - {a for a, b in zip(lk, rk, strict=True) if a == b}
        names = [c + suffixes[0] if c in shared else c for c in self.columns] + [c + suffixes[1] if c in shared else c for c in other.columns if not (c in rk and c in lk)]
        return self._next(Op.JOIN, (self, other), build, f"on {lk} == {rk} ({how})", names, reads=[*lk, *rk], left_on=lk, right_on=rk, how=how, suffixes=list(suffixes), sort=sort)

    def fuzzy_merge(self, other: Frame, left_on: str, right_on: str, threshold: float = 0.6) -> Frame:
        build = lambda a, b: relational.fuzzy_merge(a.drop(*[c for c in a.columns if c.startswith("_prov_") and c in b.columns]), b.drop(RID), left_on, right_on, threshold)
        shared = set(self.columns) & set(other.columns)
        names = [c + "_x" if c in shared else c for c in self.columns] + [c + "_y" if c in shared else c for c in other.columns]
        return self._next(Op.JOIN, (self, other), build, f"{left_on} ~ {right_on} ({threshold})", names, reads=[left_on, right_on], left_on=left_on, right_on=right_on, threshold=threshold, fuzzy=True)

    def groupby(self, keys) -> Grouped:
        return Grouped(self, [keys] if isinstance(keys, str) else list(keys))

    def train_test_split(self, test_size=0.25, seed=0) -> tuple[Frame, Frame]:
        main = self._next(Op.SPLIT, (self,), lambda df: relational.train_test_split(df, test_size, seed), "split", self.columns, test_size=test_size, seed=seed)
        return tuple(main._next(Op.SPLIT, (main,), lambda v, i=i: v[i], f"split ({'train' if i == 0 else 'test'} data)", self.columns, part=i) for i in (0, 1))

    def retrieve(self, corpus: Frame, k=4, vector="embedding") -> Frame:
        return self._next(Op.RETRIEVE, (self, corpus), lambda q, c: relational.top_k(q, c, k, vector), f"{k} nearest", ["query", "doc", "distance", "rank"], k=k, vector=vector)

    def extract(self, label: str) -> Frame:
        return self._next(Op.OUTPUT, (self,), lambda df: df, label, self.columns, label=label)

    # what a model sees; the markers say which side a frame is on
    def fit(self, features, model, label: str) -> Fitted:
        train = self._next(Op.ROLE, (self,), lambda df: df, "train rows", self.columns, role="train rows")
        fitted = self.session._add(Op.ENCODE, (train,), lambda df: features.copy().fit(df), params={"transformer": features}, description=f"{type(features).__name__}: fit", phase=Phase.FIT, reads=tuple(features.columns))
        seen = self.session.plan.add(Op.ENCODE, (fitted, train.node), lambda t, df: t.apply(df), params={"apply": True}, description="apply (train)", phase=Phase.APPLY, columns=tuple(self.columns)).id
        labels = self.session.plan.add(Op.ROLE, (seen,), lambda df: df, params={"role": "train labels", "label": label}, description="train labels", reads=(label,)).id
        est = self.session.plan.add(Op.FIT, (labels,), lambda df: models.make(model).fit(df, label), params={"model": model, "label": label}, description=type(models.make(model)).__name__, code=_code()).id
        return Fitted(self.session, fitted, est, label)


class Fitted:
    def __init__(self, session: Session, features: int, model: int, label: str):
        self.session, self.features, self.model, self.label = session, features, model, label

    def predict(self, test: Frame) -> Frame:
        plan = self.session.plan
        data = plan.add(Op.ROLE, (test.node,), lambda df: df, params={"role": "test rows"}, description="test rows", columns=tuple(test.columns)).id
        seen = plan.add(Op.ENCODE, (self.features, data), lambda t, df: t.apply(df), params={"apply": True}, description="apply (test)", phase=Phase.APPLY, columns=tuple(test.columns)).id
        node = plan.add(Op.PREDICT, (self.model, seen), lambda m, df: m.predict(df), description="predict", columns=(*test.columns, "prediction"), code=_code()).id
        return Frame(self.session, node, [*test.columns, "prediction"])

    def score(self, test: Frame, metric: str = "accuracy", name: str | None = None) -> int:
        """Adds a score. It is a column to aggregate; the executor works out all scores of a frame in one pass."""
        predicted = self.predict(test)
        labels = self.session.plan.add(Op.ROLE, (predicted.node,), lambda df: df, params={"role": "test labels", "label": self.label}, description="test labels", reads=(self.label,)).id
        made = metrics.METRICS[metric]
        return self.session.plan.add(Op.SCORE, (labels,), lambda df: (df, made(self.label)), params={"metric": metric, "name": name or metric}, description=metric, code=_code()).id
