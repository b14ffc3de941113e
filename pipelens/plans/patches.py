"""Edits that make a variant of a plan, and where in the plan they belong."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import functions as F

from pipelens.plans.plan import ROW_WISE, Op, Phase, Plan

SIDES = {"test": "test rows", "train": "train rows"}


def side_nodes(plan: Plan, side: str) -> list[int]:
    """Frames on the way to a side's marker, from the side's own part of the split (or the sources) to the marker's parent."""
    markers = plan.role(SIDES[side])
    other = plan.role(SIDES["train" if side == "test" else "test"])
    shared = {a for m in other for a in plan.ancestors(m.id)}
    own = {a for m in markers for a in plan.ancestors(m.id)}
    return [i for i in plan.order() if i in own and (i not in shared) and plan.nodes[i].columns]


def column_location(plan: Plan, column: str, side: str = "test", late: bool = True) -> int:
    """The frame after which a changed column takes effect. Late: as near to the model as can be, just before the first
    operator that reads or changes the column; all before it is shared with the original. Early: the first frame of
    the side that has the column."""
    marker = plan.role(SIDES[side])[0]
    frames = [i for i in side_nodes(plan, side) if column in plan.nodes[i].columns]
    if not frames:
        return marker.parents[0]
    if not late:
        return frames[0]
    for i in frames:
        n = plan.nodes[i]
        if i != frames[0] and (column in n.writes or column in n.reads and n.op not in (Op.JOIN,)):
            before = [p for p in n.parents if p in plan.nodes and column in plan.nodes[p].columns]
            if before:
                return before[0]
    return marker.parents[0]


def fusible(plan: Plan, at: int) -> bool:
    """Whether all that follows treats rows one by one, up to the scores."""
    return all(plan.nodes[k].op in ROW_WISE | {Op.SCORE} and not plan.nodes[k].params.get("exact") for s in plan.of(Op.SCORE) for k in plan.path_down(at, s.id))


@dataclass(frozen=True)
class ChangeColumn:
    """A column expression at a place found by column_location."""

    column: str
    change: Any  # Column -> Column, or a function of (df) -> Column
    name: str
    side: str = "test"
    late: bool = True
    of_frame: bool = False

    def apply(self, plan: Plan) -> Plan:
        at = column_location(plan, self.column, self.side, self.late)
        f, c = self.change, self.column
        build = (lambda df: df.withColumn(c, f(df))) if self.of_frame else (lambda df: df.withColumn(c, f(F.col(c))))
        n = plan.nodes[at]
        only = set(side_nodes(plan, self.side)) | {m.id for m in plan.role(SIDES[self.side])} | {m.id for m in plan.nodes.values() if at in m.parents and m.op == Op.COMPUTE}
        return plan.inserted_after(at, Op.MAP, build, only=only, params={"patch": self.name, "column": c, "change": f}, description=self.name, columns=n.columns, reads=(c,), writes=(c,))[0]


@dataclass(frozen=True)
class ReplaceFrame:
    """A function of (training frame, this frame) -> frame in front of a side's marker."""

    change: Any
    name: str
    side: str = "train"

    def apply(self, plan: Plan) -> Plan:
        train = plan.role("train rows")[0]
        marker = plan.role(SIDES[self.side])[0]
        at = marker.parents[0]
        f = self.change
        if self.side == "train":
            return plan.inserted_after(at, Op.MAP, lambda df: f(df, df), only={marker.id}, params={"patch": self.name, "change": f}, description=self.name, columns=plan.nodes[at].columns)[0]
        source = plan.nodes[train.id].parents[0]
        while plan.nodes[source].params.get("patch"):  # what is learned comes from the training rows as they were
            source = plan.nodes[source].parents[0]
        return plan.inserted_after(at, Op.MAP, lambda df, tr: f(tr, df), only={marker.id}, parents_more=(source,), params={"patch": self.name, "change": f}, description=self.name, columns=plan.nodes[at].columns)[0]


@dataclass(frozen=True)
class AddFilter:
    predicate: Any  # Column -> Column
    column: str
    name: str
    side: str = "test"
    late: bool = True

    def apply(self, plan: Plan) -> Plan:
        at = column_location(plan, self.column, self.side, self.late)
        f, c = self.predicate, self.column
        only = set(side_nodes(plan, self.side)) | {m.id for m in plan.role(SIDES[self.side])}
        return plan.inserted_after(at, Op.FILTER, lambda df: df.where(f(F.col(c))), only=only, params={"patch": self.name, "predicate": f, "column": c}, description=self.name, columns=plan.nodes[at].columns, reads=(c,))[0]


@dataclass(frozen=True)
class RemoveNode:
    node: int

    def apply(self, plan: Plan) -> Plan:
        return plan.removed(self.node)


@dataclass(frozen=True)
class ReplaceTransformer:
    """Another transformer in place of the fitted one."""

    node: int
    transformer: Any
    name: str

    def apply(self, plan: Plan) -> Plan:
        t = self.transformer
        return plan.replaced(self.node, build=lambda df: t.copy().fit(df), params={"transformer": t}, description=self.name)


@dataclass(frozen=True)
class ReplaceModel:
    factory: Any
    name: str

    def apply(self, plan: Plan) -> Plan:
        from pipelens.operators import models

        n, f = plan.only(Op.FIT), self.factory
        label = n.params["label"]
        return plan.replaced(n.id, build=lambda df: models.make(f).fit(df, label), params={"model": f, "label": label, "name": self.name}, description=self.name)


def apply_all(plan: Plan, patches) -> Plan:
    for p in patches:
        plan = p.apply(plan)
    return plan.pruned()


def fits(plan: Plan) -> list:
    return [n for n in plan.of(Op.ENCODE) if n.phase == Phase.FIT]
