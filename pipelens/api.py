"""The fluent entry point.

    on_pipeline(spark, fn).add_what_if(DataCorruption([("age", "scaling")])).execute()

fn takes a Session and ends by adding scores; a string or a .py file that uses `session` does as well.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession

from pipelens.analyses import whatif
from pipelens.plans import ivm
from pipelens.plans.executor import Executor
from pipelens.plans.optimizer import MultiQuery, Rules, estimate
from pipelens.plans.plan import Op, Plan
from pipelens.plans.session import Session


@dataclass
class Extraction:
    """What a run leaves for later ones: the plan and the values of its nodes by fingerprint."""

    plan: Plan
    values: dict = field(default_factory=dict)


@dataclass
class Results:
    scores: dict
    reports: dict
    shadows: dict
    extraction: Extraction
    info: dict
    changes: ivm.Changes | None = None


class Analyzer:
    def __init__(self, spark: SparkSession, record: Callable[[Session], None] | None = None, earlier: Extraction | None = None):
        self.spark, self.record, self.earlier = spark, record, earlier
        self.what_ifs, self.shadows, self.rules, self.provenance = [], [], Rules(), True

    def add_what_if(self, analysis: whatif.Analysis) -> Analyzer:
        self.what_ifs.append(analysis)
        return self

    def add_shadow(self, shadow) -> Analyzer:
        self.shadows.append(shadow)
        return self

    def with_rules(self, **rules: bool) -> Analyzer:
        self.rules = Rules(**rules)
        return self

    def without_provenance(self) -> Analyzer:
        self.provenance = False
        return self

    def _plan(self) -> Plan:
        if self.record is None:
            return self.earlier.plan
        session = Session(self.spark, self.provenance)
        self.record(session)
        return session.plan

    def estimate(self) -> dict:
        """Costs of the workload with and without sharing; nothing but what the variants need to know is run."""
        plan = self._plan()
        ex = Executor()
        plans = MultiQuery(plan, self.rules, ex).plans([v for a in self.what_ifs for v in a.variants(plan, ex)])
        return {"plans": len(plans), "shared": estimate(plans, True), "independent": estimate(plans, False), "original": estimate([plan], True)}

    def execute(self) -> Results:
        plan = self._plan()
        changes = ivm.classify(self.earlier.plan, plan) if self.earlier and self.record else None
        values = ivm.reusable(self.earlier.plan, plan, self.earlier.values) if self.earlier else {}
        ex = Executor(cache=values)
        scores = ex.scores([plan])[0]
        reports, infos = whatif.run(plan, self.what_ifs, self.rules) if self.what_ifs else ([], [{}])
        shadows = {}
        for s in self.shadows:
            shadows[type(s).__name__] = s.check(plan, ex) | {"text": s.text}
        info = infos[0] | {"built": ex.counters.built, "reused": ex.counters.reused}
        extracted = {n.params["label"]: ex.value(plan, n.id) for n in plan.of(Op.OUTPUT)}
        return Results(scores, dict(zip([type(a).__name__ for a in self.what_ifs], reports, strict=True)), shadows, Extraction(plan, ex.values), info | {"extracted": extracted}, changes)


def _source(code: str, name: str):
    return lambda session: exec(compile(code, name, "exec"), {"session": session})  # noqa: S102  the user's own pipeline


def on_pipeline(spark: SparkSession, pipeline) -> Analyzer:
    """pipeline: a function of a session, source text, or the path of a .py file."""
    if callable(pipeline):
        return Analyzer(spark, pipeline)
    if str(pipeline).endswith(".py"):
        return Analyzer(spark, _source(Path(pipeline).read_text(), str(pipeline)))
    return Analyzer(spark, _source(pipeline, "<pipeline>"))


def on_previous(spark: SparkSession, earlier: Extraction) -> Analyzer:
    return Analyzer(spark, None, earlier)


def on_changed(spark: SparkSession, earlier: Extraction, pipeline) -> Analyzer:
    a = on_pipeline(spark, pipeline)
    a.earlier = earlier
    return a
