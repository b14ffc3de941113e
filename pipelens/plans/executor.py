"""Runs plans. Equal sub-plans are built once, by fingerprint; scores of one frame are one aggregation."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelens.plans.plan import COSTLY, Op, Plan


FEW_GROUPS = 10_000  # groups that a join may broadcast


@dataclass
class Counters:
    built: int = 0
    reused: int = 0
    kept: int = 0
    released: int = 0
    actions: int = 0
    ms: dict[str, float] = field(default_factory=dict)


class Executor:
    """Values by fingerprint. Frames that several nodes read and that are costly are persisted, as the barrier that
    keeps the optimiser below from undoing the sharing, and let go when their last reader is done."""

    def __init__(self, share: bool = True, cache: dict | None = None):
        self.share, self.values, self.counters = share, cache if cache is not None else {}, Counters()
        self._persisted: dict[str, DataFrame] = {}
        self._groups: dict[str, bool] = {}

    def value(self, plan: Plan, i: int, readers: dict[str, int] | None = None):
        todo = [i]
        local: dict[int, object] = {}
        while todo:
            k = todo[-1]
            key = plan.key(k)
            if k in local:
                todo.pop()
                continue
            if self.share and key in self.values:
                local[k] = self.values[key]
                self.counters.reused += 1
                todo.pop()
                continue
            if missing := [p for p in plan.nodes[k].parents if p not in local]:
                todo += missing
                continue
            began = time.perf_counter()
            if self.share and (plan.nodes[k].op == Op.SPLIT or plan.nodes[k].params.get("exact")):
                for p in plan.nodes[k].parents:  # choosing rows counts them several times
                    local[p] = self._keep(plan.key(p), local[p])
            if plan.nodes[k].op == Op.JOIN:
                for p in plan.nodes[k].parents[1:]:
                    if plan.nodes[p].op == Op.AGGREGATE and self._few(plan.key(p), local[p]):
                        local[p] = F.broadcast(local[p])
            v = plan.nodes[k].build(*(local[p] for p in plan.nodes[k].parents))
            self.counters.built += 1
            if readers and readers.get(key, 0) > 1 and plan.nodes[k].op in COSTLY and self.share:
                v = self._keep(key, v)
            self.counters.ms[key] = (time.perf_counter() - began) * 1000
            local[k] = v
            if self.share:
                self.values[key] = v
            todo.pop()
        return local[i]

    def _few(self, key: str, v: DataFrame) -> bool:
        """Whether groups are so few that a join by their key would put all rows in a few tasks. A persisted frame would
        stay as the join has dealt it."""
        if key not in self._groups:
            self._groups[key] = v.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
        return self._groups[key]

    def _keep(self, key: str, v):
        if isinstance(v, DataFrame) and key not in self._persisted:
            v = v.persist(StorageLevel.MEMORY_AND_DISK)
            self._persisted[key] = self.values[key] = v
            self.counters.kept += 1
        return v

    def keep(self, plan: Plan, i: int):
        """The node's value, persisted until release()."""
        v = self.value(plan, i)
        return self._keep(plan.key(i), v) if self.share else v

    def readers(self, plans: list[Plan]) -> dict[str, int]:
        """How many different nodes read each one, over all plans together."""
        seen: dict[str, set[str]] = {}
        for p in plans:
            for n in p.nodes.values():
                for parent in n.parents:
                    seen.setdefault(p.key(parent), set()).add(p.key(n.id))
        return {k: len(v) for k, v in seen.items()}

    def scores(self, plans: list[Plan]) -> list[dict[str, float | None]]:
        """Every plan's scores by name."""
        readers = self.readers(plans)
        known: dict[str, float | None] = {}
        out = []
        for p in plans:
            pending: dict[str, list] = {}
            for n in p.of(Op.SCORE):
                if (key := p.key(n.id)) not in known or not self.share:
                    df, metric = self.value(p, n.id, readers)
                    pending.setdefault(p.key(n.parents[0]), []).append((key, df, metric))
            for asked in pending.values():
                row = asked[0][1].agg(*(m.alias(f"s{i}") for i, (_, _, m) in enumerate(asked))).first()
                self.counters.actions += 1
                known |= {key: row[f"s{i}"] for i, (key, _, _) in enumerate(asked)}
            out.append({n.params["name"]: known[p.key(n.id)] for n in p.of(Op.SCORE)})
        return out

    def fused_scores(self, plan: Plan, at: int, columns: list[tuple[str, object] | None]) -> list[dict[str, float | None]]:
        """Scores of variants that each change one column of the frame at node `at` by an expression (None: none), in
        one pass: rows are repeated by variant, every later operator runs once, and the scores are grouped."""
        base = self.value(plan, at)
        df = base.withColumn("_variant_", F.explode(F.sequence(F.lit(0), F.lit(len(columns) - 1))))
        for c in dict.fromkeys(x[0] for x in columns if x):
            changed = None
            for v, x in enumerate(columns):
                if x and x[0] == c:
                    test = F.col("_variant_") == v
                    changed = F.when(test, x[1]) if changed is None else changed.when(test, x[1])
            df = df.withColumn(f"_new_{c}", changed.otherwise(F.col(c)))
        touched = list(dict.fromkeys(x[0] for x in columns if x))
        df = df.withColumns({c: F.col(f"_new_{c}") for c in touched}).drop(*(f"_new_{c}" for c in touched))
        out: list[dict] = [{} for _ in columns]
        for s in plan.of(Op.SCORE):
            local: dict[int, object] = {at: df}
            for k in plan.path_down(at, s.id):
                local[k] = plan.nodes[k].build(*(local[p] if p in local else self.value(plan, p) for p in plan.nodes[k].parents))
            frame, metric = local[s.id]
            for r in frame.groupBy("_variant_").agg(metric.alias("s")).collect():
                out[r["_variant_"]][s.params["name"]] = r["s"]
            self.counters.actions += 1
        return out

    def release(self) -> None:
        for df in self._persisted.values():
            df.unpersist()
            self.counters.released += 1
        for key in self._persisted:
            self.values.pop(key, None)
        self._persisted.clear()
