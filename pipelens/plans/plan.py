"""Operator plans: immutable nodes with ordered parents, fingerprints, and searches over them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from enum import Enum, StrEnum, auto
from typing import Any


class Op(StrEnum):
    """What the planner tells apart: where rows come from, how they change, and what becomes of them."""

    SCAN = auto()
    FILTER = auto()
    PICK = auto()  # columns of a frame
    COMPUTE = auto()  # a column out of others
    MAP = auto()  # a frame or column with other values
    JOIN = auto()
    RETRIEVE = auto()
    AGGREGATE = auto()
    SPLIT = auto()
    ROLE = auto()  # marks rows or labels as those to fit or to score
    ENCODE = auto()
    FIT = auto()
    PREDICT = auto()
    SCORE = auto()
    OUTPUT = auto()


class Phase(Enum):
    FIT = "fit"
    APPLY = "apply"


#: Operators that treat each row by itself: variants of a column may pass them side by side.
ROW_WISE = {Op.FILTER, Op.PICK, Op.COMPUTE, Op.MAP, Op.ENCODE, Op.PREDICT, Op.ROLE}
#: Operators whose results are worth keeping when several variants read them.
COSTLY = {Op.JOIN, Op.AGGREGATE, Op.RETRIEVE, Op.SPLIT, Op.ENCODE, Op.SCAN}


@dataclass(frozen=True)
class Node:
    id: int
    op: Op
    parents: tuple[int, ...]
    build: Callable = field(compare=False, repr=False)  # (values of the parents) -> value
    params: dict = field(default_factory=dict, compare=False)
    description: str = ""
    columns: tuple[str, ...] = ()
    phase: Phase | None = None
    reads: tuple[str, ...] = ()
    writes: tuple[str, ...] = ()
    code: tuple | None = field(default=None, compare=False)  # (file, line, column, end line, end column)


def function_key(f) -> str:
    """A function by what it does: its byte code, constants and what it closes over."""
    if f is None or isinstance(f, (str, int, float, bool)):
        return repr(f)
    if isinstance(f, (list, tuple)):
        return repr([function_key(x) for x in f])
    if isinstance(f, dict):
        return repr({k: function_key(v) for k, v in sorted(f.items(), key=str)})
    if code := getattr(f, "__code__", None):
        inner = [function_key(c) if hasattr(c, "co_code") else repr(c) for c in code.co_consts]
        closed = [function_key(c.cell_contents) for c in (f.__closure__ or ())]
        return hashlib.sha256(repr((code.co_code, inner, code.co_names, closed, f.__defaults__)).encode()).hexdigest()
    if hasattr(f, "co_code"):
        return hashlib.sha256(repr((f.co_code, f.co_names)).encode()).hexdigest()
    if hasattr(f, "spec"):
        return f"{type(f).__name__}{json.dumps(f.spec(), sort_keys=True, default=str)}"
    return f"{type(f).__name__}:{f}" if not repr(f).startswith("<") else type(f).__name__


class Plan:
    """Nodes by id, in an order in which parents come first."""

    def __init__(self, nodes: dict[int, Node] | None = None):
        self.nodes = dict(nodes or {})
        self._keys: dict[int, str] = {}

    def add(self, op: Op, parents=(), build=lambda *v: v[0], **more) -> Node:
        n = Node(max(self.nodes, default=-1) + 1, op, tuple(parents), build, **more)
        self.nodes[n.id] = n
        return n

    def order(self) -> list[int]:
        seen, out = set(), []

        def visit(i):
            stack = [(i, False)]
            while stack:
                k, done = stack.pop()
                if done:
                    out.append(k)
                elif k not in seen:
                    seen.add(k)
                    stack.append((k, True))
                    stack += [(p, False) for p in reversed(self.nodes[k].parents)]

        for i in sorted(self.nodes):
            visit(i)
        return out

    def children(self, i: int) -> list[int]:
        return [n.id for n in self.nodes.values() if i in n.parents]

    def ancestors(self, i: int) -> set[int]:
        out, todo = set(), list(self.nodes[i].parents)
        while todo:
            if (k := todo.pop()) not in out:
                out.add(k)
                todo += self.nodes[k].parents
        return out

    def descendants(self, i: int) -> set[int]:
        kids: dict[int, list[int]] = {}
        for n in self.nodes.values():
            for p in n.parents:
                kids.setdefault(p, []).append(n.id)
        out, todo = set(), list(kids.get(i, ()))
        while todo:
            if (k := todo.pop()) not in out:
                out.add(k)
                todo += kids.get(k, ())
        return out

    def key(self, i: int) -> str:
        """The fingerprint: operator, parameters, function, parents. The same in every plan that computes the same."""
        if i not in self._keys:
            for k in [*sorted(self.ancestors(i), key=self._rank()), i]:
                n = self.nodes[k]
                said = repr((n.op.name, n.phase and n.phase.name, function_key(n.params), [self._keys[p] for p in n.parents]))
                self._keys[k] = hashlib.sha256(said.encode()).hexdigest()
        return self._keys[i]

    def _rank(self):
        at = {k: i for i, k in enumerate(self.order())}
        return lambda k: at[k]

    def of(self, *ops: Op) -> list[Node]:
        return [self.nodes[i] for i in self.order() if self.nodes[i].op in ops]

    def role(self, name: str) -> list[Node]:
        """The markers of a role: train rows, train labels, test rows or test labels."""
        return [n for n in self.of(Op.ROLE) if n.params["role"] == name]

    def only(self, op: Op) -> Node:
        found = self.of(op)
        if len(found) != 1:
            raise ValueError(f"the plan has {len(found)} nodes of type {op.value}, not one")
        return found[0]

    # edits return new plans; ids of untouched nodes stay
    def rewired(self, old: int, new: int, only: set[int] | None = None, but: set[int] = frozenset()) -> Plan:
        out = Plan(self.nodes)
        for n in list(out.nodes.values()):
            if old in n.parents and n.id not in but and (only is None or n.id in only):
                out.nodes[n.id] = replace(n, parents=tuple(new if p == old else p for p in n.parents))
        return out

    def replaced(self, i: int, **changes) -> Plan:
        out = Plan(self.nodes)
        out.nodes[i] = replace(out.nodes[i], **changes)
        return out

    def inserted_after(self, i: int, op: Op, build, only: set[int] | None = None, parents_more=(), **more) -> tuple[Plan, int]:
        out = Plan(self.nodes)
        n = out.add(op, (i, *parents_more), build, **more)
        return out.rewired(i, n.id, only, {n.id}), n.id

    def removed(self, i: int) -> Plan:
        """Without a node that passes on its first parent's kind of value."""
        n = self.nodes[i]
        out = self.rewired(i, n.parents[0])
        del out.nodes[i]
        return out.pruned()

    def pruned(self) -> Plan:
        """Without nodes that no result needs."""
        ends = {Op.SCORE, Op.OUTPUT}
        keep = {n.id for n in self.nodes.values() if n.op in ends}
        keep |= {a for i in keep for a in self.ancestors(i)}
        return Plan({i: n for i, n in self.nodes.items() if i in keep}) if keep else Plan(self.nodes)

    def path_down(self, start: int, end: int) -> list[int]:
        """Nodes after start on ways to end, end included."""
        below = self.descendants(start)
        up = self.ancestors(end) | {end}
        return [i for i in self.order() if i in below and i in up]

    def to_dot(self) -> str:
        lines = ["digraph plan {", "  rankdir=TB;"]
        for i in self.order():
            n = self.nodes[i]
            label = json.dumps(f"{n.op.value}\n{n.description}".strip())
            lines.append(f"  n{i} [label={label}, shape=box];")
            lines += [f"  n{p} -> n{i};" for p in n.parents]
        return "\n".join([*lines, "}"])
