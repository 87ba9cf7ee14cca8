"""Transformation definitions: a DAG of nodes over alias-keyed records."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import ClassVar

from entityframe.model import PropertyFilter

ANY_ALIAS = "__ANY_ALIAS__"  # fixed value: "whichever alias has the field"


@dataclass(frozen=True)
class Node:
    id: str
    inputs: tuple[str, ...] = ()
    type: ClassVar[str] = ""
    arity: ClassVar[int | None] = 1

    def __post_init__(self):
        object.__setattr__(self, "inputs", tuple(self.inputs))

    def check(self) -> None:
        if self.arity is None:
            if not self.inputs:
                raise ValueError(f"node {self.id}: {self.type} needs at least one input")
        elif len(self.inputs) != self.arity:
            raise ValueError(f"node {self.id}: {self.type} needs {self.arity} input(s), has {len(self.inputs)}")


@dataclass(frozen=True)
class Load(Node):
    alias: str = ""
    entity_type: str = ""
    filters: tuple[PropertyFilter, ...] = ()
    type: ClassVar[str] = "LOAD"
    arity: ClassVar[int] = 0


@dataclass(frozen=True)
class Filter(Node):
    alias: str = ""
    filters: tuple[PropertyFilter, ...] = ()
    type: ClassVar[str] = "FILTER"


@dataclass(frozen=True)
class Project(Node):
    alias: str = ""
    fields: tuple[str, ...] = ()
    type: ClassVar[str] = "PROJECT"


@dataclass(frozen=True)
class _JoinNode(Node):
    left_alias: str = ""
    right_alias: str = ""
    on_field: str = ""
    arity: ClassVar[int] = 2


@dataclass(frozen=True)
class Join(_JoinNode):
    type: ClassVar[str] = "JOIN"


@dataclass(frozen=True)
class LeftJoin(_JoinNode):
    type: ClassVar[str] = "LEFT_JOIN"


@dataclass(frozen=True)
class AntiJoin(_JoinNode):
    type: ClassVar[str] = "ANTI_JOIN"


@dataclass(frozen=True)
class Union(Node):
    type: ClassVar[str] = "UNION"
    arity: ClassVar[int | None] = None


@dataclass(frozen=True)
class OutputField:
    source_alias: str
    source_field: str
    output_field: str


@dataclass(frozen=True)
class Output:
    alias: str
    fields: tuple[OutputField, ...] = ()


@dataclass(frozen=True)
class Materialize(Node):
    outputs: tuple[Output, ...] = ()
    type: ClassVar[str] = "MATERIALIZE"

    def check(self) -> None:
        super().check()
        if not self.outputs:
            raise ValueError(f"node {self.id}: MATERIALIZE needs at least one output")
        if any(not o.alias for o in self.outputs):
            raise ValueError(f"node {self.id}: a MATERIALIZE output needs an alias")


@dataclass(frozen=True)
class Sort(Node):
    alias: str = ""
    field: str = ""
    direction: str = "ASC"
    typed: bool = False
    type: ClassVar[str] = "SORT"


@dataclass(frozen=True)
class Paginate(Node):
    limit: int | None = None
    offset: int = 0
    type: ClassVar[str] = "PAGINATE"


@dataclass(frozen=True)
class Transformation:
    nodes: tuple[Node, ...]
    output: str | None = None  # id of the result node; needed only with several sinks
    name: str = ""

    def __post_init__(self):
        object.__setattr__(self, "nodes", tuple(self.nodes))

    def ordered(self) -> list[Node]:
        """Nodes with every input before its consumer; unknown inputs and cycles are errors."""
        by_id = {n.id: n for n in self.nodes}
        if len(by_id) != len(self.nodes):
            raise ValueError("node ids must be unique")
        done: list[Node] = []
        state: dict[str, str] = {}

        def visit(node_id: str) -> None:
            if state.get(node_id) == "done":
                return
            if state.get(node_id) == "open":
                raise ValueError("transformation graph contains cycles")
            if node_id not in by_id:
                raise ValueError(f"node {node_id} not found")
            state[node_id] = "open"
            for i in by_id[node_id].inputs:
                visit(i)
            state[node_id] = "done"
            done.append(by_id[node_id])

        for n in self.nodes:
            n.check()
            visit(n.id)
        return done

    def result_id(self) -> str:
        if self.output is not None:
            return self.output
        used = {i for n in self.nodes for i in n.inputs}
        sinks = [n.id for n in self.nodes if n.id not in used]
        if len(sinks) != 1:
            raise ValueError(f"name the output: the graph ends in {len(sinks)} nodes")
        return sinks[0]

    def materialized(self) -> Materialize:
        """The last MATERIALIZE node fixes the columns of a flat result."""
        found = [n for n in self.ordered() if isinstance(n, Materialize)]
        if not found:
            raise ValueError("a flat result needs a MATERIALIZE node")
        return found[-1]


# --- stored form --------------------------------------------------------------------------------

_TYPES = {c.type: c for c in (Load, Filter, Project, Join, LeftJoin, AntiJoin, Union, Materialize, Sort, Paginate)}


def _filters(raw) -> tuple[PropertyFilter, ...]:
    return tuple(
        PropertyFilter(f.get("key", ""), f.get("value"), f.get("exists"), tuple(f.get("inArray") or ())) for f in raw or ()
    )


def nodes_from_json(text: str) -> tuple[Node, ...]:
    """Read a stored node list (``id, type, inputs`` plus one settings object named by the type)."""
    out = []
    for raw in json.loads(text or "[]") or []:
        kind = _TYPES.get(raw["type"])
        if kind is None:
            raise ValueError(f"unsupported node type {raw['type']}")
        section = "join" if issubclass(kind, _JoinNode) else raw["type"].lower()
        c = raw.get(section) or {}
        base = {"id": raw["id"], "inputs": tuple(raw.get("inputs") or ())}
        if kind is Load:
            base |= {"alias": c["alias"], "entity_type": c["entityType"], "filters": _filters(c.get("filters"))}
        elif kind is Filter:
            base |= {"alias": c.get("alias", ""), "filters": _filters(c.get("filters"))}
        elif kind is Project:
            base |= {"alias": c.get("alias", ""), "fields": tuple(c.get("fields") or ())}
        elif issubclass(kind, _JoinNode):
            base |= {"left_alias": c["leftAlias"], "right_alias": c["rightAlias"], "on_field": c.get("onField", "")}
        elif kind is Materialize:
            base["outputs"] = tuple(
                Output(
                    o["alias"],
                    tuple(
                        OutputField(f.get("sourceAlias", ""), f.get("sourceField", ""), f.get("outputField", ""))
                        for f in o.get("fields") or ()
                    ),
                )
                for o in c.get("outputs") or ()
            )
        elif kind is Sort:
            base |= {"alias": c.get("alias", ""), "field": c["field"], "direction": c.get("direction", "ASC")}
        elif kind is Paginate:
            base |= {"limit": c.get("limit"), "offset": c.get("offset") or 0}
        out.append(kind(**base))
    return tuple(out)
