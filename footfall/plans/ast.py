"""The query language: filter trees and funnels, parsed from JSON documents."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from typing import Any

from ..functions.time import parse_bound
from ..schema import CONTEXT_FIELDS, EVENT_COLUMN_FIELDS, LIFECYCLE_FIELDS

AST_VERSION = 1
FUNNEL_VERSIONS = (1, 2)
OPERATORS = ("=", "!=", ">", ">=", "<", "<=", "between")
AGGREGATES = ("count", "sum", "min", "max", "distinct")
MAX_NAME, MAX_CHILDREN, MAX_WHERE, MAX_LAST = 128, 50, 10, 3650

Scalar = str | float | int | bool


class ParseError(ValueError):
    """A document that isn't in the language; ``path`` names the place."""

    def __init__(self, path: str, message: str):
        super().__init__(f"{path}: {message}")
        self.path = path


@dataclass(frozen=True)
class Comparison:
    operator: str
    value: Any  # a scalar, or a pair for between


@dataclass(frozen=True)
class Where:
    """A condition on an event: of a property, or of one of its columns."""

    source: str
    name: str
    test: Comparison


@dataclass(frozen=True)
class Window:
    kind: str  # last, absolute or ever
    n: int = 0
    unit: str = "days"
    begin: datetime | None = None
    end: datetime | None = None


@dataclass(frozen=True)
class Trait:
    key: str
    test: Comparison


@dataclass(frozen=True)
class Context:
    field: str
    scope: str
    test: Comparison


@dataclass(frozen=True)
class Lifecycle:
    field: str
    test: Comparison


@dataclass(frozen=True)
class Behavior:
    event: str
    where: tuple[Where, ...]
    aggregate: str
    property: str | None
    window: Window
    test: Comparison


@dataclass(frozen=True)
class Group:
    op: str
    children: tuple[Node, ...]


@dataclass(frozen=True)
class Not:
    child: Node


Node = Group | Not | Trait | Context | Lifecycle | Behavior


@dataclass(frozen=True)
class Step:
    event: str
    where: tuple[Where, ...] = ()
    audience: Node | None = None


@dataclass(frozen=True)
class Funnel:
    steps: tuple[Step, ...]
    window_seconds: int
    segment_id: str | None = None


def _need(ok: bool, path: str, message: str) -> None:
    if not ok:
        raise ParseError(path, message)


def _name(d: dict, key: str, path: str) -> str:
    v = d.get(key)
    _need(isinstance(v, str) and 1 <= len(v) <= MAX_NAME, f"{path}.{key}", f"a string of 1 to {MAX_NAME} characters")
    return v


def _choice(d: dict, key: str, allowed: tuple[str, ...], path: str, default: str | None = None) -> str:
    v = d.get(key, default)
    _need(v in allowed, f"{path}.{key}", f"one of {', '.join(allowed)}")
    return v


def _comparison(d: dict, path: str, kinds: tuple[type, ...] = (str, int, float, bool)) -> Comparison:
    op, value = _choice(d, "operator", OPERATORS, path), d.get("value")
    pair = isinstance(value, (list, tuple))
    _need(pair == (op == "between") and (not pair or len(value) == 2), f"{path}.value", "`between` takes two values, other operators one")
    for v in value if pair else (value,):
        _need(isinstance(v, kinds), f"{path}.value", "not a value of this kind")
    if pair:
        _need(isinstance(value[0], str) == isinstance(value[1], str), f"{path}.value", "both values are of one kind")
    return Comparison(op, tuple(value) if pair else value)


def _where(rows: Any, path: str) -> tuple[Where, ...]:
    rows = rows or []
    _need(isinstance(rows, list) and len(rows) <= MAX_WHERE, path, f"at most {MAX_WHERE} conditions")
    out = []
    for i, d in enumerate(rows):
        at = f"{path}[{i}]"
        source = _choice(d, "source", ("property", "attribute"), at, "property")
        if source == "attribute":
            out.append(Where(source, _choice(d, "attribute", EVENT_COLUMN_FIELDS, at), _comparison(d, at, (str,))))
        else:
            out.append(Where(source, _name(d, "property", at), _comparison(d, at)))
    return tuple(out)


def _window(d: Any, path: str) -> Window:
    _need(isinstance(d, dict), path, "a window")
    kind = _choice(d, "kind", ("last", "absolute", "ever"), path)
    if kind == "last":
        n = d.get("n")
        _need(isinstance(n, int) and not isinstance(n, bool) and 1 <= n <= MAX_LAST, f"{path}.n", f"1 to {MAX_LAST}")
        return Window(kind, n, _choice(d, "unit", ("hours", "days"), path))
    if kind == "absolute":
        return Window(kind, begin=_instant(d.get("from"), f"{path}.from"), end=_instant(d.get("to"), f"{path}.to"))
    return Window(kind)


def _instant(v: Any, path: str) -> datetime:
    try:
        return v if isinstance(v, datetime) else parse_bound(v)
    except (TypeError, ValueError):
        raise ParseError(path, "an instant") from None


def parse_node(d: Any, path: str = "filter") -> Node:
    _need(isinstance(d, dict), path, "an object")
    kind = _choice(d, "kind", ("group", "not", "trait", "context", "lifecycle", "behavior"), path)
    if kind == "group":
        children = d.get("children")
        _need(isinstance(children, list) and 1 <= len(children) <= MAX_CHILDREN, f"{path}.children", f"1 to {MAX_CHILDREN} conditions")
        return Group(_choice(d, "op", ("and", "or"), path), tuple(parse_node(c, f"{path}.children[{i}]") for i, c in enumerate(children)))
    if kind == "not":
        return Not(parse_node(d.get("child"), f"{path}.child"))
    if kind == "trait":
        return Trait(_name(d, "key", path), _comparison(d, path))
    if kind == "context":
        return Context(_choice(d, "field", CONTEXT_FIELDS, path), _choice(d, "scope", ("latest", "first_touch"), path, "latest"), _comparison(d, path, (str,)))
    if kind == "lifecycle":
        raw = _comparison(d, path, (str, datetime))
        values = [_instant(v, f"{path}.value") for v in (raw.value if isinstance(raw.value, tuple) else (raw.value,))]
        return Lifecycle(_choice(d, "field", LIFECYCLE_FIELDS, path), Comparison(raw.operator, tuple(values) if raw.operator == "between" else values[0]))
    aggregate = _choice(d, "aggregate", AGGREGATES, path, "count")
    prop = d.get("property")
    _need((prop is None) == (aggregate == "count"), f"{path}.property", "every aggregate but count takes a property")
    if prop is not None:
        prop = _name(d, "property", path)
    return Behavior(_name(d, "event", path), _where(d.get("where"), f"{path}.where"), aggregate, prop, _window(d.get("window"), f"{path}.window"), _comparison(d, path, (int, float)))


def parse_segment(d: Any) -> Node:
    """The filter of a segment document {ast_version, filter}."""
    _need(isinstance(d, dict) and d.get("ast_version") == AST_VERSION, "ast_version", f"{AST_VERSION} is the version read here")
    return parse_node(d.get("filter"))


def parse_funnel(d: Any) -> Funnel:
    """A funnel document {version?, steps, window_seconds, segment_id?}."""
    _need(isinstance(d, dict) and d.get("version", FUNNEL_VERSIONS[-1]) in FUNNEL_VERSIONS, "version", "a version read here")
    steps, window = d.get("steps"), d.get("window_seconds")
    _need(isinstance(steps, list) and len(steps) >= 2, "steps", "two steps or more")
    _need(isinstance(window, int) and not isinstance(window, bool) and window > 0, "window_seconds", "a whole number over 0")
    parsed = []
    for i, s in enumerate(steps):
        at = f"steps[{i}]"
        _need(isinstance(s, dict), at, "an object")
        audience = parse_node(s["audience"], f"{at}.audience") if s.get("audience") is not None else None
        parsed.append(Step(_name(s, "event", at), _where(s.get("where"), f"{at}.where"), audience))
    return Funnel(tuple(parsed), window, d.get("segment_id"))


def walk(node: Node, path: str = "filter", depth: int = 0) -> Iterator[tuple[Node, str, int]]:
    """(node, path, depth) of a tree, parents first."""
    yield node, path, depth
    if isinstance(node, Group):
        for i, c in enumerate(node.children):
            yield from walk(c, f"{path}.children[{i}]", depth + 1)
    elif isinstance(node, Not):
        yield from walk(node.child, f"{path}.child", depth + 1)


def behaviors(node: Node) -> list[Behavior]:
    """The distinct behaviours of a tree, in order."""
    return list(dict.fromkeys(n for n, _, _ in walk(node) if isinstance(n, Behavior)))


def canonical_json(value: Any) -> str:
    """JSON with keys in order and no spaces, the same for equal documents."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def tree_hash(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def describe(node: Node) -> str:
    """A tree in words."""
    if isinstance(node, Group):
        return "(" + f" {node.op} ".join(map(describe, node.children)) + ")"
    if isinstance(node, Not):
        return f"not {describe(node.child)}"
    value = " and ".join(map(str, node.test.value)) if isinstance(node.test.value, tuple) else str(node.test.value)
    test = f"{node.test.operator} {value}"
    if isinstance(node, Trait):
        return f"trait {node.key} {test}"
    if isinstance(node, Context):
        return f"{node.scope} {node.field} {test}"
    if isinstance(node, Lifecycle):
        return f"{node.field} {test}"
    span = {"ever": "ever", "last": f"in the last {node.window.n} {node.window.unit}", "absolute": f"from {node.window.begin} to {node.window.end}"}[node.window.kind]
    what = node.aggregate if node.property is None else f"{node.aggregate} of {node.property}"
    return f"{what} of {node.event} {span} {test}"
