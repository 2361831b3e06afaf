"""Limits of trees and funnels, and warnings of what is costly."""

from __future__ import annotations

from datetime import datetime, timedelta

from .ast import Behavior, Funnel, Node, walk

MAX_DEPTH, MAX_NODES, MAX_BEHAVIORS = 10, 100, 25
MAX_STEPS, MAX_WINDOW_SECONDS, MAX_RANGE_DAYS = 8, 2_592_000, 90
BUSY_EVENTS = ("$page", "$identify")


class LimitError(ValueError):
    """Beyond a limit; ``code`` names which."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def validate_tree(node: Node) -> None:
    nodes = found = 0
    for n, _, depth in walk(node):
        nodes += 1
        found += isinstance(n, Behavior)
        if depth >= MAX_DEPTH:
            raise LimitError("depth", f"a tree has fewer than {MAX_DEPTH} levels")
        if nodes > MAX_NODES:
            raise LimitError("nodes", f"a tree has at most {MAX_NODES} nodes")
        if found > MAX_BEHAVIORS:
            raise LimitError("behaviors", f"a tree has at most {MAX_BEHAVIORS} behaviours")


def validate_funnel(funnel: Funnel) -> None:
    if len(funnel.steps) > MAX_STEPS:
        raise LimitError("steps", f"a funnel has at most {MAX_STEPS} steps")
    if funnel.window_seconds > MAX_WINDOW_SECONDS:
        raise LimitError("window", f"a window has at most {MAX_WINDOW_SECONDS} seconds")
    found = 0
    for i, step in enumerate(funnel.steps):
        if step.audience is None:
            continue
        try:
            validate_tree(step.audience)
        except LimitError as e:
            raise LimitError("audience", f"step {i + 1}: {e}") from None
        found += sum(isinstance(n, Behavior) for n, _, _ in walk(step.audience))
    if found > MAX_BEHAVIORS:
        raise LimitError("audience", f"the audiences have at most {MAX_BEHAVIORS} behaviours together")


def validate_range(since: datetime, until: datetime) -> None:
    if not since < until:
        raise LimitError("range", "since is before until")
    if until - since > timedelta(days=MAX_RANGE_DAYS):
        raise LimitError("range", f"a range has at most {MAX_RANGE_DAYS} days")


def cost_warnings(node: Node) -> list[tuple[str, str]]:
    """(path, reason) of behaviours that read much."""
    out = []
    for n, path, _ in walk(node):
        if isinstance(n, Behavior):
            if n.window.kind == "ever":
                out.append((path, f"`{n.event}` over all time reads the whole history"))
            if n.event == "*":
                out.append((path, "every event matches, so names prune nothing"))
    return out


def funnel_warnings(funnel: Funnel) -> list[tuple[str, str]]:
    out = [(f"steps[{i}]", f"`{s.event}` is an event that every visitor sends") for i, s in enumerate(funnel.steps) if s.event in BUSY_EVENTS]
    for i, s in enumerate(funnel.steps):
        if s.audience is not None:
            out += [(f"steps[{i}].audience.{p}", r) for p, r in cost_warnings(s.audience)]
    return out
