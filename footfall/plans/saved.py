"""Saved segments and funnels, with the figures of their last run."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from datetime import datetime
from typing import Any

from .ast import Node, ParseError, canonical_json, parse_funnel, parse_segment
from .validate import LimitError, validate_funnel, validate_tree


@dataclass(frozen=True)
class Snapshot:
    """What the last run gave, when, and over what range (of funnels)."""

    result: Any
    at: datetime
    since: datetime | None = None
    until: datetime | None = None


@dataclass(frozen=True)
class Saved:
    id: str
    kind: str  # segment or funnel
    name: str
    definition: dict
    snapshot: Snapshot | None = None
    stale: bool = False


def check(kind: str, definition: dict) -> None:
    """Raises ParseError or LimitError for what could not be run."""
    if kind == "segment":
        validate_tree(parse_segment(definition))
    else:
        validate_funnel(parse_funnel(definition))


class Definitions:
    """The saved definitions of one project; ``rows`` is what a store kept of them."""

    def __init__(self, rows: list[Saved] = ()):
        self._rows = {r.id: r for r in rows}

    def create(self, kind: str, name: str, definition: dict) -> Saved:
        check(kind, definition)
        row = Saved(uuid.uuid4().hex, kind, name, definition)
        self._rows[row.id] = row
        return row

    def get(self, id: str) -> Saved:
        return self._rows[id]

    def list(self, kind: str) -> list[Saved]:
        """All of a kind; those that can't be read any more are marked stale."""
        out = []
        for row in self._rows.values():
            if row.kind == kind:
                try:
                    check(kind, row.definition)
                except (ParseError, LimitError):
                    row = replace(row, stale=True)
                out.append(row)
        return sorted(out, key=lambda r: (r.name, r.id))

    def update(self, id: str, name: str | None = None, definition: dict | None = None) -> Saved:
        """A segment's new filter always clears its figures, a funnel's definition only if it differs."""
        row = self._rows[id]
        if definition is not None:
            check(row.kind, definition)
            same = row.kind == "funnel" and canonical_json(definition) == canonical_json(row.definition)
            row = replace(row, definition=definition, snapshot=row.snapshot if same else None)
        if name is not None:
            row = replace(row, name=name)
        self._rows[id] = row
        return row

    def ran(self, id: str, snapshot: Snapshot) -> Saved:
        self._rows[id] = replace(self._rows[id], snapshot=snapshot)
        return self._rows[id]

    def delete(self, id: str) -> None:
        del self._rows[id]

    def segment_of(self, funnel: Saved) -> tuple[Node | None, list[str]]:
        """The segment that a funnel is limited to; if it is gone the funnel runs over everyone, with a warning."""
        wanted = parse_funnel(funnel.definition).segment_id
        if wanted is None:
            return None, []
        if wanted not in self._rows or self._rows[wanted].kind != "segment":
            return None, [f"segment {wanted} no longer exists, so everyone is counted"]
        return parse_segment(self._rows[wanted].definition), []
