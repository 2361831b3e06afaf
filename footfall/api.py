"""One project's questions, by the names a client asks them under."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame

from .operators import identity, rollups
from .plans import catalog, cursor, events, funnels, lifecycle, person, segments
from .plans.ast import parse_funnel, parse_segment, tree_hash
from .plans.cache import ResultCache
from .plans.saved import Definitions, Snapshot
from .plans.validate import cost_warnings, funnel_warnings
from .schema import Tables
from .sources.export import export_person


@dataclass
class Project:
    """Reads take the tables as they are; writes put new ones in their place."""

    tables: Tables
    secret: bytes = field(default_factory=lambda: uuid.uuid4().bytes)
    saved: Definitions = field(default_factory=Definitions)
    cache: ResultCache = field(default_factory=ResultCache)
    requests: list[lifecycle.DeletionRequest] = field(default_factory=list)

    @property
    def schema(self) -> DataFrame:
        stored = self.tables.event_schema
        return stored if stored is not None else rollups.event_schema(self.tables.events)

    # Segments

    def segment_preview(self, document: dict) -> dict[str, Any]:
        """person_count, the first page of members with a cursor, and warnings."""
        node, t = parse_segment(document), self.tables
        key = ("preview", tree_hash(document), t.now)
        (count,) = self.cache.get(t.project_id, key, lambda: [segments.count(t, node).first()["person_count"]])
        rows, after = self._members(document, None)
        return {"person_count": count, "members": rows, "next_cursor": after, "warnings": cost_warnings(node)}

    def segment_members(self, document: dict, after: str | None = None) -> tuple[list, str | None]:
        """A page of members and the cursor of the next."""
        return self._members(document, cursor.read(after, f"members/{tree_hash(document)}", self.secret) if after else None)

    def _members(self, document: dict, walk: cursor.Walk | None) -> tuple[list, str | None]:
        t = self.tables if walk is None else self.tables.at(now=walk.as_of)
        rows = segments.members(t, parse_segment(document), walk and (walk.last_seen, walk.person_id)).collect()
        more = cursor.following(walk, [(r.last_seen.astimezone(), r.person_id) for r in rows], t.now)
        return rows, cursor.sign(more, f"members/{tree_hash(document)}", self.secret) if more else None

    def run_segment(self, id: str) -> dict[str, Any]:
        """Runs a saved segment and keeps its count."""
        found = self.segment_preview(self.saved.get(id).definition)
        self.saved.ran(id, Snapshot(found["person_count"], self.tables.now))
        return found

    # Funnels

    def funnel_preview(self, document: dict, segment=None, **span) -> dict[str, Any]:
        funnel, over = parse_funnel(document), funnels.resolve_range(self.tables.now, **span)
        found = funnels.levels(self.tables, funnel, over, segment)
        rows = [(r["level"], r["people"], r["partial"]) for r in funnels.histogram(found).collect()]
        out = funnels.summarise(rows, [s.event for s in funnel.steps])
        return out | {"biggest_leak": funnels.biggest_leak(out), "warnings": [r for _, r in funnel_warnings(funnel)], "since": over.since, "until": over.until}

    def run_funnel(self, id: str, **span) -> dict[str, Any]:
        row = self.saved.get(id)
        segment, warnings = self.saved.segment_of(row)
        out = self.funnel_preview(row.definition, segment, **span)
        self.saved.ran(id, Snapshot(out, self.tables.now, out["since"], out["until"]))
        return out | {"warnings": out["warnings"] + warnings}

    def funnel_people(self, id: str, step: int, mode: str = "reached", after: str | None = None, **span) -> dict[str, Any]:
        """A page of people at a step, their whole number, and the cursor of the next page."""
        row, route = self.saved.get(id), f"people/{id}/{step}/{mode}"
        walk = cursor.read(after, route, self.secret) if after else None
        t = self.tables if walk is None else self.tables.at(now=walk.as_of)
        funnel, over = parse_funnel(row.definition), funnels.resolve_range(t.now, **span)
        segment, warnings = self.saved.segment_of(row)
        rows = funnels.people(t, funnel, over, step, mode, walk and (walk.last_seen, walk.person_id), segment).collect()
        more = cursor.following(walk, [(r.entered_at.astimezone(), r.person_id) for r in rows], t.now)
        count = funnels.people_count(t, funnel, over, step, mode, segment).first()["person_count"]
        return {"people": rows, "people_count": count, "next_cursor": cursor.sign(more, route, self.secret) if more else None, "warnings": warnings}

    # Events and catalogs

    def feed(self, person_id: str | None = None, after: str | None = None, **more) -> tuple[list, str | None]:
        """A page of events, oldest first, and a cursor that goes on from its last."""
        scope = person.scope(self.tables, person_id) if person_id else None
        rows = events.feed(self.tables, person=scope, cursor=events.decode_cursor(after) if after else None, **more).collect()
        return rows, events.encode_cursor(rows[-1].timestamp.astimezone().isoformat(), rows[-1].event_id) if rows else after

    def stats(self, interval: str, **more) -> DataFrame:
        return events.stats(self.tables, interval, **more)

    def rejections(self, dead_letter: DataFrame, limit: int = events.FEED_DEFAULT, offset: int = 0, **more) -> dict[str, Any]:
        rows = events.rejections(dead_letter, self.tables.project_id, limit=limit, offset=offset, **more).collect()
        return {"rejections": rows, "has_more": events.rejections_has_more(len(rows), limit, offset + len(rows)), "next_offset": offset + len(rows)}

    def schema_events(self, prefix: str = "", limit: int = catalog.DEFAULT) -> DataFrame:
        return catalog.event_names(self.schema, self.tables.project_id, prefix, limit)

    def schema_properties(self, event: str = "", prefix: str = "", limit: int = catalog.DEFAULT) -> DataFrame:
        return catalog.properties(self.schema, self.tables.project_id, event, prefix, limit)

    def trait_values(self, trait: str, prefix: str = "", limit: int = catalog.DEFAULT) -> DataFrame:
        stored = self.tables.person_traits
        return catalog.trait_values(stored if stored is not None else rollups.person_traits(self.tables.events), self.tables.project_id, trait, prefix, limit)

    # Persons

    def person(self, id: str) -> dict | None:
        return person.profile(self.tables, id)

    def export_person(self, id: str) -> Iterator[str]:
        return export_person(self.tables, person.scope(self.tables, id))

    def alias(self, one: str, other: str) -> None:
        """Makes one id another's: the group of the first points at the canonical id of the second."""
        self.tables = self.tables.at(aliases=identity.apply_aliases(self.tables.aliases, self.tables.project_id, [(one, other)]))
        self.cache.clear(self.tables.project_id)

    def request_deletion(self, id: str, at: datetime | None = None) -> lifecycle.DeletionRequest:
        """Hides a person from now on, and queues their erasure."""
        t = self.tables.at(now=at) if at else self.tables
        request, hidden = lifecycle.request_deletion(t, id, uuid.uuid4().hex, self.requests)
        if request not in self.requests:
            self.requests.append(request)
        self.tables = self.tables.at(suppressed=hidden)
        self.cache.clear(self.tables.project_id)
        return request

    def deletion_status(self, request_id: str) -> str:
        return lifecycle.deletion_status(next(r for r in self.requests if r.request_id == request_id))
