"""Projects: names, settings and states, and the decision about a quota."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

RETENTION_MONTHS, MOST_MONTHS = 13, 120
STATES = ("active", "archived", "deleting")


class ProjectExists(ValueError):
    """Another project has this slug."""


@dataclass(frozen=True)
class ProjectRow:
    """A project as stored; a null quota is no bound."""

    project_id: int
    name: str
    slug: str
    retention_months: int = RETENTION_MONTHS
    monthly_event_quota: int | None = None
    state: str = "active"


def slug_of(name: str) -> str:
    """Lower-case letters and digits of a name, other runs as single hyphens inside."""
    return "-".join(re.findall("[a-z0-9]+", name.lower()))


def create(rows: list[ProjectRow], name: str) -> ProjectRow:
    slug = slug_of(name)
    if not slug:
        raise ValueError("a name has a letter or digit")
    if any(r.slug == slug for r in rows):
        raise ProjectExists(slug)
    return ProjectRow(max((r.project_id for r in rows), default=0) + 1, name, slug)


def configure(row: ProjectRow, **changes) -> ProjectRow:
    """New settings of a project: name, retention_months, monthly_event_quota or state."""
    months, quota, state = changes.get("retention_months", row.retention_months), changes.get("monthly_event_quota", row.monthly_event_quota), changes.get("state", row.state)
    if isinstance(months, bool) or not isinstance(months, int) or not 1 <= months <= MOST_MONTHS:
        raise ValueError(f"retention is 1 to {MOST_MONTHS} months")
    if quota is not None and (isinstance(quota, bool) or not isinstance(quota, int) or quota <= 0):
        raise ValueError("a quota is a whole number over 0, or none")
    if state not in STATES:
        raise ValueError(f"a state is one of {', '.join(STATES)}")
    if row.state == "deleting" and state != "deleting":
        raise ValueError("a project that is being deleted stays so")
    return replace(row, **changes)


def over_quota(persisted: int, pending: int, quota: int | None) -> bool:
    """Whether the next event is refused; figures that make no sense are errors, not answers."""
    if quota is None:
        return False
    if isinstance(quota, bool) or not isinstance(quota, int) or quota <= 0:
        raise ValueError("a quota is a whole number over 0")
    for n in (persisted, pending):
        if not 0 <= n < float("inf"):
            raise ValueError("counts are finite and not below 0")
    return persisted + pending >= quota
