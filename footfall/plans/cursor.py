"""Signed cursors of a walk over pages, which can't be altered or taken to another route."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from dataclasses import dataclass
from datetime import datetime

from .segments import PAGE, WALK


class BadCursor(ValueError):
    """Not a cursor that this route signed."""


@dataclass(frozen=True)
class Walk:
    """Where a walk is: the last row's instant and person, the instant it was begun at, pages served."""

    last_seen: datetime
    person_id: str
    as_of: datetime
    pages: int


def sign(walk: Walk, route: str, secret: bytes) -> str:
    body = json.dumps([walk.last_seen.isoformat(), walk.person_id, walk.as_of.isoformat(), walk.pages], separators=(",", ":")).encode()
    mac = hmac.new(secret, route.encode() + b"\0" + body, hashlib.sha256).digest()
    return base64.urlsafe_b64encode(mac + body).decode().rstrip("=")


def read(cursor: str, route: str, secret: bytes) -> Walk:
    try:
        raw = base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4))
        mac, body = raw[:32], raw[32:]
        if not hmac.compare_digest(mac, hmac.new(secret, route.encode() + b"\0" + body, hashlib.sha256).digest()):
            raise BadCursor("the signature doesn't match")
        seen, person, as_of, pages = json.loads(body)
        return Walk(datetime.fromisoformat(seen), person, datetime.fromisoformat(as_of), int(pages))
    except BadCursor:
        raise
    except (ValueError, TypeError):
        raise BadCursor("not a cursor") from None


def following(walk: Walk | None, rows: list[tuple[datetime, str]], as_of: datetime) -> Walk | None:
    """The walk after a page of (instant, person); None at its end: a page that isn't full, or WALK rows served."""
    pages = (walk.pages if walk else 0) + 1
    if len(rows) < PAGE or pages * PAGE >= WALK:
        return None
    return Walk(*rows[-1], as_of, pages)
