import os
import sys
from datetime import UTC, datetime
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark():
    from footfall.session import session

    s = session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def at(text: str) -> datetime:
    """An instant of UTC from 'MM-DD HH:MM[:SS[.mmm]]' of 2026."""
    return datetime.fromisoformat(f"2026-{text}").replace(tzinfo=UTC)


class Maker:
    """Makes canonical events with defaults."""

    def __init__(self, spark):
        self.spark, self.n = spark, 0

    def event(self, name, when, device="", user="", props=None, nums=None, id=None, received=None, **context):
        from footfall.schema import EVENTS

        self.n += 1
        values = dict(project_id=1, event_id=id or f"id-{self.n:04d}", anonymous_id=device, user_id=user, event_name=name, timestamp=at(when), received_at=at(received or when), trusted=1, properties=props or {}, properties_num={k: float(v) for k, v in (nums or {}).items()}, **context)
        return tuple(values.get(c, "") for c in EVENTS.names)

    def events(self, *rows):
        from footfall.schema import EVENTS

        return self.spark.createDataFrame(list(rows), EVENTS)

    def bindings(self, *rows):
        from footfall.schema import BINDINGS

        return self.spark.createDataFrame([(1, d, p, at(t)) for d, p, t in rows], BINDINGS)

    def aliases(self, *rows):
        from footfall.schema import ALIASES

        return self.spark.createDataFrame([(1, a, b) for a, b in rows], ALIASES)

    def suppressed(self, *rows):
        from footfall.schema import SUPPRESSED

        return self.spark.createDataFrame([(1, p, at(t)) for p, t in rows], SUPPRESSED)

    def tables(self, events, now="08-07 00:00", **side):
        from footfall.schema import tables

        return tables(self.spark, events, at(now), **side)


@pytest.fixture
def make(spark):
    return Maker(spark)
