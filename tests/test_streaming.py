import json

import pytest
from conftest import at

from footfall.operators import rollups
from footfall.sources import ingest
from footfall.sources.store import Store
from footfall.streaming import ingest as stream


@pytest.fixture
def requests(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for f in range(3):
        with (folder / f"{f}.json").open("w") as out:
            for i in range(20):
                n = f * 20 + i
                body = {"message_id": f"00000000-0000-4000-8000-{n % 50:012d}", "type": "identify" if n % 5 == 0 else "track", "event": f"e{n % 3}", "user_id": f"u{n % 4}", "anonymous_id": f"d{n % 6}", "properties": {"n": n}, "traits": {"t": n}, "timestamp": f"2026-08-{(n * 7) % 28 + 1:02d}T00:00:00Z"}
                print(json.dumps({"project_id": 1, "received_at": f"2026-08-{(n * 7) % 28 + 1:02d}T01:00:00Z", "user_agent": "Firefox/1 Windows NT" if n % 9 else "curl/8", "body": json.dumps(body) if n % 11 else "{bad"}), file=out)
    return str(folder)


def test_a_stream_equals_a_batch(spark, requests, tmp_path):
    store = Store(spark, str(tmp_path / "out"))
    stream.start(spark, requests, store, str(tmp_path / "check"), files=1).awaitTermination()
    done = ingest.ingest(ingest.read_requests(spark, requests))
    key = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert key(stream.events(store)) == key(done.events) and done.events.count() > 40
    assert key(stream.dead_letter(store)) == key(done.dead_letter)
    for name, whole in (("device_index", rollups.device_index), ("person_traits", rollups.person_traits), ("event_schema", rollups.event_schema)):
        assert key(stream.part(store, name)) == key(whole(done.events)), name
        stream.compact(store, name)
        assert key(stream.part(store, name)) == key(whole(done.events)), name
    assert key(stream.part(store, "counters")) == key(ingest.counters(done.rows))


def test_queries_read_what_a_stream_wrote(spark, requests, tmp_path):
    """With stored rollups and months, answers are those computed from all events; a project follows the same table."""
    from footfall.api import Project
    from footfall.plans import events, segments
    from footfall.plans.ast import parse_segment
    from footfall.schema import tables

    store, now = Store(spark, str(tmp_path / "out")), at("08-28 12:00")
    stream.start(spark, requests, store, str(tmp_path / "check"), files=1).awaitTermination()
    t, done = stream.tables(store, now), ingest.ingest(ingest.read_requests(spark, requests))
    plain = tables(spark, done.events, now, done.bindings)
    tree = {"kind": "group", "op": "and", "children": [{"kind": "behavior", "event": "*", "aggregate": "count", "window": {"kind": "last", "n": 20, "unit": "days"}, "operator": ">=", "value": 2}, {"kind": "trait", "key": "t", "operator": ">=", "value": 1}]}
    node = parse_segment({"ast_version": 1, "filter": tree})
    want = segments.members(plain, node).collect()
    assert segments.members(t, node).collect() == want and len(want) > 1
    one, other = Project(t), Project(plain)
    assert one.schema_events().collect() == other.schema_events().collect() != []
    assert one.schema_properties().collect() == other.schema_properties().collect() != []
    assert events.feed(t, since=at("08-01 00:00"), limit=500).count() == events.feed(plain, since=at("08-01 00:00"), limit=500).count() > 0
    assert t.at(events=done.events).device_index is None
    for rows in (one.schema_events(), one.trait_values("t"), segments.base(t)):
        assert not any("/incoming/" in f for f in rows.inputFiles())
    query = stream.tail(spark, store, "incoming").writeStream.format("memory").queryName("followed").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT count(*) FROM followed").first()[0] == done.events.count()


def test_a_batch_run_again_replaces_its_own_parts(spark, requests, tmp_path):
    store = Store(spark, str(tmp_path / "out"))
    raw, run = ingest.read_requests(spark, requests), stream.write_batch(store)
    run(raw, 0)
    once = stream.events(store).count()
    run(raw, 0)
    assert stream.events(store).count() == once


def test_live_counts_and_tail(spark, make, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = [make.event("x", f"08-01 00:0{i % 3}", "d", id=f"i{i % 6}") for i in range(9)]
    store.append_events(make.events(*rows))
    counted = stream.live_counts(stream.tail(spark, store))
    query = counted.writeStream.format("memory").queryName("live").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT sum(events) FROM live").first()[0] == 6
    followed = stream.tail(spark, store).writeStream.format("memory").queryName("tail").trigger(availableNow=True).start()
    followed.awaitTermination()
    assert spark.sql("SELECT count(*) FROM tail").first()[0] == 9
    assert at("08-01 00:00").year == 2026


def test_limits_and_quotas_go_on_over_batches(spark, tmp_path):
    from datetime import datetime

    from footfall.schema import PROJECTS

    store = Store(spark, str(tmp_path / "out"))
    run = stream.write_batch(store, spark.createDataFrame([(1, "one", 13, 1004, "active")], PROJECTS))

    def send(batch, *events):
        rows = [(1, datetime(2026, 8, 1, 12), "Firefox/1", json.dumps({"message_id": f"00000000-0000-4000-8000-{batch * 10_000 + i:012d}", "type": "track", "event": e, "user_id": "u", "properties": p})) for i, (e, p) in enumerate(events)]
        run(spark.createDataFrame(rows, ingest.RAW), batch)
        return [tuple(r) for r in spark.read.parquet(f"{store.path('parts/counters')}/batch={batch}").select("accepted", "throttled", "over_quota").collect()]

    assert send(0, *[(f"e{i}", {}) for i in range(1000)]) == [(1000, 0, 0)]
    assert send(1, ("e0", {str(i): 1 for i in range(250)}), ("e0", {f"x{i}": 1 for i in range(250)}), ("new", {})) == [(2, 1, 0)]
    assert send(2, ("e0", {"another": 1}), ("e0", {"x1": 1}), ("e1", {}), ("e2", {})) == [(2, 1, 1)]
