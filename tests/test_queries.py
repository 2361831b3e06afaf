"""Queries over a fixture against their SQL."""

from datetime import datetime, timedelta

import duckdb
import pytest

from footfall.oracle import ORACLES
from footfall.queries import QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Events on both sides of a million and of ten millions, each at an instant of its own."""
    kinds = ("view", "click", "signup", "purchase", "error")
    ids = [*range(999_900, 1_000_150), *range(9_999_950, 10_000_200)]
    rows = [(e, datetime(2024, 1, 2) + timedelta(minutes=n), 1 + e % 40, kinds[e % 5], n / 4, f'{{"k": {e % 90}}}') for n, e in enumerate(ids)]
    d = tmp_path_factory.mktemp("events")
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{d}/events.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["ingest_outcomes", "ingest_events", "ingest_counters", "ingest_rejections"])
def test_requests_of_ids_of_more_than_six_digits(spark, folder, name):
    with duckdb.connect() as c:
        c.execute("SET TimeZone = 'UTC'")
        c.execute(f"CREATE VIEW events AS SELECT * EXCLUDE (ts), CAST(ts AS TIMESTAMP) AS ts FROM '{folder}/events.parquet/*.parquet'")
        want = c.execute(ORACLES[name]).fetchall()
    got = QUERIES[name](spark, folder).collect()
    assert len(got) > 2 and sorted(map(tuple, got)) == sorted(map(tuple, want))


@pytest.mark.parametrize("name", ["ingest_outcomes", "ingest_events", "ingest_counters", "ingest_rejections"])
def test_requests_of_numbers_of_more_than_twelve_digits(spark, tmp_path, name):
    """An event's id holds twelve digits, the number is whole."""
    ids = [*range(999_999_999_900, 1_000_000_000_150), *range(59_000_000_000_000, 59_000_000_000_250)]
    rows = [(e, datetime(2024, 1, 2) + timedelta(minutes=n), 1 + e % 40, ("view", "click", "signup", "purchase", "error")[e % 5], n / 4, f'{{"k": {e % 90}}}') for n, e in enumerate(ids)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    with duckdb.connect() as c:
        c.execute("SET TimeZone = 'UTC'")
        c.execute(f"CREATE VIEW events AS SELECT * EXCLUDE (ts), CAST(ts AS TIMESTAMP) AS ts FROM '{tmp_path}/events.parquet/*.parquet'")
        want = c.execute(ORACLES[name]).fetchall()
    got = QUERIES[name](spark, str(tmp_path)).collect()
    assert len(got) > 2 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_rejections_of_repeated_instants(spark, tmp_path):
    """Where instants repeat, SQL by the instant alone leaves the page's ends open: the query takes the smallest ids."""
    ids = [k * 1000 + n for k in range(60) for n in range(40)]
    rows = [(e, datetime(2024, 1, 2) + timedelta(minutes=e % 1000), 1 + e % 40, ("view", "click", "signup", "purchase", "error")[e % 5], e / 4, f'{{"k": {e % 90}}}') for e in ids]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    name = "ingest_rejections"
    with duckdb.connect() as c:
        c.execute("SET TimeZone = 'UTC'")
        c.execute(f"CREATE VIEW events AS SELECT * EXCLUDE (ts), CAST(ts AS TIMESTAMP) AS ts FROM '{tmp_path}/events.parquet/*.parquet'")
        plain = c.execute(ORACLES[name]).fetchall()
        want = c.execute(ORACLES[name].replace("ORDER BY ms DESC", "ORDER BY ms DESC, event_id")).fetchall()
        around = c.execute(ORACLES[name].replace("LIMIT 40 OFFSET 20", "LIMIT 100")).fetchall()
    got = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]
    assert got == want and [r[0] for r in got] == [r[0] for r in plain]
    # Ties at both ends, with both details: the page isn't the only one of its SQL.
    at_ends = lambda n: {r for r in around if r[0] == around[n][0]}
    assert around[19][0] == around[20][0] and around[59][0] == around[60][0] and len(at_ends(20)) == len(at_ends(59)) == 2
