import pytest

from footfall.plans import projects
from footfall.sources import backup


def test_names_and_settings():
    one = projects.create([], "  My Shop, Inc. ")
    assert (one.project_id, one.slug, one.retention_months, one.monthly_event_quota) == (1, "my-shop-inc", 13, None)
    with pytest.raises(projects.ProjectExists):
        projects.create([one], "my shop -- inc")
    with pytest.raises(ValueError):
        projects.create([], "!!")
    assert projects.configure(one, monthly_event_quota=5, retention_months=120).monthly_event_quota == 5
    for bad in ({"retention_months": 0}, {"retention_months": 121}, {"monthly_event_quota": 0}, {"monthly_event_quota": True}, {"state": "gone"}):
        with pytest.raises(ValueError):
            projects.configure(one, **bad)
    with pytest.raises(ValueError):
        projects.configure(projects.configure(one, state="deleting"), state="active")


def test_quota():
    assert not projects.over_quota(10**9, 0, None)
    assert not projects.over_quota(3, 1, 5) and projects.over_quota(3, 2, 5)
    for bad in ((1, 1, 0), (float("nan"), 1, 5), (-1, 0, 5), (1, float("inf"), 5)):
        with pytest.raises(ValueError):
            projects.over_quota(*bad)


def test_backup(spark, make, tmp_path):
    path = str(tmp_path / "b")
    manifest = backup.backup({"events": make.events(make.event("x", "08-01 00:00", "d")), "bindings": make.bindings()}, path)
    assert sorted(map(tuple, manifest.collect())) == [("bindings", 0), ("events", 1)]
    assert backup.restore(spark, path)["events"].first().event_name == "x"
    make.events(make.event("y", "08-01 00:00", "d")).write.mode("append").parquet(f"{path}/events")
    with pytest.raises(backup.Incomplete):
        backup.restore(spark, path)
