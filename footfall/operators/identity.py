"""Who an event belongs to, as of the event's own time.

Bindings are facts; the ranges in which a device belongs to a person are
derived from them each time. Two derivations exist: ``tiles`` at one second
(both ends included) for queries over events, and ``exact_tiles`` at one
millisecond (end excluded) for the reads of one person.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import seconds

EPOCH = "1970-01-01 00:00:00"
FAR = "2106-02-07 06:28:15"


def _at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def bind(bindings: DataFrame) -> DataFrame:
    """Bindings as stored: one for each device and instant, of ties the smallest person."""
    return bindings.groupBy("project_id", "anonymous_id", F.date_trunc("MILLISECOND", "bound_at").alias("bound_at")).agg(F.min("person_id").alias("person_id")).select("project_id", "anonymous_id", "person_id", "bound_at")


def tiles(bindings: DataFrame) -> DataFrame:
    """project_id, anonymous_id, person_id, valid_from, valid_to: whole seconds, both included.

    The first binding also owns all time before. A tile ends a second before
    the next binding; one that would end before it begins is left out, which
    leaves a gap of a second.
    """
    by_device = Window.partitionBy("project_id", "anonymous_id").orderBy("bound_at")
    begin = F.when(F.lag("bound_at").over(by_device).isNull(), _at(EPOCH)).otherwise(F.greatest("bound_at", _at(EPOCH)))
    after = F.lead("bound_at").over(by_device)
    end = F.when(after.isNull(), _at(FAR)).otherwise(F.least(after - F.expr("INTERVAL 1 SECOND"), _at(FAR)))
    tiled = bindings.select("project_id", "anonymous_id", "person_id", begin.alias("f"), end.alias("t")).where("t >= f")
    return tiled.select("project_id", "anonymous_id", "person_id", seconds(F.col("f")).alias("valid_from"), seconds(F.col("t")).alias("valid_to"))


def exact_tiles(bindings: DataFrame) -> DataFrame:
    """project_id, anonymous_id, person_id, valid_from, valid_to: half open; null is without an end."""
    by_device = Window.partitionBy("project_id", "anonymous_id").orderBy("bound_at")
    begin = F.when(F.lag("bound_at").over(by_device).isNotNull(), F.col("bound_at"))
    return bindings.select("project_id", "anonymous_id", "person_id", begin.alias("valid_from"), F.lead("bound_at").over(by_device).alias("valid_to"))


def coalesce_tiles(exact: DataFrame) -> DataFrame:
    """Neighbouring exact tiles of one person become one."""
    by_device = Window.partitionBy("project_id", "anonymous_id").orderBy(F.col("valid_from").asc_nulls_first())
    new = (F.lag("person_id").over(by_device).isNull() | (F.lag("person_id").over(by_device) != F.col("person_id")) | (F.lag("valid_to").over(by_device) != F.col("valid_from"))).cast("int")
    run = F.sum("new").over(by_device)
    marked = exact.withColumn("new", F.coalesce(new, F.lit(1))).withColumn("run", run)
    first = F.min(F.struct(F.col("valid_from").isNotNull(), "valid_from"))["valid_from"]
    last = F.max(F.struct(F.col("valid_to").isNull(), "valid_to"))["valid_to"]
    return marked.groupBy("project_id", "anonymous_id", "person_id", "run").agg(first.alias("valid_from"), last.alias("valid_to")).drop("run")


def resolve(rows: DataFrame, bindings: DataFrame, aliases: DataFrame, at: str = "timestamp", to: str = "person_id") -> DataFrame:
    """``rows`` with their person.

    The user id if there is one, else who the device belonged to in the second
    of ``at``, else the device; then the canonical id of that. An equi-join on
    the device with the range as a residual, and one on the person: Spark
    broadcasts the small sides by their measured size and else sorts, and
    splits devices that hold many rows.
    """
    tile = tiles(bindings).select(F.col("project_id").alias("_tp"), F.col("anonymous_id").alias("_ta"), F.col("person_id").alias("_person"), "valid_from", "valid_to")
    second = seconds(F.col(at))
    # Rows with a user id match no tile: '' owns none.
    device = F.when(F.col("user_id") == "", F.col("anonymous_id"))
    inside = (F.col("project_id") == F.col("_tp")) & (F.col("_device") == F.col("_ta")) & (F.col("_second") >= F.col("valid_from")) & (F.col("_second") <= F.col("valid_to"))
    marked = rows.withColumn("_device", device).withColumn("_second", second)
    # Bound rows would all hash to one partition as nulls; they keep apart by their own user id.
    marked = marked.withColumn("_device", F.coalesce("_device", F.concat(F.lit("\u0000"), F.col("user_id"))))
    found = marked.join(tile, inside, "left")
    first = F.when(F.col("user_id") != "", F.col("user_id")).otherwise(F.coalesce("_person", "anonymous_id"))
    found = found.withColumn("_first", first).drop("_tp", "_ta", "_person", "valid_from", "valid_to", "_device", "_second")
    alias = aliases.select(F.col("project_id").alias("_ap"), F.col("person_id").alias("_alias"), "canonical_id")
    out = found.join(alias, (F.col("project_id") == F.col("_ap")) & (F.col("_first") == F.col("_alias")), "left")
    return out.withColumn(to, F.coalesce("canonical_id", "_first")).drop("_ap", "_alias", "canonical_id", "_first")


def fold_aliases(log: list[tuple[str, str]], flat: dict[str, str] | None = None) -> dict[str, str]:
    """person -> canonical after writing ``log`` of (from, to) in order; one hop leads to the end.

    Both sides are taken to their canonical ids first; equal ones change
    nothing; what pointed at the left one then points at the right one.
    """
    flat = dict(flat or {})
    for one, other in log:
        a, b = flat.get(one, one), flat.get(other, other)
        if a == b:
            continue
        for k, v in list(flat.items()):
            if v == a:
                flat[k] = b
        flat[a] = b
    return flat


def apply_aliases(aliases: DataFrame, project_id: int, log: list[tuple[str, str]]) -> DataFrame:
    """The alias table of one project after ``log``; only the groups that the log touches are read."""
    spark = aliases.sparkSession
    names = sorted({x for pair in log for x in pair})
    mine = aliases.where(F.col("project_id") == project_id)
    touched = mine.where(F.col("person_id").isin(names) | F.col("canonical_id").isin(names))
    roots = [r[0] for r in touched.select("canonical_id").distinct().collect()]
    group = mine.where(F.col("canonical_id").isin(sorted({*roots, *names})))
    flat = fold_aliases(log, {r["person_id"]: r["canonical_id"] for r in group.collect()})
    new = spark.createDataFrame([(project_id, k, v) for k, v in flat.items()], aliases.schema)
    return aliases.join(new.select("project_id", "person_id"), ["project_id", "person_id"], "left_anti").unionByName(new)
