"""Deliveries to events, and links to their names: what several operators start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.functions.naming import event_name
from seqweave.session import Written, release, write_table
from seqweave.sources.tables import table


def sorted_events(ptb: DataFrame, parts: int, with_time: bool = True) -> DataFrame:
    """One row per event ``(seq_id, pos)``, range-partitioned and sorted by it: ``seq_id, pos, name[, ts]``.

    One shuffle: the range partitioning already brings all deliveries of an event together, so they are merged
    where they arrive. A sequence that holds a third of all rows spreads over as many partitions as it needs.
    The event's name and time are those of its first named delivery. Rows with a null key are no events.
    """
    cols = ["seq_id", "pos", "token", "arrived_at"] + (["ts"] if with_time else [])
    rows = ptb.select(*cols).where("seq_id is not null and pos is not null")
    ranged = rows.repartitionByRange(parts, "seq_id", "pos")
    named = ranged.withColumn("name", event_name(F.col("token")))
    first = F.struct(F.col("name").isNull().alias("nameless"), F.col("arrived_at").isNull().alias("undated"), "arrived_at", *(["ts"] if with_time else []), "name")
    events = named.groupBy("seq_id", "pos").agg(F.min(first).alias("e"))
    out = ["seq_id", "pos", F.col("e.name").alias("name")] + ([F.col("e.ts").alias("ts")] if with_time else [])
    return events.select(*out).sortWithinPartitions("seq_id", "pos")


def named_events(ptb: DataFrame) -> DataFrame:
    """Distinct ``seq_id, pos, name`` of the events that have a name (spellings of one event agree)."""
    return (
        ptb.select("seq_id", "pos", event_name(F.col("token")).alias("name"))
        .where("name is not null and seq_id is not null and pos is not null")
    )


def link_names(spark: SparkSession, folder: str) -> Written:
    """Written table of distinct ``link_id, name``: the names of each link (TESTDATA's *names of a link*).

    Positions that are null, unknown or nameless add nothing; repeated rows and repeated deliveries count once.
    """
    at = table(spark, folder, "linkset").select("seq_id", "link_id", "pos").where("link_id is not null and seq_id is not null and pos is not null")
    events = named_events(table(spark, folder, "ptb"))
    rows = at.join(events, ["seq_id", "pos"]).select("link_id", "name")
    written = write_table(rows.distinct(), "link-names")
    del at, events, rows
    release(spark)
    return written




def digest(names: Column) -> Column:
    """128 bits that stand for an array of names: equal arrays have equal digests, and no others are expected to."""
    return F.unhex(F.md5(F.concat_ws("\n", names)))
