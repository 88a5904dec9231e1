"""Problem 6: consolidating pairwise matches into groups.

Alternating large-star and small-star edge rewrites through distributed joins until nothing changes; every node then
hangs on the minimum of its component. Each chunk of edges is first reduced to its own stars by a local union-find.
Only where a node has stars in several chunks do their centres belong together: the rounds run on those centres, and a
last join takes what they come to back to the nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.operators.links import local_stars
from seqweave.session import partitions, ship, write_table


def _fingerprint(edges: DataFrame) -> tuple:
    """Number of the edges and two 64-bit hashes of the set of them."""
    h = [F.sum(F.xxhash64(F.lit(seed), "seq_id", "hi", "lo").cast("decimal(20,0)")) for seed in (1, 2)]
    return tuple(edges.agg(F.count("*"), *h).first())


def large_star(edges: DataFrame) -> DataFrame:
    """Every node connects its larger neighbours to its least neighbour (or itself)."""
    both = edges.select("seq_id", F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select("seq_id", F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("seq_id", "u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    up = edges.select("seq_id", F.col("lo").alias("u"), F.col("hi").alias("v"))
    return up.join(least, ["seq_id", "u"]).select("seq_id", F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Every node connects its smaller neighbours and itself to the least of them."""
    least = edges.groupBy("seq_id", "hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, ["seq_id", "hi"]).where("lo <> m").select("seq_id", F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select("seq_id", "hi", F.col("m").alias("lo"))).distinct()


def star_rounds(edges: DataFrame) -> DataFrame:
    """``seq_id, hi, lo``: each node but the least of its component with that least node. ``edges`` has hi > lo."""
    now = write_table(edges, "edges")
    seen = _fingerprint(now.df)
    while True:
        after = write_table(small_star(large_star(now.df)), "edges")
        now.drop()
        now, before, seen = after, seen, _fingerprint(after.df)
        if seen == before:
            return now.df


def components(pairs: DataFrame) -> DataFrame:
    """``seq_id, group, node``: one row per node that is in a pair, ``group`` being the least node of its component.

    ``pairs`` has ``seq_id, one, two``; direction and repetition don't matter. A pair with a null, or of a node with
    itself, joins nothing and gives no row. Nodes of different ``seq_id`` are different. No pairs, no rows.
    """
    spark = pairs.sparkSession
    ship(spark)
    clean = (
        pairs.where("seq_id is not null and one is not null and two is not null and one <> two")
        .select("seq_id", F.greatest("one", "two").alias("hi"), F.least("one", "two").alias("lo"))
    )
    # Neighbouring positions share a chunk; a sequence with a third of all edges spreads over several.
    chunks = clean.repartitionByRange(partitions(spark), "seq_id", "lo", "hi")
    stars = write_table(chunks.mapInArrow(local_stars, "seq_id long, v long, p long").withColumnsRenamed({"v": "hi", "p": "lo"}), "stars")
    own = stars.df.groupBy("seq_id", "hi").agg(F.min("lo").alias("m"), F.max("lo").alias("top"), F.count("*").alias("chunks"))
    nodes = write_table(own, "nodes").df
    centres = nodes.where("m <> top").select("seq_id", F.col("top").alias("hi"), F.col("m").alias("lo"))
    several = nodes.where("chunks > 2 and m <> top").select("seq_id", "hi", "m")
    if not several.isEmpty():  # centres between the least and the largest
        between = stars.df.join(several, ["seq_id", "hi"]).where("lo <> m").select("seq_id", F.col("lo").alias("hi"), F.col("m").alias("lo"))
        centres = centres.unionByName(between)
    end = star_rounds(centres.distinct()).withColumnsRenamed({"hi": "m", "lo": "to"})
    return nodes.join(end, ["seq_id", "m"], "left").select("seq_id", F.coalesce("to", "m").alias("group"), F.col("hi").alias("node"))
