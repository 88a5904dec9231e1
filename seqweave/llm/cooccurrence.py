"""Problem 4: items that appear together.

Items are deduplicated per basket, every basket emits its ordered pairs once, counts are combined on the map side,
and lift and pointwise mutual information come from the marginals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.session import write_table

#: Frequent items up to this many are sent to every task (about 16 MB); more are joined by shuffle, before pairing.
BROADCAST_ITEMS = 200_000
#: A basket with more frequent items than this is paired in blocks of about as many, so that no task builds a huge
#: basket's pairs from one row.
BLOCK = 1024


def _pairs_at_once(rows: DataFrame) -> DataFrame:
    """``item_a, item_b``: the ordered pairs of each basket."""
    baskets = rows.groupBy("basket").agg(F.sort_array(F.collect_list("item")).alias("items"))
    each = baskets.select(F.posexplode("items").alias("i", "item_a"), "items")
    return each.select("item_a", F.explode(F.slice("items", F.col("i") + 2, F.size("items"))).alias("item_b"))


def _pairs_by_block(rows: DataFrame, n_blocks: int) -> DataFrame:
    """The same for huge baskets: their items fall into blocks, and every two blocks of a basket are paired on their own."""
    block = F.pmod(F.xxhash64("item"), F.lit(n_blocks))
    blocks = rows.groupBy("basket", block.alias("b")).agg(F.collect_list("item").alias("items"))
    left, right = blocks.select("basket", F.col("b").alias("p"), F.col("items").alias("xs")), blocks.select("basket", F.col("b").alias("q"), F.col("items").alias("ys"))
    both = left.join(right, "basket").where("p <= q").repartition("basket", "p", "q")
    each = both.select(F.explode("xs").alias("x"), "ys", (F.col("p") == F.col("q")).alias("same")).select("x", F.explode("ys").alias("y"), "same")
    return each.where("x < y or (not same and x > y)").select(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"))


def frequent_pairs(baskets: DataFrame, n_baskets: int, least: int, least_lift: float) -> DataFrame:
    """Pairs of items held together by at least ``least`` baskets, ``least_lift`` times as often as by chance or more.

    ``baskets`` has distinct ``basket, item``. Gives ``item_a, item_b`` (smaller first, by bytes), ``n_a, n_b, n_ab,
    lift, pmi``. An item in fewer than ``least`` baskets can't be in a result pair, so it is dropped before any pair
    is built (exact, not a cap); at most (rows of ``baskets``) / ``least`` items remain, whatever their distribution.
    """
    counts = baskets.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    counts = write_table(counts, "frequent").df
    n_items = counts.count()
    small = n_items <= BROADCAST_ITEMS
    kept = baskets.join(F.broadcast(counts.select("item")), "item") if small else baskets.join(counts, "item").select("basket", F.struct("item", "n").alias("item"))
    huge = write_table(kept.groupBy("basket").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("basket"), "huge").df
    if huge.isEmpty():
        pairs = _pairs_at_once(kept)
    else:
        pairs = _pairs_at_once(kept.join(huge, "basket", "left_anti")).unionByName(_pairs_by_block(kept.join(huge, "basket", "left_semi"), -(-n_items // BLOCK)))
    n_ab = pairs.groupBy("item_a", "item_b").agg(F.count("*").alias("n_ab")).where(F.col("n_ab") >= least)
    if small:
        a, b = (F.broadcast(counts.select(F.col("item").alias(f"item_{s}"), F.col("n").alias(f"n_{s}"))) for s in "ab")
        rated = n_ab.join(a, "item_a").join(b, "item_b")
    else:  # the items went into the pairs with their counts
        rated = n_ab.select("item_a.item", F.col("item_b.item").alias("item_b"), F.col("item_a.n").alias("n_a"), F.col("item_b.n").alias("n_b"), "n_ab").withColumnRenamed("item", "item_a")
    ratio = F.col("n_ab") * F.lit(n_baskets) / (F.col("n_a") * F.col("n_b"))
    return (
        rated.where(F.col("n_ab") * F.lit(n_baskets) >= least_lift * (F.col("n_a") * F.col("n_b")))
        .select("item_a", "item_b", "n_a", "n_b", "n_ab", ratio.alias("lift"), F.log2(ratio).alias("pmi"))
    )


def pairs_of_names(link_names: DataFrame, least: int = 5, one_in: int | None = 1000, least_lift: float = 4.0) -> DataFrame:
    """Problem 4 for links: ``token_a, token_b, n_a, n_b, n_ab, lift, pmi``.

    ``link_names`` has distinct ``link_id, name``; a pair needs ``least`` links and one in ``one_in`` of all (None: no share of
    all; with ``least=1, least_lift=0`` that gives every pair that occurs together). No links give no rows; nulls were dropped with the names.
    """
    n = link_names.select("link_id").distinct().count()
    if one_in is not None:
        least = max(least, -(-n // one_in))
    found = frequent_pairs(link_names.select(F.col("link_id").alias("basket"), F.col("name").alias("item")), n, least, least_lift)
    return found.withColumnsRenamed({"item_a": "token_a", "item_b": "token_b"})
