"""Problem 5: all similar pairs between set-valued records of two tables.

Size-aware overlap join. Sets of at most ``small`` elements are joined by their threshold-sized subsets: two sets of
sizes x and y that reach the similarity share at least c(x, y) elements, hence a subset of that size. A pair with a
larger set is found on inverted lists, of which only the rare end of each set needs to be scanned. Subsets and names of
lists are keys of one join; each pair that meets is filtered by the similarity itself, at the one key that stands for it,
so the union of both ways needs no further pass. Nothing is broadcast by size: the plan is the same at every scale.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweave.operators.sequence import token_sequence
from seqweave.session import release, tables, write_table

SMALL = 6
#: Meetings (rows of the left times rows of the right) at one key that a task takes; a key with more is salted.
MEETINGS = 4_000_000


def need(x: int, y: int, num: int, den: int) -> int:
    """The least overlap of sets of x and y elements whose Jaccard similarity is at least num / den."""
    return -(-num * (x + y) // (num + den))


def _need(x: Column, y: Column, num: int, den: int) -> Column:
    return F.ceil((x + y) * F.lit(num) / F.lit(num + den) - 1e-9).cast("int")


def _numbers(right: DataFrame) -> DataFrame:
    """``name, number``: the right side's names, the rarest first."""
    rarity = right.groupBy("name").agg(F.count("*").alias("n")).withColumn("all", F.lit(0))
    return token_sequence(rarity, "all", ["n", "name"], "name").select(F.col("token").alias("name"), F.col("pos").alias("number"))


def _sets(rows: DataFrame, numbers: DataFrame, num: int, den: int) -> DataFrame:
    """``key, size, names``: each record's size and those of its elements that the right side has, rarest first.

    A record of which too few are there is in no pair and left out.
    """
    sets = rows.join(numbers, "name", "left").groupBy("key").agg(F.count("*").cast("int").alias("size"), F.sort_array(F.collect_list("number")).alias("names"))
    return sets.where(F.size("names") * F.lit(den) >= F.col("size") * F.lit(num))


def _classes(sets: DataFrame) -> DataFrame:
    """Records with equal sets become one class: ``class`` (their smallest key), ``size, names``."""
    return sets.groupBy("size", "names").agg(F.min("key").alias("class")).select("class", "size", "names")


def _subset_patterns(x: int, known: int, small: int, num: int, den: int) -> list[tuple[int, ...]]:
    """The index sets (1-based) of all subsets that a set of x elements, of which some are known, may share with a small partner."""
    sizes = {need(x, y, num, den) for y in range(1, small + 1) if y * den >= num * x and x * den >= num * y}
    return [c for k in sorted(sizes) for c in combinations(range(1, known + 1), k)]


def _subset_key(elements: list[Column]) -> Column:
    return F.xxhash64(F.lit(len(elements)), *elements)


def _keys(classes: DataFrame, small: int, num: int, den: int) -> DataFrame:
    """``kind, key, rest, class, size, names``: a small set under its subsets (kind 1), every set under the names of its rare
    end (kind 0), with the number of elements from that name on.

    If the least overlap with any partner is c, one of a set's first size - c + 1 elements is shared; those that the
    right side lacks come first and needn't be listed.
    """
    n = F.size("names")
    subsets = F.lit(None).cast("array<struct<kind: int, key: bigint, rest: int>>")
    for x in range(1, small + 1):
        for known in range(1, x + 1):
            if patterns := _subset_patterns(x, known, small, num, den):
                keys = F.array(*(F.struct(F.lit(1).alias("kind"), _subset_key([F.get("names", F.lit(i - 1)) for i in p]).alias("key"), n.alias("rest")) for p in patterns))
                subsets = F.when((F.col("size") == x) & (n == known), keys).otherwise(subsets)
    length = n - F.ceil(F.col("size") * F.lit(num) / F.lit(den) - 1e-9).cast("int") + 1
    listed = F.transform(F.slice("names", F.lit(1), length), lambda e, i: F.struct(F.lit(0).alias("kind"), e.alias("key"), (n - i).alias("rest")))
    every = F.concat(listed, F.coalesce(subsets, F.array().cast("array<struct<kind: int, key: bigint, rest: int>>"))) if small else listed
    return classes.select(F.explode(every).alias("k"), "class", "size", "names").select("k.kind", "k.key", "k.rest", "class", "size", "names")


def _hot(left: DataFrame, right: DataFrame) -> DataFrame:
    """``kind, key, salts`` of the keys at which more than MEETINGS pairs meet."""
    count = lambda df, n: df.groupBy("kind", "key").agg(F.count("*").alias(n))
    both = count(left, "l").join(count(right, "r"), ["kind", "key"])
    return both.where(F.col("l") * F.col("r") > MEETINGS).select("kind", "key", F.ceil(F.col("l") * F.col("r") / MEETINGS).cast("int").alias("salts"))


@dataclass
class Similar:
    """``pairs`` of classes (``left_class, right_class, shared, similarity``) and the records of either side's classes (``class, key``)."""

    pairs: DataFrame
    left: DataFrame
    right: DataFrame


def similar_sets(left: DataFrame, right: DataFrame, num: int = 3, den: int = 5, small: int = SMALL) -> Similar:
    """All pairs of a left and a right record whose sets have a Jaccard similarity of at least ``num / den``.

    Both inputs have distinct ``key, name``; a record without names isn't there and in no pair. Equal sets are joined once
    for all their copies, and a set that is too large for the largest set of the other side is dropped before it is
    gathered, both exact.
    """
    with tables() as kept:
        bound = right.groupBy("key").count().agg(F.max("count").alias("most")).first().most or 0
        sizes = left.groupBy("key").agg(F.count("*").alias("size"))
        large = write_table(sizes.where(F.col("size") * num > bound * den).select("key"), "large").df
        if not large.isEmpty():
            left = left.join(large, "key", "left_anti")
        numbers = write_table(_numbers(right), "numbers").df
        sets = [write_table(_sets(side, numbers, num, den), "sets") for side in (left, right)]
        release(left.sparkSession)
        classes = [write_table(_classes(s.df), "classes") for s in sets]
        l, r = (_keys(c.df, small, num, den) for c in classes)
        hot = write_table(_hot(l.select("kind", "key"), r.select("kind", "key")), "hot").df
        release(left.sparkSession)
        pairs = write_table(_met(l, r, hot, small, num, den), "pairs")
        release(left.sparkSession)
        kept += [pairs, *sets, *classes]
    members = [s.df.join(c.df, ["size", "names"]).select("class", "key") for s, c in zip(sets, classes)]
    return Similar(pairs.df, *members)


def _met(l: DataFrame, r: DataFrame, hot: DataFrame, small: int, num: int, den: int) -> DataFrame:
    """The pairs that meet at a key and are similar, each once."""
    l = l.select("kind", "key", F.col("rest").alias("lr"), F.col("class").alias("left_class"), F.col("size").alias("x"), F.col("names").alias("xs"))
    r = r.select("kind", "key", F.col("rest").alias("rr"), F.col("class").alias("right_class"), F.col("size").alias("y"), F.col("names").alias("ys"))
    on = ["kind", "key"]
    if not hot.isEmpty():
        on.append("salt")
        salts = F.coalesce("salts", F.lit(1))
        l = l.join(hot, ["kind", "key"], "left").withColumn("salt", F.pmod(F.xxhash64("left_class"), salts)).drop("salts")
        r = r.join(hot, ["kind", "key"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), (salts - 1).cast("long")))).drop("salts")
    least = _need(F.col("x"), F.col("y"), num, den)
    both_small = (F.col("x") <= small) & (F.col("y") <= small)
    possible = (F.least("lr", "rr") >= least) & ((F.col("kind") == 1) == both_small)
    met = l.hint("merge").join(r, on).where(possible).withColumn("both", F.array_intersect("xs", "ys")).withColumn("shared", F.size("both"))
    # The key that stands for a pair: the first name that both have, or the first of the subsets of the needed size.
    own = F.lit(None).cast("long")
    for c in range(1, small + 1):
        own = F.when(least == c, _subset_key([F.get("both", F.lit(i)) for i in range(c)])).otherwise(own)
    stands = F.when(F.col("kind") == 0, F.get("both", F.lit(0))).otherwise(own)
    union = F.col("x") + F.col("y") - F.col("shared")
    return met.where((F.col("shared") >= least) & (F.col("key") == stands)).select("left_class", "right_class", "shared", (F.col("shared") / union).alias("similarity"))


def links_and_types(link_names: DataFrame, form_names: DataFrame) -> DataFrame:
    """Problem 5: ``link_id, type_name, similarity`` of all pairs whose names overlap by 0.6 or more.

    ``link_names`` has distinct ``link_id, name``, ``form_names`` distinct ``type_name, name``.
    """
    l, r = link_names.select(F.col("link_id").alias("key"), "name"), form_names.select(F.col("type_name").alias("key"), "name")
    found = similar_sets(l, r)
    links = found.left.select(F.col("class").alias("left_class"), F.col("key").alias("link_id"))
    types = found.right.select(F.col("class").alias("right_class"), F.col("key").alias("type_name"))
    return found.pairs.join(types, "right_class").join(links, "left_class").select("link_id", "type_name", "similarity")
