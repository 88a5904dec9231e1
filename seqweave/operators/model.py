"""Next-event estimators: position and offset to probabilities over the vocabulary; deltas, scans of the results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.operators.sequence import blocked, in_block, lookahead_pairs


class MarkovEstimator:
    """P(event at +k | event now) by counting, one model for each offset k = 1..lookahead. Deterministic."""

    def __init__(self, lookahead: int):
        self.lookahead = lookahead

    def fit(self, sequence: DataFrame) -> "MarkovModel":
        return MarkovModel(next_event_prob(lookahead_pairs(sequence, self.lookahead)))


class MarkovModel:
    def __init__(self, prob: DataFrame):
        self.prob = prob

    def save(self, path: str) -> None:
        self.prob.write.mode("overwrite").partitionBy("k").parquet(path)

    @staticmethod
    def load(spark, path: str) -> "MarkovModel":
        return MarkovModel(spark.read.parquet(path).select("k", "ctx", "nxt", "n", "n_ctx", "p"))

    def transform(self, sequence: DataFrame) -> DataFrame:
        """``seq_id, pos, k, token, p``: the probabilities that aren't 0, keyed by the position the prediction is made at."""
        seq = sequence.select("seq_id", "pos", F.col("token").alias("ctx"))
        return seq.join(self.prob, "ctx").select("seq_id", "pos", "k", F.col("nxt").alias("token"), "p")


def next_event_prob(pairs: DataFrame) -> DataFrame:
    """``k, ctx, nxt, n, n_ctx, p`` of all observed pairs; counts are combined before the shuffle."""
    n = pairs.groupBy("k", "ctx", "nxt").agg(F.count("*").alias("n"))
    total = n.groupBy("k", "ctx").agg(F.sum("n").alias("n_ctx"))
    return n.join(total, ["k", "ctx"]).select("k", "ctx", "nxt", "n", "n_ctx", (F.col("n") / F.col("n_ctx")).alias("p"))


def probability_rows(prob: DataFrame, vocab: DataFrame) -> DataFrame:
    """``k, ctx, p``: the dense vector over the vocabulary, in the order of token ids, one per offset and context."""
    size = vocab.count()
    cells = prob.join(vocab.withColumnRenamed("token", "nxt"), "nxt").groupBy("k", "ctx").agg(F.map_from_entries(F.collect_list(F.struct("token_id", "p"))).alias("m"))
    ids = F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))
    return cells.select("k", "ctx", F.transform(ids, lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("p"))


def probability_deltas(sequence: DataFrame, rows: DataFrame) -> DataFrame:
    """``seq_id, pos, k, token_id, delta``: each vector minus that of the position before; the first minus zeros."""
    ctx = blocked(sequence, 0, 1).withColumn("before", F.lag("token").over(in_block())).where("own").select("seq_id", "pos", "token", "before")
    now, was = rows.select("k", F.col("ctx").alias("token"), "p"), rows.select(F.col("k").alias("k2"), F.col("ctx").alias("before2"), F.col("p").alias("q"))
    both = ctx.join(now, "token").join(was, (F.col("before") == F.col("before2")) & (F.col("k") == F.col("k2")), "left")
    delta = F.when(F.col("q").isNull(), F.col("p")).otherwise(F.zip_with("p", "q", lambda x, y: x - y))
    return both.select("seq_id", "pos", "k", F.posexplode(delta).alias("token_id", "delta")).withColumn("token_id", F.col("token_id").cast("long"))


def sparse_deltas(sequence: DataFrame, prob: DataFrame) -> DataFrame:
    """``seq_id, pos, k, token, delta`` of the tokens that were or are probable; all other cells are 0.

    Grows with what the model has seen, not with the vocabulary: the rows of ``probability_deltas`` but those where both
    probabilities are 0.
    """
    ctx = blocked(sequence, 0, 1).withColumn("before", F.lag("token").over(in_block())).where("own").select("seq_id", "pos", "token", "before")
    p = prob.select("k", F.col("ctx").alias("of"), F.col("nxt").alias("token"), "p")
    at = [ctx.select("seq_id", "pos", F.col(c).alias("of")).join(p, "of").select("seq_id", "pos", "k", "token", (F.col("p") * sign).alias("delta")) for c, sign in (("token", 1.0), ("before", -1.0))]
    known = prob.select("k", F.col("ctx").alias("of")).distinct()  # a context never seen has no row to subtract from
    now = ctx.select("seq_id", "pos", F.col("token").alias("of")).join(known, "of").select("seq_id", "pos", "k")
    both = at[0].unionByName(at[1].join(now, ["seq_id", "pos", "k"], "left_semi"))
    return both.groupBy("seq_id", "pos", "k", "token").agg(F.sum("delta").alias("delta"))


def matrix_shape(sequence: DataFrame, rows: DataFrame) -> DataFrame:
    """``k, n_rows, n_columns`` of the probability matrix of each offset."""
    size = rows.select("k", "ctx", F.size("p").alias("n_columns"))
    counts = sequence.groupBy("token").agg(F.count("*").alias("n"))
    return size.join(counts, size.ctx == counts.token).groupBy("k").agg(F.sum("n").alias("n_rows"), F.max("n_columns").cast("long").alias("n_columns"))


def sampled(rows: DataFrame, rate: float = 0.2, seed: int = 42, keys: list[str] | None = None) -> DataFrame:
    """A Bernoulli sample of rows; by ``keys`` the same rows in every run: those whose MD5 begins below ``rate``."""
    if keys is None:
        return rows.sample(False, rate, seed)
    if rate >= 1:
        return rows
    return rows.where(F.substring(F.md5(F.concat_ws("|", *keys)), 1, 4) < f"{round(rate * 65536):04x}")


def probability_column(prob: DataFrame, token: str, non_negative: bool = True) -> DataFrame:
    """``k, ctx, p, n``: one token's probabilities over all offsets, each with the number of rows that have it."""
    kept = prob.where(F.col("nxt") == token)
    return (kept.where("p >= 0") if non_negative else kept).select("k", "ctx", "p", F.col("n_ctx").alias("n"))
