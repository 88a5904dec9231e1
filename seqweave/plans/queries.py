"""The queries of the core, over the whole tables of a data folder.

The event stream gives one sequence per user; the tables of links and types give the contents that clustering,
canonical forms and matching work on. Floats that are sums are rounded where they leave, not before.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.functions.naming import event_name
from seqweave.operators import links, model, network, rewrite, sequence, similarity, thresholds, types
from seqweave.plans import pipeline
from seqweave.schema import Params
from seqweave.session import remove, shared_dir, write_table
from seqweave.sources import text
from seqweave.sources.tables import table

WINDOW, BATCH = 10, 50
#: As far ahead, and with windows as long, as the published run looked.
PARAMS = Params(window=WINDOW)
LOOKAHEAD = PARAMS.lookahead


def _seq(spark: SparkSession, d: str) -> DataFrame:
    return sequence.token_sequence(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """All events as the one sequence that the text formats hold."""
    events = table(spark, d, "events").withColumn("all", F.lit(0))
    return sequence.token_sequence(events, "all", ["ts", "event_id"], "event_type")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return sequence.lookahead_pairs(_seq(spark, d), LOOKAHEAD)


def _prob(spark: SparkSession, d: str) -> DataFrame:
    return model.next_event_prob(_pairs(spark, d))


def _edges(seq: DataFrame) -> DataFrame:
    return pipeline.find_edges(seq, PARAMS).edges


def _groups(seq: DataFrame) -> DataFrame:
    return links.link_groups(_edges(seq))


def _named(spark: SparkSession, d: str) -> DataFrame:
    """The events of ``ptb`` under their names, at their own positions."""
    rows = table(spark, d, "ptb").select("seq_id", "pos", event_name(F.col("token")).alias("token"))
    return rows.where("token is not null").groupBy("seq_id", "pos").agg(F.min("token").alias("token"))


def _contents(spark: SparkSession, d: str) -> DataFrame:
    return links.link_contents(table(spark, d, "linkset"), _named(spark, d))


def _forms(spark: SparkSession, d: str) -> DataFrame:
    return types.canonical_forms(_contents(spark, d), table(spark, d, "link_types"), PARAMS.threshold)


def token_sequence(spark, d):
    return _seq(spark, d)


def vocabulary(spark, d):
    return sequence.vocabulary(_seq(spark, d))


def numberify(spark, d):
    s = _seq(spark, d)
    return sequence.numberify(s, sequence.vocabulary(s))


def lookahead_pairs(spark, d):
    return _pairs(spark, d)


def sliding_windows(spark, d):
    s = _seq(spark, d)
    w = sequence.sliding_windows(sequence.numberify(s, sequence.vocabulary(s)), WINDOW, 1)
    return w.select("seq_id", "pos", F.concat_ws(" ", F.col("win").cast("array<string>")).alias("win"), "label")


def one_hot_labels(spark, d):
    s = _seq(spark, d)
    vocab = sequence.vocabulary(s)
    size = vocab.count()
    return sequence.numberify(s, vocab).select("seq_id", "pos", F.concat_ws("", sequence.one_hot(F.col("token_id"), size).cast("array<string>")).alias("label"))


def batch_layout(spark, d):
    return sequence.batch_layout(_seq(spark, d), BATCH)


def next_event_prob(spark, d):
    return _prob(spark, d)


def probability_column(spark, d):
    return model.probability_column(_prob(spark, d), "click")


def matrix_shape(spark, d):
    s = _seq(spark, d)
    return model.matrix_shape(s, model.probability_rows(_prob(spark, d), sequence.vocabulary(s)))


def probability_deltas(spark, d):
    s = _seq(spark, d)
    rows = model.probability_rows(model.next_event_prob(sequence.lookahead_pairs(s, LOOKAHEAD)), sequence.vocabulary(s))
    return model.probability_deltas(s, rows).select("seq_id", "pos", "k", "token_id", F.round("delta", 9).alias("delta"))


def network_probabilities(spark, d):
    s = _seq(spark, d)
    vocab = sequence.vocabulary(s)
    net = network.NetworkEstimator(LOOKAHEAD, WINDOW, embedding=100, layers=2, epochs=3, epoch_increment=1).fit(s, vocab)
    return network.scores(net.transform(s, vocab), vocab)


def sampled_scan(spark, d):
    return model.sampled(_pairs(spark, d), 0.2, keys=["seq_id", "k", "one"])


def thresholds_query(spark, d):
    t = thresholds.two_means_thresholds(thresholds.value_weights(_prob(spark, d)))
    return t.select("token", F.round("threshold", 9).alias("threshold"))


def thresholds_of_sample(spark, d):
    """Thresholds learnt from half of the rows, whole rows being drawn."""
    seq = _seq(spark, d)
    t = pipeline.find_edges(seq, replace(PARAMS, sample=0.5)).thresholds
    return t.select("token", F.round("threshold", 9).alias("threshold"))


def thresholds_of_three(spark, d):
    """Thresholds between the two largest of three clusters."""
    t = thresholds.k_means_thresholds(thresholds.value_weights(_prob(spark, d)), 3)
    return t.select("token", F.round("threshold", 9).alias("threshold"))


def kmeans_assign(spark, d):
    """Each event's value and the nearest of the three centres of its type's values."""
    events = table(spark, d, "events").where("event_type is not null").select("event_id", F.col("event_type").alias("token"), F.col("value").alias("p"))
    centres = thresholds.k_means_centres(events.where("p is not null").withColumn("w", F.lit(1)), 3)
    at = thresholds.nearest(F.col("p"), F.col("centres"))
    return events.join(centres, "token", "left").select("event_id", at.alias("centre"), F.round(F.get("centres", at), 6).alias("at"))


def estimate_epochs(spark, d):
    all_ = _named_split(spark, d)
    n = sequence.estimate_epochs(16.0, all_.where("split = 'train'"), all_)
    return spark.range(1).select(F.round(F.lit(float(n)), 6).alias("epochs"))


def _named_split(spark, d):
    rows = table(spark, d, "ptb").select("split", event_name(F.col("token")).alias("token"))
    return rows.where("token is not null")


def link_edges(spark, d):
    return _edges(_seq(spark, d))


def link_groups(spark, d):
    return _groups(_seq(spark, d))


def link_groups_merged(spark, d):
    return links.link_groups_merged(_edges(_seq(spark, d)))


def delta_edges(spark, d):
    """Edges by the rise of probabilities instead of the probabilities."""
    return pipeline.find_edges(_seq(spark, d), replace(PARAMS, score_source="delta")).edges


def link_contents(spark, d):
    return _contents(spark, d).select("seq_id", "link_id", F.concat_ws(" ", "tokens").alias("tokens"))


def link_span(spark, d):
    return links.link_span(table(spark, d, "linkset"))


def link_similarity(spark, d):
    own = write_table(similarity.bags(_contents(spark, d)), "bags").df
    return similarity.similar_bags(own, PARAMS.threshold).select("one", "two", F.round("similarity", 9).alias("similarity"))


def cluster_links(spark, d):
    return types.cluster_links(_contents(spark, d), PARAMS.threshold)


def canonical_forms(spark, d):
    return _forms(spark, d).select("type_name", F.concat_ws(" ", "tokens").alias("tokens"))


def _previous(spark, d):
    each = table(spark, d, "type_forms").where("type_name is not null").select("type_name", F.explode("tokens").alias("t"))
    sets = each.select("type_name", event_name(F.col("t")).alias("t")).where("t is not null").groupBy("type_name").agg(F.sort_array(F.collect_set("t")).alias("tokens"))
    return sets.withColumn("ord", F.col("type_name"))


def match_previous_types(spark, d):
    return types.match_previous(_forms(spark, d), _previous(spark, d), PARAMS.threshold)


def rename_matched(spark, d):
    """Links under the names of the earlier types that theirs match."""
    named = table(spark, d, "link_types").select("link_id", "type_name").distinct()
    return types.renamed_by_match(named, match_previous_types(spark, d))


def rename_types(spark, d):
    rows = table(spark, d, "link_types").select("link_id", F.when(F.col("link_id") % 3 != 0, F.regexp_extract("type_name", "([0-9]+)$", 1)).otherwise(F.col("type_name")).alias("type_name"))
    rows = rows.distinct()
    dataset = table(spark, d, "type_forms").select(F.col("type_name").alias("token"))
    return types.rename_types(rows, types.new_names(rows, types.newest_event(dataset)))


def update_dataset(spark, d):
    return rewrite.update_dataset(_named(spark, d), table(spark, d, "linkset"), table(spark, d, "link_types"))


def compress_sequence(spark, d):
    """The event sequences with each group as one event, of the type of its size."""
    seq = _seq(spark, d)
    own = write_table(links.numbered_links(_groups(seq)), "groups").df
    kinds = own.groupBy("link_id").agg(F.concat(F.lit("new_event_"), F.count("*").cast("string")).alias("type_name"))
    return rewrite.compress_sequence(seq, own, kinds)


def split_sequence(spark, d):
    return rewrite.split_sequence(_seq(spark, d))


def holdout_split(spark, d):
    return rewrite.holdout_split(_seq(spark, d), 0.2)


def activity_pipeline(spark, d):
    layer = pipeline.run_layer(_seq(spark, d), None, PARAMS)
    return layer.split(PARAMS)


def activity_links(spark, d):
    """The links of the first layer and their types."""
    layer = pipeline.run_layer(_seq(spark, d), None, PARAMS)
    return layer.linkset.join(layer.link_types, "link_id", "left").select("seq_id", "link_id", "pos", "type_name")


def two_layer_pipeline(spark, d):
    return pipeline.run_layers(_seq(spark, d), 2, PARAMS)[-1].compressed


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/text-{uuid.uuid4().hex}"


def _back(df: DataFrame, folder: str) -> DataFrame:
    """What was read back, kept as a table; the text files are removed."""
    out = write_table(df, "read").df
    remove(df.sparkSession, folder)
    return out


def text_sequence(spark, d):
    """A sequence written as the three files of a split and read again."""
    to = _folder(spark)
    text.write_splits(rewrite.split_sequence(_stream(spark, d)), to)
    return _back(text.read_sequence(spark, to), to)


def text_vocabulary(spark, d):
    to = _folder(spark)
    text.write_vocabulary(sequence.vocabulary(_named_split(spark, d)), f"{to}/vocabulary")
    return _back(text.read_vocabulary(spark, f"{to}/vocabulary"), to)


def text_thresholds(spark, d):
    to = _folder(spark)
    s = _seq(spark, d)
    t = thresholds.two_means_thresholds(thresholds.value_weights(model.next_event_prob(sequence.lookahead_pairs(s, LOOKAHEAD))))
    text.write_thresholds(t.join(sequence.vocabulary(s), "token"), f"{to}/thresholds")
    return _back(text.read_thresholds(spark, f"{to}/thresholds").select("token_id", F.round("threshold", 9).alias("threshold")), to)


def _matrices(spark, d, value):
    """The matrices of the one sequence, a file for each offset, written and read again cell by cell."""
    to = _folder(spark)
    s = _stream(spark, d)
    vocab = sequence.vocabulary(s)
    rows = write_table(model.probability_rows(model.next_event_prob(sequence.lookahead_pairs(s, LOOKAHEAD)), vocab), "rows").df
    at = write_table(value(s, rows), "matrix").df
    out = None
    for k in range(1, LOOKAHEAD + 1):
        text.write_matrix(at.where(F.col("k") == k).select("pos", "p"), f"{to}/lookahead={k}")
        read = text.read_matrix(spark, f"{to}/lookahead={k}", k)
        out = read if out is None else out.unionByName(read)
    cells = out.select("k", "pos", F.posexplode("p").alias("token_id", "p"))
    return _back(cells.select("k", "pos", F.col("token_id").cast("long").alias("token_id"), F.round("p", 9).alias("p")), to)


def text_probabilities(spark, d):
    return _matrices(spark, d, lambda s, rows: s.join(rows, s.token == rows.ctx).select("k", "pos", "p"))


def text_deltas(spark, d):
    def vectors(s, rows):
        each = model.probability_deltas(s, rows)
        return each.groupBy("k", "pos").agg(F.sort_array(F.collect_list(F.struct("token_id", "delta"))).alias("o")).select("k", "pos", F.col("o.delta").alias("p"))

    return _matrices(spark, d, vectors)


def text_linkset(spark, d):
    """Links by the number of their line."""
    to = _folder(spark)
    text.write_linkset(table(spark, d, "linkset"), f"{to}/links")
    return _back(text.read_linkset(spark, f"{to}/links"), to)


def text_link_types(spark, d):
    to = _folder(spark)
    one = table(spark, d, "link_types").groupBy("link_id").agg(F.min("type_name").alias("type_name"))
    text.write_link_types(one, f"{to}/types")
    return _back(text.read_link_types(spark, f"{to}/types"), to)


def text_type_forms(spark, d):
    to = _folder(spark)
    text.write_type_forms(_forms(spark, d), f"{to}/forms")
    return _back(text.read_type_forms(spark, f"{to}/forms").select("type_name", F.concat_ws(" ", "tokens").alias("tokens")), to)


def stored_model(spark, d):
    """A trained model, stored and loaded again: the probabilities it gives at every position."""
    to = _folder(spark)
    seq = _seq(spark, d)
    model.MarkovEstimator(LOOKAHEAD).fit(seq).save(to)
    return _back(model.MarkovModel.load(spark, to).transform(seq).select("seq_id", "pos", "k", "token", F.round("p", 9).alias("p")), to)


def preloaded_matrix(spark, d):
    """One offset of stored probabilities, read through the memory that keeps matrices."""
    to = _folder(spark)
    model.MarkovModel(_prob(spark, d)).save(to)
    held = network.Preloaded(spark)
    out = _back(held.matrix(to, 1).select("k", "ctx", "nxt", "n", "n_ctx", "p"), to)
    held.unload()
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_ = (
        token_sequence, vocabulary, numberify, lookahead_pairs, sliding_windows, one_hot_labels, batch_layout, next_event_prob, probability_column, matrix_shape,
        probability_deltas, network_probabilities, sampled_scan, thresholds_of_sample, thresholds_of_three, kmeans_assign, estimate_epochs, link_edges, link_groups, link_groups_merged, delta_edges,
        link_contents, link_span, link_similarity, cluster_links, canonical_forms, match_previous_types, rename_matched, rename_types, update_dataset, compress_sequence,
        split_sequence, holdout_split, activity_pipeline, activity_links, two_layer_pipeline, text_sequence, text_vocabulary, text_thresholds, text_probabilities, text_deltas, text_linkset,
        text_link_types, text_type_forms, stored_model, preloaded_matrix,
    )
    return {f.__name__: f for f in all_} | {"thresholds": thresholds_query}
