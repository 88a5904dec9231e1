"""The layers: links, activity types and the compressed sequence, which is the next layer's input."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.operators import links, model, rewrite, sequence, thresholds, types
from seqweave.operators.network import NetworkEstimator, scores
from seqweave.schema import Params
from seqweave.session import release, tables, write_table, written


@dataclass
class Found:
    """What links are made of: edges, probabilities, thresholds, and deltas if they were asked for."""

    edges: DataFrame
    prob: DataFrame
    thresholds: DataFrame
    deltas: DataFrame | None = None


@dataclass
class Layer:
    vocabulary: DataFrame
    prob: DataFrame
    deltas: DataFrame | None
    thresholds: DataFrame
    edges: DataFrame
    linkset: DataFrame
    link_types: DataFrame
    type_forms: DataFrame
    uncompressed: DataFrame
    compressed: DataFrame

    def split(self, params: Params) -> DataFrame:
        return rewrite.split_sequence(self.compressed, params.test_share, params.valid_share)

    def save(self, folder: str, params: Params) -> None:
        """All tables of the layer under ``folder``; probabilities and deltas by offset, the compressed sequence by split."""
        for name in ("vocabulary", "thresholds", "edges", "linkset", "link_types", "type_forms", "uncompressed"):
            getattr(self, name).write.mode("overwrite").parquet(f"{folder}/{name}")
        for name in ("prob", "deltas"):
            if getattr(self, name) is not None:
                getattr(self, name).write.mode("overwrite").partitionBy("k").parquet(f"{folder}/{name}")
        self.split(params).write.mode("overwrite").partitionBy("split").parquet(f"{folder}/compressed")


def learnt_thresholds(values: DataFrame, params: Params) -> DataFrame:
    """Written ``token, threshold`` of weighted values ``token, p, w``."""
    found = thresholds.two_means_thresholds(values) if params.k_means == 2 else thresholds.k_means_thresholds(values, params.k_means, params.k_means_rounds)
    return write_table(found, "thresholds").df


def find_edges(seq: DataFrame, params: Params, stored: DataFrame | None = None) -> Found:
    """Edges of a sequence by the probabilities of its model, which is trained, or ``stored`` by an earlier run (``do_train=False``)."""
    pairs = sequence.lookahead_pairs(seq, params.lookahead)
    if not params.do_train and stored is None:
        raise ValueError("without training, stored probabilities are needed")
    if params.estimator == "network":
        if params.do_train:
            vocab = sequence.vocabulary(seq)
            net = NetworkEstimator(params.lookahead, params.window, params.embedding, params.network_layers, params.epochs, params.epoch_increment, params.seed).fit(seq, vocab)
            stored = write_table(scores(net.transform(seq, vocab), vocab), "scores").df
        some = stored if params.sample is None else model.sampled(stored, params.sample, params.seed, ["seq_id", "k", "pos"])
        learnt = learnt_thresholds(some.groupBy("token", "p").agg(F.count("*").alias("w")), params)
        return Found(links.score_edges(pairs, stored, learnt), stored, learnt)
    prob = write_table(model.MarkovEstimator(params.lookahead).fit(seq).prob, "prob").df if params.do_train else stored
    some = pairs if params.sample is None else model.sampled(pairs, params.sample, params.seed, ["seq_id", "k", "one"])
    seen = prob if params.sample is None else write_table(thresholds.rows_of(prob, some), "rows").df
    deltas = None
    if params.do_deltify or params.score_source == "delta":
        deltas = write_table(model.sparse_deltas(seq, prob), "deltas").df
    if params.score_source != "delta":
        learnt = learnt_thresholds(thresholds.value_weights(seen), params)
        return Found(links.link_edges(pairs, prob, learnt), prob, learnt, deltas)
    rows = prob.select("k", "ctx").distinct()
    at = seq.join(rows.withColumnRenamed("ctx", "token"), "token").select("seq_id", "pos", "k")
    near = deltas
    if params.sample is not None:
        at, near = (model.sampled(x, params.sample, params.seed, ["seq_id", "k", "pos"]) for x in (at, near))
    every = at.count()
    held = near.groupBy("token").agg(F.count("*").alias("n"))
    above = near.where("delta > 0").groupBy("token", F.col("delta").alias("p")).agg(F.count("*").alias("w"))
    nought = near.groupBy("token").agg(F.sum((F.col("delta") == 0).cast("long")).alias("nought"))
    zero = held.join(nought, "token").select("token", F.lit(0.0).alias("p"), (F.lit(every) - F.col("n") + F.col("nought")).alias("w")).where("w > 0")
    learnt = learnt_thresholds(above.unionByName(zero), params)
    return Found(links.delta_edges(pairs, deltas, rows, learnt), prob, learnt, deltas)


def cluster_and_rewrite(seq: DataFrame, linkset: DataFrame, previous_forms: DataFrame | None, params: Params) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Link types, type forms and the sequence with linked events replaced by their types.

    ``previous_forms`` has ``type_name, tokens`` of the layer before; None for the first layer.
    """
    contents = write_table(links.link_contents(linkset, seq), "contents").df
    clusters = types.cluster_links(contents, params.threshold)
    named = write_table(clusters.select("link_id", F.col("cluster_id").cast("string").alias("type_name")), "types").df
    forms = types.canonical_forms(contents, named, params.threshold)
    if previous_forms is not None:
        matches = write_table(types.match_previous(forms, previous_forms.withColumn("ord", F.col("type_name")), params.threshold), "matches").df
        forms = types.forms_after_match(forms, matches)
        named = types.renamed_by_match(named, matches)
    names = write_table(types.new_names(named, types.newest_event(seq)), "names").df
    link_types = write_table(types.rename_types(named, names), "link-types").df
    forms = write_table(types.rename_types(forms, names), "forms").df
    return link_types, forms, rewrite.update_dataset(seq, linkset, link_types)


def run_layer(seq: DataFrame, previous_forms: DataFrame | None, params: Params, stored: DataFrame | None = None) -> Layer:
    """One layer over ``seq_id, pos, token`` with dense positions. ``link_id`` is unique over all sequences in the result."""
    spark = seq.sparkSession
    with tables() as kept:
        seq = written(seq, "layer").df  # every step reads it
        found = find_edges(seq, params, stored)
        edges = write_table(found.edges, "edges")
        release(spark)
        group = (links.link_groups_merged if params.merged_groups else links.link_groups)(edges.df)
        linkset = write_table(links.numbered_links(group), "linkset")
        release(spark)
        link_types, forms, uncompressed = (written(t, n) for t, n in zip(cluster_and_rewrite(seq, linkset.df, previous_forms, params), ("link-types", "forms", "uncompressed")))
        release(spark)
        small = rewrite.compress_sequence(seq, linkset.df, link_types.df)
        compressed = write_table(sequence.token_sequence(small, "seq_id", ["pos"], "token"), "compressed")
        vocabulary = write_table(sequence.vocabulary(seq), "vocabulary")
        rest = [written(t, n) if t is not None else None for t, n in ((found.prob, "prob"), (found.deltas, "deltas"), (found.thresholds, "thresholds"))]
        kept += [vocabulary, edges, linkset, link_types, forms, uncompressed, compressed, *(w for w in rest if w)]
    release(spark)
    return Layer(vocabulary.df, *(w and w.df for w in rest), edges.df, linkset.df, link_types.df, forms.df, uncompressed.df, compressed.df)


def run_layers(seq: DataFrame, layers: int, params: Params = Params(), folder: str | None = None) -> list[Layer]:
    """Layer after layer, each on the compressed sequence of the one before; stops early when nothing is linked any more."""
    out: list[Layer] = []
    previous = None
    for i in range(layers):
        layer = run_layer(seq, previous, params)
        out.append(layer)
        if folder:
            layer.save(f"{folder}/layer={i + 1}", params)
        if i + 1 == layers or layer.linkset.isEmpty():
            break
        params = next_params(params, layer.vocabulary, layer.compressed)
        seq, previous = layer.compressed, layer.type_forms
    return out


def next_params(params: Params, before: DataFrame, now: DataFrame) -> Params:
    """The next layer's sizes: one step more network layers, a larger embedding, epochs by the growth of the vocabulary."""
    return replace(
        params, network_layers=params.network_layers + params.network_layers_step, embedding=params.embedding * params.embedding_growth,
        epochs=sequence.estimate_epochs(params.epochs, before, now, params.most_epoch_growth, params.most_epochs),
    )
