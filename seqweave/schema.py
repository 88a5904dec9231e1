"""Schemas of the engine's tables and the parameters of a run."""

from __future__ import annotations

from dataclasses import dataclass

SEQUENCE = "seq_id BIGINT, pos BIGINT, token STRING"
VOCABULARY = "token STRING, token_id BIGINT"
EDGES = "seq_id BIGINT, k INT, one BIGINT, two BIGINT"
LINKSET = "seq_id BIGINT, link_id BIGINT, pos BIGINT"
LINK_TYPES = "seq_id BIGINT, link_id BIGINT, type_name STRING"
TYPE_FORMS = "type_name STRING, tokens ARRAY<STRING>"
THRESHOLDS = "token STRING, threshold DOUBLE"


@dataclass(frozen=True)
class Params:
    """What a layer is run with."""

    window: int = 10
    lookahead: int = 10
    threshold: float = 0.6
    test_share: float = 0.1
    valid_share: float = 0.2
    merged_groups: bool = False
    estimator: str = "counts"  # or "network"
    score_source: str = "prob"  # or "delta", of counts
    sample: float | None = None  # the share of rows that thresholds are learnt from; None: all
    k_means: int = 2
    k_means_rounds: int = 15  # for more than two clusters
    do_train: bool = True  # otherwise ``stored`` of run_layer has the probabilities
    do_deltify: bool = False  # deltas are made and stored, whatever links are scored by
    seed: int = 42
    embedding: float = 120.0
    embedding_growth: float = 1.02
    network_layers: int = 4
    network_layers_step: int = 0
    epochs: float = 16.0
    epoch_increment: float = 0.0
    most_epoch_growth: float = 2.0
    most_epochs: float | None = None
