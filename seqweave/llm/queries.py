"""Queries of the problems, over the whole tables of a data folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.functions.naming import event_name, source_name
from seqweave.llm import bpe, clusters, components, cooccurrence, events, mixing, overlap, runs, terms, visual
from seqweave.sources.tables import table


def form_names(type_forms: DataFrame) -> DataFrame:
    """Distinct ``type_name, name``; null types, null elements and empty arrays add nothing."""
    each = type_forms.where("type_name is not null").select("type_name", F.explode("tokens").alias("token"))
    return each.select("type_name", event_name(F.col("token")).alias("name")).where("name is not null").distinct()


def p1_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.repeated_runs(table(spark, folder, "ptb"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_runs(spark, folder).select("seq_id", "first_pos", "last_pos")


def _groups(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    names = events.link_names(spark, folder)
    found = clusters.similar_groups(names.df)
    names.drop()
    return found


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _groups(spark, folder)[0]


def p2_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.describe(*_groups(spark, folder), table(spark, folder, "link_types"))


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    return terms.term_counts(table(spark, folder, "ptb"), table(spark, folder, "vocabulary"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_counts(spark, folder).where("mark is not null").select("token", "mark")


def p4_pairs(spark: SparkSession, folder: str) -> DataFrame:
    rated = cooccurrence.pairs_of_names(events.link_names(spark, folder).df)
    return rated.withColumns({"lift": F.round("lift", 9), "pmi": F.round("pmi", 9)})


def p4_all_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of names that occur together, however seldom; ``p4_pairs`` has those of ``p4_found`` only."""
    rated = cooccurrence.pairs_of_names(events.link_names(spark, folder).df, least=1, one_in=None, least_lift=0)
    return rated.withColumns({"lift": F.round("lift", 9), "pmi": F.round("pmi", 9)})


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_pairs(spark, folder).select("token_a", "token_b")


def p5_pairs(spark: SparkSession, folder: str) -> DataFrame:
    names = events.link_names(spark, folder)
    found = overlap.links_and_types(names.df, form_names(table(spark, folder, "type_forms")))
    names.drop()
    return found


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_pairs(spark, folder).select("link_id", "type_name")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    groups = components.components(table(spark, folder, "edges"))
    return groups.select("seq_id", F.col("group").alias("group_pos"), F.col("node").alias("pos"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.token_ids(table(spark, folder, "documents"))


def p7_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The ids decoded again: every text comes back as it was, null ones empty."""
    return bpe.texts(p7_ids(spark, folder))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(mixing.sized_documents(table(spark, folder, "documents")).df, table(spark, folder, "source_targets"))


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    sized, targets = mixing.sized_documents(table(spark, folder, "documents")).df, table(spark, folder, "source_targets")
    return mixing.report(mixing.mix(sized, targets), targets, sized)


def _sized_in_characters(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", source_name(F.col("source")).alias("source"), F.length("text").cast("long").alias("tokens"))


def p8_mix_characters(spark: SparkSession, folder: str) -> DataFrame:
    """As ``p8_mix``, with characters for tokens, which SQL can count."""
    return mixing.mix(_sized_in_characters(spark, folder), table(spark, folder, "source_targets"))


def p8_report_characters(spark: SparkSession, folder: str) -> DataFrame:
    """As ``p8_report``, with characters for tokens."""
    sized, targets = _sized_in_characters(spark, folder), table(spark, folder, "source_targets")
    return mixing.report(mixing.mix(sized, targets), targets, sized)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return visual.look_alikes(table(spark, folder, "documents"))


def p9_classes(spark: SparkSession, folder: str) -> DataFrame:
    return visual.look_classes(table(spark, folder, "documents"))


def p9_forms(spark: SparkSession, folder: str) -> DataFrame:
    return visual.unified(table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_ = (p1_found, p1_runs, p2_found, p2_clusters, p3_found, p3_counts, p4_found, p4_pairs, p4_all_pairs, p5_found, p5_pairs, p6_found, p7_ids, p7_texts, p8_mix, p8_mix_characters, p8_report, p8_report_characters, p9_found, p9_classes, p9_forms)
    return {f.__name__: f for f in all_}


_SPELLING = "^[^A-Za-z0-9]*([A-Za-z]+)[^A-Za-z0-9]*([0-9]+)"


def _name(token: str) -> str:
    return f"CASE WHEN regexp_matches({token}, '{_SPELLING}') THEN upper(regexp_extract({token}, '{_SPELLING}', 1)) || '_' || CAST(CAST(regexp_extract({token}, '{_SPELLING}', 2) AS BIGINT) AS VARCHAR) END"


_EVENTS = f"""ev AS (SELECT seq_id, pos, name, ts FROM (SELECT *, row_number() OVER (PARTITION BY seq_id, pos ORDER BY name IS NULL, arrived_at, ts NULLS FIRST) AS r
FROM (SELECT seq_id, pos, ts, arrived_at, {_name('token')} AS name FROM ptb)) WHERE r = 1)"""
_LINKS = "ln AS (SELECT DISTINCT l.link_id, e.name FROM linkset l JOIN ev e ON e.seq_id = l.seq_id AND e.pos = l.pos WHERE e.name IS NOT NULL)"
_RUNS = f"""WITH {_EVENTS},
marked AS (SELECT *, CASE WHEN name IS NOT NULL AND name = lag(name) OVER (PARTITION BY seq_id ORDER BY pos) THEN 0 ELSE 1 END AS starts FROM ev),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY seq_id ORDER BY pos) AS run FROM marked),
found AS (SELECT seq_id, name, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n_events, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration_s FROM numbered WHERE name IS NOT NULL GROUP BY seq_id, name, run HAVING count(*) >= 2)
"""
_COUNTS = f"""WITH {_EVENTS},
c AS (SELECT name, count(*) AS n_events, count(DISTINCT seq_id) AS n_sequences FROM ev WHERE name IS NOT NULL GROUP BY name),
t AS (SELECT v.token, coalesce(n_events, 0) AS n_events, coalesce(n_sequences, 0) AS n_sequences FROM (SELECT DISTINCT token FROM vocabulary WHERE token IS NOT NULL) v LEFT JOIN c ON c.name = v.token),
found AS (SELECT token, n_events, n_sequences, CASE WHEN n_sequences < 3 THEN 'rare' WHEN n_sequences > 0.5 * (SELECT count(DISTINCT seq_id) FROM ptb) THEN 'common' END AS mark FROM t)
"""
_PAIRS = f"""WITH {_EVENTS}, {_LINKS},
n AS (SELECT count(DISTINCT link_id) AS n FROM ln),
one AS (SELECT name, count(*) AS n FROM ln GROUP BY name),
two AS (SELECT a.name AS token_a, b.name AS token_b, count(*) AS n_ab FROM ln a JOIN ln b ON a.link_id = b.link_id AND a.name < b.name GROUP BY a.name, b.name)
"""
_FORMS = f"""fn AS (SELECT DISTINCT type_name, name FROM (SELECT type_name, {_name('token')} AS name FROM (SELECT type_name, unnest(tokens) AS token FROM type_forms WHERE type_name IS NOT NULL)) WHERE name IS NOT NULL)"""

_SOURCE = r"nullif(regexp_replace(lower(trim(regexp_replace(source, '[\s\x{00a0}]+', ' ', 'g'))), '[\s\-]+', '_', 'g'), '')"
_MIX = f"""WITH t AS (SELECT source, any_value(target_share) AS share, any_value(max_repeats) AS r FROM (SELECT {_SOURCE} AS source, target_share, coalesce(max_repeats, 1) AS max_repeats FROM source_targets) GROUP BY source),
d AS (SELECT doc_id, source, tokens, share, r FROM (SELECT doc_id, {_SOURCE} AS source, length(text) AS tokens FROM documents) JOIN t USING (source) WHERE tokens > 0 AND share > 0 AND r > 0),
h AS (SELECT source, sum(tokens) AS held, sum(tokens) * any_value(r) / any_value(share) AS room, any_value(share) AS share FROM d GROUP BY source),
b AS (SELECT floor(round(min(room) * sum(share), 6)) AS budget, min(room) AS least FROM h),
q AS (SELECT source, CAST(copy AS INTEGER) AS copy, doc_id, tokens, share, CAST('0x' || substr(md5(concat_ws('|', '42', doc_id, source)), 1, 15) AS BIGINT) AS shuffled FROM d, unnest(range(1, r + 1)) AS u(copy)),
f AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY source ORDER BY copy, shuffled, doc_id) AS DOUBLE) / share AS finish FROM q),
p AS (SELECT *, CAST(sum(tokens) OVER (ORDER BY finish, source, doc_id, copy) AS BIGINT) AS position_tokens FROM f),
m AS (SELECT doc_id, source, copy, tokens, finish, position_tokens FROM p, b WHERE position_tokens <= budget)
"""
_REPORT = """own AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS taken, count(*) FILTER (copy = 1) AS documents, coalesce(sum(tokens) FILTER (copy = 1), 0) AS once FROM m GROUP BY source)
SELECT source, t.share AS target_share, coalesce(own.tokens, 0) / CAST(greatest((SELECT sum(tokens) FROM m), 1) AS DOUBLE) AS actual_share, coalesce(own.tokens, 0) AS tokens, coalesce(taken, 0) AS taken, coalesce(documents, 0) AS documents,
CAST(coalesce(held, 0) - coalesce(once, 0) AS BIGINT) AS unused, coalesce(room = least, false) AS binds FROM t LEFT JOIN own USING (source) LEFT JOIN h USING (source), b"""


def oracle_sql() -> dict[str, str]:
    overlap_sql = f"""WITH {_EVENTS}, {_LINKS}, {_FORMS},
x AS (SELECT link_id, count(*) AS x FROM ln GROUP BY link_id), y AS (SELECT type_name, count(*) AS y FROM fn GROUP BY type_name),
s AS (SELECT link_id, type_name, count(*) AS shared FROM ln JOIN fn USING (name) GROUP BY link_id, type_name)
"""
    pair = "FROM two JOIN one a ON a.name = token_a JOIN one b ON b.name = token_b, n WHERE n_ab >= 5 AND n_ab * 1000 >= n.n AND n_ab * n.n >= 4 * a.n * b.n"
    return {
        "p1_found": _RUNS + "SELECT seq_id, first_pos, last_pos FROM found",
        "p1_runs": _RUNS + "SELECT seq_id, name, first_pos, last_pos, n_events, duration_s FROM found",
        "p4_pairs": _PAIRS + f"SELECT token_a, token_b, a.n AS n_a, b.n AS n_b, n_ab, round(CAST(n_ab * n.n AS DOUBLE) / (a.n * b.n), 9) AS lift, round(log2(CAST(n_ab * n.n AS DOUBLE) / (a.n * b.n)), 9) AS pmi {pair}",
        "p5_pairs": overlap_sql + "SELECT link_id, type_name, CAST(shared AS DOUBLE) / (x + y - shared) AS similarity FROM s JOIN x USING (link_id) JOIN y USING (type_name) WHERE 5 * shared >= 3 * (x + y - shared)",
        "p3_found": _COUNTS + "SELECT token, mark FROM found WHERE mark IS NOT NULL",
        "p3_counts": _COUNTS + "SELECT token, n_events, n_sequences, mark FROM found",
        "p4_all_pairs": _PAIRS + f"SELECT token_a, token_b, a.n AS n_a, b.n AS n_b, n_ab, round(CAST(n_ab * n.n AS DOUBLE) / (a.n * b.n), 9) AS lift, round(log2(CAST(n_ab * n.n AS DOUBLE) / (a.n * b.n)), 9) AS pmi {pair.partition(' WHERE ')[0]}",
        "p4_found": _PAIRS + f"SELECT token_a, token_b {pair}",
        "p5_found": overlap_sql + "SELECT link_id, type_name FROM s JOIN x USING (link_id) JOIN y USING (type_name) WHERE 5 * shared >= 3 * (x + y - shared)",
        "p7_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p8_mix_characters": _MIX + "SELECT * FROM m",
        "p8_report_characters": _MIX.rstrip() + ",\n" + _REPORT,
        "p6_found": """WITH RECURSIVE e AS (SELECT DISTINCT seq_id, a, b FROM (SELECT seq_id, one AS a, two AS b FROM edges UNION ALL SELECT seq_id, two, one FROM edges) WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
reach(seq_id, pos, g) AS (SELECT DISTINCT seq_id, a, a FROM e UNION SELECT e.seq_id, e.b, r.g FROM reach r JOIN e ON e.seq_id = r.seq_id AND e.a = r.pos WHERE r.g < e.b)
SELECT seq_id, min(g) AS group_pos, pos FROM reach GROUP BY seq_id, pos""",
    }
