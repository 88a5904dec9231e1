"""The line formats: sequences of whitespace-separated tokens, linksets, link types, type forms, matrices.

What the published pipeline keeps in one line (sequences, vocabulary, thresholds) is written as one line, everything in one
file, or with ``one_file=False`` as a folder of parts whose names sort as their contents. Parts are written by all tasks and
then streamed into the file, so neither a task nor the driver holds more than a buffer; a one-line file is read in splits.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqweave.operators.sequence import concatenated, token_sequence
from seqweave.session import partitions, write_table

#: The files of a sequence in the order they are read.
SPLITS = ("train", "valid", "test")


def _numbered(spark: SparkSession, path: str, sep: str = "\n") -> DataFrame:
    """``line_no, value``: the lines of text files in order. Lines keep their order within a file split, splits theirs within the file."""
    rows = spark.read.option("lineSep", sep).text(path).select("value", F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    placed = write_table(rows, "lines").df
    sizes = placed.groupBy("f", "b").agg(F.min("i").alias("start"), F.count("*").alias("n"))
    before = Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)  # one row per file split
    offsets = sizes.select("f", "b", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return placed.join(offsets, ["f", "b"]).select((F.col("i") - F.col("start") + F.col("offset")).alias("line_no"), "value")


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    """All tokens of a file, whatever whitespace parts them. It is split at blanks: a sequence is one long line."""
    lines = _numbered(spark, path, " ")
    each = lines.select("line_no", F.posexplode(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")).alias("at", "token"))
    return token_sequence(each.where("token <> ''").withColumn("seq_id", F.lit(0)), "seq_id", ["line_no", "at"], "token")


def read_sequence(spark: SparkSession, folder: str, stem: str = "ptb") -> DataFrame:
    """``seq_id, pos, token`` (one sequence, 0) of ``stem.train.txt``, ``stem.valid.txt``, ``stem.test.txt``, one after the other."""
    return concatenated(*(_tokens(spark, f"{folder}/{stem}.{s}.txt") for s in SPLITS))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``token, token_id``: ids in the order of the file."""
    return _tokens(spark, path).select("token", F.col("pos").alias("token_id"))


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """``token_id, threshold``, by place."""
    return read_vocabulary(spark, path).select("token_id", F.col("token").cast("double").alias("threshold"))


def read_matrix(spark: SparkSession, path: str, k: int) -> DataFrame:
    """``k, pos, p``: one row of numbers per line."""
    lines = _numbered(spark, path).where(F.length(F.trim("value")) > 0)
    return lines.select(F.lit(k).alias("k"), F.col("line_no").alias("pos"), F.split(F.trim("value"), r"\s+").cast("array<double>").alias("p"))


def read_linkset(spark: SparkSession, path: str) -> DataFrame:
    """``seq_id, link_id, pos``: a link per line, named by the line among the lines that aren't blank."""
    lines = token_sequence(_numbered(spark, path).where(F.length(F.trim("value")) > 0).withColumn("seq_id", F.lit(0)), "seq_id", ["line_no"], "value")
    return lines.select("seq_id", F.col("pos").alias("link_id"), F.explode(F.split(F.trim("token"), r"\s+").cast("array<bigint>")).alias("pos"))


def read_link_types(spark: SparkSession, path: str) -> DataFrame:
    """``seq_id, link_id, type_name``: the name on the line of each link."""
    return _numbered(spark, path).select(F.lit(0).cast("long").alias("seq_id"), F.col("line_no").alias("link_id"), F.trim("value").alias("type_name"))


def read_type_forms(spark: SparkSession, path: str) -> DataFrame:
    """``type_name, tokens`` from lines ``name: token token``; blank lines are skipped, a second colon is an error."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    parts = F.split("value", ":")
    name = F.when(F.size(parts) == 2, F.trim(parts[0])).otherwise(F.raise_error(F.concat(F.lit("not a type form: "), "value")))
    return lines.select(name.alias("type_name"), F.filter(F.split(F.trim(parts[1]), r"\s+"), lambda t: t != "").alias("tokens"))


def _write(rows: DataFrame, order: list[str], value: Column, path: str, one_file: bool, sep: str = "\n") -> None:
    """Writes values in order, each ended by ``sep``."""
    spark = rows.sparkSession
    to = f"{path}.parts-{uuid.uuid4().hex}" if one_file else path
    ranged = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    ranged.select(value.alias("value")).write.mode("overwrite").option("lineSep", sep).text(to)
    if one_file:
        _joined(spark, to, path)


def _joined(spark: SparkSession, parts: str, path: str) -> None:
    """Streams the parts of a folder, in the order of their names, into one file, and removes the folder."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop
    folder = hadoop.fs.Path(parts)
    fs = folder.getFileSystem(conf)
    out = fs.create(hadoop.fs.Path(path), True)
    try:
        for part in sorted((s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName()):
            source = fs.open(part)
            hadoop.io.IOUtils.copyBytes(source, out, conf, False)
            source.close()
    finally:
        out.close()
    fs.delete(folder, True)


def write_sequence(sequence: DataFrame, path: str, one_file: bool = True) -> None:
    """One sequence as one line of tokens (of several, one after the other); null tokens are left out."""
    _write(sequence.where("token is not null"), ["seq_id", "pos"], F.col("token"), path, one_file, " ")


def write_splits(split_sequence: DataFrame, folder: str, stem: str = "ptb", one_file: bool = True) -> None:
    """The three parts of a split sequence."""
    for s in SPLITS:
        write_sequence(split_sequence.where(F.col("split") == s), f"{folder}/{stem}.{s}.txt", one_file)


def write_vocabulary(vocab: DataFrame, path: str, one_file: bool = True) -> None:
    """One line of tokens in the order of their ids."""
    _write(vocab, ["token_id"], F.col("token"), path, one_file, " ")


def write_thresholds(thresholds: DataFrame, path: str, one_file: bool = True) -> None:
    """``token_id, threshold`` as one line of numbers in the order of ids."""
    _write(thresholds, ["token_id"], F.col("threshold").cast("string"), path, one_file, " ")


def write_matrix(rows: DataFrame, path: str, one_file: bool = True) -> None:
    """``pos, p`` as one line of numbers per row: probabilities or deltas of one offset."""
    _write(rows, ["pos"], F.concat_ws(" ", F.col("p").cast("array<string>")), path, one_file)


def write_linkset(linkset: DataFrame, path: str, one_file: bool = True) -> None:
    """One line of positions per link, in the order of link ids."""
    lines = linkset.groupBy("link_id").agg(F.sort_array(F.collect_set("pos")).alias("o")).where(F.size("o") > 0)
    _write(lines, ["link_id"], F.concat_ws(" ", F.col("o").cast("array<string>")), path, one_file)


def write_link_types(types: DataFrame, path: str, one_file: bool = True) -> None:
    """One name per line, in the order of link ids; a null name is a blank line."""
    _write(types, ["link_id"], F.coalesce("type_name", F.lit("")), path, one_file)


def write_type_forms(forms: DataFrame, path: str, one_file: bool = True) -> None:
    """Lines ``name: token token``."""
    _write(forms, ["type_name"], F.concat("type_name", F.lit(": "), F.concat_ws(" ", "tokens")), path, one_file)
