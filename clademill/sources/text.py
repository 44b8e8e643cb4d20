"""Text sources of an analysis: alignments, partitions, weights, exclusions, groups."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, seq) of FASTA files: Spark cuts the files at each '>' that begins a line, so that each record is a row, however long the file is."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^\s*>", "").alias("value"), F.col("_metadata.file_path").alias("file"))
    head = F.regexp_extract("value", r"^[^\r\n]*", 0)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", "")
    return records.where(F.trim("value") != "").select("file", F.trim(head).alias("name"), F.upper(body).alias("seq"))


def phylip(spark: SparkSession, path: str) -> DataFrame:
    """(file, taxon_id, name, seq) of relaxed PHYLIP files, sequential or interleaved: a file is one row, as its lines depend on one
    another; many files spread over tasks."""
    files = spark.read.text(path, wholetext=True).select(F.col("value"), F.col("_metadata.file_path").alias("file"))
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    first = F.split(F.trim(lines[0]), r"\s+")
    rows = files.select("file", first[0].cast("int").alias("n"), first[1].cast("int").alias("sites"), F.posexplode(F.filter(lines, lambda x, k: k > 0)).alias("p", "line"))
    rows = rows.withColumn("taxon_id", (F.col("p") % F.col("n") + 1).cast("int")).withColumn("turn", F.floor(F.col("p") / F.col("n")))
    name = F.regexp_extract(F.trim("line"), r"^\S+", 0)
    part = F.when(F.col("turn") == 0, F.regexp_replace(F.trim("line"), r"^\S+", "")).otherwise(F.col("line"))
    rows = rows.select("file", "sites", "taxon_id", "turn", F.when(F.col("turn") == 0, name).alias("name"), F.regexp_replace(part, r"\s", "").alias("part"))
    joined = rows.groupBy("file", "sites", "taxon_id").agg(F.max("name").alias("name"), F.sort_array(F.collect_list(F.struct("turn", "part"))).alias("ps"))
    seq = F.upper(F.array_join(F.transform("ps", lambda x: x["part"]), ""))
    checked = F.when(F.length(seq) == F.col("sites"), seq).otherwise(F.raise_error(F.concat(F.lit("sequence of the wrong length: "), "name")))
    return joined.select("file", "taxon_id", "name", checked.alias("seq"))


def partitions(spark: SparkSession, path: str) -> DataFrame:
    """(part_id, model, name, ranges) of lines 'MODEL, name = 1-100\\3, 200-300'; part_id by order of lines within files."""
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.monotonically_increasing_id().alias("at"))
    part = F.row_number().over(Window.orderBy("at")) - 1  # a partition file has a line per gene
    head = lines.select(
        part.alias("part_id"),
        F.trim(F.regexp_extract("value", r"^([^,]*),", 1)).alias("model"),
        F.trim(F.regexp_extract("value", r"^[^,]*,([^=]*)=", 1)).alias("name"),
        F.regexp_extract_all(F.regexp_extract("value", r"=(.*)$", 1), F.lit(r"(\d+\s*(?:-\s*\d+\s*(?:\\\s*\d+)?)?)"), 1).alias("r"),
    )
    number = lambda x, k: F.regexp_extract(x, r"^(\d+)\s*(?:-\s*(\d+)\s*)?(?:\\\s*(\d+))?", k)
    one = lambda x: F.struct(
        number(x, 1).cast("int").alias("lo"),
        F.when(number(x, 2) != "", number(x, 2)).otherwise(number(x, 1)).cast("int").alias("hi"),
        F.when(number(x, 3) != "", number(x, 3)).otherwise("1").cast("int").alias("stride"),
    )
    return head.select("part_id", "model", "name", F.transform("r", one).alias("ranges"))


def exclusions(spark: SparkSession, path: str) -> DataFrame:
    """(lo, hi) of ranges 'a-b' anywhere in the files."""
    found = spark.read.text(path).select(F.explode(F.regexp_extract_all("value", F.lit(r"(\d+\s*-\s*\d+)"), 1)).alias("r"))
    return found.select(F.regexp_extract("r", r"^(\d+)", 1).cast("int").alias("lo"), F.regexp_extract("r", r"(\d+)$", 1).cast("int").alias("hi"))


def site_weights(spark: SparkSession, path: str) -> DataFrame:
    """(site, weight): the numbers of a weight file in order."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.regexp_extract_all("value", F.lit(r"(\d+)"), 1)).alias("p", "w")).select((F.col("p") + 1).alias("site"), F.col("w").cast("int").alias("weight"))


def structure(spark: SparkSession, path: str) -> DataFrame:
    """(site, symbol) of a secondary-structure line."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"\s", "").alias("v"))
    return text.select(F.posexplode(F.split("v", "")).alias("p", "symbol")).where("symbol <> ''").select((F.col("p") + 1).alias("site"), "symbol")


def groups(spark: SparkSession, path: str) -> DataFrame:
    """(group_id, name) of a quartet grouping '(a,b),(c),(d),(e);'."""
    text = spark.read.text(path, wholetext=True)
    found = text.select(F.posexplode(F.regexp_extract_all("value", F.lit(r"\(([^()]*)\)"), 1)).alias("g", "names"))
    return found.select((F.col("g") + 1).alias("group_id"), F.explode(F.split("names", ",")).alias("name")).select("group_id", F.trim("name").alias("name"))


def names(text: str) -> list[str]:
    """An outgroup or candidate list: names between commas or white space."""
    return [n for n in re.split(r"[,\s]+", text) if n]
