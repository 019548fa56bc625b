"""Readers of text formats, each one scan that splits by records."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Header aliases of metadata tables.
ALIASES = {"Entry": "accession", "Entry Name": "id", "Protein names": "protein_name", "Gene Names": "gene_names", "Organism": "organism_name", "Organism (ID)": "organism_id", "Length": "length", "Sequence": "sequence"}


def fasta(spark: SparkSession, path: str, key: str = "pipe") -> DataFrame:
    """accession, header, seq of each record.

    key: which part of the header names the record. pipe: the second of several fields between pipes, else the first word;
    first: up to the first pipe or blank; second: the second pipe field, else the first word; word: the first word.
    """
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("v")).where(F.trim("v") != "")
    parts = F.split("v", "\r?\n", 2)
    header, word = F.trim(parts[0]), F.split(F.trim(parts[0]), r"\s+")[0]
    pipe = F.split(word, r"\|")
    name = {"pipe": F.when(F.size(pipe) >= 2, pipe[1]).otherwise(word), "second": F.when(F.size(pipe) >= 2, pipe[1]).otherwise(word), "first": pipe[0], "word": word}[key]
    return rows.select(name.alias("accession"), header.alias("header"), F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s+", "").alias("seq"))


def inline(df: DataFrame, text: str = "text") -> DataFrame:
    """Pasted FASTA or bare residues as header, seq."""
    parts = F.split(F.trim(text), "\n", 2)
    marked = F.trim(F.col(text)).startswith(">")
    header = F.when(marked, F.trim(F.regexp_replace(parts[0], "^>", ""))).otherwise("Input_Sequence")
    body = F.when(marked, F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).otherwise(F.col(text))
    return df.select(header.alias("header"), F.upper(F.regexp_replace(body, r"\s+", "")).alias("seq"))


def tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated text, unquoted: all strings, missing fields empty, aliases resolved."""
    df = spark.read.csv(path, sep="\t", header=True, quote="", inferSchema=False)
    return df.select(*(F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(ALIASES.get(c, c)) for c in df.columns))


def csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",") -> DataFrame:
    """Comma-separated text with a header; rows of blanks are dropped."""
    df = spark.read.csv(path, sep=sep, header=True, schema=schema, inferSchema=schema is None)
    return df.where(F.concat_ws("", *(F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in df.columns)) != "")


HIT_FIELDS = 23


def hits(spark: SparkSession, path: str | list[str], evalue: float | None = None) -> DataFrame:
    """Domain hits: uniprot_id, pfam_id, pfam_name, env_from, env_to, domain_length, evalue, bitscore, hit_pos (the line's order within its file)."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("hit_pos"))
    f = F.split(F.trim("value"), r"\s+", HIT_FIELDS)
    rows = lines.where(~F.col("value").startswith("#") & (F.size(f) >= HIT_FIELDS)).select(
        f[0].alias("uniprot_id"), F.substring_index(f[4], ".", 1).alias("pfam_id"), f[3].alias("pfam_name"), f[19].cast("int").alias("env_from"), f[20].cast("int").alias("env_to"),
        (f[20].cast("int") - f[19].cast("int") + 1).alias("domain_length"), f[12].cast("double").alias("evalue"), f[13].cast("double").alias("bitscore"), "hit_pos",
    )
    return rows if evalue is None else rows.where(F.col("evalue") <= evalue)


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """Cluster listings: cluster_id, member, length, is_rep, identity (percent; null for the representative)."""
    blocks = spark.read.option("lineSep", "\n>Cluster ").text(path).select(F.regexp_replace("value", "^>Cluster ", "").alias("v")).where(F.trim("v") != "")
    rows = blocks.select(F.split("v", "\n", 2)[0].cast("int").alias("cluster_id"), F.explode(F.split(F.get(F.split("v", "\n", 2), F.lit(1)), "\n")).alias("line")).where("trim(line) <> ''")
    return rows.select(
        "cluster_id", F.regexp_extract("line", r">(.+?)\.\.\.", 1).alias("member"), F.regexp_extract("line", r"(\d+)(aa|nt)", 1).cast("int").alias("length"),
        F.rtrim(F.col("line")).endswith("*").alias("is_rep"), F.expr("try_cast(regexp_extract(line, 'at (?:[+-]/)?([0-9.]+)%', 1) as double)").alias("identity"),
    )


def ids(spark: SparkSession, path: str, allow_empty: bool = False) -> DataFrame:
    """Distinct non-blank lines; an empty list is an error unless allowed."""
    out = spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''").distinct()
    if not allow_empty and out.isEmpty():
        raise ValueError(f"{path} holds no ids")
    return out


def json_document(spark: SparkSession, path: str) -> DataFrame | None:
    """A whole JSON file as a row, or None if there is none."""
    return spark.read.json(path, multiLine=True) if exists(spark, path) else None


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def profile_version(spark: SparkSession, path: str) -> DataFrame:
    """The accession on the first ACC line of a profile file."""
    rows = spark.read.text(path).where(F.col("value").startswith("ACC")).select(F.monotonically_increasing_id().alias("n"), F.get(F.split("value", r"\s+"), F.lit(1)).alias("version"))
    return rows.agg(F.min_by("version", "n").alias("version"))


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, size_bytes, sha256 of files below a folder; contents are hashed where they are read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return rows.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def matrix(spark: SparkSession, path: str, id_list: list[str] | None = None) -> DataFrame:
    """.npy matrices as rows: path, row, embedding; an executor reads a file, whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                x = np.load(io.BytesIO(content), allow_pickle=False).astype(np.float32)
                for lo in range(0, len(x), 4096):
                    part = x[lo : lo + 4096]
                    lists = pa.ListArray.from_arrays(np.arange(0, part.size + 1, part.shape[1], dtype=np.int32), part.ravel())
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(lo, lo + len(part))), lists], names=["path", "row", "embedding"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, row long, embedding array<float>")
