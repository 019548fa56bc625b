"""Writers. All refuse to overwrite unless mode says otherwise."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import wrapped

REFUSE = "errorifexists"


def fasta(df: DataFrame, path: str, order: list[str] | None = None, width: int = 60, mode: str = REFUSE) -> None:
    """accession (or header) and seq as FASTA, in the given order."""
    df = df.orderBy(*order) if order else df
    name = F.coalesce("header", "accession") if "header" in df.columns else F.col("accession")
    df.select(F.concat(F.lit(">"), name, F.lit("\n"), wrapped(F.col("seq"), width)).alias("value")).write.mode(mode).text(path)


def domain_fasta(df: DataFrame, path: str, mode: str = REFUSE) -> None:
    """uniprot_id, pfam_id, env_from, env_to, seq under headers of id|family|from-to."""
    header = F.concat_ws("|", "uniprot_id", "pfam_id", F.concat_ws("-", "env_from", "env_to"))
    fasta(df.select(header.alias("accession"), "seq"), path, ["accession"], mode=mode)


def tsv(df: DataFrame, path: str, order: list[str] | None = None, sep: str = "\t", mode: str = REFUSE) -> None:
    (df.orderBy(*order) if order else df).write.mode(mode).csv(path, sep=sep, header=True, emptyValue="")


def ids(df: DataFrame, path: str, mode: str = REFUSE) -> None:
    df.select(F.col(df.columns[0]).cast("string").alias("value")).where("value is not null").distinct().orderBy("value").write.mode(mode).text(path)


def registry(df: DataFrame, path: str, mode: str = REFUSE) -> None:
    """Long registry rows by run, section and key as Parquet."""
    df.write.mode(mode).partitionBy(*[c for c in ("run_id",) if c in df.columns]).parquet(path)


def report(df: DataFrame, path: str, mode: str = REFUSE) -> None:
    """Each row as one JSON object."""
    df.write.mode(mode).json(path)


def hash_manifest(df: DataFrame, path: str, mode: str = REFUSE) -> None:
    """sha256, two blanks, path - one line for each file."""
    df.orderBy("path").select(F.concat_ws("  ", "sha256", "path").alias("value")).write.mode(mode).text(path)


def merged_hits(parts: list[DataFrame], path: str, mode: str = REFUSE) -> None:
    """Raw hit lines of several files together, without comment lines."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out.where(~F.col("value").startswith("#")).select("value").write.mode(mode).text(path)


def matrix(df: DataFrame, path: str) -> int:
    """The vectors of a table's one column as .npy files, one for each partition that has rows; returns how many.

    Executors write straight to the folder, so it has to be a mounted one that all of them share.
    """
    folder, name = path.removeprefix("file:"), df.columns[0]
    if "://" in folder:
        raise ValueError(f"{path} is not a mounted folder")
    if os.path.exists(folder):
        raise FileExistsError(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.asarray(b.column(0).flatten().to_numpy(zero_copy_only=False), dtype=np.float32).reshape(b.num_rows, -1) for b in batches if b.num_rows]
        if parts:
            os.makedirs(folder, exist_ok=True)
            hidden = f"{folder}/.{uuid.uuid4().hex}"  # a task that is run again leaves no half file behind
            with open(hidden, "wb") as f:
                np.save(f, np.concatenate(parts), allow_pickle=False)
            os.replace(hidden, f"{folder}/{TaskContext.get().partitionId():06d}.npy")
            yield pa.RecordBatch.from_arrays([pa.array([1])], names=["n"])

    return df.select(F.col(f"`{name}`").cast("array<float>")).mapInArrow(run, "n long").count()
