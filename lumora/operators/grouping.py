"""Greedy identity clustering and statistics of clusters."""

from __future__ import annotations

import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StructField, StructType

from ..storage import stored

BLOCK = 256  # sequences a block; a task compares two blocks


def common_length(a: str, b: str) -> int:
    """The length of the longest common subsequence, a row of bits for each residue of b."""
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & where.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def identity(a: str, b: str) -> Column:
    """Aligned identical residues over the shorter length, of two columns."""

    @pandas_udf(DoubleType())
    def share(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([common_length(p, q) / min(len(p), len(q)) if p and q else 0.0 for p, q in zip(x, y, strict=True)])

    return share(a, b)


def _all_pairs(s: DataFrame, least: float) -> DataFrame:
    """similar() of all pairs: sequences are dealt to blocks, and each pair of blocks is compared where it meets."""
    s = s.where("id is not null")
    kind, blocks = s.schema["id"].dataType, max(1, math.ceil(s.count() / BLOCK))
    dealt = s.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("other")
    dealt = dealt.select("id", "seq", "n", "block", other).select("id", "seq", "n", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))

    def compare(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*(t[c].to_pylist() for c in ("n", "id", "seq", "block")), strict=True), key=lambda r: (-r[0], r[1]))
        x, y = t["x"][0].as_py(), t["y"][0].as_py()
        out = []
        for i, (_, a, p, block) in enumerate(rows):
            for m, b, q, other in rows[i + 1 :]:
                # a block is with itself in one pair of blocks only
                if (x == y or block != other) and (m, b) != (len(p), a) and common_length(p, q) / m >= least:
                    out.append((a, b))
        return pa.table({c: pa.array([r[k] for r in out], t.schema.field("id").type) for k, c in enumerate("ab")})

    return dealt.groupBy("x", "y").applyInArrow(compare, StructType([StructField("a", kind), StructField("b", kind)]))


def similar(seqs: DataFrame, least: float, word: int | None = None) -> DataFrame:
    """(a, b) with a before b (longer first, then by id): pairs that are identical in least of the shorter; with word, only those that share one of its length."""
    s = seqs.select("id", "seq", F.length("seq").alias("n")).where("n > 0")
    if word is None:
        return _all_pairs(s, least)
    words = s.select("id", "n", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.col("n") - word + 1, F.lit(1))), lambda i: F.substring("seq", i, F.lit(word))))).alias("w"))
    other = words.select(F.col("id").alias("b"), F.col("n").alias("m"), "w")
    pairs = words.withColumnRenamed("id", "a").join(other, "w").where((F.col("n") > F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("a") < F.col("b")))).select("a", "b").distinct()
    text = lambda x: s.select(F.col("id").alias(x), F.col("seq").alias(f"s{x}"))
    return pairs.join(text("a"), "a").join(text("b"), "b").where(identity("sa", "sb") >= least).select("a", "b")


def greedy(seqs: DataFrame, least: float, word: int | None = None) -> DataFrame:
    """id, representative, is_rep: longest first, a sequence joins the first representative it is similar to, else it becomes one.

    Rounds decide all that can be decided: a sequence whose earlier neighbours are all members becomes a representative, one
    with an earlier representative a member; when none is left, each member takes its first representative.
    """
    edges = stored(similar(seqs, least, word))
    nodes = stored(seqs.select("id", F.length("seq").alias("n"), F.lit(None).cast("string").alias("state")))
    while True:
        waiting = edges.join(nodes.select(F.col("id").alias("a"), F.col("state").alias("sa")), "a").groupBy(F.col("b").alias("id")).agg(
            F.max(F.when(F.col("sa") == "rep", 1).otherwise(0)).alias("near_rep"), F.max(F.when(F.col("sa").isNull(), 1).otherwise(0)).alias("open")
        )
        state = F.when(F.col("state").isNotNull(), F.col("state")).when(F.col("near_rep") == 1, "member").when(F.coalesce("open", F.lit(0)) == 0, "rep")
        nodes = stored(nodes.join(waiting, "id", "left").select("id", "n", state.alias("state")))
        if nodes.where("state is null").isEmpty():
            break
    reps = nodes.where("state = 'rep'").select(F.col("id").alias("a"), "n")
    first = edges.join(reps, "a").groupBy(F.col("b").alias("id")).agg(F.min(F.struct((-F.col("n")).alias("o"), "a")).alias("f"))
    out = nodes.join(first, "id", "left")
    return out.select("id", F.when(F.col("state") == "rep", F.col("id")).otherwise(F.col("f.a")).alias("representative"), (F.col("state") == "rep").alias("is_rep"))


def cluster_stats(members: DataFrame, cluster: str) -> DataFrame:
    """One row: clusters, members, least, most and mean size, singletons."""
    s = members.groupBy(cluster).agg(F.count("*").alias("n"))
    return s.agg(F.count("*").alias("clusters"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("members"), F.min("n").alias("smallest"), F.max("n").alias("largest"), F.round(F.avg("n"), 6).alias("mean_size"), F.count(F.when(F.col("n") == 1, 1)).alias("singletons"))


def size_histogram(members: DataFrame, cluster: str, top: int = 10) -> DataFrame:
    """size ('1' to top, then 'top+1 and more'), clusters."""
    s = members.groupBy(cluster).agg(F.count("*").alias("n"))
    return s.groupBy(F.when(F.col("n") > top, f"{top + 1}+").otherwise(F.col("n").cast("string")).alias("size")).agg(F.count("*").alias("clusters"))


def leakage(assigned: DataFrame, cluster: str, side: str) -> DataFrame:
    """cluster, sides of clusters that lie on more than one side of a split."""
    return assigned.groupBy(cluster).agg(F.countDistinct(side).alias("sides")).where("sides > 1")
