"""From a sequence to a classified domain: all steps of a prediction as joins, with a status for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import motifs, scalars
from .curation import best

#: What the status says, in the order in which it is looked at.
INVALID, NO_DOMAIN, NO_EMBEDDING, OK = "invalid sequence", "no domain found", "no embedding", "ok"


def predict(seqs: DataFrame, hits: DataFrame, scored: DataFrame, neighbours: DataFrame, valid: Column, most: int = 3) -> DataFrame:
    """One row per sequence (id, seq); a row that can't be predicted says why in status, and has nulls for what is missing.

    hits: id, env_from, env_to, evalue, bitscore; the domain is that of the least evalue, then the largest bitscore, then
    the first envelope. scored: query_id, label, p by any model, of which the most likely are kept (ties by label).
    neighbours: query_id, rank, gallery_id. valid: whether a sequence can be read at all.
    """
    order = [F.asc("evalue"), F.desc("bitscore"), F.asc("env_from"), F.asc("env_to")]
    domain = best(hits.select("id", "env_from", "env_to", "evalue", "bitscore"), "id", order)
    # a row a class: bounded by the number of classes, and by k for neighbours
    top = scored.groupBy(F.col("query_id").alias("id")).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("m"), "label"))), 1, most).alias("top"))
    near = neighbours.groupBy(F.col("query_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "gallery_id"))), lambda x: x["gallery_id"]).alias("exemplars"))
    j = seqs.join(domain, "id", "left").join(top, "id", "left").join(near, "id", "left")
    status = F.when(~F.coalesce(valid, F.lit(False)), INVALID).when(F.col("env_from").isNull(), NO_DOMAIN).when(F.col("top").isNull(), NO_EMBEDDING).otherwise(OK)
    j = j.withColumn("status", status)
    good = lambda c: F.when(F.col("status") == OK, c)
    piece = scalars.envelope(F.col("seq"), F.col("env_from"), F.col("env_to"))
    flags = motifs.flags(piece)
    p = -F.col("top")[0]["m"]
    return j.select(
        "id", "status", good(piece).alias("domain"), good(F.col("top")[0]["label"]).alias("predicted"), good(p).alias("confidence"), good(scalars.confidence_flag(p)).alias("flag"),
        good(F.transform("top", lambda x: F.struct(x["label"].alias("label"), (-x["m"]).alias("p")))).alias("classes"), good(F.col("exemplars")).alias("exemplars"),
        good(sum((f.cast("long") for f in flags), F.lit(0).cast("long"))).alias("n_motifs"),
    )
