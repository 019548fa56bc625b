"""Filters with audits, exact duplicates, labels and cohorts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UNKNOWN = "Unknown"
#: Label sources and their tags.
SOURCE_TAGS = {"original": "original", "protein_name_parsing": "name_regex", "subfamily_mapping": "mapping"}


def cascade(df: DataFrame, filters: Mapping[str, Column]) -> DataFrame:
    """df with first_filter: the first filter (name to removal condition) that removes a row, null for those that stay. One pass."""
    removed = F.coalesce(*(F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in filters.items()))
    return df.withColumn("first_filter", removed)


def cascade_audit(df: DataFrame, filters: Mapping[str, Column]) -> DataFrame:
    """step, filter, removed, remaining - filters that remove nothing included."""
    flagged = cascade(df, filters)
    names = list(filters)
    step = F.coalesce(*(F.when(F.col("first_filter") == n, i) for i, n in enumerate(names, 1)), F.lit(0))
    counts = flagged.agg(F.count("*").alias("total"), *(F.count(F.when(step == i, 1)).alias(f"r{i}") for i in range(1, len(names) + 1)))
    rows = F.array(*(F.struct(F.lit(i).alias("step"), F.lit(n).alias("filter"), F.col(f"r{i}").alias("removed"), (F.col("total") - sum((F.col(f"r{j}") for j in range(1, i + 1)), F.lit(0))).alias("remaining")) for i, n in enumerate(names, 1)))
    return counts.select(F.explode(rows).alias("x")).select("x.*")


def removed_samples(df: DataFrame, filters: Mapping[str, Column], key: str, most: int = 50) -> DataFrame:
    """filter, n, sample: the least keys that each filter removed, by a bounded merge rather than a collected list."""
    flagged = cascade(df, filters).where("first_filter is not null")
    ranked = flagged.withColumn("rank", F.row_number().over(W.partitionBy("first_filter").orderBy(key))).where(F.col("rank") <= most)
    sample = ranked.groupBy("first_filter").agg(F.sort_array(F.collect_list(key)).alias("sample"))
    return flagged.groupBy("first_filter").agg(F.count("*").alias("n")).join(sample, "first_filter").withColumnRenamed("first_filter", "filter")


def representatives(df: DataFrame, key: str, group: Column, order: Column | None = None) -> DataFrame:
    """group_key, representative, n: of equal rows the least key, or the first by order."""
    pick = F.min(key) if order is None else F.min_by(key, order)
    return df.groupBy(group.alias("group_key")).agg(pick.alias("representative"), F.count("*").alias("n"))


def duplicate_map(df: DataFrame, key: str, group: Column, order: Column | None = None) -> DataFrame:
    """duplicate, representative, group_key of rows that aren't representatives."""
    keyed = df.select(F.col(key).alias("duplicate"), group.alias("group_key"))
    reps = representatives(df, key, group, order).where("n > 1")
    return keyed.join(reps, "group_key").where("duplicate <> representative").select("duplicate", "representative", "group_key")


def dedup_report(df: DataFrame, key: str, group: Column) -> DataFrame:
    """One row: total, groups, singletons, duplicate groups, removed, largest (1 if no duplicates), retention."""
    sizes = representatives(df, key, group)
    return sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"), F.count("*").alias("unique_sequences"), F.count(F.when(F.col("n") == 1, 1)).alias("singletons"), F.count(F.when(F.col("n") > 1, 1)).alias("duplicate_groups"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("removed"), F.coalesce(F.max("n"), F.lit(1)).cast("long").alias("largest_group"), F.round(F.coalesce(F.try_divide(F.count("*") * 100.0, F.sum("n")), F.lit(0.0)), 6).alias("retention_pct"),
    )


def duplicate_sizes(df: DataFrame, key: str, group: Column) -> DataFrame:
    return representatives(df, key, group).where("n > 1").groupBy(F.col("n").alias("group_size")).agg(F.count("*").alias("groups"))


def assign_labels(df: DataFrame, label: str = "label", source: str = "label_source") -> DataFrame:
    """df with label_original, label_recovered, label_used and source_tag (null for a source that isn't known)."""
    recovered = F.col(source).isin("protein_name_parsing", "subfamily_mapping")
    tags = F.create_map(*(F.lit(x) for pair in SOURCE_TAGS.items() for x in pair))
    return df.withColumns(
        {
            "label_original": F.when(F.col(source) == "original", F.col(label)).otherwise("Other"),
            "label_recovered": F.when(recovered, F.col(label)).otherwise(""),
            "label_used": F.col(label),
            "source_tag": F.when(F.col(source).isNotNull(), F.try_element_at(tags, F.col(source))),
        }
    )


def label_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """label_column, label_value, n over several label columns in one pass."""
    both = F.explode(F.array(*(F.struct(F.lit(c).alias("label_column"), F.col(c).cast("string").alias("label_value")) for c in columns)))
    return df.select(both.alias("x")).groupBy("x.label_column", "x.label_value").agg(F.count("*").alias("n"))


def shares(df: DataFrame, by: str) -> DataFrame:
    """by, n, pct of the total."""
    counts = df.groupBy(by).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select(by, "n", F.round(F.col("n") * 100.0 / F.col("total"), 6).alias("pct"))


def with_label(df: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """df with its label, 'Unknown' where there is none."""
    return df.join(labels.select(key, F.col(label).cast("string").alias("label")), key, "left").withColumn("label", F.coalesce("label", F.lit(UNKNOWN)))


def cohort(df: DataFrame, label: str, excluded: list[str], least: int = 0) -> DataFrame:
    """Rows whose label isn't excluded and, if asked for, whose class has least rows."""
    kept = df.where(~F.coalesce(F.col(label).cast("string"), F.lit(UNKNOWN)).isin(excluded))
    if least > 0:
        kept = kept.join(kept.groupBy(label).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(label), label, "left_semi")
    return kept


def best(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key; ties go on along the order."""
    return df.withColumn("rank__", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("rank__ = 1").drop("rank__")


def group_split(groups: DataFrame, group: str, size: str, ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """groups with side: whole groups, in the order of a hash with the seed, go to test while those before hold less than ratio of all.

    The running sum is over one row for each group; it is taken within buckets of the hash and over the buckets' totals, so no
    task needs all groups.
    """
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string")))
    g = groups.select(group, F.col(size).alias("size__"), order.alias("order__")).withColumn("bucket__", F.substring("order__", 1, 2))
    totals = g.groupBy("bucket__").agg(F.sum("size__").alias("t"))  # 256 rows
    upto = W.orderBy("bucket__").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("bucket__", F.coalesce(F.sum("t").over(upto), F.lit(0)).alias("before_bucket"), F.sum("t").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("all__"))
    inside = W.partitionBy("bucket__").orderBy("order__", group).rowsBetween(W.unboundedPreceding, -1)
    g = g.withColumn("before__", F.coalesce(F.sum("size__").over(inside), F.lit(0))).join(F.broadcast(totals), "bucket__")
    side = F.when(F.col("before__") + F.col("before_bucket") < F.floor(F.col("all__") * ratio), "test").otherwise("train")
    return g.select(group, F.col("size__").alias(size), side.alias("side"))
