"""Set algebra as checks: rows of (check, passed, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check(df: DataFrame, name: str, passed: Column, message: Column) -> DataFrame:
    """df has one row."""
    return df.select(F.lit(name).alias("check"), passed.alias("passed"), message.alias("message"))


def all_of(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def split_counts(members: DataFrame, train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """One row of counts from one full join: members, train, test, in both, missing from both, beyond the members."""
    mark = lambda df, flag: df.select(key).distinct().withColumn(flag, F.lit(True))
    j = mark(members, "m").join(mark(train, "a"), key, "full").join(mark(test, "b"), key, "full")
    n = lambda cond: F.count(F.when(cond, 1))
    m, a, b = (F.coalesce(x, F.lit(False)) for x in ("m", "a", "b"))
    return j.agg(n(m).alias("n_members"), n(a).alias("n_train"), n(b).alias("n_test"), n(a & b).alias("n_overlap"), n(m & ~a & ~b).alias("n_missing"), n((a | b) & ~m).alias("n_extra"))


def split_integrity(members: DataFrame, train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    c = split_counts(members, train, test, key)
    say = lambda col: F.concat(F.lit(f"{col}="), F.col(col).cast("string"))
    checks = F.array(
        F.struct(F.lit("sizes_add_up").alias("check"), (F.col("n_train") + F.col("n_test") == F.col("n_members")).alias("passed"), F.concat_ws(" ", say("n_train"), say("n_test"), say("n_members")).alias("message")),
        F.struct(F.lit("disjoint").alias("check"), (F.col("n_overlap") == 0).alias("passed"), say("n_overlap").alias("message")),
        F.struct(F.lit("covers").alias("check"), ((F.col("n_missing") == 0) & (F.col("n_extra") == 0)).alias("passed"), F.concat_ws(" ", say("n_missing"), say("n_extra")).alias("message")),
    )
    return c.select(F.explode(checks).alias("c")).select("c.*")


def subset(small: DataFrame, large: DataFrame | None, key: str, name: str) -> DataFrame:
    """Whether small's keys are all in large; if large isn't there the check passes with a warning."""
    if large is None:
        return check(small.sparkSession.range(1), name, F.lit(True), F.lit("skipped: nothing to compare with"))
    n = small.select(key).distinct().join(large.select(key), key, "left_anti").agg(F.count("*").alias("n"))
    return check(n, name, F.col("n") == 0, F.concat(F.lit("missing="), F.col("n").cast("string")))


def same_hashes(expected: DataFrame, found: DataFrame) -> DataFrame:
    """path, status: match, mismatch, absent or unlisted."""
    j = expected.select("path", F.col("sha256").alias("want")).join(found.select("path", F.col("sha256").alias("have")), "path", "full")
    return j.select("path", F.when(F.col("have").isNull(), "absent").when(F.col("want").isNull(), "unlisted").when(F.col("want") == F.col("have"), "match").otherwise("mismatch").alias("status"))


def required(names: list[str], listing: DataFrame) -> DataFrame:
    """name, present of the names that must be in a listing (column name)."""
    want = listing.sparkSession.sql("SELECT explode(array(" + ", ".join(f"'{n}'" for n in names) + ")) AS name")
    have = listing.select("name").distinct().withColumn("present", F.lit(True))
    return want.join(have, "name", "left").select("name", F.coalesce("present", F.lit(False)).alias("present"))


def agree(left: DataFrame, right: DataFrame, keys: list[str], value: str, tolerance: float = 0.0) -> DataFrame:
    """keys, expected, found, passed: whether two tables of numbers say the same; a number that one side lacks does not pass."""
    j = left.select(*keys, F.col(value).alias("expected")).join(right.select(*keys, F.col(value).alias("found")), keys, "full")
    return j.withColumn("passed", F.coalesce(F.abs(F.col("expected") - F.col("found")) <= tolerance, F.lit(False)))


def checklist(numbers: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Rules (name: SQL over n, a map of section.key to value) on a registry of section, key, value; a number that isn't there fails its rules."""
    n = numbers.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(".", "section", "key"), "value"))).alias("n"))  # a registry is small
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("check"), F.coalesce(F.expr(rule), F.lit(False)).alias("passed"), F.lit(rule).alias("message")) for name, rule in rules.items())))
    return n.select(each.alias("c")).select("c.*")


def tracked(asked: DataFrame, needed: dict[str, DataFrame], key: str) -> DataFrame:
    """key, status of all that is asked for: used, or the first of the tables (name: keys) that lacks it."""
    out = asked.select(key).distinct()
    for i, df in enumerate(needed.values()):
        out = out.join(df.select(key).distinct().withColumn(f"has_{i}", F.lit(True)), key, "left")
    status = F.coalesce(*(F.when(F.col(f"has_{i}").isNull(), name) for i, name in enumerate(needed)), F.lit("used"))
    return out.select(key, status.alias("status"))


def embedding_sets(rows: DataFrame, base: str) -> DataFrame:
    """config, n, dims, with_nan, same_ids: what sets of vectors (config, id, embedding) hold, and whether each has the ids of the one called base."""
    e = F.col("embedding")
    stats = rows.groupBy("config").agg(F.count("*").alias("n"), F.countDistinct(F.size(e)).alias("dims"), F.count(F.when(F.exists(e, lambda x: F.isnan(x)), 1)).alias("with_nan"))
    ids = rows.select("config", "id").distinct()
    configs = F.broadcast(rows.select("config").distinct())  # a handful
    both = ids.where(F.col("config") == base).select("id").join(configs).withColumn("b", F.lit(True)).join(ids.withColumn("a", F.lit(True)), ["config", "id"], "full")
    return stats.join(both.groupBy("config").agg(F.bool_and(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("same_ids")), "config")


def manifest_checks(members: DataFrame, key: str) -> DataFrame:
    """Whether a list of ids holds any, and each once."""
    n = members.agg(F.count("*").alias("n"), F.countDistinct(key).alias("d"))
    say = lambda name, col: F.concat(F.lit(f"{name}="), F.col(col).cast("string"))
    return check(n, "not_empty", F.col("n") > 0, say("n", "n")).unionByName(check(n, "unique", F.col("n") == F.col("d"), F.concat_ws(" ", say("n", "n"), say("distinct", "d"))))


def verify_package(hashes: tuple, counts: tuple, split: tuple, tables: tuple, orphans: tuple) -> DataFrame:
    """Five checks of a package: file hashes, numbers of rows, the split, a table against its stored numbers, orphans."""
    differ = lambda n: F.concat(F.lit("differ="), F.col(n).cast("string"))
    bad = same_hashes(*hashes).where("status <> 'match'").agg(F.count("*").alias("n"))
    sizes = counts[0].agg(F.count("*").alias("a")).crossJoin(F.broadcast(counts[1].agg(F.count("*").alias("b"))))  # one row each
    c = split_counts(*split)
    say = F.concat_ws(" ", *(F.concat(F.lit(f"{x}="), F.col(x).cast("string")) for x in ("n_overlap", "n_missing", "n_extra")))
    wrong = agree(*tables).where(~F.col("passed")).agg(F.count("*").alias("n"))
    return all_of(
        [
            check(bad, "hashes", F.col("n") == 0, differ("n")),
            check(sizes, "counts", F.col("a") == F.col("b"), F.concat(F.lit("expected="), F.col("a").cast("string"), F.lit(" found="), F.col("b").cast("string"))),
            check(c, "splits", (F.col("n_overlap") == 0) & (F.col("n_missing") == 0) & (F.col("n_extra") == 0), say),
            check(wrong, "table", F.col("n") == 0, differ("n")),
            subset(*orphans, "orphans"),
        ]
    )
