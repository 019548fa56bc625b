"""Metrics from contingency counts and predicted distributions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BINS, CLIP, DIGITS = 10, 1e-15, 6


def confusion(pred: DataFrame, dense: bool = True) -> DataFrame:
    """true_label, predicted, n; dense: pairs of all labels on either side, zeros kept (labels squared)."""
    counts = pred.groupBy("true_label", "predicted").agg(F.count("*").alias("n"))
    if not dense:
        return counts
    names = pred.select("true_label").union(pred.select("predicted")).distinct()
    grid = names.withColumnRenamed("true_label", "t").crossJoin(names.withColumnRenamed("true_label", "p"))
    return grid.join(counts, (F.col("t") == F.col("true_label")) & (F.col("p") == F.col("predicted")), "left").select(F.col("t").alias("true_label"), F.col("p").alias("predicted"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def normalised(counts: DataFrame) -> DataFrame:
    """Confusion counts as shares of their row; 0 in an empty row."""
    row = F.sum("n").over(W.partitionBy("true_label"))
    return counts.select("true_label", "predicted", F.round(F.when(row > 0, F.col("n") / row).otherwise(0.0), DIGITS).alias("share"))


def per_class(counts: DataFrame) -> DataFrame:
    """label, support, precision, recall, f1 over all labels on either side; a ratio of nothing is 0."""
    both = counts.select("true_label", "predicted", "n", F.explode(F.array_distinct(F.array("true_label", "predicted"))).alias("label"))
    tp = F.sum(F.when((F.col("true_label") == F.col("label")) & (F.col("predicted") == F.col("label")), F.col("n")).otherwise(0))
    support, claimed = (F.sum(F.when(F.col(x) == F.col("label"), F.col("n")).otherwise(0)) for x in ("true_label", "predicted"))
    s = both.groupBy("label").agg(tp.alias("tp"), support.alias("support"), claimed.alias("claimed"))
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    return s.select("label", F.col("support").cast("long"), ratio(F.col("tp"), F.col("claimed")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("support") + F.col("claimed")).alias("f1"))


def classification(pred: DataFrame) -> DataFrame:
    """One row: accuracy, macro and weighted F1, macro precision and recall."""
    counts = confusion(pred, dense=False)
    acc = counts.agg(F.round(F.sum(F.when(F.col("true_label") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n"), DIGITS).alias("accuracy"))
    macro = per_class(counts).agg(
        F.round(F.avg("f1"), DIGITS).alias("macro_f1"), F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), DIGITS).alias("weighted_f1"), F.round(F.avg("precision"), DIGITS).alias("macro_precision"), F.round(F.avg("recall"), DIGITS).alias("macro_recall")
    )
    return acc.crossJoin(macro)


def _margins(pred: DataFrame) -> DataFrame:
    c = confusion(pred, dense=False)
    pairs = lambda x: x * (x - 1) / 2.0
    a, b = (c.groupBy(k).agg(F.sum("n").alias("m")).agg(F.sum(pairs(F.col("m"))).alias(x)) for k, x in (("true_label", "sa"), ("predicted", "sb")))
    return c.agg(F.sum(pairs(F.col("n"))).alias("sij"), F.sum("n").alias("n")).crossJoin(a).crossJoin(b)


def adjusted_rand(pred: DataFrame) -> DataFrame:
    """One row: ari."""
    m = _margins(pred)
    expected = F.col("sa") * F.col("sb") / (F.col("n") * (F.col("n") - 1) / 2.0)
    most = (F.col("sa") + F.col("sb")) / 2
    return m.select(F.round(F.when((F.col("n") < 2) | (most == expected), 1.0).otherwise((F.col("sij") - expected) / (most - expected)), DIGITS).alias("ari"))


def normalised_mutual_information(pred: DataFrame) -> DataFrame:
    """One row: nmi, over the mean of both entropies; 1 if neither side has more than one class."""
    c = confusion(pred, dense=False)
    n = F.sum("n").over(W.partitionBy())  # classes squared rows
    w = c.select("n", n.alias("all"), F.sum("n").over(W.partitionBy("true_label")).alias("a"), F.sum("n").over(W.partitionBy("predicted")).alias("b"))
    share = F.col("n") / F.col("all")
    s = w.agg(F.sum(share * F.log(F.col("n") * F.col("all") / (F.col("a") * F.col("b")))).alias("mi"), F.sum(-share * F.log(F.col("a") / F.col("all"))).alias("ha"), F.sum(-share * F.log(F.col("b") / F.col("all"))).alias("hb"))
    return s.select(F.round(F.when(F.col("ha") + F.col("hb") <= 0, 1.0).otherwise(F.col("mi") / ((F.col("ha") + F.col("hb")) / 2)), DIGITS).alias("nmi"))


def assignment_sql(table: str, classes: int) -> str:
    """SQL for the best one-to-one assignment over (r, c, n), r and c from 0: subsets of columns, a row at a time."""
    steps = ["d0 AS (SELECT CAST(0 AS BIGINT) AS mask, CAST(0 AS BIGINT) AS best)"]
    for i in range(classes):
        bit = "(CAST(1 AS BIGINT) << CAST(c AS INT))"
        steps.append(f"d{i + 1} AS (SELECT mask | {bit} AS mask, max(best + n) AS best FROM d{i} JOIN {table} ON r = {i} AND (mask & {bit}) = 0 GROUP BY 1)")
    return ", ".join(steps) + f" SELECT max(best) AS best FROM d{classes}"


def best_assignment(gain: np.ndarray) -> float:
    """The largest sum of one entry a row and column of a square matrix, by shortest augmenting paths."""
    n = len(gain)
    cost = gain.max() - gain
    row_of, price_row, price_col = np.full(n, -1), np.zeros(n), np.zeros(n)
    for r in range(n):
        reach, via, done = np.full(n, np.inf), np.full(n, -1), np.zeros(n, dtype=bool)
        at, row, level = -1, r, 0.0
        while True:
            way = level + cost[row] - price_row[row] - price_col
            nearer = ~done & (way < reach)
            reach[nearer], via[nearer] = way[nearer], at
            at = int(np.where(done, np.inf, reach).argmin())
            level = reach[at]
            done[at] = True
            if row_of[at] < 0:
                break
            row = row_of[at]
        seen = np.flatnonzero(done & (row_of >= 0))
        price_row[r] += level
        price_row[row_of[seen]] += level - reach[seen]
        price_col[done] -= level - reach[done]
        while at >= 0:
            row_of[at], at = (row_of[via[at]] if via[at] >= 0 else r), via[at]
    return float(gain[row_of, np.arange(n)].sum())


def assignment_accuracy(pred: DataFrame) -> DataFrame:
    """One row: the share of rows that the best one-to-one matching of predicted to true classes gets right. The driver solves it on the classes' counts."""
    spark = pred.sparkSession
    counts = confusion(pred, dense=False).collect()  # a row a pair of classes
    if not counts:
        return spark.sql("SELECT CAST(NULL AS DOUBLE) AS assignment_accuracy")
    rows, columns = ({x: i for i, x in enumerate(sorted({r[c] for r in counts}, key=lambda x: (x is not None, x)))} for c in ("true_label", "predicted"))
    gain = np.zeros((max(len(rows), len(columns)),) * 2)
    for r in counts:
        gain[rows[r.true_label], columns[r.predicted]] = r.n
    return spark.createDataFrame([(float(best_assignment(gain) / gain.sum()),)], "x double").select(F.round("x", DIGITS).alias("assignment_accuracy"))


def edges(bins: int = BINS) -> list[float]:
    """Bin edges as i * (1 / bins), the last one exactly 1."""
    return [i * (1.0 / bins) for i in range(bins)] + [1.0]


def reliability(pred: DataFrame, bins: int = BINS) -> DataFrame:
    """bin, bin_lower, bin_upper, mean_confidence, fraction_positive, count of all bins (lower, upper]; an empty bin has its middle and 0."""
    e = edges(bins)
    place = F.coalesce(*(F.when((F.col("confidence") > e[i]) & (F.col("confidence") <= e[i + 1]), i) for i in range(bins)))
    s = pred.select(place.alias("bin"), "confidence", (F.col("true_label") == F.col("predicted")).cast("double").alias("right")).where("bin is not null").groupBy("bin").agg(F.avg("confidence").alias("c"), F.avg("right").alias("f"), F.count("*").alias("n"))
    grid = pred.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    lower, upper = (F.get(F.array(*(F.lit(x) for x in e[o : o + bins])), F.col("bin")) for o in (0, 1))
    return grid.join(s, "bin", "left").select("bin", lower.alias("bin_lower"), upper.alias("bin_upper"), F.round(F.coalesce("c", (lower + upper) / 2), DIGITS).alias("mean_confidence"), F.round(F.coalesce("f", F.lit(0.0)), DIGITS).alias("fraction_positive"), F.coalesce("n", F.lit(0)).alias("count"))


def calibration_error(pred: DataFrame, bins: int = BINS) -> DataFrame:
    """One row: ece. Rows with a confidence of 0 are in no bin but count in the shares."""
    total = pred.agg(F.count("*").alias("total"))
    r = reliability(pred, bins).crossJoin(F.broadcast(total))
    return r.agg(F.round(F.coalesce(F.sum(F.when(F.col("count") > 0, F.abs(F.col("fraction_positive") - F.col("mean_confidence")) * F.col("count") / F.col("total"))), F.lit(0.0)), 5).alias("ece"))


def log_loss(p: DataFrame) -> DataFrame:
    """One row: log_loss of (query_id, query_label, label, p); a true class without a probability counts as CLIP."""
    true = p.groupBy("query_id").agg(F.coalesce(F.max(F.when(F.col("label") == F.col("query_label"), F.col("p"))), F.lit(0.0)).alias("q"))
    return true.agg(F.round(-F.avg(F.log(F.greatest(F.least("q", F.lit(1 - CLIP)), F.lit(CLIP)))), DIGITS).alias("log_loss"))


def top_accuracy(p: DataFrame, k: int = 3) -> DataFrame:
    """One row: the share of rows whose true class is among the k likeliest (ties by class)."""
    ranked = p.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("p"), "label")))
    hit = ranked.groupBy("query_id").agg(F.max(F.when((F.col("label") == F.col("query_label")) & (F.col("rank") <= k), 1.0).otherwise(0.0)).alias("hit"))
    return hit.agg(F.round(F.avg("hit"), DIGITS).alias(f"top_{k}_accuracy"))
