"""Model training: multinomial regression, calibration, k-means, a network, and a baseline by chance."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, MultilayerPerceptronClassifier
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.formats import exists
from ..storage import stored

SEED, FOLDS = 42, 5


def features(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    return df.select(F.col(key).alias("id"), F.col(label).cast("string").alias("y"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"))


def scaled(train: DataFrame, rows: DataFrame, column: str = "features") -> DataFrame:
    """rows with each dimension less its mean over train, in units of its (population) deviation; 0 where train has none."""
    n = train.count()
    model = StandardScaler(inputCol=column, outputCol="unit__", withMean=True, withStd=True).fit(train)  # by sample deviations
    wide = ElementwiseProduct(inputCol="unit__", outputCol="scaled__", scalingVec=Vectors.dense([math.sqrt(n / max(1, n - 1))] * model.mean.size))
    return wide.transform(model.transform(rows)).withColumn(column, F.col("scaled__")).drop("unit__", "scaled__")


def _weighted(train: DataFrame) -> tuple[DataFrame, list[str], int]:
    """Balanced weights n / (classes * n of the class), and classes in order."""
    counts = {r.y: r.n for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}  # a row a class
    names, n = sorted(counts), sum(counts.values())
    weight = F.coalesce(*(F.when(F.col("y") == c, n / (len(counts) * k)) for c, k in counts.items()))
    index = F.coalesce(*(F.when(F.col("y") == c, float(i)) for i, c in enumerate(names)))
    return train.withColumns({"w": weight, "label": index}), names, n


def logistic(train: DataFrame, rows: DataFrame, iterations: int = 1000):
    """(model, classes, rows with rawPrediction and probability): an L2-regularised multinomial model with C = 1 and balanced weights."""
    weighted, names, n = _weighted(train)
    model = LogisticRegression(family="multinomial", regParam=1.0 / n, elasticNetParam=0.0, standardization=False, weightCol="w", maxIter=iterations, tol=1e-8).fit(weighted)
    return model, names, model.transform(rows)


def distribution(scored: DataFrame, names: list[str], column: str = "probability") -> DataFrame:
    """query_id, query_label, label, p in long form."""
    each = F.arrays_zip(F.array(*(F.lit(c) for c in names)).alias("label"), vector_to_array(column).alias("p"))
    return scored.select(F.col("id").alias("query_id"), F.col("y").alias("query_label"), F.explode(each).alias("x")).select("query_id", "query_label", "x.label", "x.p")


def folds(train: DataFrame, k: int = FOLDS) -> DataFrame:
    """train with fold: within a class, rows in the order of id go around the folds, as many to each as the classes' order gives."""
    first = train.groupBy("y").agg(F.min("id").alias("first"))
    code = first.withColumn("code", F.row_number().over(W.orderBy("first")) - 1).select("y", "code")  # a row a class
    sizes = train.groupBy("y").agg(F.count("*").alias("n")).join(code, "y")
    before = F.coalesce(F.sum("n").over(W.orderBy("code").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("y", "n", before.alias("start"))
    # of positions start..start+n-1 in the order of classes, those that are f modulo k go to fold f
    take = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: F.floor((F.col("start") + F.col("n") - 1 - f) / k) - F.floor((F.col("start") - 1 - f) / k))
    upto = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.aggregate(F.slice("take", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x))
    sizes = sizes.withColumn("take", take).withColumn("upto", upto).select("y", "upto")
    # ranks by ranges of ids, so that no class needs one task: places within a range, after those of the ranges before it
    ranged = stored(train.repartitionByRange("y", "id").withColumn("part__", F.spark_partition_id()))
    before = F.coalesce(F.sum("n").over(W.partitionBy("y").orderBy("part__").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = ranged.groupBy("y", "part__").agg(F.count("*").alias("n")).select("y", "part__", before.alias("offset__"))  # a row a class and partition
    within = F.row_number().over(W.partitionBy("y", "part__").orderBy("id"))
    ranked = ranged.withColumn("within__", within).join(F.broadcast(offsets), ["y", "part__"]).withColumn("rank", F.col("within__") + F.col("offset__")).drop("within__", "offset__", "part__")
    return ranked.join(F.broadcast(sizes), "y").withColumn("fold", F.size(F.filter("upto", lambda u: u < F.col("rank")))).drop("rank", "upto")


def _sigmoids(margins: DataFrame, steps: int = 12) -> dict[tuple[int, str], tuple[float, float]]:
    """(slope, intercept) by fold and class: logistic fits to softened targets, all at once by Newton steps over sums (a row a fold and class)."""
    key = ["fold", "label"]
    m = margins.withColumn("pos", (F.col("query_label") == F.col("label")).cast("double"))
    n = m.groupBy(*key).agg(F.sum("pos").alias("np"), F.sum(1 - F.col("pos")).alias("nn"))
    soft = F.when(F.col("pos") > 0, (F.col("np") + 1) / (F.col("np") + 2)).otherwise(1 / (F.col("nn") + 2))
    m = m.join(F.broadcast(n), key).select(*key, "m", soft.alias("t"))
    m = stored(m)
    fits = {(r.fold, r.label): (0.0, math.log((r.np + 1) / (r.nn + 1))) for r in n.collect()}
    spark = margins.sparkSession
    for _ in range(steps):
        now = spark.createDataFrame([(f, c, a, b) for (f, c), (a, b) in fits.items()], "fold int, label string, a double, b double")
        p = 1 / (1 + F.exp(-(F.col("a") * F.col("m") + F.col("b"))))
        d = m.join(F.broadcast(now), key).select(*key, "m", (p - F.col("t")).alias("e"), (p * (1 - p)).alias("h"))
        sums = d.groupBy(*key).agg(F.sum(F.col("e") * F.col("m")).alias("ga"), F.sum("e").alias("gb"), F.sum(F.col("h") * F.col("m") * F.col("m")).alias("haa"), F.sum(F.col("h") * F.col("m")).alias("hab"), F.sum("h").alias("hbb"))
        for r in sums.collect():
            haa, hbb = r.haa + 1e-9, r.hbb + 1e-9
            det = haa * hbb - r.hab * r.hab
            a, b = fits[r.fold, r.label]
            fits[r.fold, r.label] = (a - (hbb * r.ga - r.hab * r.gb) / det, b - (haa * r.gb - r.hab * r.ga) / det)
    return fits


def platt(train: DataFrame, rows: DataFrame, k: int = FOLDS, iterations: int = 1000) -> DataFrame:
    """query_id, query_label, label, p: the mean of k models' sigmoid-calibrated, renormalised one-against-rest probabilities."""
    dealt = stored(folds(train, k))
    held, asked = [], []
    for f in range(k):
        model, names, own = logistic(dealt.where(F.col("fold") != f).drop("fold"), dealt.where(F.col("fold") == f).drop("fold"), iterations)
        for box, df in ((held, own), (asked, model.transform(rows))):
            box.append(distribution(df, names, "rawPrediction").withColumnRenamed("p", "m").withColumn("fold", F.lit(f)))
    fits = _sigmoids(reduce(DataFrame.unionByName, held))
    table = train.sparkSession.createDataFrame([(f, c, a, b) for (f, c), (a, b) in fits.items()], "fold int, label string, a double, b double")
    s = reduce(DataFrame.unionByName, asked).join(F.broadcast(table), ["fold", "label"]).withColumn("s", 1 / (1 + F.exp(-(F.col("a") * F.col("m") + F.col("b")))))
    w = W.partitionBy("query_id", "fold")
    total = F.sum("s").over(w)
    p = s.select("query_id", "query_label", "label", F.when(total > 0, F.col("s") / total).otherwise(1 / F.count("*").over(w)).alias("p"))
    return p.groupBy("query_id", "query_label", "label").agg((F.sum("p") / k).alias("p"))


START_ROWS = 20_000  # starts are drawn from a sample of so many rows at most, those with the least hash of id


def _starts(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows of a sample, each drawn by its squared distance to those before."""
    picked = [int(rng.integers(len(sample)))]
    near = ((sample - sample[picked[0]]) ** 2).sum(axis=1)
    while len(picked) < k:
        picked.append(int(rng.choice(len(sample), p=near / near.sum())) if near.sum() > 0 else int(rng.integers(len(sample))))
        near = np.minimum(near, ((sample - sample[picked[-1]]) ** 2).sum(axis=1))
    return sample[picked]


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None, :]
    at = d.argmin(axis=1)
    return at, np.maximum(d[np.arange(len(x)), at], 0)


def k_means_fit(rows: DataFrame, k: int, tries: int = 10, seed: int = SEED, most: int = 100, settled: float = 1e-4) -> tuple[np.ndarray, float]:
    """(centres, cost) of the best of several starts. All starts take their steps in the same pass over rows; the driver sees tries x k sums."""
    vectors = stored(rows.select("id", vector_to_array("features").alias("v")))
    sample = np.array([r.v for r in vectors.orderBy(F.xxhash64("id"), "id").limit(START_ROWS).collect()], dtype=np.float64)
    if not len(sample):
        raise ValueError("no rows to cluster")
    limit = settled * float(sample.var(axis=0).mean())
    centres = {t: _starts(sample, k, np.random.Generator(np.random.PCG64([seed, t]))) for t in range(tries)}
    cost, open_ = dict.fromkeys(centres, math.inf), set(centres)
    shape, dim = "start int, sums array<double>", sample.shape[1]
    for _ in range(most):
        now = {t: centres[t] for t in sorted(open_)}

        def step(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            sums = {t: np.zeros((k, dim + 2)) for t in now}  # of each cluster: its vectors, how many, their cost
            for b in batches:
                if b.num_rows:
                    x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                    for t, c in now.items():
                        at, d = _nearest(x, c)
                        own = np.zeros((k, b.num_rows))
                        own[at, np.arange(b.num_rows)] = 1
                        sums[t] += own @ np.column_stack((x, np.ones(b.num_rows), d))
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.ravel().tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["start", "sums"])

        def add(t: pa.Table) -> pa.Table:
            return pa.table({"start": t["start"][:1], "sums": pa.array([np.sum(t["sums"].to_pylist(), axis=0).tolist()], pa.list_(pa.float64()))})

        total, new = {}, {}
        for r in vectors.select("v").mapInArrow(step, shape).groupBy("start").applyInArrow(add, shape).collect():  # a row a start
            x = np.array(r.sums).reshape(k, dim + 2)
            total[r.start], new[r.start] = float(x[:, -1].sum()), np.where(x[:, -2:-1] > 0, x[:, :dim] / np.maximum(x[:, -2:-1], 1), now[r.start])
        for t, c in now.items():
            cost[t], centres[t] = total[t], new[t]
            if ((new[t] - c) ** 2).sum() <= limit:
                open_.discard(t)
        if not open_:
            break
    best = min(centres, key=lambda t: (cost[t], t))
    return centres[best], cost[best]


def k_means(rows: DataFrame, k: int, tries: int = 10, seed: int = SEED) -> DataFrame:
    """id, y, cluster by the best of several starts."""
    centres, _ = k_means_fit(rows, k, tries, seed)
    return assign(rows, centres)


def assign(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """id, y, cluster: the nearest of a few centres."""
    flat = F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in centres))
    far = F.transform(flat, lambda c: F.aggregate(F.zip_with(c, vector_to_array("features"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    return rows.select("id", "y", far.alias("d")).select("id", "y", (F.array_position("d", F.array_min("d")) - 1).cast("int").alias("cluster"))


def save(model, path: str) -> None:
    """Store a fitted model; one that is there is an error."""
    spark = SparkSession.getActiveSession()
    if exists(spark, path):
        raise FileExistsError(path)
    model.write().save(path)


def load(path: str) -> LogisticRegressionModel:
    return LogisticRegressionModel.load(path)


def network(train: DataFrame, rows: DataFrame, width: int, hidden: tuple[int, ...] = (256, 64), iterations: int = 500) -> DataFrame:
    """id, y, predicted by a feed-forward network (sigmoid units, L-BFGS)."""
    index = StringIndexer(inputCol="y", outputCol="label", handleInvalid="skip", stringOrderType="alphabetAsc").fit(train)
    model = MultilayerPerceptronClassifier(layers=[width, *hidden, len(index.labels)], maxIter=iterations, seed=SEED).fit(index.transform(train))
    names = F.array(*(F.lit(x) for x in index.labels))
    return model.transform(rows).select("id", "y", F.get(names, F.col("prediction").cast("int")).alias("predicted"))


def by_chance(train: DataFrame, rows: DataFrame, label: Column, key: Column, seed: int = SEED) -> DataFrame:
    """id, predicted: classes drawn by their share of train, a row's draw from a hash of seed and key (so it is the same on every run)."""
    counts = train.groupBy(label.cast("string").alias("c")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.orderBy("c"))  # a row a class
    shares = counts.select("c", (upto - F.col("n")).alias("lo"), upto.alias("hi"), F.sum("n").over(W.partitionBy()).alias("total"))
    table = shares.agg(F.collect_list(F.struct("lo", "hi", "c")).alias("shares"), F.max("total").alias("total"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("long")
    drawn = rows.select(key.alias("id"), draw.alias("d")).crossJoin(F.broadcast(table)).withColumn("at", F.floor(F.col("d") * F.col("total") / 4294967296.0))
    return drawn.select("id", F.filter("shares", lambda s: (s["lo"] <= F.col("at")) & (F.col("at") < s["hi"]))[0]["c"].alias("predicted"))
