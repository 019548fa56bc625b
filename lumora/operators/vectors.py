"""Cosine search and what follows from rankings."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import stored

#: Rows of a side that meet in one task; a block of either side travels once to each block of the other.
BLOCK = 4096
DIGITS = 6


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    x = np.asarray(flat.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(flat), -1)
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _sides(queries: DataFrame, gallery: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Both sides' rows, dealt so that every block of queries meets every block of the gallery once."""
    counts = [math.ceil(max(1, df.count()) / BLOCK) for df in (queries, gallery)]
    rows = []
    for i, df in enumerate((queries, gallery)):
        own, other = counts[i], counts[1 - i]
        block = F.pmod(F.xxhash64(key, F.lit(i)), F.lit(own))
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other - 1).cast("long")))
        r = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"), block.alias("own"), F.lit(i).alias("side")).withColumn("other", each)
        rows.append(r.select("id", "label", "v", "side", F.col("own" if i == 0 else "other").alias("q"), F.col("other" if i == 0 else "own").alias("g")))
    return rows[0].unionByName(rows[1])


_NEAREST = "query_id long, query_label string, gallery_id long, gallery_label string, sim double"


def _nearest(k: int):
    def run(t: pa.Table) -> pa.Table:
        side = t["side"].to_numpy()
        q, g = t.filter(pa.array(side == 0)), t.filter(pa.array(side == 1))
        out: dict[str, list] = {x: [] for x in ("query_id", "query_label", "gallery_id", "gallery_label", "sim")}
        if q.num_rows and g.num_rows:
            ids, names, labels = g["id"].to_numpy(), np.array(g["label"].to_pylist(), dtype=object), q["label"].to_pylist()
            gv, qv = _matrix(g["v"]), _matrix(q["v"])
            for lo in range(0, len(qv), 256):
                sims = np.round(qv[lo : lo + 256] @ gv.T, DIGITS) + 0.0
                for i, s in enumerate(sims, lo):
                    at = np.flatnonzero(s >= np.partition(s, max(0, len(s) - k))[max(0, len(s) - k)])
                    at = at[np.lexsort((ids[at], -s[at]))][:k]
                    out["query_id"] += [q["id"][i].as_py()] * len(at)
                    out["query_label"] += [labels[i]] * len(at)
                    out["gallery_id"] += ids[at].tolist()
                    out["gallery_label"] += names[at].tolist()
                    out["sim"] += s[at].tolist()
        return pa.table({c: pa.array(v, pa.string() if "label" in c else pa.float64() if c == "sim" else pa.int64()) for c, v in out.items()})

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("sim"), "gallery_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "query_label", "rank", "gallery_id", "gallery_label", "sim")


def top_k(queries: DataFrame, gallery: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """query_id, query_label, rank, gallery_id, gallery_label, sim: the k nearest by cosine (rounded to DIGITS), ties by id."""
    return _ranked(_sides(queries, gallery, key, vector, label).groupBy("q", "g").applyInArrow(_nearest(k), _NEAREST), k)


#: Lists of the pruned search: at most so many, from a sample of so many rows at most (by the hash of their id), and how many a query looks at first.
LISTS, SAMPLE, FIRST = 2048, 20_000, 4


def _centres(gallery: DataFrame, n: int, vector: str, key: str, seed: int = 3) -> np.ndarray:
    """Unit vectors that a sample of the gallery gathers around: a few steps of spherical k-means on the driver."""
    rows = gallery.orderBy(F.xxhash64(key), key).limit(SAMPLE).select(F.col(vector).cast("array<double>").alias("v")).collect()
    x = np.array([r.v for r in rows], dtype=np.float64)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    c = x[np.random.Generator(np.random.PCG64(seed)).permutation(len(x))[:n]]
    for _ in range(5):
        at = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        c = np.where(size > 0, sums / np.maximum(size, 1e-300), c)
    return c


def _angles(column: pa.Array | pa.ChunkedArray, centres: np.ndarray) -> np.ndarray:
    """Of vectors to centres; a vector of nought is at no angle to any, so that nothing is pruned for it."""
    x = _matrix(pa.chunked_array([column]) if isinstance(column, pa.Array) else column)
    out = np.arccos(np.clip(x @ centres.T, -1, 1))
    out[~x.any(axis=1)] = 0
    return out


def top_k_pruned(queries: DataFrame, gallery: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", label: str = "label", lists: int | None = None) -> DataFrame:
    """top_k(), by lists around centres: the same rows, without comparing what can't be among them.

    A query looks at the FIRST lists next to it, which gives a bound for its k-th neighbour, and then only at lists that may
    hold a nearer one: no vector of a list is nearer to a query than the angle to the list's centre less the list's radius. So
    the result is exact; on gathered vectors few lists are left, on scattered ones most are. Lists meet queries in blocks.
    """
    n = gallery.count()
    centres = _centres(gallery, lists or max(1, min(LISTS, math.isqrt(n))), vector, key) if n else np.zeros((0, 1))
    if not len(centres):
        return top_k(queries, gallery, k, key, vector, label)
    pick = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a = _angles(b.column(2), centres)
                at = a.argmin(axis=1)
                far = np.where(a.any(axis=1), a[np.arange(len(a)), at], math.pi)  # a vector of nought opens its list to all
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at), pa.array(far)], names=["id", "label", "v", "list", "far"])

    g = stored(pick(gallery).mapInArrow(listed, "id long, label string, v array<double>, list long, far double"))
    sizes = {r.list: (r.n, r.far) for r in g.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # LISTS rows
    radius = np.array([sizes.get(i, (0, -math.inf))[1] for i in range(len(centres))])

    def chosen(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                a = _angles(b.column(2), centres)
                a[:, radius < 0] = np.inf
                early = np.zeros(a.shape, dtype=bool)
                np.put_along_axis(early, np.argsort(a, axis=1, kind="stable")[:, :FIRST], True, axis=1)
                early &= np.isfinite(a)
                if not first:
                    bound = b.column(3).to_numpy(zero_copy_only=False)
                    most = np.cos(np.clip(a - radius, 0, math.pi))  # the largest cosine that a list can have
                    early = ~early & np.isfinite(a) & ((most >= (bound - 2 * 10.0**-DIGITS)[:, None]) | np.isnan(bound)[:, None])
                q, at = np.nonzero(early)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(q)) for c in b.columns[:3]), pa.array(at)], names=["id", "label", "v", "list"])

        return run

    def search(asked: DataFrame) -> DataFrame:
        own = F.ceil(F.col("n") / BLOCK)
        each = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), m.cast("long") - 1))
        many = stored(asked)
        counts = many.groupBy("list").agg(F.count("*").alias("m")).join(g.groupBy("list").agg(F.count("*").alias("n")), "list")
        counts = F.broadcast(counts)  # LISTS rows
        left = many.join(counts, "list").select("id", "label", "v", F.lit(0).alias("side"), "list", F.pmod(F.xxhash64("id", F.lit(0)), F.ceil(F.col("m") / BLOCK)).alias("q"), each(own).alias("g"))
        right = g.join(counts, "list").select("id", "label", "v", F.lit(1).alias("side"), "list", each(F.ceil(F.col("m") / BLOCK)).alias("q"), F.pmod(F.xxhash64("id", F.lit(1)), own).alias("g"))
        return _ranked(left.unionByName(right).groupBy("list", "q", "g").applyInArrow(_nearest(k), _NEAREST), k)

    asked = pick(queries)
    near = stored(search(asked.mapInArrow(chosen(True), "id long, label string, v array<double>, list long")))
    bound = near.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("sim").alias("bound"))
    rest = asked.join(bound, "id", "left").select("id", "label", "v", F.coalesce("bound", F.lit(float("nan"))).alias("bound"))
    more = search(rest.mapInArrow(chosen(False), "id long, label string, v array<double>, list long"))
    return _ranked(near.unionByName(more).drop("rank"), k)


def first_matches(queries: DataFrame, gallery: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """query_id, first_rank: the rank of the first gallery row of the query's label (null if there is none), without sorting the gallery.

    A block tells its best match and every block counts what comes before the best of all, so two passes over blocks.
    """
    keys = "query_id long, sim double, gallery_id long"

    def nearest(t: pa.Table) -> pa.Table:
        side = t["side"].to_numpy()
        q, g = t.filter(pa.array(side == 0)), t.filter(pa.array(side == 1))
        out = ([], [], [])
        if q.num_rows and g.num_rows:
            ids, gl, ql = g["id"].to_numpy(), np.array(g["label"].to_pylist(), dtype=object), q["label"].to_pylist()
            sims = np.round(_matrix(q["v"]) @ _matrix(g["v"]).T, DIGITS) + 0.0
            for i, s in enumerate(sims):
                at = np.flatnonzero(gl == ql[i])
                if len(at):
                    b = at[np.lexsort((ids[at], -s[at]))[0]]
                    out[0].append(q["id"][i].as_py()), out[1].append(float(s[b])), out[2].append(int(ids[b]))
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "sim": pa.array(out[1], pa.float64()), "gallery_id": pa.array(out[2], pa.int64())})

    def ahead(t: pa.Table) -> pa.Table:
        side = t["side"].to_numpy()
        q, g = t.filter(pa.array(side == 0)), t.filter(pa.array(side == 1))
        n = np.zeros(q.num_rows, dtype=np.int64)
        if q.num_rows and g.num_rows:
            ids = g["id"].to_numpy()
            sims = np.round(_matrix(q["v"]) @ _matrix(g["v"]).T, DIGITS) + 0.0
            s, b = q["best_sim"].to_numpy()[:, None], q["best_id"].to_numpy()[:, None]
            n = ((sims > s) | (sims == s) & (ids[None, :] < b)).sum(axis=1)
        return pa.table({"query_id": q["id"], "n": pa.array(n, pa.int64())})

    sides = _sides(queries, gallery, key, vector, label)
    best = sides.groupBy("q", "g").applyInArrow(nearest, keys).groupBy("query_id").agg(F.min(F.struct((-F.col("sim")).alias("s"), "gallery_id")).alias("b"))
    best = best.select(F.col("query_id").alias("id"), (-F.col("b.s")).alias("best_sim"), F.col("b.gallery_id").alias("best_id"))
    asked = sides.where("side = 0").join(best, "id").unionByName(sides.where("side = 1"), allowMissingColumns=True)
    ranks = asked.groupBy("q", "g").applyInArrow(ahead, "query_id long, n long").groupBy("query_id").agg((F.sum("n") + 1).alias("first_rank"))
    return queries.select(F.col(key).cast("long").alias("query_id")).join(ranks, "query_id", "left")


def hit_rates(first: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """hit_rate_at_k for each k, and mrr; no match counts 0."""
    rank = F.col("first_rank")
    hit = [F.round(F.avg(F.coalesce((rank <= k).cast("double"), F.lit(0.0))), 9).alias(f"hit_rate_at_{k}") for k in ks]
    return first.agg(*hit, F.round(F.avg(F.coalesce(1.0 / rank, F.lit(0.0))), 9).alias("mrr"), F.count("*").alias("n_queries"))


GRID = 100


def pr_curve(queries: DataFrame, gallery: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """step, threshold, tp, fp, fn, precision, recall at GRID thresholds from 0.5 to 1: tp and fp count pairs, fn queries without a match.

    Blocks return histograms over the grid and each query's best match, never pairs.
    """
    edges = [0.5 + i * 0.5 / (GRID - 1) for i in range(GRID)]
    cuts = np.round(np.array(edges), 9)

    def run(t: pa.Table) -> pa.Table:
        side = t["side"].to_numpy()
        q, g = t.filter(pa.array(side == 0)), t.filter(pa.array(side == 1))
        out: list[tuple] = []
        if q.num_rows and g.num_rows:
            gl, ql = np.array(g["label"].to_pylist(), dtype=object), np.array(q["label"].to_pylist(), dtype=object)
            place = np.searchsorted(cuts, np.round(_matrix(q["v"]) @ _matrix(g["v"]).T, DIGITS), side="right") - 1  # the last threshold that a pair reaches
            same = ql[:, None] == gl[None, :]
            for kind, m in ((0, same), (1, ~same)):
                at, n = np.unique(place[m & (place >= 0)], return_counts=True)
                out += [(kind, None, int(a), int(c)) for a, c in zip(at, n, strict=True)]
            top = np.where(same, place, -1).max(axis=1)
            out += [(2, int(i), int(a), 1) for i, a in zip(q["id"].to_numpy(), top, strict=True)]
        return pa.table({"kind": pa.array([x[0] for x in out], pa.int32()), "id": pa.array([x[1] for x in out], pa.int64()), "step": pa.array([x[2] for x in out], pa.int64()), "n": pa.array([x[3] for x in out], pa.int64())})

    found = _sides(queries, gallery, key, vector, label).groupBy("q", "g").applyInArrow(run, "kind int, id long, step long, n long")
    best = found.where("kind = 2").groupBy("id").agg(F.max("step").alias("step")).groupBy("step").agg(F.count("*").alias("n")).select(F.lit(2).alias("kind"), "step", "n")
    sums = found.where("kind < 2").groupBy("kind", "step").agg(F.sum("n").alias("n")).union(best).groupBy("step").pivot("kind", [0, 1, 2]).sum("n")
    grid = queries.sparkSession.range(-1, GRID).withColumnRenamed("id", "step").join(sums, "step", "left").fillna(0)
    from_here = W.orderBy("step").rowsBetween(0, W.unboundedFollowing)  # GRID + 1 rows
    up_to = W.orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    counted = grid.select("step", F.sum("0").over(from_here).alias("tp"), F.sum("1").over(from_here).alias("fp"), F.coalesce(F.sum("2").over(up_to), F.lit(0)).alias("fn")).where("step >= 0")
    ratio = lambda x, y, none: F.round(F.when(y > 0, x / y).otherwise(none), 6)
    return counted.select("step", F.round(0.5 + F.col("step") * 0.5 / (GRID - 1), 6).alias("threshold"), "tp", "fp", "fn", ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn"), 0.0).alias("recall"))


def votes(top: DataFrame) -> DataFrame:
    """query_id, query_label, label, votes, p of each class among a query's neighbours."""
    n = top.groupBy("query_id").agg(F.count("*").alias("k"))
    v = top.groupBy("query_id", "query_label", F.col("gallery_label").alias("label")).agg(F.count("*").alias("votes"))
    return v.join(n, "query_id").select("query_id", "query_label", "label", "votes", F.round(F.col("votes") / F.col("k"), 6).alias("p"))


def decide(p: DataFrame) -> DataFrame:
    """query_id, true_label, predicted, confidence: the likeliest class, the first in order on a tie."""
    best = p.groupBy("query_id", "query_label").agg(F.min(F.struct((-F.col("p")).alias("q"), "label")).alias("b"))
    return best.select("query_id", F.col("query_label").alias("true_label"), F.col("b.label").alias("predicted"), (-F.col("b.q")).alias("confidence"))


def nearest_centroid(train: DataFrame, rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """query_id, true_label, predicted, distance: one Lloyd step from the labels' mean vectors (a row for each label)."""
    parts = train.select(F.col(label).cast("string").alias("c"), F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x")).groupBy("c", "i").agg(F.avg("x").alias("m"))
    means = parts.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    all_means = means.agg(F.collect_list(F.struct("c", "mean")).alias("means"))  # classes x dimensions
    d = F.transform("means", lambda s: F.struct(F.round(F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), s["mean"], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x), DIGITS).alias("d"), s["c"].alias("c")))
    near = rows.crossJoin(F.broadcast(all_means)).select(F.col(key).alias("query_id"), F.col(label).cast("string").alias("true_label"), F.array_min(d).alias("near"))
    return near.select("query_id", "true_label", F.col("near.c").alias("predicted"), F.col("near.d").alias("distance"))
