"""What the operators of this subpackage share on the Spark side."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: An upper bound for the bytes of one Arrow batch, so that long texts don't pile up in a Python worker.
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches, and see that there is a checkpoint folder: that of spark.checkpoint.dir.

    Only a local session, whose executor is the driver, may do without: it gets a temporary folder, removed at exit.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() is not None:
        return
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="lumora-checkpoint-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)


#: Tables written by this process that are still there.
_written: list[str] = []


def _folder(spark: SparkSession) -> str:
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table of its own into the shared checkpoint folder, and go on from there.

    A table read back knows its true size; a checkpoint would keep the plan's estimates, which multiply with every
    join of an iteration until the numbers themselves stall the planner.
    """
    spark = df.sparkSession
    prepare(spark)
    path = f"{_folder(spark)}/lumora-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


stored = cut


def written() -> set[str]:
    """The tables that this process has written and not removed."""
    return set(_written)


def sweep(spark: SparkSession, before: set[str], keep: DataFrame | None = None) -> None:
    """Remove the tables written since there were those before, but for those that keep reads; results of theirs not read yet are lost."""
    files = " ".join(keep.inputFiles()) if keep is not None else ""
    for path in [x for x in _written if x not in before]:
        if path.rsplit("/", 1)[1] not in files:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
            _written.remove(path)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A kernel over batches that gives its memory back when a partition ends; Python workers stay and would keep it."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key that holds more than one row in SHARE is hot: there are fewer than SHARE of them, however many keys there are.
SHARE, COLD = 500, 500


def heavy(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, salts): the keys of rows (written already) that hold more than a SHARE-th of them, and into how many parts
    that size each would have to be cut. Fewer than SHARE rows, so they may be broadcast."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("k__")).where(F.col("k__") > COLD)
    limit = max(COLD, rows.count() // SHARE)
    return cut(counts.where(F.col("k__") > limit).select(*keys, F.ceil(F.col("k__") / limit).cast("int").alias("salts__")))


def salted(rows: DataFrame, hot: DataFrame, by: str, *keys: str) -> DataFrame:
    """rows with the part (salt__) of their key, by the hash of a column."""
    return rows.join(F.broadcast(hot), list(keys), "left").withColumn("salt__", F.coalesce(F.pmod(F.xxhash64(by), F.col("salts__")), F.lit(0)).cast("int")).drop("salts__")


def spread(rows: DataFrame, hot: DataFrame, *keys: str) -> DataFrame:
    """rows once for each part (salt__) of their key."""
    return rows.join(F.broadcast(hot), list(keys), "left").withColumn("salt__", F.explode(F.sequence(F.lit(0), F.coalesce("salts__", F.lit(1)) - 1))).drop("salts__")


#: Least and most bits of the bitmaps that say which keys can't be in a set; one holds bits / 64 rows at most, so 2**20 whatever the set's size.
MARK_BITS = (1 << 20, 1 << 26)


def _hash(df: DataFrame, key: str):
    """Equal for equal strings, and for equal keys of any integer type."""
    return F.xxhash64(F.col(key) if dict(df.dtypes)[key] in ("string", "binary") else F.col(key).cast("long"))


def marks(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(word, bits): a bitmap of the hashes of keys (written already), and its length, some 16 bits a key."""
    size = min(MARK_BITS[1], max(MARK_BITS[0], 1 << (16 * keys.count()).bit_length()))
    place = F.pmod(_hash(keys, key), F.lit(size))
    spots = keys.select(F.floor(place / 64).cast("long").alias("word"), F.pmod(place, F.lit(64)).cast("int").alias("at"))
    return spots.selectExpr("word", "shiftleft(1L, at) bit").groupBy("word").agg(F.bit_or("bit").alias("bits")), size


def marked(df: DataFrame, key: str, bitmap: tuple[DataFrame, int], inside: bool = True) -> DataFrame:
    """The rows of df whose key may be in the bitmap's set (all that are, and few others while the set is small); or those whose key isn't."""
    bits, size = bitmap
    place = F.pmod(_hash(df, key), F.lit(size))
    hit = F.expr("coalesce(shiftright(bits, at__) & 1L, 0L) = 1L")
    out = df.withColumns({"word__": F.floor(place / 64).cast("long"), "at__": F.pmod(place, F.lit(64)).cast("int")})
    out = out.join(F.broadcast(bits.withColumnRenamed("word", "word__")), "word__", "inner" if inside else "left")
    return out.where(hit if inside else ~hit).select(*(F.col(f"`{c}`") for c in df.columns))


def without(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """df without the rows whose key is among keys (which should be written already); only rows that the bitmap can't clear are shuffled."""
    bitmap = marks(keys, key)
    # an anti join would be pushed below the bitmap's, and shuffle all rows
    listed = keys.select(key).distinct().withColumn("listed__", F.lit(True))
    rest = marked(df, key, bitmap).join(listed, key, "left").where("listed__ is null").select(*(F.col(f"`{c}`") for c in df.columns))
    return marked(df, key, bitmap, inside=False).union(rest)


#: Edges that one task joins by itself, a few MB; longer lists take rounds of jobs.
ALONE = 1 << 18


def _alone(e: DataFrame) -> DataFrame:
    """components of the edges (u, v) by union-find in one task."""
    kind = e.schema["u"].dataType

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if t is None or not t.num_rows:
            return
        nodes, at = np.unique(np.concatenate((t["u"].to_numpy(), t["v"].to_numpy())), return_inverse=True)
        up = list(range(len(nodes)))  # the parent is never the larger node
        for a, b in zip(at[: t.num_rows].tolist(), at[t.num_rows :].tolist(), strict=True):
            while up[a] != a:
                up[a] = a = up[up[a]]
            while up[b] != b:
                up[b] = b = up[up[b]]
            up[max(a, b)] = min(a, b)
        for x in range(len(up)):
            up[x] = up[up[x]]
        roots = nodes[up]
        for lo in range(0, len(up), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 10_000], t["u"].type) for x in (nodes, roots)], names=["node", "root"])

    return cut(e.coalesce(1).mapInArrow(run, f"node {kind.simpleString()}, root {kind.simpleString()}"))


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(node, root): the least node that each node of an undirected edge list can reach.

    A list of ALONE edges or fewer is joined by one task. A longer one takes alternating large-star and small-star
    steps: each node's neighbours are re-linked to the least of
    them, until the edge list no longer changes or is short enough for one task; every round's list is cut by a checkpoint. Only counts
    and sums come to the driver. Minima are pre-aggregated, and the nodes that hold a large share of all edges (a giant
    component's centre) are looked up in a broadcast of bounded size, so no task gets a centre's neighbours. Nodes
    without an edge have no row. Null ends, loops and repeated edges are allowed and change nothing.
    """
    x, y = F.col(a), F.col(b)
    e = cut(edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")))
    if e.count() <= ALONE:
        return _alone(e)
    e = cut(e.distinct())
    nodes = None
    before = None
    for _ in range(most):
        sums = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if nodes is None:
            nodes = cut(e.select(F.col("u").alias("node")).union(e.select("v")).distinct())
        if before == tuple(sums):
            break
        if sums[0] <= ALONE:  # every node of a component keeps an edge
            return _alone(e)
        before = tuple(sums)
        both = e.union(e.select("v", "u"))
        large = cut(_lowest(both, sums[0] * 2).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        small = _lowest(large, sums[0]).select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("x"))
        e = cut(small.select("x.u", "x.v").where("u != v").distinct())
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    # a settled list is a star around each component's least node
    return nodes.join(e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _lowest(rows: DataFrame, n: int) -> DataFrame:
    """(u, v, m): each edge with the least of u and its neighbours; edges of hot nodes are not shuffled by them."""
    low = cut(rows.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("k")))
    limit = max(COLD, n // SHARE)
    hot = F.broadcast(low.where(F.col("k") > limit).select("u", F.col("m").alias("hot")))  # fewer than SHARE rows
    rows = rows.join(hot, "u", "left")
    cold = rows.where("hot is null").join(low.where(F.col("k") <= limit).select("u", "m"), "u")
    return rows.where("hot is not null").select("u", "v", F.col("hot").alias("m")).union(cold.select("u", "v", "m"))
