"""Embedding near-dedup by NN-descent on bit sketches, with exact verification.

Vectors are compared only within a label that isn't null (and within a dimension), by cosine in double precision;
vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Equal vectors of a label
form a class that counts once in all comparisons; its members are linked with each other.

1. Every class has a sketch: the signs of its vector against BITS random hyperplanes. Distances are Hamming distances of sketches.
2. Seeds: classes are ordered by the bits of their sketch from some place on, and each meets the REACH next ones. An order
   gives each class its first neighbours; the number of orders grows with the logarithm of the label's size, so that a
   linked pair meets in none with a probability of MISS at most.
3. Descent: each class keeps a list of its K nearest. In a round, all that have a class in their list or are in its list
   meet there (neighbours of neighbours), if one of them is new there; those next to each other in some more orders meet too.
   Rounds follow each other until all orders are used and the last one found nothing that may be a link, or changed
   no more than SETTLED of the entries.
4. Saturation: a list whose entries may be links for the most part grows to twice these, up to LONGEST. Where a list is
   full at that length, all that entries connect with it is a group that is counted whole: members within half the links' angle of the
   group's mean direction are all linked with each other (angles obey the triangle inequality), which takes one pass; the
   others are compared with the whole group in blocks. Neither makes a list of a group's pairs.
5. Entries that may be links are verified on the vectors; only those of LEAST or more stay.
6. Audit: PROBES vectors at the links' very angle to some class are searched for along with the others, and the links of
   AUDIT classes (picked by hash) are counted against all vectors. If less than RECALL of either was found, the search is done
   again with other sketches and twice the orders, and its lists join those before; after ATTEMPTS it raises. ``audit_log``
   has the figures, ``search_log`` the entries that may be links after the seeds and after each round.

Rows meet in sorted order, dealt by ranges that split any key, each with the next ones: no class, list or group needs one
task. Rows that repeat a vec_id keep a row each and are linked as copies are if their vectors are equal. Further columns
are ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jobs import components, cut, heavy, prepare, salted, spread, table, tidy
from .text import column

LEAST = 0.98
BITS, K, LONGEST = 256, 6, 64
REACH, MEET, SETTLED, MISS = 8, 48, 0.05, 1e-4
#: Sketches of linked vectors differ in more bits with a probability below 1e-6.
CLOSE = 38
BLOCK = 1024
AUDIT, PROBES, RECALL, ATTEMPTS = 500, 300, 0.99, 3
audit_log: list[dict[str, int]] = []
search_log: list[tuple[int, int, int]] = []
_LONGS = BITS // 64


def orders(n: int) -> int:
    """How many orders a label of n classes takes: in one, a linked pair is next to each other if the bits that tell n apart are equal."""
    same = (1 - math.acos(LEAST) / math.pi) ** max(1.0, math.log2(max(2, n) / REACH))
    return min(BITS, 4 * math.ceil(math.log(MISS) / math.log(1 - same) / 4))


def _units(raw: list[bytes], kind: str) -> np.ndarray:
    v = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # else squares of large components overflow
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True)) + 0.0


def _planes(seed: int, dim: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, dim])).normal(size=(dim, BITS))


def sketches(units: np.ndarray, seed: int) -> np.ndarray:
    return np.packbits(units @ _planes(seed, units.shape[1]) > 0, axis=1)


def _class_batches(kind: str):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                keys, raws = [], []
                for label, x in zip(column(part, "label").to_pylist(), column(part, "embedding").to_pylist(), strict=True):
                    key = raw = None
                    if label is not None and x and None not in x:
                        v = np.asarray(x, dtype=kind)
                        if np.isfinite(v).all() and np.abs(v).max() > 0:
                            raw = v.tobytes()
                            key = hashlib.blake2b(f"{label}:".encode() + _units([raw], kind)[0].tobytes(), digest_size=16).digest()
                    raws.append(raw)
                    keys.append(key)
                yield pa.RecordBatch.from_arrays([column(part, "vec_id"), column(part, "label"), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], names=["vec_id", "label", "key", "raw"])

    return run


def _sketch_batches(kind: str, seed: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, out = column(b, "raw").to_pylist(), np.zeros((b.num_rows, _LONGS), dtype=np.int64)
            lengths = np.array([len(x) for x in raw], dtype=np.int64)
            for n in set(lengths.tolist()):
                at = np.flatnonzero(lengths == n)
                out[at] = sketches(_units([raw[i] for i in at], kind), seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([column(b, "cid"), column(b, "part"), column(b, "orders"), *(pa.array(out[:, i]) for i in range(_LONGS))], names=["cid", "part", "orders", *(f"s{i}" for i in range(_LONGS))])

    return run


_SKETCH = ", ".join(f"s{i} long" for i in range(_LONGS))


@tidy
def _meet_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (way, at, o, cid, fresh, worst, sketch): each meets the next rows of its way and place; what is nearer to a class than the worst of its list comes out."""
    held: dict[str, np.ndarray] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        rows = {x: column(b, x).to_numpy(zero_copy_only=False) for x in ("way", "at", "cid", "fresh", "worst", *(f"s{i}" for i in range(_LONGS)))}
        n0 = 0
        if held is not None:
            n0 = len(held["cid"])
            rows = {x: np.concatenate((held[x], v)) for x, v in rows.items()}
        n = len(rows["cid"])
        a_all, b_all, h_all = [], [], []
        s = np.column_stack([rows[f"s{i}"] for i in range(_LONGS)]).view(np.uint64)
        for d in range(1, min(n, MEET + 1)):
            i = np.arange(max(0, n0 - d), n - d)  # pairs within the rows held were met before
            reach = rows["way"][i] < 0
            if d > REACH:
                i = i[reach]
            j = i + d
            together = (rows["way"][i] == rows["way"][j]) & (rows["at"][i] == rows["at"][j])
            i, j = i[together], j[together]
            if not len(i) and d >= REACH:
                break
            on = (rows["fresh"][i] | rows["fresh"][j]) & (rows["cid"][i] != rows["cid"][j])
            i, j = i[on], j[on]
            h = np.bitwise_count(s[i] ^ s[j]).sum(axis=1).astype(np.int32)
            for x, y in ((i, j), (j, i)):
                good = h < rows["worst"][x]
                a_all.append(rows["cid"][x[good]]), b_all.append(rows["cid"][y[good]]), h_all.append(h[good])
        if a_all:
            a, o, h = np.concatenate(a_all), np.concatenate(b_all), np.concatenate(h_all)
            order = np.lexsort((o, h, a))
            a, o, h = a[order], o[order], h[order]
            new = np.concatenate(([True], (a[1:] != a[:-1]) | (o[1:] != o[:-1])))
            a, o, h = a[new], o[new], h[new]
            first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, dtype=np.int64)
            rank = np.arange(len(a)) - np.repeat(first, np.diff(np.concatenate((first, [len(a)]))))
            keep = rank < np.where(h <= CLOSE, LONGEST, K)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(o[keep]), pa.array(h[keep], pa.int32())], names=["cid", "other", "ham"])
        held = {x: v[-MEET:].copy() for x, v in rows.items()}


def _order(way: int) -> str:
    """SQL: the 64 bits of a sketch from one place on."""
    at = way * 37 % BITS
    i, r = divmod(at, 64)
    return f"s{i}" if not r else f"shiftleft(s{i}, {r}) | shiftrightunsigned(s{(i + 1) % _LONGS}, {64 - r})"


def _lists(rows: DataFrame) -> DataFrame:
    """Rows (cid, other, ham, old) as lists (cid, l, worst) of the nearest, with those marked that weren't there before."""
    got = rows.groupBy("cid").agg(F.array_sort(F.collect_set(F.struct("ham", "other"))).alias("all"), F.collect_set(F.when(F.col("old"), F.col("other"))).alias("old"))
    close = F.size(F.filter("all", lambda x: x.ham <= CLOSE))
    width = F.least(F.lit(LONGEST), F.greatest(F.lit(K), close * 2))
    got = got.select("cid", F.slice("all", F.lit(1), width).alias("l"), "old", width.alias("width"))
    worst = F.when(F.size("l") < F.col("width"), BITS + 1).otherwise(F.element_at("l", -1).ham)
    return got.select("cid", F.transform("l", lambda x: F.struct(x.ham.alias("ham"), x.other.alias("other"), (~F.array_contains("old", x.other)).alias("fresh"))).alias("l"), worst.cast("int").alias("worst"))


def _no_lists(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "cid long, l array<struct<ham:int,other:long,fresh:boolean>>, worst int")


def _search(classes: DataFrame, kind: str, seed: int, factor: int) -> DataFrame:
    """(cid, l): the lists of all classes (cid, part, n, raw) after the descent."""
    steps = F.create_map(*(F.lit(x) for i in range(64) for x in (i, min(BITS, orders(2**i) * factor))))
    rows = classes.withColumn("orders", F.element_at(steps, F.ceil(F.log2(F.greatest("n", F.lit(2)))).cast("int")))
    sk = cut(rows.mapInArrow(_sketch_batches(kind, seed), f"cid long, part long, orders int, {_SKETCH}"))
    most = sk.agg(F.max("orders")).first()[0] or 0
    names = [f"s{i}" for i in range(_LONGS)]
    lists, done, round_ = None, 0, 0
    if not most:
        return _no_lists(classes.sparkSession)
    while True:
        ways = range(done, min(most, done + (6 if lists is None else 3)))
        done += len(ways)
        worst = sk if lists is None else sk.join(lists.select("cid", "worst"), "cid", "left")
        worst = worst.withColumn("worst", F.lit(BITS + 1) if lists is None else F.coalesce("worst", F.lit(BITS + 1)))
        meet = None
        if ways:
            meet = worst.select("cid", "worst", *names, F.explode(F.array(*(F.when(F.col("orders") > w, F.struct(F.lit(w).alias("way"), F.col("part").alias("at"), F.expr(_order(w)).alias("o"))) for w in ways))).alias("x"))
            meet = meet.where("x is not null").select("x.way", "x.at", "x.o", "cid", F.lit(True).alias("fresh"), "worst", *names)
        if lists is not None:
            entries = lists.select("cid", F.explode("l").alias("x")).select("cid", "x.other", "x.fresh")
            pairs = entries.select(F.col("cid").alias("at"), F.col("other").alias("cid"), "fresh").union(entries.select(F.col("other").alias("at"), "cid", "fresh")).union(lists.select(F.col("cid").alias("at"), "cid", F.lit(False)))
            near = pairs.join(worst.select("cid", "worst", *names), "cid").select(F.lit(-1).alias("way"), "at", F.lit(0).cast("long").alias("o"), "cid", "fresh", "worst", *names)
            meet = near if meet is None else meet.union(near)
        keys = ["way", "at", "o", F.xxhash64("cid", F.lit(round_)), "cid"]
        found = meet.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_meet_batches, "cid long, other long, ham int").withColumn("old", F.lit(False))
        if lists is not None:
            found = found.union(lists.select("cid", F.explode("l").alias("x")).select("cid", "x.other", "x.ham", F.lit(True).alias("old")))
        lists = cut(_lists(found))
        sums = lists.agg(F.sum(F.size("l")).alias("n"), F.sum(F.size(F.filter("l", lambda x: x.fresh))).alias("fresh"), F.sum(F.size(F.filter("l", lambda x: x.ham <= CLOSE))).alias("close")).first()
        search_log.append((round_, sums.fresh or 0, sums.close or 0))
        round_ += 1
        still = round_ == 1 or sums.fresh > SETTLED * sums.n and sums.close > close
        close = sums.close
        if not sums.n or done >= most and not still:
            return lists


def _verify_batches(kind: str):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = column(b, "raw_a").to_pylist(), column(b, "raw_b").to_pylist()
            keep = np.zeros(b.num_rows, dtype=bool)
            lengths = np.array([len(v) if len(v) == len(w) else -1 for v, w in zip(x, y, strict=True)], dtype=np.int64)
            for n in set(lengths[lengths >= 0].tolist()):
                at = np.flatnonzero(lengths == n)
                for lo in range(0, len(at), 4096):
                    own = at[lo : lo + 4096]
                    keep[own] = (_units([x[i] for i in own], kind) * _units([y[i] for i in own], kind)).sum(axis=1) >= LEAST
            yield pa.RecordBatch.from_arrays([column(b, "a"), column(b, "b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(pairs: DataFrame, classes: DataFrame, kind: str) -> DataFrame:
    """Of distinct pairs (a, b) those that are links, verified on the vectors."""
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("part").alias(f"part_{x}"), F.col("raw").alias(f"raw_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where("part_a = part_b").mapInArrow(_verify_batches(kind), "a long, b long")


_HALF = math.acos(LEAST) / 2


def _sum_batches(kind: str):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roots = column(b, "root").to_numpy()
            raw = column(b, "raw").to_pylist()
            out = []
            for root in np.unique(roots).tolist():
                at = np.flatnonzero(roots == root)
                out.append((root, _units([raw[i] for i in at], kind).sum(axis=0).tobytes(), len(at)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.int64())], names=["root", "sums", "n"])

    return run


def _sum_group(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x) for x in t["sums"].to_pylist())
    return pa.table({"root": t["root"][:1], "mean": pa.array([(total / max(np.sqrt(total @ total), 1e-300)).tobytes()], pa.binary()), "n": pa.array([sum(t["n"].to_pylist())], pa.int64())})


def _core_batches(kind: str):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, mean = column(b, "raw").to_pylist(), column(b, "mean").to_pylist()
            core = [bool((_units([x], kind)[0] * np.frombuffer(m)).sum() >= math.cos(_HALF) + 1e-9) for x, m in zip(raw, mean, strict=True)]
            yield pa.RecordBatch.from_arrays([*(column(b, x) for x in ("root", "cid", "mult", "n")), pa.array(core, pa.bool_()), column(b, "raw")], names=["root", "cid", "mult", "n", "core", "raw"])

    return run


def _tile(kind: str):
    def run(t: pa.Table) -> pa.Table:
        """A block of members off the core against a block of all: links of the former, what they add to those in the core, and the least class each reaches."""
        t = t.combine_chunks()
        left, ids, mult, core = (t[x].to_numpy(zero_copy_only=False) for x in ("left", "cid", "mult", "core"))
        units = _units(t["raw"].to_pylist(), kind)
        p, q = np.flatnonzero(left), np.flatnonzero(~left)
        hit = (units[p] @ units[q].T >= LEAST) & (ids[p][:, None] != ids[q][None, :])
        add = np.zeros(len(ids), dtype=np.int64)
        add[p] = hit @ mult[q]
        add[q] = np.where(core[q], mult[p] @ hit, 0)
        root, none = ids.copy(), np.iinfo(np.int64).max
        while len(p) and len(q):
            root_p = np.minimum(root[p], np.where(hit, root[q][None, :], none).min(axis=1))
            root_q = np.minimum(root[q], np.where(hit, root_p[:, None], none).min(axis=0))
            if (root_p == root[p]).all() and (root_q == root[q]).all():
                break
            root[p], root[q] = root_p, root_q
        return pa.table({"cid": pa.array(ids), "add": pa.array(add), "root": pa.array(root)}).filter(pa.array((add > 0) | (root < ids)))

    return run


def _whole(members: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(cid, add): the links within groups of all their members (root, cid, mult, raw); (a, b): links that connect what is linked in them."""
    sums = members.select("root", "raw").mapInArrow(_sum_batches(kind), "root long, sums binary, n long")
    means = cut(sums.groupBy("root").applyInArrow(_sum_group, "root long, mean binary, n long"))
    hot = heavy(members, "root")
    near = salted(members, hot, "cid", "root").join(spread(means, hot, "root"), ["root", "salt__"])
    near = cut(near.select("root", "cid", "mult", "n", "raw", "mean").mapInArrow(_core_batches(kind), "root long, cid long, mult long, n long, core boolean, raw binary"))
    off = near.where("not core").groupBy("root").agg(F.count("*").alias("off"))
    inner = near.where("core").groupBy("root").agg(F.sum("mult").alias("inner"), F.min("cid").alias("head"))
    sizes = cut(means.select("root", "n").join(off, "root", "left").join(inner, "root", "left").na.fill(0, ["off", "inner"]))
    near = salted(near.drop("n"), hot, "cid", "root").join(spread(sizes, hot, "root"), ["root", "salt__"])
    own = near.where("core").select("cid", (F.col("inner") - F.col("mult")).alias("add"), F.col("head").alias("root"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("long")
    rows = near.where("off > 0").select("root", "cid", "mult", "core", "raw", "off", F.col("n").alias("size"))
    every = rows.select("root", "cid", "mult", "core", "raw", F.lit(False).alias("left"), F.pmod(F.xxhash64("cid"), blocks("size")).alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), blocks("off") - 1)).alias("i"))
    outer = rows.where("not core").select("root", "cid", "mult", "core", "raw", F.lit(True).alias("left"), F.pmod(F.xxhash64("cid", F.lit(1)), blocks("off")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), blocks("size") - 1)).alias("j"))
    tiles = every.unionByName(outer).groupBy("root", "i", "j").applyInArrow(_tile(kind), "cid long, add long, root long")
    both = cut(own.union(tiles))
    return both.groupBy("cid").agg(F.sum("add").alias("add")), both.where("root < cid").select(F.col("cid").alias("a"), F.col("root").alias("b")).distinct()


def _audit_batches(sample, kind: str):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for part in {x[1] for x in sample.value}:
            mine = [x for x in sample.value if x[1] == part]
            own[part] = np.array([x[0] for x in mine]), _units([x[2] for x in mine], kind)
        for b in batches:
            parts, cid, mult, raw = column(b, "part").to_numpy(), column(b, "cid").to_numpy(), column(b, "mult").to_numpy(), column(b, "raw").to_pylist()
            ids, counts = [], []
            for part, (have, units) in own.items():
                at = np.flatnonzero(parts == part)
                if len(at):
                    hit = (units @ _units([raw[i] for i in at], kind).T >= LEAST) & (have[:, None] != cid[at][None, :])
                    ids.append(have), counts.append(hit @ mult[at])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids) if ids else [], pa.int64()), pa.array(np.concatenate(counts) if ids else [], pa.int64())], names=["cid", "n"])

    return run


def _probes(sample: list, kind: str, seed: int) -> list[tuple]:
    """(cid, part, raw, n, of): vectors at the links' angle to those of a sample."""
    rng, out = np.random.Generator(np.random.PCG64(seed)), []
    for k, (cid, part, raw, n) in enumerate(sample):
        unit = _units([raw], kind)[0]
        if len(unit) < 2:
            continue
        off = rng.normal(size=len(unit))
        off -= (off @ unit) * unit
        off /= np.sqrt(off @ off)
        cos = LEAST + 1e-4
        out.append((-1 - k, part, (cos * unit + math.sqrt(1 - cos * cos) * off).astype(kind).tobytes(), n, cid))
    return out


def _classes(units: DataFrame) -> DataFrame:
    """(key, cid, vec, mult, part, raw): classes of equal vectors, numbered in order of their least vec_id."""
    got = units.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("vec"), F.count("*").alias("mult"), F.first("label").alias("label"), F.min("raw").alias("raw")).where("vec is not null")
    got = got.repartitionByRange("vec", "key").sortWithinPartitions("vec", "key")
    return cut(got.select("key", F.monotonically_increasing_id().alias("cid"), "vec", "mult", F.xxhash64("label", F.length("raw")).alias("part"), "raw"))


def _joined(lists: DataFrame, more: DataFrame) -> DataFrame:
    """Lists of two searches; what may be a link by either stays one."""
    both = lists.union(more).select("cid", F.explode("l").alias("x")).select("cid", "x.other", F.when(F.col("x.ham") <= CLOSE, 0).otherwise(F.col("x.ham")).alias("ham"))
    both = both.groupBy("cid", "other").agg(F.min("ham").alias("ham")).withColumn("old", F.lit(True))
    return cut(_lists(both))


def groups(vectors: DataFrame, seed: int = 5) -> DataFrame:
    """Per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    prepare(spark)
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"
    values = vectors.selectExpr("cast(vec_id as long) vec_id", "cast(label as string) label", f"cast(embedding as array<{'float' if single else 'double'}>) embedding")
    units = cut(values.mapInArrow(_class_batches(kind), "vec_id long, label string, key binary, raw binary"))
    classes = _classes(units)
    hot = heavy(classes, "part")
    sizes = classes.groupBy("part").agg(F.count("*").alias("n"))
    sized = salted(classes, hot, "cid", "part").join(spread(sizes, hot, "part"), ["part", "salt__"]).select("cid", "part", "raw", "n")
    picked = [tuple(r) for r in sized.orderBy(F.xxhash64("cid"), "cid").limit(AUDIT).collect()]  # AUDIT rows
    sample = spark.sparkContext.broadcast(picked)
    true = sum(r.n for r in classes.mapInArrow(_audit_batches(sample, kind), "cid long, n long").groupBy("cid").agg(F.sum("n").alias("n")).collect())  # AUDIT rows
    probes = _probes(picked[:PROBES], kind, seed)
    planted = spark.createDataFrame([p[:4] for p in probes], "cid long, part long, raw binary, n long")
    want = spark.createDataFrame([(p[4], p[0]) for p in probes], "a long, b long")
    lists = None
    for attempt in range(ATTEMPTS):
        got = _search(sized.union(planted), kind, seed + attempt, 2**attempt)
        lists = got if lists is None else _joined(lists, got)
        vectors_ = classes.select("cid", "part", "raw").union(planted.drop("n"))
        close = lists.select("cid", F.explode("l").alias("x")).where(F.col("x.ham") <= CLOSE)
        pairs = cut(close.select(F.greatest("cid", "x.other").alias("a"), F.least("cid", "x.other").alias("b")).distinct())
        full = lists.where("cid >= 0").where(F.size(F.filter("l", lambda x: x.ham <= CLOSE)) >= LONGEST // 2).select("cid")
        members = None
        if not full.isEmpty():
            near = components(pairs.where("b >= 0")).select(F.col("node").alias("cid"), "root")
            members = cut(near.join(near.join(full, "cid").select("root").distinct(), "root", "left_semi").join(classes, "cid").select("root", "cid", "mult", "raw"))
        # the links of saturated groups are counted whole, others are verified one by one
        single = pairs if members is None else pairs.where("b < 0").union(pairs.where("b >= 0").join(members.select(F.col("cid").alias("a")), "a", "left_anti"))
        every = cut(_links(single, vectors_, kind))
        links = every.where("b >= 0")
        adds = links.select(F.col("a").alias("cid"), F.col("b").alias("o")).union(links.select("b", "a"))
        adds = adds.join(classes.select(F.col("cid").alias("o"), "mult"), "o").groupBy("cid").agg(F.sum("mult").alias("add"))
        if members is not None:
            more, inside = _whole(members, kind)
            adds, links = adds.union(more), links.union(inside)
        adds = cut(adds)
        roots = cut(components(links).select(F.col("node").alias("cid"), "root"))
        # a probe is found if its class, or one of the group in which its class is counted whole, is in its list or the other way round
        home = (roots.limit(0) if members is None else members).select(F.col("cid").alias("a"), "root")
        met = pairs.where("b < 0").join(home, "a", "left").select("b", F.coalesce("root", "a").alias("root"))
        found = want.join(home, "a", "left").select("b", F.coalesce("root", "a").alias("root")).join(met, ["b", "root"]).select("b").distinct().count()
        have = adds.where(F.col("cid").isin([p[0] for p in picked])).agg(F.sum("add")).first()[0] or 0
        audit_log.append({"links": true, "links found": have, "probes": len(probes), "probes found": found})
        if have >= RECALL * true and audit_log[-1]["probes found"] >= RECALL * len(probes):
            break
    else:
        raise RuntimeError(f"the descent found too little: {audit_log[-ATTEMPTS:]}")
    # classes are numbered in the order of their least ids, so a component's least class has its least id
    heads = roots.where("cid = root").join(classes.select(F.col("cid").alias("root"), F.col("vec").alias("head")), "root").select("root", "head")
    hot = heavy(roots, "root")
    heads = salted(roots, hot, "cid", "root").join(spread(heads, hot, "root"), ["root", "salt__"]).select("cid", "head")
    of = classes.select("key", "cid", "vec", "mult").join(adds, "cid", "left").join(heads, "cid", "left").select("key", "mult", "add", F.coalesce("head", "vec").alias("head"))
    hot = heavy(units.where("key is not null"), "key")
    out = salted(units.select("vec_id", "key"), hot, "vec_id", "key").join(spread(of, hot, "key"), ["key", "salt__"], "left")
    n = F.coalesce(F.col("mult") - 1 + F.coalesce("add", F.lit(0)), F.lit(0)).cast("long")
    head = F.coalesce("head", "vec_id")
    return out.select("vec_id", n.alias("n_links"), head.alias("component_id"), F.coalesce(F.col("vec_id") == head, F.lit(False)).alias("kept"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links and components of all vectors."""
    return groups(table(spark, sf_dir, "embeddings"))


_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {LEAST}),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN n ON n.a = vec_id
"""

QUERIES = {"op10_embedding_dedup": op10_embedding_dedup}
ORACLE = {"op10_embedding_dedup": _SQL}
