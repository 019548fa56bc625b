"""MinHash near-dedup with SetSketch registers.

A document's set is the distinct SHINGLE-word shingles of its whole text (words end at white space, A-Z lower-cased;
a text of fewer words is one shingle; a text without words has an empty set and is linked with nothing). Documents are
linked if the Jaccard similarity of their sets is THRESHOLD or more, which is always confirmed on the full sets.

1. Documents with equal sets form a class; all that follows is on classes, so copies never meet in pairs.
2. A class has ROWS * BANDS SetSketch registers: for each register the least of the elements' exponentially distributed
   values x is kept as floor(1 - log_BASE(x)), truncated to a byte. Registers of a union are the maxima of its parts'.
   Two sets' registers are equal with a probability of about their similarity.
3. ROWS registers make a band. Classes that share a band's values share a bucket: at THRESHOLD a pair shares none with a
   probability below 1e-5, and less above.
4. In each bucket every class is paired with the bucket's first and last class only. Pairs pass if the similarity that
   is likeliest, jointly for all registers and given the sets' sizes, is LIKELY or more (5 standard deviations below
   THRESHOLD), and are then verified on the sets.
5. Buckets whose classes are not yet all connected are compared whole: cut into blocks of at most BLOCK classes and some
   MASS shingles, block against block. Pairs of
   different components that pass the likelihood, each in the first bucket it shares, are verified where they meet: their
   classes' texts come to the block, and only links that connect components leave it. So every pair that shares a
   bucket is connected already or decided, and no list of a group's pairs is made.

Rows that share a doc_id are one document as for components (they get a row each). A null doc_id is never linked by
itself, has the component of its class's least id if there is one, and isn't kept. Shingles are compared as 64-bit hashes: two different ones of a
pair pass for one with a probability of some 1e-19. Null texts count as empty. Further
columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .jobs import COLD, SHARE, components, cut, marked, marks, prepare, salted, spread, table, tidy, without
from .text import SPACED, Words, column, mix, shingle_sets, slices

SHINGLE, THRESHOLD = 5, (75, 100)
ROWS, BANDS, BASE, SCALE = 5, 44, 1.1, 20.0
REGISTERS = ROWS * BANDS
LIKELY = 0.6
STAR, BLOCK, MASS = 256, 1024, 1_000_000  # classes and shingles of a block
_rng = np.random.Generator(np.random.PCG64(99))
_A = _rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """The registers of each set (hashes of its elements); an empty set's are 0."""
    low = np.full((len(sets), REGISTERS), 0xFFFFFFFF, dtype=np.uint32)
    for i, s in enumerate(sets):
        x = (s >> np.uint64(32)).astype(np.uint32)
        for lo in range(0, len(x), 1024):
            v = x[None, lo : lo + 1024] ^ _B[:, None]
            v *= _A[:, None]
            np.minimum(low[i], v.min(axis=1), out=low[i])
    u = (low.astype(np.float64) + 0.5) / 2.0**32
    x = -np.log1p(-u) / SCALE
    out = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 255).astype(np.uint8)
    out[[not len(s) for s in sets]] = 0
    return out


def bands(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each set and band."""
    r = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    key = np.zeros((len(regs), BANDS), dtype=np.uint64)
    for j in range(ROWS):
        key = key << np.uint64(8) | r[:, :, j]
    return mix(key ^ (np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(48)))


_GRID = np.linspace(0, 1, 101)


def likeliest(higher: np.ndarray, lower: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The similarity that is likeliest given how many registers of a are higher and lower than b's, and the sets' sizes."""
    out = np.zeros(len(higher))
    log_b = np.log(BASE)
    for lo in range(0, len(higher), 4096):
        s = slice(lo, lo + 4096)
        u = (n_a[s] / (n_a[s] + n_b[s]))[:, None]
        v = 1 - u
        j = _GRID[None, :] * np.minimum(u / v, v / u)
        p = lambda x: -np.log1p(-x * (BASE - 1) / BASE) / log_b
        up, down = p(np.clip(u - v * j, 0, 1)), p(np.clip(v - u * j, 0, 1))
        same = REGISTERS - higher[s] - lower[s]
        tiny = 1e-300
        fit = higher[s][:, None] * np.log(np.maximum(up, tiny)) + lower[s][:, None] * np.log(np.maximum(down, tiny)) + same[:, None] * np.log(np.maximum(1 - up - down, tiny))
        best = fit.argmax(axis=1)
        out[s] = j[np.arange(len(best)), best]
    return out


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted distinct arrays are as similar as THRESHOLD."""
    if not len(a) or not len(b):
        return False
    num, den = THRESHOLD
    if min(len(a), len(b)) * den < max(len(a), len(b)) * num:
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return den * both >= num * (len(a) + len(b) - both)


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray]]]:
    for lo, _, raw, off in slices(column(batch, "text")):
        yield lo, shingle_sets(Words(raw, off, SPACED), SHINGLE)


def _digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


@tidy
def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = column(batch, "doc_id")
        for lo, sets in _sets(batch):
            regs = registers(sets)
            keys = [_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [ids[lo : lo + len(sets)], pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([r.tobytes() if len(s) else None for r, s in zip(regs, sets, strict=True)], pa.binary())],
                names=["doc_id", "n_shingles", "set", "regs"],
            )


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set (a digest of the shingle set, null if empty), regs (the registers)."""
    prepare(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_sketch_batches, "doc_id long, n_shingles long, set binary, regs binary")


def _matrix(regs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(regs.to_pylist()), dtype=np.uint8).reshape(-1, REGISTERS)


@tidy
def _band_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 2000):
            part = b.slice(lo, 2000)
            keys = bands(_matrix(column(part, "regs")))
            ids = np.repeat(column(part, "cid").to_numpy(), BANDS)
            n = np.repeat(np.minimum(column(part, "n_shingles").to_numpy(), 1 << 30), BANDS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids), pa.array(n)], names=["bucket", "cid", "n"])


@tidy
def _likely_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, y = _matrix(column(b, "regs_a")), _matrix(column(b, "regs_b"))
        j = likeliest((x > y).sum(axis=1), (x < y).sum(axis=1), column(b, "n_a").to_numpy(), column(b, "n_b").to_numpy())
        keep = pa.array(j >= LIKELY)
        yield pa.RecordBatch.from_arrays([column(b, "a").filter(keep), column(b, "b").filter(keep)], names=["a", "b"])


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of distinct pairs (a, b) those whose registers make LIKELY or more the likeliest similarity."""
    num, den = THRESHOLD
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where((F.least("n_a", "n_b") * den) >= (F.greatest("n_a", "n_b") * num))
    return both.mapInArrow(_likely_batches, "a long, b long")


@tidy
def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (b, salt), the centre's own text first: the centre is held, the others pass by."""
    held, centre = None, None
    for batch in batches:
        out = []
        b, salt, member, ids = (column(batch, x).to_numpy() for x in ("b", "salt", "member", "doc_id"))
        for lo, sets in _sets(batch):
            for i, s in enumerate(sets, lo):
                if not member[i]:
                    held, centre = (b[i], salt[i]), s
                elif held == (b[i], salt[i]) and linked(centre, s):
                    out.append((ids[i], b[i]))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["a", "b"])


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of distinct pairs (a, b), written already, those whose full sets are linked, again for a doc_id's further rows; texts travel once for each pair's a and each STAR pairs of a b."""
    # a table of its own: where few centres have many pairs, the pairs need no shuffle to find their parts
    size = cut(pairs.groupBy("b").agg(F.count("*").alias("k")).where(F.col("k") > STAR))
    salted = pairs.join(size, "b", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("a"), F.ceil(F.col("k") / STAR)), F.lit(0)).alias("salt"))
    needs = salted.select(F.col("a").alias("doc_id"), "b", "salt", F.lit(1).alias("member")).union(salted.select(F.col("b"), "b", "salt", F.lit(0)).distinct())
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    texts = marked(docs.selectExpr("cast(doc_id as long) doc_id", "text"), "doc_id", marks(ends, "doc_id"))
    rows = texts.join(needs, "doc_id")
    return rows.repartition("b", "salt").sortWithinPartitions("b", "salt", "member", "doc_id").mapInArrow(_verify_batches, "a long, b long")


def _tile_pairs(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The likely pairs of a block against a block of a bucket, as row numbers, and how likely they are alike.

    Only pairs in different components, and each only in the first of all buckets that it shares.
    """
    bucket, i, j = (t[x][0].as_py() for x in ("bucket", "i", "j"))
    own, regs = t["block"].to_numpy(), _matrix(t["regs"])
    cid, comp, n = (t[x].to_numpy() for x in ("cid", "comp", "n_shingles"))
    keys = bands(regs).view(np.int64)
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    num, den = THRESHOLD
    pairs = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
    for a in left.tolist():
        b = right[cid[right] > cid[a]] if i == j else right
        b = b[(comp[b] != comp[a]) & (np.minimum(n[b], n[a]) * den >= np.maximum(n[b], n[a]) * num)]
        b = b[keys[a][(keys[b] == keys[a]).argmax(axis=1)] == bucket]
        x, y = regs[a][None, :], regs[b]
        close = (x == y).sum(axis=1) >= 0.4 * REGISTERS  # far below what LIKELY asks for
        b, y = b[close], y[close]
        if len(b):
            alike = likeliest((x > y).sum(axis=1), (x < y).sum(axis=1), np.full(len(b), n[a]), n[b])
            keep = alike >= LIKELY
            pairs.append((np.full(int(keep.sum()), a), b[keep], alike[keep]))
    return tuple(np.concatenate(x) for x in zip(*pairs, strict=True))


def _tile_members(t: pa.Table) -> pa.Table:
    """The classes of a tile that are in a likely pair."""
    a, b, _ = _tile_pairs(t)
    return t.select(["bucket", "i", "j", "block", "cid", "comp"]).take(pa.array(np.unique(np.concatenate((a, b)))))


def _tile_links(t: pa.Table) -> pa.Table:
    """Links, verified on the full sets, that connect what is linked in a tile; the likeliest pairs come first."""
    t = t.combine_chunks()
    sets = [s for c in t["text"].chunks for *_, raw, off in slices(c) for s in shingle_sets(Words(raw, off, SPACED), SHINGLE)]
    cid, of = t["cid"].to_numpy(), dict(enumerate(t["comp"].to_pylist()))
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.get(x, x) != x:
            up[x] = x = up.get(up[x], up[x])
        return x

    a, b, alike = _tile_pairs(t)
    out = []
    for k in np.argsort(-alike, kind="stable").tolist():
        x, y = int(a[k]), int(b[k])
        p, q = root(of[x]), root(of[y])
        if p != q and linked(sets[x], sets[y]):
            up[p] = q
            out.append((max(cid[x], cid[y]), min(cid[x], cid[y])))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})


def link(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sketches of the documents, classes, links between classes that connect all that are linked)."""
    sketches = cut(sketch(docs))
    classes = cut(sketches.where("set is not null").groupBy("set").agg(F.min("doc_id").alias("cid"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs")).where("cid is not null"))
    rows = classes.select("cid", "regs", "n_shingles").mapInArrow(_band_batches, "bucket long, cid long, n int")
    shared = cut(rows.groupBy("bucket").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi"), F.count("*").alias("k"), F.sum("n").alias("mass")).where("k > 1 and lo < hi"))
    # buckets that hold a large share of all rows, a handful at most, are cut into parts
    limit = max(COLD, (shared.agg(F.sum("k")).first()[0] or 0) // SHARE)
    hot = cut(shared.where(F.col("k") > limit).select("bucket", F.ceil(F.col("k") / limit).cast("int").alias("salts__")))
    members = cut(salted(rows, hot, "cid", "bucket").join(spread(shared, hot, "bucket"), ["bucket", "salt__"]).drop("salt__", "n"))
    near = F.explode(F.array("lo", "hi")).alias("c")
    pairs = members.select("cid", near).where("cid != c").select(F.greatest("cid", "c").alias("a"), F.least("cid", "c").alias("b")).distinct()
    tested = cut(likely(pairs, classes))
    links = cut(verify(tested, docs))
    comps = components(links)
    # what is left: buckets that hold several components
    inside = members.select("bucket", "cid", "k", "mass").join(comps.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("root", "cid"))
    # in a bucket of two classes the pair is decided by now
    open_ = cut(inside.where("k > 2").groupBy("bucket").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least < most").select("bucket"))
    todo = salted(inside.where("k > 2"), hot, "cid", "bucket").join(spread(open_, hot, "bucket"), ["bucket", "salt__"], "left_semi").drop("salt__")
    blocks = F.ceil(F.greatest(F.col("k") / BLOCK, F.col("mass") / MASS))
    todo = todo.select("bucket", "cid", "comp", blocks.alias("blocks"), F.pmod(F.xxhash64("cid"), blocks).alias("block"))
    todo = todo.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    todo = todo.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cid", "comp")
    body = classes.select("cid", "n_shingles", "regs")
    tile = ["bucket", "i", "j"]
    left = cut(todo.join(body, "cid").groupBy(*tile).applyInArrow(_tile_members, "bucket long, i long, j long, block long, cid long, comp long"))
    texts = marked(docs.selectExpr("cast(doc_id as long) cid", "text"), "cid", marks(left, "cid"))
    more = left.join(body, "cid").join(texts, "cid").groupBy(*tile).applyInArrow(_tile_links, "a long, b long")
    return sketches, classes, links.union(cut(more.distinct()))


def _rows(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, n_shingles, set, component_id, kept."""
    sketches, classes, links = link(docs)
    roots = components(links).select(F.col("node").alias("cid"), "root")
    of = classes.select("set", "cid").join(roots, "cid", "left").select("set", F.coalesce("root", "cid").alias("root"))
    out = sketches.select("doc_id", "n_shingles", "set").join(of, "set", "left")
    return out.select("doc_id", "n_shingles", "set", F.coalesce("root", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("root", "doc_id"), F.lit(False)).alias("kept"))


def groups(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id, kept."""
    return _rows(docs).drop("set")


def _once(docs: DataFrame, heads: DataFrame) -> DataFrame:
    """Of the rows whose (doc_id, set) is among heads, the one with the least text for each; equal texts by a hash of the row."""
    schema = StructType([*docs.schema.fields, StructField("set__", BinaryType())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_digest(s) for _, sets in _sets(batch) for s in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=[*batch.schema.names, "set__"])

    rows = docs.mapInArrow(run, schema)
    by = F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema.fields if not f.dataType.simpleString().count("map<")))
    # the least is kept on either side of the shuffle, however often a row repeats
    least = rows.groupBy(F.col("doc_id").cast("long").alias("id__"), "set__").agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.struct("text", by)).alias("row__"))
    same = (F.col("id__") == F.col("h.doc_id")) & F.col("set__").eqNullSafe(F.col("h.set"))
    return least.join(heads.alias("h"), same, "left_semi").select("row__.*")


def dedupe(docs: DataFrame) -> DataFrame:
    """docs without those that aren't kept. Of rows that repeat both a doc_id and its shingle set one stays, that of the least text;
    rows of a doc_id with other sets are judged each by its own; rows without a doc_id stay."""
    of = _rows(docs).where("doc_id is not null")
    per = cut(of.groupBy("doc_id").agg(F.max("kept").alias("heads"), F.count("*").alias("n")).where("not heads or n > 1"))
    out = without(docs, per, "doc_id")
    again = per.where("heads and n > 1").select("doc_id")
    if again.isEmpty():
        return out
    heads = of.where("kept").join(again, "doc_id", "left_semi").select("doc_id", "set").distinct()
    return out.union(_once(marked(docs, "doc_id", marks(again, "doc_id")), heads))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of all documents."""
    return groups(table(spark, sf_dir, "documents"))


_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {THRESHOLD[1]} * c >= {THRESHOLD[0]} * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""

QUERIES = {"op1_minhash_dedup": op1_minhash_dedup}
ORACLE = {"op1_minhash_dedup": _SQL}
