"""Benchmark decontamination by winnowing.

Both sides are cut into words of lower-case letters, digits and characters beyond ASCII (A-Z lower-cased).
A window is WINDOW consecutive words of an item; an item of fewer words is one window. Of every WINDOW - K + 1
neighbouring K-word grams the one with the least hash (the rightmost on a tie) is kept as a fingerprint, so each
run of WINDOW words, on either side, holds a kept gram at the same place: two texts that share a window share a
fingerprint. Fingerprints are joined, and each hit is extended over the words around it: all windows that hold
the gram and are equal on both sides count, and their words are hit. Items shorter than WINDOW are looked up
by the hash of their whole sequence at every position, for the lengths that occur.

Only a filter of bounded size (FILTER_BITS) is broadcast: it says which hashes can't be in the benchmark. It
saves rows and decides nothing; the join and the extension do. Fingerprints with a large share of all hits are cut into parts.

Null and empty texts have no words and no hit. Every document row is judged by its own text, has a number of its own in all
joins, and has one result row, whether doc_ids repeat or are null. Items with no words match nothing; items that repeat
an item_id count once. Items without an item_id hit like others, count as one item and are not in the list of items. Further columns are ignored; empty tables give empty results or no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jobs import cut, heavy, prepare, salted, spread, table, tidy, without
from .text import ALNUM, Words, column, grams, slices

WINDOW, K = 10, 6
SPAN = WINDOW - K + 1
REACH = WINDOW - K  # words to either side of a gram that a window with it can hold
#: Least and most bits of the filter: 16 for each fingerprint, in these bounds (8 MB at most).
FILTER_BITS = (1 << 20, 1 << 26)


def _winnow(h: np.ndarray) -> np.ndarray:
    """Positions of the grams kept out of a text's gram hashes."""
    n = len(h)
    if n < SPAN:
        return np.zeros(0, dtype=np.int64)
    views = np.lib.stride_tricks.sliding_window_view(h, SPAN)
    kept = np.arange(n - SPAN + 1) + (SPAN - 1 - np.argmin(views[:, ::-1], axis=1))
    return np.unique(kept)


def _bit(h: np.ndarray, size: int) -> np.ndarray:
    return (h >> np.uint64(17)).astype(np.int64) & (size - 1)


_ITEM = "item_id string, fp long, short int, before array<long>, own array<long>, after array<long>"
_HIT = "row long, doc_id long, n_words long, digest string, hits array<struct<fp:long,at:long,short:int,before:array<long>,own:array<long>,after:array<long>>>"


def _rows(h: np.ndarray, at: int, k: int) -> tuple:
    """The words before a gram (nearest first), of it, and after it, as far as a window reaches."""
    s = h.view(np.int64)
    return s[max(0, at - REACH) : at][::-1].tolist(), s[at : at + k].tolist(), s[at + k : at + k + REACH].tolist()


@tidy
def _item_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = None
    for batch in batches:
        texts, ids = column(batch, "text"), column(batch, "item_id")
        out = []
        for lo, _, raw, off in slices(texts):
            w = Words(raw, off, ALNUM)
            h = w.hashes()
            for i, (a, b) in enumerate(zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True)):
                own, name = h[a:b], ids[lo + i].as_py()
                if 0 < b - a < WINDOW:
                    out.append((name, int(grams(own, b - a).view(np.int64)[0]), b - a, [], own.view(np.int64).tolist(), []))
                elif b > a:
                    g = grams(own, K)
                    out += [(name, int(g.view(np.int64)[p]), 0, *_rows(own, p, K)) for p in _winnow(g).tolist()]
        kinds = [pa.string(), pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 3]
        schema = schema or pa.schema(list(zip(("item_id", "fp", "short", "before", "own", "after"), kinds, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], schema=schema)


def fingerprints(items: DataFrame) -> DataFrame:
    """The kept grams of a benchmark with the words around them; short: the item's words if fewer than WINDOW, else 0."""
    prepare(items.sparkSession)
    return items.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(_item_batches, _ITEM)


def _filter(prints: DataFrame) -> tuple[np.ndarray, list[int]]:
    """A bitmap of the fingerprints, and the lengths (under WINDOW) of short items."""
    size = min(FILTER_BITS[1], max(FILTER_BITS[0], 1 << (16 * prints.count()).bit_length()))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, lengths = np.zeros(size, dtype=bool), 0
        for b in batches:
            bits[_bit(column(b, "fp").to_numpy().view(np.uint64), size)] = True
            for n in set(column(b, "short").to_pylist()):
                lengths |= 1 << n
        at = np.flatnonzero(bits) >> 15
        for part in np.unique(at).tolist():  # pieces of 4 KB, merged over the tasks before the driver sees them
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([lengths]), pa.array([np.packbits(bits[part << 15 : part + 1 << 15]).tobytes()], pa.binary())], names=["part", "lengths", "bits"])

    def merge(t: pa.Table) -> pa.Table:
        bits = np.zeros(1 << 12, dtype=np.uint8)
        lengths = 0
        for b, n in zip(t["bits"].to_pylist(), t["lengths"].to_pylist(), strict=True):
            bits |= np.frombuffer(b, dtype=np.uint8)
            lengths |= n
        return pa.table({"part": t["part"][:1], "lengths": pa.array([lengths]), "bits": pa.array([bits.tobytes()], pa.binary())})

    shape = "part long, lengths long, bits binary"
    out, lengths = np.zeros(size, dtype=bool), 0
    for r in prints.mapInArrow(run, shape).groupBy("part").applyInArrow(merge, shape).collect():  # at most 2**11 rows
        out[r.part << 15 : r.part + 1 << 15] = np.unpackbits(np.frombuffer(r.bits, dtype=np.uint8)).view(bool)
        lengths |= r.lengths
    return out, [n for n in range(1, WINDOW) if lengths >> n & 1]


def _spans(spark: SparkSession, docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per document row its number, doc_id, n_words, hits; and (row, digest, item_id, at, n): item windows that occur at a word of a document.

    digest is the MD5 of the row's text, if it has hits.
    """
    prepare(spark)
    prints = cut(fingerprints(items))
    bits, lengths = _filter(prints)
    packed = spark.sparkContext.broadcast(np.packbits(bits).tobytes())

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.unpackbits(np.frombuffer(packed.value, dtype=np.uint8)).view(bool)
        hit = pa.list_(pa.struct([("fp", pa.int64()), ("at", pa.int64()), ("short", pa.int32()), *((x, pa.list_(pa.int64())) for x in ("before", "own", "after"))]))
        schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("digest", pa.string()), ("hits", hit)])
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            counts, hits, digests = [], [], []
            for _, _, raw, off in slices(column(batch, "text")):
                w = Words(raw, off, ALNUM)
                h = w.hashes()
                counts += w.counts.tolist()
                own: list[list] = [[] for _ in w.counts]
                row_of = w.rows()
                g = grams(h, K)
                if len(g) >= SPAN:
                    views = np.lib.stride_tricks.sliding_window_view(g, SPAN)
                    inside = row_of[: len(views)] == row_of[WINDOW - 1 :]  # the window is of one row
                    kept = np.zeros(len(g), dtype=bool)
                    # the least of SPAN by pairwise minima, then the rightmost place that has it
                    low = views.min(axis=1)
                    place = np.zeros(len(low), dtype=np.int64)
                    for j in range(1, SPAN):
                        place[g[j : j + len(low)] == low] = j
                    kept[(np.arange(len(low)) + place)[inside]] = True
                    at = np.flatnonzero(kept)
                    at = at[have[_bit(g[at], len(have))]]
                    for p in at.tolist():
                        r = int(row_of[p])
                        a, b = int(w.bounds[r]), int(w.bounds[r + 1])
                        own[r].append((int(g.view(np.int64)[p]), p - a, 0, *_rows(h[a:b], p - a, K)))
                for n in lengths:
                    s = grams(h, n)
                    at = np.flatnonzero(have[_bit(s, len(have))] & (row_of[: len(s)] == row_of[n - 1 :])) if len(s) else []
                    for p in at:
                        r = int(row_of[p])
                        own[r].append((int(s.view(np.int64)[p]), int(p - w.bounds[r]), n, [], h.view(np.int64)[p : p + n].tolist(), []))
                digests += [hashlib.md5(raw[off[r] : off[r + 1]].tobytes()).hexdigest() if x else None for r, x in enumerate(own)]
                hits += [[dict(zip(("fp", "at", "short", "before", "own", "after"), x, strict=True)) for x in rows] for rows in own]
            numbers = pa.array(np.arange(number, number + batch.num_rows))
            number += batch.num_rows
            yield pa.RecordBatch.from_arrays([numbers, column(batch, "doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(hits, hit)], schema=schema)

    found = cut(docs.select("doc_id", "text").mapInArrow(run, _HIT))
    left = cut(found.where("size(hits) > 0").select("row", "digest", F.explode("hits").alias("h")).select("row", "digest", "h.*"))
    right = prints.select("item_id", "fp", "short", *(F.col(x).alias(f"i_{x}") for x in ("before", "own", "after")))
    hot = heavy(left, "fp", "short")
    both = salted(left, hot, "row", "fp", "short").join(spread(right, hot, "fp", "short"), ["fp", "short", "salt__"]).where("own = i_own")
    same = lambda x: F.aggregate(  # noqa: E731  how many of the nearest words are equal
        F.sequence(F.lit(0), F.least(F.size(x), F.size(f"i_{x}"))),
        F.lit(0),
        lambda acc, i: F.when((acc == i - 1) & (i > 0) & (F.get(F.col(x), i - 1) == F.get(F.col(f"i_{x}"), i - 1)), i).otherwise(acc),
    )
    both = both.withColumn("l", F.when(F.col("short") > 0, 0).otherwise(same("before"))).withColumn("r", F.when(F.col("short") > 0, 0).otherwise(same("after")))
    both = both.withColumn("n", F.col("l") + F.size("own") + F.col("r")).where((F.col("short") > 0) | (F.col("n") >= WINDOW))
    return found, both.select("row", "digest", "item_id", (F.col("at") - F.col("l")).alias("at"), "n")


def _counted(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """hits(), and n_items, in which a null id counts."""
    found, spans = _spans(spark, docs, items)
    spans = cut(spans)
    words = spans.select("row", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("w")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    names = spans.select("row", "item_id").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item_id")).alias("items"), F.count("*").alias("n_items"))
    out = found.select("row", "doc_id", "n_words").join(words.join(names, "row"), "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"))


def hits(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, items (item ids as strings, sorted)."""
    return _counted(spark, docs, items).drop("n_items")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all items."""
    out = _counted(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows in whose text an item's window occurs; rows are judged by their text alone, whatever their doc_id."""
    _, spans = _spans(docs.sparkSession, docs, items)
    bad = cut(spans.select(F.col("digest").alias("digest__")).distinct())
    return without(docs.withColumn("digest__", F.md5(F.coalesce("text", F.lit("")).cast("binary"))), bad, "digest__").drop("digest__")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, len(w) AS n, array_to_string(w, ' ') AS g FROM b WHERE len(w) BETWEEN 1 AND {WINDOW - 1}
  UNION SELECT item_id, {WINDOW}, array_to_string(w[s:s + {WINDOW - 1}], ' ') FROM (SELECT item_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS s FROM b WHERE len(w) >= {WINDOW})),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, s, dw.n FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN names USING (doc_id)
"""

QUERIES = {"op4_benchmark_decontamination": op4_benchmark_decontamination}
ORACLE = {"op4_benchmark_decontamination": _SQL}
