import random
import re

import pytest

from lumora.llm import decontam as D

from ..conftest import rows


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for s in [tuple(w)] if 0 < len(w) < 10 else [tuple(w[k : k + 10]) for k in range(len(w) - 9)] if w else []:
            windows.setdefault(s, set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for n in {len(s) for s in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    names |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), sorted(names)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(spark, seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefgh") if seed % 2 else f"w{rnd.randrange(300)}"  # noqa: E731  few words: many ties and repeats
    items = [(k, " ".join(word() for _ in range(rnd.choice((3, 7, 9, 10, 11, 18, 30))))) for k in range(25)] + [(90, ""), (91, None), (92, "!?"), (3, "dup of item three words")]
    docs = []
    for i in range(60):
        t = [word() for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 3)):
            w = words(rnd.choice(items)[1])
            lo = rnd.randint(0, max(0, len(w) - 10))
            t[rnd.randint(0, len(t)) : 0] = w[lo : lo + rnd.choice((8, 9, 10, 12, 40))]
        docs.append((i, rnd.choice((" ", ", ", "\n")).join(x.upper() if rnd.random() < 0.3 else x for x in t)))
    docs += [(100, None), (101, ""), (102, "...")]
    got = D.hits(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got) == brute(docs, items)
    kept = D.clean(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(kept.select("doc_id")) == sorted((i,) for i, _, n, _ in brute(docs, items) if not n)


def test_empty_tables_and_more_columns(spark):
    docs = spark.createDataFrame([(1, "one two three", "x", 0), (None, "one two three", "y", 1)], "doc_id long, text string, item_id string, at int")
    items = spark.createDataFrame([(5, "Two three")], "item_id long, text string")
    assert rows(D.hits(spark, docs.where("doc_id = 1"), items)) == [(1, 3, 2, ["5"])]
    assert rows(D.hits(spark, docs.where("doc_id = 1"), items.limit(0))) == [(1, 3, 0, [])]
    assert rows(D.hits(spark, docs, items)) == [(None, 3, 2, ["5"]), (1, 3, 2, ["5"])]
    assert D.hits(spark, docs.limit(0), items).count() == 0
    assert D.clean(docs, items).count() == 0 and D.clean(docs, items.limit(0)).count() == 2


def test_rows_of_a_doc_id_are_judged_apart(spark):
    docs = spark.createDataFrame([(1, "a clean text of its own", 0), (1, "one two three", 1), (1, "one two three", 2), (None, "clean", 3), (2, None, 4)], "doc_id long, text string, n int")
    items = spark.createDataFrame([(5, "two three")], "item_id long, text string")
    assert rows(D.hits(spark, docs, items)) == [(None, 1, 0, []), (1, 3, 2, ["5"]), (1, 3, 2, ["5"]), (1, 6, 0, []), (2, 0, 0, [])]
    kept = D.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.n for r in kept.collect()) == [0, 3, 4]


def test_items_without_an_id_hit(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four five"), (3, "six")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "two three"), (5, "one two"), (None, "five"), (6, "none of it")], "item_id long, text string")
    assert rows(D.hits(spark, docs, items)) == [(1, 3, 3, ["5"]), (2, 2, 1, []), (3, 1, 0, [])]
    assert rows(D._counted(spark, docs, items).select("doc_id", "n_items")) == [(1, 2), (2, 1), (3, 0)]
    assert rows(D.clean(docs, items).select("doc_id")) == [(3,)]
