import random
import re

import numpy as np
import pytest

from lumora.llm import jobs
from lumora.llm import neardup as N

from ..conftest import rows


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def brute(docs):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(comp[a], comp[b])
            changed |= comp[a] != m or comp[b] != m
            comp[a] = comp[b] = m
    return sorted((i, len(sets[i]), comp[i], comp[i] == i) for i in sets)


def corpus(seed, n=120):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rnd.choice(vocab) for _ in range(rnd.randint(6, 160))] for _ in range(25)]
    out = []
    for i in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice((0, 0, 1, 2, 4, 8))):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        out.append((i, " ".join(w)))
    return out + [(900, None), (901, ""), (902, " \n "), (903, "One two"), (904, "one  TWO"), (905, "x" * 5000), (906, "ß É")]


@pytest.mark.parametrize("seed,block", [(1, 1024), (2, 4), (3, 1)])
def test_equals_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(N, "BLOCK", block)
    docs = corpus(seed)
    assert rows(N.groups(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_hot_group(spark):
    """Many near copies of one text: a third of all rows, most of them linked only by way of others."""
    rnd = random.Random(4)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(60)]
    docs = corpus(5, 60)
    for i in range(80):
        w = list(base)
        for k in rnd.sample(range(60), rnd.choice((1, 2))):
            w[k] = f"n{rnd.randrange(10**6)}"
        docs.append((2000 + i, " ".join(w)))
    assert rows(N.groups(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


@pytest.mark.parametrize("star,alone", [(3, 0), (3, 1 << 18), (256, 20)])
def test_parts_of_centres_and_long_lists(spark, monkeypatch, star, alone):
    """Centres with more pairs than a part holds; lists of links that one task doesn't take. Repeated ids with other texts too."""
    monkeypatch.setattr(N, "STAR", star)
    monkeypatch.setattr(jobs, "ALONE", alone)
    docs = corpus(6, 90)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(N.groups(df)) == brute(docs)
    assert rows(N.groups(df.union(df)).distinct()) == brute(docs)


def test_repeats_nulls_and_more_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e", 1, "x"), (1, "a b c d e", 2, "y"), (None, "a b c d e", 3, "z"), (2, "A B C D E", 4, None), (None, "alone here", 5, None)], "doc_id long, text string, cid int, bucket string")
    assert rows(N.groups(df)) == [(None, 1, None, False), (None, 1, 1, False), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]
    kept = N.dedupe(df)
    assert kept.columns == df.columns and rows(kept.select("doc_id", "text")) == [(None, "a b c d e"), (None, "alone here"), (1, "a b c d e")]
    assert N.groups(df.limit(0)).count() == 0 and N.dedupe(df.limit(0)).count() == 0


def test_dedupe_judges_repeated_ids_by_row(spark):
    docs = [(1, "a b c d e f")] * 40 + [(3, "p q r s t u"), (5, "p q r s t u"), (5, "unique words stand here alone"), (7, None), (7, ""), (8, "one text of"), (8, "another text of"), (9, "A B C D E F")]
    want = [(1, "a b c d e f"), (3, "p q r s t u"), (5, "unique words stand here alone"), (7, None), (8, "another text of"), (8, "one text of")]
    for kind in ("long", "int"):
        df = spark.createDataFrame([(i, t, {"k": i}) for i, t in docs], f"doc_id {kind}, text string, cid map<string,int>")
        kept = N.dedupe(df)
        assert kept.schema.simpleString() == df.schema.simpleString() and rows(kept.select("doc_id", "text")) == want


def test_registers_merge():
    rnd = np.random.Generator(np.random.PCG64(1))
    a, b = rnd.integers(0, 1 << 63, 3000, dtype=np.uint64), rnd.integers(0, 1 << 63, 500, dtype=np.uint64)
    r = N.registers([a, b, np.concatenate((a, b)), a[:0]])
    assert (np.maximum(r[0], r[1]) == r[2]).all() and not r[3].any()


def test_likelihood_finds_the_similarity():
    rnd = np.random.Generator(np.random.PCG64(2))
    for j in (0.2, 0.5, 0.75, 0.95):
        both = int(2000 * j)
        err = []
        for _ in range(6):
            x = rnd.integers(0, 1 << 63, 4000 - both, dtype=np.uint64)
            a, b = x[: both + (2000 - both) // 2], np.concatenate((x[:both], x[both + (2000 - both) // 2 : 2000]))
            r = N.registers([a, b]).astype(int)
            got = N.likeliest(np.array([(r[0] > r[1]).sum()]), np.array([(r[0] < r[1]).sum()]), np.array([len(a)]), np.array([len(b)]))[0]
            err.append(got - both / len(np.union1d(a, b)))
        assert abs(np.mean(err)) < 0.04
