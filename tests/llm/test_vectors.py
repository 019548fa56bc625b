import math
import random

import numpy as np
import pytest

from lumora.llm import vectors as V

from ..conftest import rows


def brute(data):
    ok = [(i, v, lab) for i, v, lab in data if lab is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    cos = lambda a, b: len(a) == len(b) and float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)) >= V.LEAST
    n, comp = {i: 0 for i, *_ in data}, {i: i for i, *_ in data}
    links = [(a[0], b[0]) for k, a in enumerate(ok) for b in ok[k + 1 :] if a[2] == b[2] and cos(a[1], b[1])]
    for a, b in links:
        n[a] += 1
        n[b] += 1
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(comp[a], comp[b])
            changed |= comp[a] != m or comp[b] != m
            comp[a] = comp[b] = m
    return sorted((i, n[i], comp[i], comp[i] == i) for i, *_ in data)


def points(seed, n=160, dim=16):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(12)]
    data = [(i, [x + rnd.gauss(0, rnd.choice((0.02, 0.12, 0.16))) for x in rnd.choice(centres)], rnd.choice("ab")) for i in range(n)]
    hot = [(1000 + i, [x + rnd.gauss(0, 0.13) for x in centres[0]], "a") for i in range(90)]
    odd = [(2000, None, "a"), (2001, [0.0] * dim, "a"), (2002, [math.nan] * dim, "a"), (2003, [math.inf] + [1.0] * (dim - 1), "a"), (2004, [None] * dim, "b"), (2005, centres[0], None), (2006, [], "a"), (2007, centres[0][:3], "a")]
    return data + hot + odd + [(3000 + i, centres[1], "b") for i in range(9)] + [(3100, [1e200 * x for x in centres[1]], "b")]


@pytest.mark.parametrize("seed,block", [(2, 48)])
def test_equals_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(V, "BLOCK", block)
    data = points(seed)
    df = spark.createDataFrame([(*r, 1) for r in data], "vec_id long, embedding array<double>, label string, root int")
    with np.errstate(all="ignore"):
        assert rows(V.groups(df)) == brute([(i, [x / 1e200 for x in v] if i == 3100 else v, lab) for i, v, lab in data])
    last = V.audit_log[-1]
    assert last["links"] > 0 and last["links found"] >= V.RECALL * last["links"] and last["probes found"] >= V.RECALL * last["probes"] > 0


def test_descent_carries_links(spark, monkeypatch):
    """With one order and no others later, most links come from neighbours of neighbours."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 24))
    data = [(i, (centres[i % 4] + rng.normal(size=24) * 0.08).tolist(), "a") for i in range(400)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label string")
    monkeypatch.setattr(V, "orders", lambda n: 1)
    V.search_log.clear()
    got, want = {r[0]: tuple(r)[1:] for r in rows(V.groups(df))}, {r[0]: tuple(r)[1:] for r in brute(data)}
    assert V.search_log[-1][2] >= 1.5 * V.search_log[0][2]
    assert [w[1] for w in want.values()] == [got[i][1] for i in want] and sum(g[0] for g in got.values()) >= 0.9 * sum(w[0] for w in want.values())


def test_repeated_ids_are_told_apart(spark):
    a, b = [1.0] + [0.0] * 7, [0.0, 1.0] + [0.0] * 6
    df = spark.createDataFrame([(7, a, 1), (7, b, 1), (8, a, 1), (9, b, 1), (7, a, 1), (None, a, 1), (None, b, 2)], "vec_id long, embedding array<float>, label int")
    assert rows(V.groups(df)) == [(None, 0, None, False), (None, 3, 7, False), (7, 1, 7, True), (7, 3, 7, True), (7, 3, 7, True), (8, 3, 7, False), (9, 1, 7, False)]


def test_core_and_others_add_up(spark):
    """A group counted by its mean direction and by blocks has the links of brute force."""
    rng = np.random.default_rng(1)
    centre = rng.normal(size=16)
    x = np.concatenate((centre + rng.normal(size=(150, 16)) * 0.05, centre + rng.normal(size=(90, 16)) * 0.14))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    members = spark.createDataFrame([(5, i, 1 + i % 3, x[i].tobytes()) for i in range(240)], "root long, cid long, mult long, raw binary")
    mult = np.array([1 + i % 3 for i in range(240)])
    hit = unit @ unit.T >= V.LEAST
    np.fill_diagonal(hit, False)
    adds, links = V._whole(members, "<f8")
    got = dict(rows(adds))
    assert [got.get(i, 0) for i in range(240)] == (hit @ mult).tolist()
    assert all(hit[a, b] or a != b for a, b in rows(links)) and 0 < links.count() <= 2 * 240


def test_empty(spark):
    assert V.groups(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
