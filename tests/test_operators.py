import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumora.operators import curation, grouping, integrity, learning, metrics, prediction, reports, vectors

from .conftest import rows


def test_cascade(spark):
    df = spark.createDataFrame([("P1-2", "x", 200), ("P2", "fragment", 50), ("P3", "x", 50), ("P4", None, 500)], "acc string, name string, n int")
    filters = {"none": F.lit(False), "isoform": F.col("acc").contains("-"), "fragment": F.col("name") == "fragment", "short": F.col("n") < 100}
    assert rows(curation.cascade_audit(df, filters)) == [(1, "none", 0, 4), (2, "isoform", 1, 3), (3, "fragment", 1, 2), (4, "short", 1, 1)]
    assert rows(curation.cascade_audit(df.limit(0), filters).select("remaining")) == [(0,)] * 4


def test_duplicates(spark):
    df = spark.createDataFrame([("b", "AC"), ("a", "ac*"), ("c", "X")], "acc string, seq string")
    from lumora.functions.scalars import sequence_hash

    h = sequence_hash(F.col("seq"))
    assert rows(curation.duplicate_map(df, "acc", h).select("duplicate", "representative")) == [("b", "a")]
    r = curation.dedup_report(df, "acc", h).first()
    assert (r.total, r.unique_sequences, r.singletons, r.duplicate_groups, r.removed, r.largest_group) == (3, 2, 1, 1, 1, 2)
    e = curation.dedup_report(df.limit(0), "acc", h).first()
    assert (e.total, e.largest_group, e.retention_pct) == (0, 1, 0.0)
    kept = df.join(curation.duplicate_map(df, "acc", h), df.acc == F.col("duplicate"), "left_anti")
    assert curation.dedup_report(kept, "acc", h).first().removed == 0


def test_labels(spark):
    df = spark.createDataFrame([("A", "original"), ("B", "subfamily_mapping"), ("C", "odd"), ("D", None)], "label string, label_source string")
    got = rows(curation.assign_labels(df).select("label_original", "label_recovered", "label_used", "source_tag"))
    assert got == [("A", "", "A", "original"), ("Other", "", "C", None), ("Other", "", "D", None), ("Other", "B", "B", "mapping")]


def test_cohort(spark):
    df = spark.createDataFrame([(1, "A"), (2, "A"), (3, "Other"), (4, None), (5, "B")], "id int, label string")
    assert rows(curation.cohort(df, "label", ["Other"]).select("id")) == [(1,), (2,), (4,), (5,)]
    assert rows(curation.cohort(df, "label", ["Other"], 2).select("id")) == [(1,), (2,)]


def test_group_split_fills_in_order(spark):
    import hashlib

    sizes = {f"g{i}": random.Random(i).randint(1, 30) for i in range(200)}
    got = dict(rows(curation.group_split(spark.createDataFrame(list(sizes.items()), "g string, n int"), "g", "n").select("g", "side")))
    before, target, want = 0, int(sum(sizes.values()) * 0.2), {}
    for g in sorted(sizes, key=lambda g: hashlib.md5(f"42:{g}".encode()).hexdigest()):
        want[g] = "test" if before < target else "train"
        before += sizes[g]
    assert got == want


def test_integrity(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id int")
    ok = integrity.split_integrity(ids(1, 2, 3), ids(1, 2), ids(3), "id")
    assert all(r.passed for r in ok.collect())
    bad = {r.check: r.passed for r in integrity.split_integrity(ids(1, 2, 3), ids(1, 2), ids(2, 9), "id").collect()}
    assert bad == {"sizes_add_up": False, "disjoint": False, "covers": False}
    assert integrity.subset(ids(1), None, "id", "x").first().passed
    assert integrity.subset(ids(1, 5), ids(1), "id", "x").first().message == "missing=1"


def pred(spark, pairs):
    return spark.createDataFrame([(i, t, p, 0.5) for i, (t, p) in enumerate(pairs)], "query_id long, true_label string, predicted string, confidence double")


def test_perfect_and_constant(spark):
    good = pred(spark, [("a", "x"), ("b", "y"), ("a", "x"), ("c", "z")])
    assert metrics.adjusted_rand(good).first().ari == 1.0 and metrics.normalised_mutual_information(good).first().nmi == 1.0
    assert metrics.assignment_accuracy(good).first().assignment_accuracy == 1.0
    flat = pred(spark, [("a", "x"), ("b", "x"), ("a", "x")])
    assert metrics.adjusted_rand(flat).first().ari == 0.0 and metrics.normalised_mutual_information(flat).first().nmi == 0.0


def test_classification(spark):
    r = metrics.classification(pred(spark, [("a", "a"), ("a", "b"), ("b", "b"), ("c", "d")])).first()
    assert r.accuracy == 0.5 and abs(r.macro_f1 - (2 / 3 + 2 / 3 + 0 + 0) / 4) < 1e-6


def test_assignment_is_the_best(spark):
    from itertools import permutations

    rnd = random.Random(5)
    pairs = [(rnd.choice("abcde"), rnd.choice("vwxyz")) for _ in range(120)]
    best = max(sum(dict(zip("abcde", p, strict=True))[t] == c for t, c in pairs) for p in permutations("vwxyz"))
    assert metrics.assignment_accuracy(pred(spark, pairs)).first().assignment_accuracy == round(best / 120, 6)


def test_calibration_edges(spark):
    df = spark.createDataFrame([(i, "a", "a" if right else "b", c) for i, (c, right) in enumerate([(0.0, True), (0.1, True), (0.30000000000000004, False), (1.0, True)])], "query_id long, true_label string, predicted string, confidence double")
    r = {x.bin: x for x in metrics.reliability(df).collect()}
    assert [r[i].count if not callable(r[i].count) else r[i]["count"] for i in range(10)] == [1, 0, 1, 0, 0, 0, 0, 0, 0, 1] and r[4].mean_confidence == 0.45
    assert metrics.calibration_error(df).first().ece == round((0.9 + 0.3 + 0) / 4, 5)


def points(spark, n, dim=4, seed=1):
    rnd = random.Random(seed)
    return spark.createDataFrame([(i, [rnd.choice((-1.0, 0.0, 1.0, 2.0)) for _ in range(dim)], rnd.choice("abc")) for i in range(n)], "vec_id long, embedding array<double>, label string")


@pytest.mark.parametrize("block", [7, 4096])
def test_search_equals_brute_force(spark, monkeypatch, block):
    import numpy as np

    monkeypatch.setattr(vectors, "BLOCK", block)
    q, g = points(spark, 15, seed=2), points(spark, 40, seed=3)
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-300)
    gs, want, first = g.collect(), [], []
    for r in q.collect():
        order = sorted(gs, key=lambda x: (-round(float(unit(r.embedding) @ unit(x.embedding)), 6), x.vec_id))
        want += [(r.vec_id, i + 1, x.vec_id) for i, x in enumerate(order[:5])]
        first.append((r.vec_id, next((i + 1 for i, x in enumerate(order) if x.label == r.label), None)))
    assert rows(vectors.top_k(q, g, 5).select("query_id", "rank", "gallery_id")) == sorted(want)
    assert rows(vectors.first_matches(q, g)) == sorted(first)
    c = vectors.pr_curve(q, g).where("step = 0").first()
    sims = [(r, x, round(float(unit(r.embedding) @ unit(x.embedding)), 6)) for r in q.collect() for x in gs]
    assert (c.tp, c.fp) == (sum(s >= 0.5 and r.label == x.label for r, x, s in sims), sum(s >= 0.5 and r.label != x.label for r, x, s in sims))


def test_hit_rates_count_missing(spark):
    f = spark.createDataFrame([(1, 1), (2, 4), (3, None)], "query_id long, first_rank long")
    r = vectors.hit_rates(f).first()
    assert r.hit_rate_at_1 == round(1 / 3, 9) and r.hit_rate_at_5 == round(2 / 3, 9) and r.mrr == round((1 + 0.25) / 3, 9)


def test_greedy_equals_sequential(spark):
    rnd = random.Random(11)
    base = ["".join(rnd.choice("ACDE") for _ in range(30)) for _ in range(6)]
    seqs = [(i, "".join(c if rnd.random() > 0.12 else rnd.choice("ACDE") for c in rnd.choice(base))[: rnd.randint(22, 30)]) for i in range(60)]
    got = dict(rows(grouping.greedy(spark.createDataFrame(seqs, "id long, seq string"), 0.8, 3).select("id", "representative")))
    reps, want = [], {}
    for i, s in sorted(seqs, key=lambda x: (-len(x[1]), x[0])):
        words = {s[k : k + 3] for k in range(len(s) - 2)}
        hit = next((r for r, t in reps if words & {t[k : k + 3] for k in range(len(t) - 2)} and grouping.common_length(s, t) / min(len(s), len(t)) >= 0.8), None)
        want[i] = i if hit is None else hit
        if hit is None:
            reps.append((i, s))
    assert got == want


@pytest.mark.parametrize("block", [256, 16])
def test_greedy_compares_pairs_without_a_common_word(spark, monkeypatch, block):
    monkeypatch.setattr(grouping, "BLOCK", block)
    rnd = random.Random(12)
    base = ["".join(rnd.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(60)) for _ in range(6)]
    seqs = [(i, "".join(c if rnd.random() > 0.3 else rnd.choice("ACDEFGHIKLMNPQRSTVWY") for c in rnd.choice(base))[: rnd.randint(50, 60)]) for i in range(60)] + [(90, "ACDEFG"), (91, "ACDEF")]
    got = dict(rows(grouping.greedy(spark.createDataFrame(seqs, "id long, seq string"), 0.6).select("id", "representative")))
    reps, want = [], {}
    for i, s in sorted(seqs, key=lambda x: (-len(x[1]), x[0])):
        want[i] = next((r for r, t in reps if grouping.common_length(s, t) / min(len(s), len(t)) >= 0.6), i)
        if want[i] == i:
            reps.append((i, s))
    assert got == want


def test_common_length():
    assert grouping.common_length("ABCBDAB", "BDCABA") == 4 and grouping.common_length("", "A") == 0


def test_folds_cover(spark):
    df = spark.createDataFrame([(i, "ab"[i % 3 == 0]) for i in range(47)], "id long, y string")
    f = learning.folds(df)
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert sum(sizes) == 47 and len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_by_chance_is_stable(spark):
    g = points(spark, 200)
    a, b = (rows(learning.by_chance(g, g, F.col("label"), F.col("vec_id"))) for _ in range(2))
    assert a == b and {x for _, x in a} == {"a", "b", "c"}


def test_reports(spark):
    one = spark.range(1).select(F.lit(0.5).alias("ari"), F.lit(3).alias("k"))
    reg = reports.registry([reports.entries("x", one), reports.entries("y", one, "p_")])
    assert reports.as_json(reg).first().document == '{"x":{"ari":0.5,"k":3.0},"y":{"p_ari":0.5,"p_k":3.0}}'
    html = reports.page("T & U", {"n": "3"}, {"numbers": reg}, {"f": b"png"})
    assert "T &amp; U" in html and "data:image/png;base64," in html
    runs = spark.createDataFrame([("a", "2024"), ("b", None), ("c", "2025")], "run_id string, created_at string")
    assert [r.run_id for r in reports.runs(runs).orderBy("position").collect()] == ["c", "a", "b"]


def test_streaming_dedup(spark, tmp_path):
    from lumora.streaming import dedup

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "A"), (2, "a"), (3, "B")], "id long, text string").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp")).write.parquet(src)
    stream = spark.readStream.schema("id long, text string, ts timestamp").parquet(src)
    dedup.write(dedup.first_seen(stream, F.upper("text"), "ts").drop("group_key"), out, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_report_tables(spark):
    m = spark.createDataFrame([("z", 0.5, 0.25, 0.0), ("b", 0.12345, None, None), ("knn", 0.9, 0.8, 1.5)], "method string, accuracy double, macro_f1 double, log_loss double")
    assert rows(reports.methods(m, ["knn", "absent"])) == [(1, "knn", 0.9, 0.8, "1.5"), (2, "b", 0.1235, 0.0, "N/A"), (3, "z", 0.5, 0.25, "N/A")]
    a = spark.createDataFrame([("l33", 0.2), ("l20", 0.3), ("cls", 0.1)], "name string, ari double")
    assert rows(reports.ablation(a, "name", ["ari"], "l33")) == [("cls", 0.1, "-50.0%"), ("l20", 0.3, "+50.0%"), ("l33", 0.2, "+0.0%")]
    assert rows(reports.stages([("all", m), ("none", m.limit(0))], "method")) == [(1, "all", 3, 3), (2, "none", 0, 0)]
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert rows(reports.upsert(old, new, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(reports.upsert(old.limit(0), new, ["k"])) == [(2, "c"), (3, "d")]


def test_numbers_and_rules(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("z", None)], "k string, v double")
    b = spark.createDataFrame([("x", 1.05), ("y", 3.0), ("w", 1.0)], "k string, v double")
    got = {r.k: r.passed for r in integrity.agree(a, b, ["k"], "v", 0.1).collect()}
    assert got == {"x": True, "y": False, "z": False, "w": False}
    n = spark.createDataFrame([("d", "n", 5.0), ("d", "none", None)], "section string, key string, value double")
    rules = {"many": "n['d.n'] > 3", "few": "n['d.n'] < 3", "null": "n['d.none'] > 0", "absent": "n['x.y'] = 1"}
    assert {r.check: r.passed for r in integrity.checklist(n, rules).collect()} == {"many": True, "few": False, "null": False, "absent": False}
    assert not any(r.passed for r in integrity.checklist(n.limit(0), rules).collect())


def test_scaled(spark):
    x = learning.features(spark.createDataFrame([(1, [1.0, 5.0], "a"), (2, [3.0, 5.0], "b")], "k long, v array<double>, y string"), "k", "v", "y")
    assert sorted(tuple(r.features) for r in learning.scaled(x, x).collect()) == [(-1.0, 0.0), (1.0, 0.0)]


def test_predict(spark):
    seqs = spark.createDataFrame([(1, "MKVAIKDFGA" * 6), (2, "SHORT"), (3, "M" * 60), (4, "M" * 60), (5, None)], "id long, seq string")
    hits = spark.createDataFrame([(1, "x", 1, 10, 1e-3, 9.0), (1, "y", 2, 9, 1e-9, 5.0), (1, "z", 3, 9, 1e-9, 5.0), (2, "x", 1, 2, 0.0, 1.0), (4, "x", 1, 5, 0.0, 1.0)], "id long, name string, env_from int, env_to int, evalue double, bitscore double")
    scored = spark.createDataFrame([(1, "B", 0.4), (1, "A", 0.4), (1, "C", 0.1), (1, "D", 0.1), (3, "A", 1.0)], "query_id long, label string, p double")
    near = spark.createDataFrame([(1, 2, 70), (1, 1, 90)], "query_id long, rank int, gallery_id long")
    got = {r.id: r for r in prediction.predict(seqs, hits, scored, near, F.length("seq") >= 50).collect()}
    assert {i: r.status for i, r in got.items()} == {1: "ok", 2: "invalid sequence", 3: "no domain found", 4: "no embedding", 5: "invalid sequence"}
    r = got[1]
    assert (r.domain, r.predicted, r.confidence, r.flag, r.exemplars) == ("KVAIKDFG", "A", 0.4, "low", [90, 70])
    assert [tuple(c) for c in r.classes] == [("A", 0.4), ("B", 0.4), ("C", 0.1)] and r.n_motifs > 0
    assert all(got[i].predicted is None and got[i].domain is None for i in (2, 3, 4, 5))
    assert prediction.predict(seqs.limit(0), hits, scored, near, F.lit(True)).count() == 0


def test_best_assignment_of_any_size():
    from itertools import permutations

    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 6):
        gain = rng.integers(0, 9, (n, n)).astype(float)
        assert metrics.best_assignment(gain) == max(sum(gain[i, p[i]] for i in range(n)) for p in permutations(range(n)))
    gain = rng.integers(0, 50, (60, 60)).astype(float)
    hidden = rng.permutation(60)
    gain[np.arange(60), hidden] = 50
    assert metrics.best_assignment(gain) == 3000


def test_k_means_finds_blobs_in_one_pass_for_all_starts(spark):
    rng = np.random.default_rng(2)
    data = [(i, (np.array([10.0 * (i % 4), -10.0 * (i % 4)]) + rng.normal(size=2)).tolist(), str(i % 4)) for i in range(400)]
    x = learning.features(spark.createDataFrame(data, "k long, v array<double>, y string"), "k", "v", "y")
    out = learning.k_means(x, 4)
    per = {(r.y, r.cluster) for r in out.collect()}
    assert len(per) == 4 and out.count() == 400
    centres, cost = learning.k_means_fit(x, 4)
    flat = np.array([v for _, v, _ in data])
    assert abs(cost - ((flat[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum()) < 1e-3 * cost


def test_runs(spark, tmp_path):
    folder = str(tmp_path)
    reports.run_init(spark, folder, "2026-01-01_000000", "a")
    with pytest.raises(FileExistsError):
        reports.run_init(spark, folder, "2026-01-01_000000")
    with pytest.raises(FileNotFoundError):
        reports.set_current(spark, folder, "2026-01-02_000000")
    reports.run_init(spark, folder, "2026-01-01_000000", "b", force=True)
    reports.set_current(spark, folder, "2026-01-01_000000")
    assert rows(reports.run_listing(spark, folder)) == [("2026-01-01_000000", "b", True, 1)]
    assert spark.range(1).select(reports.run_day(F.lit("2026-01-01_000000")).alias("a"), reports.run_day(F.lit("x")).alias("b")).first() == ("2026-01-01", None)


def test_tracked_and_sets(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert rows(integrity.tracked(ids(1, 2, 3, 3), {"no a": ids(1, 2), "no b": ids(1)}, "id")) == [(1, "used"), (2, "no b"), (3, "no a")]
    v = spark.createDataFrame([("a", 1, [0.0]), ("a", 2, [1.0]), ("b", 2, [float("nan")]), ("b", 1, [1.0]), ("c", 1, [1.0, 2.0])], "config string, id long, embedding array<double>")
    assert {r.config: (r.n, r.with_nan, r.same_ids) for r in integrity.embedding_sets(v, "a").collect()} == {"a": (2, 0, True), "b": (2, 1, True), "c": (1, 0, False)}


@pytest.mark.parametrize("gathered", [True, False])
def test_pruned_search_is_exact(spark, monkeypatch, gathered):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 8)) * 5
    x = [(i, ((centres[i % 12] if gathered else 0) + rng.normal(size=8) * 0.3).tolist(), "ab"[i % 2]) for i in range(300)] + [(900, [0.0] * 8, "a"), (901, [0.0] * 8, "b")]
    df = spark.createDataFrame([(i, v, y) for i, v, y in x], "vec_id long, embedding array<double>, label string")
    q, g = df.where("vec_id % 5 = 0"), df.where("vec_id % 5 <> 0 or vec_id = 900")
    seen = []
    real = vectors.stored
    monkeypatch.setattr(vectors, "stored", lambda d: seen.append(real(d)) or seen[-1])
    assert rows(vectors.top_k_pruned(q, g, 6)) == rows(vectors.top_k(q, g, 6))
    looked = sum(d.count() for d in seen if "list" in d.columns and "far" not in d.columns)
    assert looked < 0.6 * 60 * 15 if gathered else looked > 0  # pairs of queries and lists, of 61 x 15
    assert rows(vectors.top_k_pruned(q, g.limit(0), 6)) == [] == rows(vectors.top_k_pruned(q.limit(0), g, 6))
