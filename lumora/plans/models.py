"""Queries over embeddings: search, metrics, models, registries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions import motifs, scalars
from ..operators import integrity, learning, metrics, prediction, reports, vectors
from ..storage import stored
from .common import table, wide

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: wide(f(spark, sf_dir))
        if sql:
            ORACLE[name] = sql
        return f

    return add


#: Every fifth vector asks, all others are the gallery: together the whole table.
def _sides(s, d):
    e = table(s, d, "embeddings")
    return e.where("vec_id % 5 = 0"), e.where("vec_id % 5 <> 0")


_SIM = """q AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 5 = 0),
g AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 5 <> 0),
s AS (SELECT q.vec_id AS query_id, q.label AS query_label, g.vec_id AS gallery_id, g.label AS gallery_label, round(list_cosine_similarity(q.e, g.e), 6) + 0.0 AS sim FROM q, g),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, gallery_id) AS rank FROM s)"""
_VOTES = _SIM + """, v AS (SELECT query_id, query_label, gallery_label AS label, count(*) AS votes, round(count(*) / 5.0, 6) AS p FROM ranked WHERE rank <= 5 GROUP BY ALL),
pred AS (SELECT query_id, query_label AS true_label, label AS predicted, p AS confidence FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY p DESC, label) = 1),
c AS (SELECT true_label, predicted, count(*) AS n FROM pred GROUP BY ALL)"""


@query("cosine_topk", f"WITH {_SIM} SELECT query_id, query_label, rank, gallery_id, gallery_label, sim FROM ranked WHERE rank <= 10")
def _top(s, d):
    return vectors.top_k(*_sides(s, d), 10)


@query("cosine_topk_pruned", f"WITH {_SIM} SELECT query_id, query_label, rank, gallery_id, gallery_label, sim FROM ranked WHERE rank <= 10")
def _top_pruned(s, d):
    return vectors.top_k_pruned(*_sides(s, d), 10)


@query("top_exemplars", f"WITH {_SIM} SELECT query_id, rank, gallery_id, gallery_label, sim, doc.source AS payload FROM ranked LEFT JOIN documents doc ON doc.doc_id = gallery_id WHERE rank <= 5")
def _exemplars(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("gallery_id"), F.col("source").alias("payload"))
    return vectors.top_k(*_sides(s, d), 5).join(docs, "gallery_id", "left").select("query_id", "rank", "gallery_id", "gallery_label", "sim", "payload")


@query("hit_rate_mrr", f"""WITH {_SIM}, f AS (SELECT q.vec_id, (SELECT min(rank) FROM ranked r WHERE r.query_id = q.vec_id AND r.gallery_label = r.query_label) AS fr FROM q)
SELECT {", ".join(f"round(avg(CASE WHEN fr <= {k} THEN 1.0 ELSE 0.0 END), 9) AS hit_rate_at_{k}" for k in (1, 3, 5, 10))}, round(avg(coalesce(1.0 / fr, 0.0)), 9) AS mrr, count(*) AS n_queries FROM f""")
def _hits(s, d):
    return vectors.hit_rates(vectors.first_matches(*_sides(s, d)))


@query("pr_curve", f"""WITH {_SIM}, th AS (SELECT CAST(i AS BIGINT) AS step, round(0.5 + i * 0.5 / 99, 9) AS t FROM range(100) r(i)), b AS (SELECT query_id, max(sim) FILTER (gallery_label = query_label) AS best FROM s GROUP BY 1),
p AS (SELECT step, t, (SELECT count(*) FROM s WHERE sim >= t AND gallery_label = query_label) AS tp, (SELECT count(*) FROM s WHERE sim >= t AND gallery_label <> query_label) AS fp, (SELECT count(*) FROM b WHERE coalesce(best, -2) < t) AS fn FROM th)
SELECT step, round(0.5 + step * 0.5 / 99, 6) AS threshold, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall FROM p""")
def _curve(s, d):
    return vectors.pr_curve(*_sides(s, d))


def _votes(s, d):
    return vectors.votes(vectors.top_k(*_sides(s, d), 5))


def _pred(s, d):
    return vectors.decide(_votes(s, d))


query("knn_votes", f"WITH {_VOTES} SELECT * FROM v")(_votes)
query("knn_vote", f"WITH {_VOTES} SELECT * FROM pred")(_pred)


@query("knn_top3", f"WITH {_VOTES}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, label) AS k FROM v), h AS (SELECT query_id, max(CASE WHEN label = query_label AND k <= 3 THEN 1.0 ELSE 0.0 END) AS hit FROM r GROUP BY 1) SELECT round(avg(hit), 6) AS top_3_accuracy FROM h")
def _top3(s, d):
    return metrics.top_accuracy(_votes(s, d))


@query("log_loss", f"WITH {_VOTES}, t AS (SELECT query_id, coalesce(max(p) FILTER (label = query_label), 0) AS q FROM v GROUP BY 1) SELECT round(-avg(ln(greatest(least(q, 1 - 1e-15), 1e-15))), 6) AS log_loss FROM t")
def _loss(s, d):
    return metrics.log_loss(_votes(s, d))


_MEANS = "t AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), x AS (SELECT label, i, avg(e[i]) AS m FROM t, range(1, 65) r(i) WHERE vec_id % 5 <> 0 GROUP BY ALL), mean AS (SELECT label, list(m ORDER BY i) AS m FROM x GROUP BY 1)"


@query("centroid_assign", f"WITH {_MEANS}, d AS (SELECT t.vec_id, t.label AS true_label, mean.label AS c, round(list_distance(t.e, mean.m) ** 2, 6) AS d FROM t, mean WHERE vec_id % 5 = 0) SELECT vec_id AS query_id, true_label, c AS predicted, d AS distance FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1")
def _centroid(s, d):
    q, g = _sides(s, d)
    return vectors.nearest_centroid(g, q)


_NAMES = "names AS (SELECT true_label AS l FROM pred UNION SELECT predicted FROM pred), cc AS (SELECT a.l AS true_label, b.l AS predicted, coalesce(n, 0) AS n FROM names a CROSS JOIN names b LEFT JOIN c ON c.true_label = a.l AND c.predicted = b.l)"


@query("confusion", f"WITH {_VOTES}, {_NAMES} SELECT * FROM cc")
def _confusion(s, d):
    return metrics.confusion(stored(_pred(s, d)))


@query("confusion_norm", f"WITH {_VOTES}, {_NAMES} SELECT true_label, predicted, round(CASE WHEN sum(n) OVER w > 0 THEN n / sum(n) OVER w ELSE 0 END, 6) AS share FROM cc WINDOW w AS (PARTITION BY true_label)")
def _norm(s, d):
    return metrics.normalised(metrics.confusion(stored(_pred(s, d))))


_PER = "names AS (SELECT true_label AS l FROM pred UNION SELECT predicted FROM pred), pc AS (SELECT l AS label, (SELECT count(*) FROM pred WHERE true_label = l) AS support, (SELECT count(*) FROM pred WHERE predicted = l) AS claimed, (SELECT count(*) FROM pred WHERE predicted = l AND true_label = l) AS tp FROM names), m AS (SELECT label, support, CASE WHEN claimed > 0 THEN tp / claimed ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, CASE WHEN support + claimed > 0 THEN 2 * tp / (support + claimed) ELSE 0 END AS f1 FROM pc)"


@query("per_class_report", f"WITH {_VOTES}, {_PER} SELECT label, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m")
def _per_class(s, d):
    return metrics.per_class(metrics.confusion(_pred(s, d), dense=False)).select("label", "support", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("classification_report", f"WITH {_VOTES}, {_PER} SELECT round((SELECT avg(CASE WHEN true_label = predicted THEN 1.0 ELSE 0 END) FROM pred), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall FROM m")
def _report(s, d):
    return metrics.classification(stored(_pred(s, d)))


@query("ari", f"""WITH {_VOTES}, z AS (SELECT sum(n * (n - 1) / 2) AS sij, sum(n) AS n FROM c), a AS (SELECT sum(m * (m - 1) / 2) AS sa FROM (SELECT sum(n) AS m FROM c GROUP BY true_label)), b AS (SELECT sum(m * (m - 1) / 2) AS sb FROM (SELECT sum(n) AS m FROM c GROUP BY predicted))
SELECT round((sij - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)), 6) AS ari FROM z, a, b""")
def _ari(s, d):
    return metrics.adjusted_rand(stored(_pred(s, d)))


@query("nmi", f"WITH {_VOTES}, w AS (SELECT n, sum(n) OVER () AS total, sum(n) OVER (PARTITION BY true_label) AS a, sum(n) OVER (PARTITION BY predicted) AS b FROM c) SELECT round(sum(n / total * ln(n * total / (a * b))) / ((sum(-n / total * ln(a / total)) + sum(-n / total * ln(b / total))) / 2), 6) AS nmi FROM w")
def _nmi(s, d):
    return metrics.normalised_mutual_information(_pred(s, d))


@query("assignment_acc", f"""WITH {_VOTES}, tr AS (SELECT true_label, dense_rank() OVER (ORDER BY true_label) - 1 AS r FROM (SELECT DISTINCT true_label FROM c)), pr AS (SELECT predicted, dense_rank() OVER (ORDER BY predicted) - 1 AS c FROM (SELECT DISTINCT predicted FROM c)),
sq AS (SELECT CAST(x.i AS BIGINT) AS r, CAST(y.i AS BIGINT) AS c, coalesce((SELECT n FROM c JOIN tr USING (true_label) JOIN pr USING (predicted) WHERE tr.r = x.i AND pr.c = y.i), 0) AS n FROM range(10) x(i), range(10) y(i)),
best AS (WITH {metrics.assignment_sql("sq", 10)}) SELECT round(best / (SELECT count(*) FROM pred), 6) AS assignment_accuracy FROM best""")
def _assignment(s, d):
    return metrics.assignment_accuracy(stored(_pred(s, d)))


_E = metrics.edges()
_BINS = "bins AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, CAST({_E[i]!r} AS DOUBLE), CAST({_E[i + 1]!r} AS DOUBLE))" for i in range(10)) + ") v(bin, lo, hi))"
_RELIABILITY = f"{_BINS}, r AS (SELECT CAST(bin AS BIGINT) AS bin, lo AS bin_lower, hi AS bin_upper, round(coalesce(avg(confidence), (lo + hi) / 2), 6) AS mean_confidence, round(coalesce(avg(CASE WHEN true_label = predicted THEN 1.0 WHEN query_id IS NOT NULL THEN 0.0 END), 0), 6) AS fraction_positive, count(query_id) AS count FROM bins LEFT JOIN pred ON confidence > lo AND confidence <= hi GROUP BY bin, lo, hi)"


@query("reliability_bins", f"WITH {_VOTES}, {_RELIABILITY} SELECT * FROM r")
def _reliability(s, d):
    return metrics.reliability(_pred(s, d))


@query("ece", f"WITH {_VOTES}, {_RELIABILITY} SELECT round(sum(CASE WHEN count > 0 THEN abs(fraction_positive - mean_confidence) * count / (SELECT count(*) FROM pred) END), 5) AS ece FROM r")
def _ece(s, d):
    return metrics.calibration_error(stored(_pred(s, d)))


@query("mean_pool", "WITH c AS (SELECT label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT CAST(label AS BIGINT) AS label, CAST(i - 1 AS BIGINT) AS dim, round(avg(e[i]), 6) AS value FROM c, range(1, 65) r(i) GROUP BY ALL")
def _pool(s, d):
    return table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("value"))


@query("layer_mean_pool", "WITH c AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT vec_id, round((e[1] + e[33]) / 2, 6) AS first, round(list_sum(e) / 2, 6) AS total FROM c")
def _layers(s, d):
    v = scalars.mean_pool(F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)))
    return table(s, d, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("l2_validate", "WITH c AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT count(*) AS n, count(DISTINCT len(e)) AS dims, count(*) FILTER (list_count(list_filter(e, lambda x: isnan(x))) > 0) AS with_nan, count(*) FILTER (abs(sqrt(list_dot_product(e, e)) - 1) > 1e-3) AS not_unit FROM c")
def _validate(s, d):
    e = F.col("embedding")
    return table(s, d, "embeddings").agg(F.count("*").alias("n"), F.countDistinct(F.size(e)).alias("dims"), F.count(F.when(F.exists(e, lambda x: F.isnan(x)), 1)).alias("with_nan"), F.count(F.when(F.abs(scalars.norm(e) - 1) > 1e-3, 1)).alias("not_unit"))


_CONFIGS = "(VALUES ('l33', 'esm2_t33_650M_UR50D', [33], 'mean'), ('l20_22', 'esm2_t33_650M_UR50D', [20, 21, 22], 'mean'), ('cls', 'esm2_t33_650M_UR50D', [33], 'cls')) v(config, model, layers, pooling)"


@query("config_hash", f"SELECT config, substring(sha256(model || '|[' || array_to_string(layers, ', ') || ']|' || pooling), 1, 16) AS h3, substring(sha256(model || '|[' || array_to_string(layers, ', ') || ']|' || pooling || '|1022|900'), 1, 16) AS h5 FROM {_CONFIGS}")
def _config(s, d):
    rows = s.sql("SELECT * FROM VALUES ('l33', 'esm2_t33_650M_UR50D', array(33), 'mean'), ('l20_22', 'esm2_t33_650M_UR50D', array(20, 21, 22), 'mean'), ('cls', 'esm2_t33_650M_UR50D', array(33), 'cls') AS v(config, model, layers, pooling)")
    parts = (F.col("model"), F.col("layers"), F.col("pooling"))
    return rows.select("config", scalars.config_hash(*parts).alias("h3"), scalars.config_hash(*parts, F.lit(1022), F.lit(900)).alias("h5"))


@query("word_size", "SELECT DISTINCT l_discount, CASE WHEN x >= 1.0 THEN 5 WHEN x >= 0.7 THEN 5 WHEN x >= 0.6 THEN 4 WHEN x >= 0.5 THEN 3 WHEN x >= 0.4 THEN 2 ELSE 5 END AS word FROM (SELECT l_discount, l_discount * 10 AS x FROM lineitem)")
def _word(s, d):
    return table(s, d, "lineitem").select("l_discount", scalars.word_size(F.col("l_discount") * 10).alias("word")).distinct()


@query("confidence_flags", f"WITH {_VOTES} SELECT query_id, CASE WHEN confidence >= 0.7 THEN 'high' ELSE 'low' END AS flag, CASE WHEN confidence > 0.7 THEN 'good' WHEN confidence > 0.5 THEN 'moderate' ELSE 'low' END AS band FROM pred")
def _flags(s, d):
    return _pred(s, d).select("query_id", scalars.confidence_flag(F.col("confidence")).alias("flag"), scalars.integrity_band(F.col("confidence")).alias("band"))


_PRICES = "x AS (SELECT o_orderpriority AS name, avg(o_totalprice) AS value FROM orders GROUP BY 1)"


@query("improvement_pct", f"WITH {_PRICES} SELECT name, round(value, 4) AS value, round((value - b.v) * 100 / b.v, 6) AS improvement_pct, name = (SELECT name FROM x ORDER BY value DESC, name LIMIT 1) AS is_best FROM x, (SELECT max(value) AS v FROM x WHERE name = '3-MEDIUM') b")
def _improvement(s, d):
    return reports.improvements(table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.avg("o_totalprice").alias("value")), "name", "value", "3-MEDIUM")


@query("run_list", "SELECT s_name AS run_id, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(s_nationkey AS VARCHAR) END AS created_at, row_number() OVER (ORDER BY coalesce(CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(s_nationkey AS VARCHAR) END, '') DESC, s_name) AS position FROM supplier")
def _runs(s, d):
    return reports.runs(table(s, d, "supplier").select(F.col("s_name").alias("run_id"), F.when(F.col("s_suppkey") % 4 == 0, None).otherwise(F.col("s_nationkey").cast("string")).alias("created_at")))


def _numbers(s, d):
    pred = stored(_pred(s, d))
    data = table(s, d, "embeddings").agg(F.count("*").alias("n"), F.countDistinct("label").alias("classes"))
    return reports.registry([reports.entries("dataset", data), reports.entries("knn", metrics.classification(pred)), reports.entries("clustering", metrics.adjusted_rand(pred)), reports.entries("calibration", metrics.calibration_error(pred))])


query(
    "numbers_registry",
    f"""WITH {_VOTES}, {_PER}, {_RELIABILITY}, z AS (SELECT sum(n * (n - 1) / 2) AS sij, sum(n) AS n FROM c), a AS (SELECT sum(m * (m - 1) / 2) AS sa FROM (SELECT sum(n) AS m FROM c GROUP BY true_label)), b AS (SELECT sum(m * (m - 1) / 2) AS sb FROM (SELECT sum(n) AS m FROM c GROUP BY predicted)),
o AS (SELECT round((SELECT avg(CASE WHEN true_label = predicted THEN 1.0 ELSE 0 END) FROM pred), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall FROM m)
SELECT 'dataset' AS section, 'n' AS key, CAST(count(*) AS DOUBLE) AS value FROM embeddings UNION ALL SELECT 'dataset', 'classes', count(DISTINCT label) FROM embeddings
UNION ALL SELECT 'knn', unnest(['accuracy', 'macro_f1', 'weighted_f1', 'macro_precision', 'macro_recall']), unnest([accuracy, macro_f1, weighted_f1, macro_precision, macro_recall]) FROM o
UNION ALL SELECT 'clustering', 'ari', round((sij - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)), 6) FROM z, a, b
UNION ALL SELECT 'calibration', 'ece', round(sum(CASE WHEN count > 0 THEN abs(fraction_positive - mean_confidence) * count / (SELECT count(*) FROM pred) END), 5) FROM r""",
)(_numbers)


def _prepared(s, d):
    q, g = _sides(s, d)
    return tuple(stored(learning.features(x, "vec_id", "embedding", "label")) for x in (g, q))


@query("logreg")
def _logreg(s, d):
    train, rows = _prepared(s, d)
    _, names, scored = learning.logistic(train, rows)
    return learning.distribution(scored, names)


@query("platt")
def _platt(s, d):
    train, rows = _prepared(s, d)
    return learning.platt(train, rows)


@query("kmeans_best_of_n")
def _kmeans(s, d):
    every = learning.features(table(s, d, "embeddings"), "vec_id", "embedding", "label")
    return learning.k_means(every, 10)


@query("mlp")
def _mlp(s, d):
    return learning.network(*_prepared(s, d), 64)


@query("random_stratified", """WITH c AS (SELECT CAST(label AS VARCHAR) AS c, count(*) AS n FROM embeddings WHERE vec_id % 5 <> 0 GROUP BY 1), sh AS (SELECT c, sum(n) OVER (ORDER BY c) - n AS lo, sum(n) OVER (ORDER BY c) AS hi, sum(n) OVER () AS total FROM c),
d AS (SELECT vec_id, CAST('0x' || substring(md5('42:' || CAST(vec_id AS VARCHAR)), 1, 8) AS BIGINT) AS d FROM embeddings WHERE vec_id % 5 = 0) SELECT vec_id AS id, c AS predicted FROM d JOIN sh ON floor(d * total / 4294967296.0) >= lo AND floor(d * total / 4294967296.0) < hi""")
def _chance(s, d):
    q, g = _sides(s, d)
    return learning.by_chance(g, q, F.col("label"), F.col("vec_id"))


@query("motif_logreg")
def _motif_model(s, d):
    docs = table(s, d, "documents").select("doc_id", F.col("lang").alias("y"), F.array(*(c.cast("double") for c in motifs.flags(F.col("text")))).alias("v"))
    x = stored(learning.features(docs, "doc_id", "v", "y"))
    _, names, scored = learning.logistic(x.where("id % 5 <> 0"), x.where("id % 5 = 0"))
    return learning.distribution(scored, names)


# What models have to fulfil whatever their weights are: sums of probabilities, gradients of nought, nearest centres, every row once.
_TRUE = lambda *names: " UNION ALL ".join(f"SELECT '{n}' AS \"check\", true AS passed" for n in names)
_ASKED = "SELECT count(*) FROM embeddings WHERE vec_id % 5 = 0"


def _sums(p, rows: int, tolerance: float = 1e-6):
    per = p.groupBy("query_id").agg(F.sum("p").alias("s"), F.min("p").alias("least"))
    return per.agg((F.max(F.abs(F.col("s") - 1)) < tolerance).alias("sums_to_one"), (F.min("least") >= 0).alias("not_negative"), (F.count("*") == rows).alias("every_row"))


def _checks(one_row):
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).alias("passed")) for c in one_row.columns)))
    return one_row.select(each.alias("x")).select("x.*")


def _at_rest(train, model, names):
    """Whether the gradient of the balanced, regularised log-likelihood is nought: by class and dimension, within a thousandth of the weights' scale."""
    weighted, _, n = learning._weighted(train)
    w = model.coefficientMatrix.toArray()
    g = model.transform(weighted).select(F.posexplode(vector_to_array("probability")).alias("k", "p"), "label", "w", vector_to_array("features").alias("v"))
    g = g.select("k", ((F.col("p") - (F.col("k") == F.col("label")).cast("double")) * F.col("w")).alias("e"), F.posexplode("v").alias("i", "x")).groupBy("k", "i").agg(F.sum(F.col("e") * F.col("x")).alias("g"))
    flat = F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in w))
    return g.select(F.abs(F.col("g") + F.get(F.get(flat, F.col("k")), F.col("i"))).alias("g")).agg((F.max("g") < 1e-2 * (1 + float(abs(w).max()))).alias("gradient_is_nought"))


@query("logreg_check", _TRUE("sums_to_one", "not_negative", "every_row", "gradient_is_nought"))
def _logreg_check(s, d):
    train, rows = _prepared(s, d)
    model, names, scored = learning.logistic(train, rows)
    return _checks(_sums(learning.distribution(scored, names), rows.count())).unionByName(_checks(_at_rest(train, model, names)))


@query("platt_check", _TRUE("sums_to_one", "not_negative", "every_row"))
def _platt_check(s, d):
    train, rows = _prepared(s, d)
    return _checks(_sums(learning.platt(train, rows), rows.count()))


@query("kmeans_check", _TRUE("every_row", "centres_are_means", "better_than_one_start"))
def _kmeans_check(s, d):
    every = stored(learning.features(table(s, d, "embeddings"), "vec_id", "embedding", "label"))
    centres, cost = learning.k_means_fit(every, 10)
    _, one = learning.k_means_fit(every, 10, 1)
    got = learning.assign(every, centres).join(every.select("id", vector_to_array("features").alias("v")), "id")
    flat = F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in centres))
    means = got.select("cluster", F.posexplode("v").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("m"))
    off = means.agg((F.max(F.abs(F.col("m") - F.get(F.get(flat, F.col("cluster")), F.col("i")))) < 1e-2).alias("centres_are_means"))
    rows = got.agg((F.count("*") == every.count()).alias("every_row"))
    return _checks(rows).unionByName(_checks(off)).unionByName(_checks(rows.select(F.lit(cost <= one + 1e-9).alias("better_than_one_start"))))


@query("mlp_check", _TRUE("every_row", "known_classes", "fits_its_training_rows"))
def _mlp_check(s, d):
    train, rows = _prepared(s, d)
    got = learning.network(train, train.unionByName(rows), 64).withColumn("right", (F.col("y") == F.col("predicted")).cast("int"))
    names = [r.y for r in train.select("y").distinct().collect()]  # a row a class
    held = got.join(rows.select("id"), "id", "left_semi").agg((F.count("*") == rows.count()).alias("every_row"), F.bool_and(F.col("predicted").isin(names)).alias("known_classes"))
    return _checks(held).unionByName(_checks(got.join(train.select("id"), "id", "left_semi").agg((F.avg("right") > 0.9).alias("fits_its_training_rows"))))


@query("motif_logreg_check", _TRUE("sums_to_one", "not_negative", "every_row"))
def _motif_check(s, d):
    p = _motif_model(s, d)
    return _checks(_sums(p, table(s, d, "documents").where("doc_id % 5 = 0").count()))


@query("standardised", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), m AS (SELECT avg(e[1]) AS a, stddev_pop(e[1]) AS s, avg(e[64]) AS b, stddev_pop(e[64]) AS t FROM e WHERE vec_id % 5 <> 0)
SELECT vec_id, round((e[1] - a) / s, 6) AS first, round((e[64] - b) / t, 6) AS last FROM e, m WHERE vec_id % 5 = 0""")
def _standardised(s, d):
    q, g = (learning.features(x, "vec_id", "embedding", "label") for x in _sides(s, d))
    v = learning.scaled(g, q).select(F.col("id").alias("vec_id"), vector_to_array("features").alias("v"))
    return v.select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.get("v", F.lit(63)), 6).alias("last"))


_ROW = "SELECT {} AS position, '{}' AS stage, count(*) AS n_sequences, count(DISTINCT lang) AS n_classes FROM documents {}"


@query("dataset_stages", " UNION ALL ".join(_ROW.format(*x) for x in ((1, "documents", ""), (2, "labelled", "WHERE doc_id IN (SELECT doc_id FROM labels)"), (3, "good", "WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"))))
def _dataset(s, d):
    docs, labels = table(s, d, "documents").select("doc_id", "lang"), table(s, d, "labels")
    return reports.stages([("documents", docs), ("labelled", docs.join(labels, "doc_id", "left_semi")), ("good", docs.join(labels.where("quality = 1"), "doc_id", "left_semi"))], "lang")


@query("layer_ablation", """WITH x AS (SELECT o_orderpriority AS name, avg(o_totalprice) / 300000 AS ari, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS nmi FROM orders GROUP BY 1), b AS (SELECT ari AS v FROM x WHERE name = '3-MEDIUM')
SELECT name, round(ari, 4) AS ari, round(nmi, 4) AS nmi, printf('%+.1f%%', (ari - v) * 100 / v) AS improvement FROM x, b""")
def _ablation(s, d):
    x = table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg((F.avg("o_totalprice") / 300000).alias("ari"), F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("nmi"))
    return reports.ablation(x, "name", ["ari", "nmi"], "3-MEDIUM")


_LOSS = "CASE c_mktsegment WHEN 'BUILDING' THEN NULL WHEN 'FURNITURE' THEN 0.0 ELSE avg(abs(c_acctbal)) / 10000 END"


@query("method_table", f"""WITH x AS (SELECT c_mktsegment AS method, avg(CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0.0 END) AS accuracy, avg(CASE WHEN c_acctbal > 5000 THEN 1.0 ELSE 0.0 END) AS macro_f1, {_LOSS} AS log_loss FROM customer GROUP BY 1)
SELECT row_number() OVER (ORDER BY CASE method WHEN 'MACHINERY' THEN 1 WHEN 'AUTOMOBILE' THEN 2 ELSE 3 END, method) AS position, method, round(accuracy, 4) AS accuracy, round(macro_f1, 4) AS macro_f1, CASE WHEN coalesce(log_loss, 0) <> 0 THEN CAST(round(log_loss, 4) AS VARCHAR) ELSE 'N/A' END AS log_loss FROM x""")
def _methods(s, d):
    share = lambda least: F.avg(F.when(F.col("c_acctbal") > least, 1.0).otherwise(0.0))
    x = table(s, d, "customer").groupBy("c_mktsegment").agg(share(0).alias("accuracy"), share(5000).alias("macro_f1"), F.expr(_LOSS).alias("log_loss"))
    return reports.methods(x.withColumnRenamed("c_mktsegment", "method"), ["MACHINERY", "AUTOMOBILE"])


@query("registry_upsert", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN -p_size ELSE p_size END AS p_size FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0")
def _upsert(s, d):
    part = table(s, d, "part").select("p_partkey", "p_size")
    return reports.upsert(part.where("p_partkey % 2 = 0"), part.where("p_partkey % 3 = 0").withColumn("p_size", -F.col("p_size")), ["p_partkey"])


@query("numbers_agree", """WITH a AS (SELECT c_nationkey AS nation, count(*) AS expected FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS nation, count(*) AS found FROM supplier GROUP BY 1)
SELECT nation, expected, found, coalesce(abs(expected - found) <= 55, false) AS passed FROM a FULL JOIN b USING (nation)""")
def _agree(s, d):
    n = lambda name, key: table(s, d, name).groupBy(F.col(key).alias("nation")).agg(F.count("*").alias("n"))
    return integrity.agree(n("customer", "c_nationkey"), n("supplier", "s_nationkey"), ["nation"], "n", 55)


_RULES = {"several_classes": "n['dataset.classes'] > 1", "enough_rows": "n['dataset.n'] >= n['dataset.classes']", "few_rows": "n['dataset.n'] < 10", "splits": "n['splits.n'] > 0"}


@query("report_checklist", "WITH e AS (SELECT count(*) AS n, count(DISTINCT label) AS c FROM embeddings) " + " UNION ALL ".join(f"""SELECT '{k}' AS "check", {sql} AS passed, '{_RULES[k].replace("'", "''")}' AS message FROM e""" for k, sql in zip(_RULES, ("c > 1", "n >= c", "n < 10", "false"), strict=True)))
def _checklist(s, d):
    return integrity.checklist(reports.entries("dataset", table(s, d, "embeddings").agg(F.count("*").alias("n"), F.countDistinct("label").alias("classes"))), _RULES)


_FOUND = " + ".join(f"CAST(regexp_matches(piece, '{p}') AS BIGINT)" for _, p in motifs.FLAGS)


@query("predict_batch", f"""WITH {_VOTES}, b AS (SELECT l_orderkey AS id, l_linenumber AS a FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount, l_extendedprice DESC, l_linenumber) = 1),
t AS (SELECT query_id AS id, string_agg(label || ':' || p, ';' ORDER BY p DESC, label) AS classes FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, label) AS k FROM v) WHERE k <= 3 GROUP BY 1),
e AS (SELECT query_id AS id, string_agg(CAST(gallery_id AS VARCHAR), ',' ORDER BY rank) AS exemplars FROM ranked WHERE rank <= 5 GROUP BY 1),
sq AS (SELECT doc_id AS id, upper(regexp_replace(replace(text, 'ß', 'SS'), '\\s+', '', 'g')) AS seq FROM documents),
j AS (SELECT sq.id, substring(seq, CAST(a AS BIGINT), 100) AS piece, classes, exemplars, predicted, confidence, CASE WHEN NOT coalesce(length(seq) >= 50, false) THEN 'invalid sequence' WHEN a IS NULL THEN 'no domain found' WHEN classes IS NULL THEN 'no embedding' ELSE 'ok' END AS status FROM sq LEFT JOIN b USING (id) LEFT JOIN t USING (id) LEFT JOIN e USING (id) LEFT JOIN pred ON query_id = sq.id)
SELECT id, status, CASE WHEN status = 'ok' THEN md5(piece) END AS domain, CASE WHEN status = 'ok' THEN predicted END AS predicted, CASE WHEN status = 'ok' THEN confidence END AS confidence,
  CASE WHEN status = 'ok' THEN CASE WHEN confidence >= 0.7 THEN 'high' ELSE 'low' END END AS flag, CASE WHEN status = 'ok' THEN classes END AS classes, CASE WHEN status = 'ok' THEN exemplars END AS exemplars, CASE WHEN status = 'ok' THEN {_FOUND} END AS n_motifs FROM j""")
def _predict(s, d):
    top = vectors.top_k(*_sides(s, d), 5)
    seqs = table(s, d, "documents").select(F.col("doc_id").alias("id"), scalars.normalised(F.col("text")).alias("seq"))
    hits = table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("env_from"), (F.col("l_linenumber") + 99).alias("env_to"), F.col("l_discount").alias("evalue"), F.col("l_extendedprice").alias("bitscore"))
    out = prediction.predict(seqs, hits, vectors.votes(top), top, F.length("seq") >= 50)
    classes = F.array_join(F.transform("classes", lambda x: F.concat_ws(":", x["label"], x["p"].cast("string"))), ";")
    return out.withColumns({"domain": F.md5("domain"), "classes": classes, "exemplars": F.array_join(F.transform("exemplars", lambda x: x.cast("string")), ",")})


#: What the six figures show: name, the query that has its data, and which of its columns are series, x and y.
FIGURES = (
    ("layers", "layer_ablation", "name", "'ari'", "ari"),
    ("methods", "method_table", "method", "'accuracy'", "accuracy"),
    ("classes", "per_class_report", "label", "'f1'", "f1"),
    ("confusion", "confusion_norm", "true_label", "predicted", "share"),
    ("reliability", "reliability_bins", "'fraction_positive'", "cast(bin AS string)", "fraction_positive"),
    ("retrieval", "pr_curve", "'precision'", "cast(step AS string)", "precision"),
)


@query("figure_data", " UNION ALL ".join(f"SELECT '{name}' AS figure, {series} AS series, {x} AS x, CAST({y} AS DOUBLE) AS y FROM ({ORACLE[q]})" for name, q, series, x, y in FIGURES))
def _figures(s, d):
    return integrity.all_of([QUERIES[q](s, d).selectExpr(f"'{name}' AS figure", f"{series} AS series", f"{x} AS x", f"cast({y} AS double) AS y") for name, q, series, x, y in FIGURES])
