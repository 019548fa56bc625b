"""Queries that write files, read them back, and are held against the tables they came from."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import integrity, learning, reports
from ..sources import formats, sinks
from ..storage import scratch
from .common import table, wide

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: wide(f(spark, sf_dir))
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _letters(s: SparkSession, d: str) -> DataFrame:
    """Documents as sequences: the letters A to Z of the whole text."""
    return table(s, d, "documents").select("doc_id", "lang", "source", F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")).alias("seq"))


_SEQ = "upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'))"
_KEYS = {"pipe": "'D' || doc_id", "second": "'D' || doc_id", "first": "'sp'", "word": "'sp|D' || doc_id || '|' || lang"}


@query("fasta_scan", " UNION ALL ".join(f"SELECT '{k}' AS keying, {sql} AS accession, 'sp|D' || doc_id || '|' || lang || ' ' || source AS header, length({_SEQ}) AS n, md5({_SEQ}) AS seq_md5 FROM documents" for k, sql in _KEYS.items()))
def _fasta(s, d):
    path = scratch(s)
    x = _letters(s, d)
    sinks.fasta(x.select(F.concat(F.lit("sp|D"), "doc_id", F.lit("|"), "lang", F.lit(" "), "source").alias("header"), F.lit("").alias("accession"), "seq"), path)
    parts = [formats.fasta(s, path, k).select(F.lit(k).alias("keying"), "accession", "header", F.length("seq").alias("n"), F.md5("seq").alias("seq_md5")) for k in _KEYS]
    return integrity.all_of(parts)


@query("fasta_lines", f"WITH s AS (SELECT length({_SEQ}) AS n FROM documents) SELECT CAST(sum(1 + ceil(n / 60.0)) AS BIGINT) AS lines, count(*) AS records, CAST(max(least(n, 60)) AS BIGINT) AS widest FROM s")
def _lines(s, d):
    path = scratch(s)
    sinks.fasta(_letters(s, d).select(F.concat(F.lit("D"), "doc_id").alias("accession"), "seq"), path, ["accession"])
    lines = s.read.text(path).where("value <> ''")
    body = ~F.col("value").startswith(">")
    return lines.agg(F.count("*").alias("lines"), F.count(F.when(~body, 1)).alias("records"), F.max(F.when(body, F.length("value"))).alias("widest"))


@query("domain_fasta", f"WITH x AS (SELECT doc_id, lang, doc_id % 50 + 1 AS a, {_SEQ} AS seq FROM documents) SELECT 'D' || doc_id || '|' || lang || '|' || a || '-' || (a + 99) AS accession, substring(seq, CAST(a AS INT), 100) AS seq FROM x")
def _domains(s, d):
    path, a = scratch(s), (F.col("doc_id") % 50 + 1).cast("int")
    sinks.domain_fasta(_letters(s, d).select(F.concat(F.lit("D"), "doc_id").alias("uniprot_id"), F.col("lang").alias("pfam_id"), a.alias("env_from"), (a + 99).alias("env_to"), scalars.envelope(F.col("seq"), a, a + 99).alias("seq")), path)
    return formats.fasta(s, path, "word").select("accession", "seq")


@query("inline_fasta", "WITH x AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^A-Za-z \\n]', '', 'g') AS t FROM documents) SELECT CASE WHEN doc_id % 2 = 0 THEN 'h' || doc_id ELSE 'Input_Sequence' END AS header, md5(upper(regexp_replace(t, '\\s+', '', 'g'))) AS seq_md5 FROM x")
def _inline(s, d):
    t = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z \n]", "")
    x = table(s, d, "documents").select(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(">h"), "doc_id", F.lit("\n"), t)).otherwise(t).alias("text"))
    return formats.inline(x).select("header", F.md5("seq").alias("seq_md5"))


@query("tsv_round_trip", "SELECT CAST(c_custkey AS VARCHAR) AS accession, c_name AS protein_name, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE c_mktsegment END AS organism_name, CAST(c_nationkey AS VARCHAR) AS length FROM customer")
def _tsv(s, d):
    path = scratch(s)
    x = table(s, d, "customer").select(F.col("c_custkey").alias("Entry"), F.col("c_name").alias("Protein names"), F.when(F.col("c_custkey") % 9 == 0, None).otherwise(F.col("c_mktsegment")).alias("Organism"), F.col("c_nationkey").alias("Length"))
    sinks.tsv(x, path, ["Entry"])
    return formats.tsv(s, path)


@query("csv_blank_rows", "SELECT p_partkey, p_name, p_brand FROM part")
def _csv(s, d):
    path, part = scratch(s), table(s, d, "part").select("p_partkey", "p_name", "p_brand")
    blank = part.where("p_partkey % 10 = 0").select(F.lit(None).cast("long").alias("p_partkey"), F.lit(None).cast("string").alias("p_name"), F.lit(None).cast("string").alias("p_brand"))
    sinks.tsv(part.unionByName(blank), path, sep=",")
    return formats.csv(s, path, "p_partkey long, p_name string, p_brand string")


_HIT = ("concat_ws(' ', concat('P', l_orderkey), '-', '300', concat('Fam', l_linenumber), concat('PF', l_suppkey, '.7'), '264', '1e-50', '170', '0.1', '1', '1', '2e-60', l_discount, l_extendedprice, '0.1', '1', '264', '5', '280', l_linenumber, l_linenumber + 100, '0.95', 'what it is')",)


@query("domain_hits", "SELECT 'P' || l_orderkey AS uniprot_id, 'PF' || l_suppkey AS pfam_id, 'Fam' || l_linenumber AS pfam_name, CAST(l_linenumber AS BIGINT) AS env_from, CAST(l_linenumber + 100 AS BIGINT) AS env_to, CAST(101 AS BIGINT) AS domain_length, l_discount AS evalue, l_extendedprice AS bitscore FROM lineitem WHERE l_discount <= 0.05")
def _hits(s, d):
    lines, parts = table(s, d, "lineitem"), []
    for i in (0, 1):  # two files of hits, with comments and a broken line, put together
        path = scratch(s)
        own = lines.where(f"l_linenumber % 2 = {i}").selectExpr(f"{_HIT[0]} AS value")
        own.union(s.range(2).selectExpr("if(id = 0, '# a comment', 'too short a line') AS value")).write.text(path)
        parts.append(s.read.text(path))
    path = scratch(s)
    sinks.merged_hits(parts, path)
    return formats.hits(s, path, 0.05).drop("hit_pos")


@query("cluster_listing", "SELECT CAST(l_orderkey AS BIGINT) AS cluster_id, 'O' || l_orderkey || 'L' || l_linenumber AS member, CAST(l_quantity AS BIGINT) AS length, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) = 1 AS is_rep, CASE WHEN row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) > 1 THEN round(50 + 100 * l_discount, 2) END AS identity FROM lineitem")
def _clusters(s, d):
    path = scratch(s)
    x = table(s, d, "lineitem").selectExpr("l_orderkey", "l_linenumber k", "l_partkey p", "l_extendedprice e", "concat(cast(l_quantity as int), 'aa, >O', l_orderkey, 'L', l_linenumber, '... ') AS head", "format_string('at %.2f%%', 50 + 100 * l_discount) AS tail")
    # an order has a handful of lines
    listed = x.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("k", "p", "e", "head", "tail"))).alias("m"))
    text = listed.selectExpr("concat('>Cluster ', l_orderkey, '\n', array_join(transform(m, (r, i) -> concat(i, '\t', r.head, if(i = 0, '*', r.tail))), '\n')) AS value")
    text.write.text(path)
    return formats.clusters(s, path)


@query("id_list", "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS id FROM orders")
def _ids(s, d):
    path = scratch(s)
    sinks.ids(table(s, d, "orders").select("o_custkey"), path)
    return formats.ids(s, path)


@query("json_report", "SELECT count(*) AS documents, count(DISTINCT lang) AS langs, (SELECT count(*) FROM labels) AS labels FROM documents")
def _json(s, d):
    path = scratch(s)
    docs = table(s, d, "documents").agg(F.count("*").alias("documents"), F.countDistinct("lang").alias("langs"))
    numbers = reports.registry([reports.entries("corpus", docs), reports.entries("marks", table(s, d, "labels").agg(F.count("*").alias("labels")))])
    reports.as_json(numbers).write.text(path)
    if formats.json_document(s, path + "-absent") is not None:
        raise AssertionError("a document that isn't there was read")
    return formats.json_document(s, path).selectExpr("cast(corpus.documents as long) documents", "cast(corpus.langs as long) langs", "cast(marks.labels as long) labels")


@query("json_rows", "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang")
def _json_rows(s, d):
    path = scratch(s)
    x = table(s, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    sinks.report(x.select("lang", F.struct("n", "chars").alias("counts")), path)
    return s.read.json(path).select("lang", "counts.n", "counts.chars")


@query("profile_version", "SELECT 'PF' || lpad(CAST(count(*) AS VARCHAR), 5, '0') || '.28' AS version FROM nation")
def _profile(s, d):
    path = scratch(s)
    acc = table(s, d, "nation").agg(F.concat(F.lit("HMMER3/f\nNAME  X\nACC   PF"), F.lpad(F.count("*").cast("string"), 5, "0"), F.lit(".28\nACC   PF99999.1\nEND")).alias("value"))
    acc.write.text(path)
    return formats.profile_version(s, path)


@query("file_manifest", "SELECT 'region-' || r_regionkey AS folder, CAST(length(r_name) + 1 AS BIGINT) AS size_bytes, sha256(r_name || chr(10)) AS sha256 FROM region WHERE r_regionkey <> 3")
def _manifest(s, d):
    path, listing = scratch(s), scratch(s)
    region = table(s, d, "region")
    for key in [r.r_regionkey for r in region.select("r_regionkey").collect()]:  # five rows
        region.where(F.col("r_regionkey") == key).select("r_name").coalesce(1).write.text(f"{path}/region-{key}" if key != 3 else f"{path}-other")
    found = formats.files(s, path, "*.txt").withColumn("path", F.regexp_extract("path", "(region-[0-9]+)/", 1))
    sinks.hash_manifest(found, listing)
    back = s.read.text(listing).select(F.split("value", "  ", 2).alias("x")).select(F.col("x")[1].alias("folder"), F.col("x")[0].alias("sha256"))
    return back.join(found.select(F.col("path").alias("folder"), "size_bytes"), "folder")


@query("matrix_files", "WITH e AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT round(e[1], 6) AS first, round(e[64], 6) AS last, CAST(len(e) AS BIGINT) AS dims FROM e")
def _matrix(s, d):
    path = scratch(s)
    sinks.matrix(table(s, d, "embeddings").select("embedding"), path)
    e = F.col("embedding")
    return formats.matrix(s, path).select(F.round(F.get(e, F.lit(0)).cast("double"), 6).alias("first"), F.round(F.get(e, F.lit(63)).cast("double"), 6).alias("last"), F.size(e).alias("dims"))


@query("model_store", "SELECT vec_id AS id, true AS same FROM embeddings WHERE vec_id % 5 = 0")
def _model(s, d):
    e = learning.features(table(s, d, "embeddings"), "vec_id", "embedding", "label")
    asked = e.where("id % 5 = 0")
    model, _, scored = learning.logistic(e.where("id % 5 <> 0"), asked, 20)
    path = scratch(s)
    learning.save(model, path)
    try:
        learning.save(model, path)
        raise AssertionError("a stored model was overwritten")
    except FileExistsError:
        pass
    again = learning.load(path).transform(asked).select("id", F.col("probability").alias("again"))
    return scored.join(again, "id").select("id", (F.col("probability") == F.col("again")).alias("same"))


@query("run_lifecycle", "SELECT * FROM (VALUES ('2026-01-03_000000', 'third', true, CAST(1 AS BIGINT)), ('2026-01-02_000000', 'second, again', false, 2), ('2026-01-01_000000', 'first', false, 3)) v(run_id, note, is_current, position)")
def _lifecycle(s, d):
    path = scratch(s)
    for run, note in (("2026-01-01_000000", "first"), ("2026-01-02_000000", "second"), ("2026-01-03_000000", "third")):
        reports.run_init(s, path, run, note)
    try:
        reports.run_init(s, path, "2026-01-02_000000", "refused")
        raise AssertionError("a run was overwritten without force")
    except FileExistsError:
        pass
    reports.run_init(s, path, "2026-01-02_000000", "second, again", force=True)
    reports.set_current(s, path, "2026-01-03_000000")
    return reports.run_listing(s, path)


@query("refuse_overwrite", "SELECT 'orders' AS name, true AS refused, count(*) AS n FROM orders")
def _refuse(s, d):
    path, x = scratch(s), table(s, d, "orders").select("o_orderkey")
    sinks.tsv(x, path)
    try:
        sinks.tsv(x.limit(1), path)
        refused = False
    except AnalysisException:
        refused = True
    return formats.tsv(s, path).agg(F.lit("orders").alias("name"), F.lit(refused).alias("refused"), F.count("*").alias("n"))


@query("stored_registries", """WITH a AS (SELECT 'clustering' AS section, lang AS key, CAST(count(*) AS DOUBLE) AS value FROM documents GROUP BY lang), f AS (SELECT 'calibration' AS section, CAST(quality AS VARCHAR) AS key, CAST(count(*) AS DOUBLE) AS value FROM labels GROUP BY quality)
SELECT * FROM a UNION ALL SELECT * FROM f""")
def _registries(s, d):
    docs, labels = table(s, d, "documents"), table(s, d, "labels")
    one = docs.groupBy(F.col("lang").alias("key")).agg(F.count("*").cast("double").alias("value")).select(F.lit("clustering").alias("section"), "key", "value")
    old = labels.groupBy(F.col("quality").cast("string").alias("key")).agg(F.count("*").cast("double").alias("value"))
    paths = [scratch(s) for _ in range(3)]
    sinks.registry(one, paths[0])
    sinks.registry(old.select(F.lit("calibration").alias("section"), "key", "value"), paths[1])
    sinks.registry(one.withColumn("value", F.lit(0.0)), paths[2])
    # a section that the registries lack comes from the older files; one that they have doesn't
    return reports.merged(s, [paths[0], scratch(s)], [paths[1], paths[2]])


@query("summary_csv", "SELECT event_type, CAST(count(*) AS VARCHAR) AS n, printf('%.3f', avg(value)) AS mean FROM events GROUP BY event_type")
def _summary(s, d):
    path = scratch(s)
    x = table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    sinks.tsv(reports.formatted(x, {"mean": "%.3f"}), path, ["event_type"], ",")
    return s.read.csv(path, header=True)


_SETS = {"first": "true", "second": "vec_id % 7 <> 0", "third": "true"}


@query("embedding_sets", "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) " + " UNION ALL ".join(f"SELECT '{k}' AS config, count(*) AS n, count(DISTINCT len(e)) AS dims, count(*) FILTER (list_count(list_filter(e, lambda x: isnan(x))) > 0) AS with_nan, count(*) = (SELECT count(*) FROM e) AS same_ids FROM e WHERE {w}" for k, w in _SETS.items()))
def _sets(s, d):
    e = table(s, d, "embeddings")
    return integrity.embedding_sets(integrity.all_of([e.where(w).select(F.lit(k).alias("config"), F.col("vec_id").alias("id"), "embedding") for k, w in _SETS.items()]), "first")


@query("three_way_inner", "SELECT vec_id AS id, quality, lang FROM embeddings JOIN labels ON labels.doc_id = vec_id JOIN documents ON documents.doc_id = vec_id")
def _three(s, d):
    e, lab, docs = table(s, d, "embeddings").select(F.col("vec_id").alias("id")), table(s, d, "labels").select(F.col("doc_id").alias("id"), "quality"), table(s, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    return e.join(lab, "id").join(docs, "id")


@query("tracked_exclusions", "SELECT id, CASE WHEN NOT v THEN 'no vector' WHEN NOT l THEN 'no label' ELSE 'used' END AS status FROM (SELECT o_orderkey AS id, o_orderkey IN (SELECT vec_id FROM embeddings) AS v, o_orderkey IN (SELECT doc_id FROM labels) AS l FROM orders)")
def _tracked(s, d):
    asked = table(s, d, "orders").select(F.col("o_orderkey").alias("id"))
    return integrity.tracked(asked, {"no vector": table(s, d, "embeddings").select(F.col("vec_id").alias("id")), "no label": table(s, d, "labels").select(F.col("doc_id").alias("id"))}, "id")


@query("layer_residue_pool", """WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT vec_id, round((e[1] + e[9] + e[17] + e[25] + e[33] + e[41] + e[49] + e[57]) / 8, 6) AS pooled_first, round(list_sum(e) / 8, 6) AS pooled_sum, round(e[33], 6) AS cls_first, round(list_sum(e[33:40]), 6) AS cls_sum FROM x""")
def _layers(s, d):
    # two layers of four residues with eight dimensions
    layers = F.array(*(F.array(*(F.slice("embedding", 32 * layer + 8 * r + 1, 8) for r in range(4))) for layer in range(2)))
    x = table(s, d, "embeddings").select("vec_id", scalars.layer_residue_pool(layers).alias("p"), scalars.cls_pick(layers).alias("c"))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, v: a + v), 6)
    return x.select("vec_id", F.round(F.get("p", F.lit(0)), 6).alias("pooled_first"), total("p").alias("pooled_sum"), F.round(F.get("c", F.lit(0)), 6).alias("cls_first"), total("c").alias("cls_sum"))


_COUNTS = "SELECT CAST(c_nationkey AS BIGINT) AS key, count(*) AS n FROM customer GROUP BY 1"


@query("package_verify", f"""WITH d AS (SELECT count(*) AS n FROM documents), h AS (SELECT count(*) AS bad FROM documents WHERE doc_id % 100 = 0 AND text IS NOT NULL),
o AS (SELECT count(DISTINCT o_custkey) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
SELECT 'hashes' AS "check", bad = 0 AS passed, 'differ=' || bad AS message FROM h UNION ALL SELECT 'counts', true, 'expected=' || n || ' found=' || n FROM d
UNION ALL SELECT 'splits', true, 'n_overlap=0 n_missing=0 n_extra=0' UNION ALL SELECT 'table', count(*) FILTER (key % 5 = 0) = 0, 'differ=' || count(*) FILTER (key % 5 = 0) FROM ({_COUNTS}) UNION ALL SELECT 'orphans', n = 0, 'missing=' || n FROM o""")
def _verify(s, d):
    docs = table(s, d, "documents")
    want = docs.select(F.col("doc_id").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    have = docs.select(F.col("doc_id").alias("path"), F.sha2(F.when(F.col("doc_id") % 100 == 0, F.concat(F.coalesce("text", F.lit("")), F.when(F.col("text").isNotNull(), "!").otherwise(""))).otherwise(F.coalesce("text", F.lit(""))), 256).alias("sha256"))
    counts = table(s, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("key")).agg(F.count("*").alias("n"))
    return integrity.verify_package(
        hashes=(want, have), counts=(docs, docs.select("doc_id")), split=(docs.select("doc_id"), docs.where("doc_id % 4 <> 0"), docs.where("doc_id % 4 = 0"), "doc_id"),
        tables=(counts, counts.withColumn("n", F.col("n") + (F.col("key") % 5 == 0).cast("int")), ["key"], "n"),
        orphans=(table(s, d, "orders").select(F.col("o_custkey").alias("k")), table(s, d, "customer").select(F.col("c_custkey").alias("k")), "k"),
    )


@query("manifest_assertions", "SELECT 'not_empty' AS \"check\", count(*) > 0 AS passed, 'n=' || count(*) AS message FROM documents UNION ALL SELECT 'unique', count(*) = count(DISTINCT source), 'n=' || count(*) || ' distinct=' || count(DISTINCT source) FROM documents UNION ALL SELECT 'labelled', count(*) = 0, 'missing=' || count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _assertions(s, d):
    docs = table(s, d, "documents")
    return integrity.manifest_checks(docs.select(F.col("source").alias("id")), "id").unionByName(integrity.subset(docs, table(s, d, "labels"), "doc_id", "labelled"))


@query("run_dates", "SELECT strftime(o_orderdate, '%Y-%m-%d_%H%M%S') AS run_id, strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders GROUP BY ALL")
def _dates(s, d):
    return table(s, d, "orders").groupBy(reports.run_id(F.col("o_orderdate")).alias("run_id")).agg(F.count("*").alias("n")).select("run_id", reports.run_day(F.col("run_id")).alias("day"), "n")


@query("recommendation_text", f"SELECT doc_id, CASE WHEN n_chars >= 500 THEN '{scalars.RECOMMEND_HIGH}' ELSE '{scalars.RECOMMEND_LOW}' END AS recommendation FROM documents")
def _recommend(s, d):
    return table(s, d, "documents").select("doc_id", scalars.recommendation(F.when(F.col("n_chars") >= 500, "high").otherwise("low")).alias("recommendation"))
