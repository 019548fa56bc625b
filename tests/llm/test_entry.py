from pathlib import Path

import duckdb
import pytest

from lumora.llm import registry

from ..test_entry import TABLES, plain

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    names = sorted(df.columns)
    sql = registry.oracle_sql()[name]
    quoted = ", ".join(f'"{c}"' for c in names)
    assert plain(tuple(r) for r in df.select(*names).collect()) == plain(con.sql(f"SELECT {quoted} FROM ({sql})").fetchall())


def test_pipeline(spark):
    """Each stage against what it says of its own input."""
    import corpus_pipeline as P

    from lumora.llm import decontam, mil, neardup, secrets
    from lumora.llm.jobs import cut, table

    docs = table(spark, SF, "documents")
    names = [n for n, _ in P.STAGES]
    assert len(names) == 5
    at = docs
    outs = []
    for _, stage in P.STAGES:
        outs.append((at, cut(stage(spark, at, SF))))
        at = outs[-1][1]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    (a, b), (c, d), (e, f), (g, h), (i, j) = outs
    assert ids(b) == ids(mil.score(a, mil.train(a, table(spark, SF, "labels"))).where("predicted = 1"))
    assert ids(d) == ids(neardup.groups(c).where("kept"))
    assert ids(f) == ids(decontam.hits(spark, e, table(spark, SF, "benchmark")).where("n_hit = 0"))
    assert ids(h) == ids(g) and secrets.secret_spans(h).where("size(kind) > 0").count() == 0
    assert ids(j) == ids(i) and j.where("not lossless").count() == 0
    assert all(x.columns == docs.columns for x in (b, d, f, h))
    assert ids(P.run(spark, SF)) == ids(j)


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, repeats, empty and long texts, further columns that have names of the operators' own, and empty tables."""
    import corpus_pipeline as P

    sf, none = str(tmp_path / "sf"), str(tmp_path / "none")
    hit = "a b c d e f g h i j"
    data = [(1, "one text of some words that is good"), (1, "one text of some words that is good"), (1, "another text that has this id too"), (2, None), (3, ""), (None, "no id but a text"), (4, f"x {hit} y"), (1, f"and {hit}"), (5, "w " * 60_000 + "password = abcdefghijklmnop123")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", 7, [1]) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long, set string, row int, ids array<int>")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, hit)], "item_id long, text string")
    for folder, limit in ((sf, 100), (none, 0)):
        for name, df in (("documents", docs), ("labels", labels), ("benchmark", items)):
            df.limit(limit).write.parquet(f"{folder}/{name}.parquet")
    at = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        at = stage(spark, at, sf)
        assert at.columns == docs.columns, name
    kept = sorted(((r.doc_id, r.text) for r in at.collect()), key=str)
    want = [(1, "one text of some words that is good"), (1, "another text that has this id too"), (2, None), (3, ""), (None, "no id but a text"), (5, "w " * 60_000 + "[REDACTED:assign]")]
    assert kept == sorted(want, key=str)
    out = P.run(spark, sf).collect()
    assert sorted((str(r.doc_id), r.lossless) for r in out) == sorted((str(i), True) for i, _ in want)
    assert P.run(spark, none).count() == 0
