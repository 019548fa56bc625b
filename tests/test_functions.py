from pyspark.sql import functions as F

from lumora.functions import motifs, scalars


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_accessions(spark):
    get = lambda f, v: one(spark, f(F.lit(v)))
    assert [get(scalars.is_isoform, v) for v in ("P12345", "P12345-2", "P12345-A")] == [False, True, False]
    assert get(scalars.canonical, "P12345-2") == "P12345"


def test_fragments(spark):
    get = lambda v: one(spark, scalars.is_fragment(F.lit(v).cast("string")))
    assert [get(v) for v in ("", None, "X (Fragment)", "fragmented", "truncated form", "a partial", "éfragment")] == [False, False, True, False, True, True, False]


def test_hash_ignores_case_and_stops(spark):
    assert one(spark, scalars.sequence_hash(F.lit("ac*D"))) == one(spark, scalars.sequence_hash(F.lit("ACD")))


def test_config_hashes(spark):
    h = lambda layers, pool, *more: one(spark, scalars.config_hash(F.lit("esm2_t33_650M_UR50D"), F.array(*map(F.lit, layers)), F.lit(pool), *map(F.lit, more)))
    assert h([33], "mean") == "fc3f7e9ca15e9ade" and h(range(20, 31), "mean") == "800e63845a3556db" and h([33], "cls") == "daf982999db2b0a2"
    assert h([33], "mean", 1022, 900) == "a7c50a025f8463d1" and h(range(20, 31), "mean", 1022, 900) == "0f1acc77f51c2676" and h(range(1, 34), "mean", 1022, 900) == "28e8f0b7b2979ad1"


def test_word_sizes(spark):
    got = [one(spark, scalars.word_size(F.lit(x))) for x in (0.3, 0.4, 0.5, 0.6, 0.7, 0.9, 1.0)]
    assert got == [5, 2, 3, 4, 5, 5, 5]


def test_wrap_and_envelope(spark):
    assert one(spark, scalars.wrapped(F.lit("a" * 61), 60)) == "a" * 60 + "\na"
    assert one(spark, scalars.wrapped(F.lit("a" * 60), 60)) == "a" * 60
    assert one(spark, scalars.envelope(F.lit("ABCDEFG"), F.lit(2), F.lit(4))) == "BCD"


def test_valid_and_bands(spark):
    assert one(spark, scalars.is_valid(F.lit("ACDEF" * 10))) and not one(spark, scalars.is_valid(F.lit("ACDEF" * 9))) and not one(spark, scalars.is_valid(F.lit("ACDEB" * 10)))
    assert [one(spark, scalars.integrity_band(F.lit(x))) for x in (0.8, 0.7, 0.5)] == ["good", "moderate", "low"]
    assert [one(spark, scalars.confidence_flag(F.lit(x))) for x in (0.7, 0.69)] == ["high", "low"]
    assert one(spark, scalars.signed_percent(F.lit(138.04))) == "+138.0%"


def test_pooling(spark):
    v = F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(6.0)))
    assert one(spark, scalars.mean_pool(v)) == [2.0, 4.0] and one(spark, scalars.mean_pool(F.array().cast("array<array<double>>"))) == []


def test_flags_equal_python(spark):
    import re

    seqs = ["MAGTGSFGKVAVKE", "aaaDFGLAPEL", "HRDLKxxxDFGV", "", "NPQYSSSSDDDE", None, "TEYKAKFAAY"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "i int, s string")
    for r in df.select("i", *motifs.flags(F.col("s"))).collect():
        assert [r[motifs.flag_name(n)] for n, _ in motifs.FLAGS] == [int(bool(re.search(p, (seqs[r.i] or "").upper()))) for _, p in motifs.FLAGS]


def test_gatekeeper(spark):
    assert one(spark, motifs.gatekeeper(F.lit("AAADFG"))) is None
    g = one(spark, motifs.gatekeeper(F.lit("T" + "A" * 14 + "DFG")))
    assert (g.residue, g.position) == ("T", 1)
    assert one(spark, motifs.gatekeeper(F.lit("A" * 14 + "DFG"))) is None


def test_highlight(spark):
    html = one(spark, motifs.highlighted(F.lit("T" + "A" * 14 + "DFG")))
    assert html.count("<span") == 4 and motifs.GATEKEEPER_COLOUR in html and one(spark, motifs.highlighted(F.lit(""))) == ""


def test_flags_look_for_letters_first():
    assert motifs._core("DFG[IL]") == "DFG" and motifs._core("R[^P]D[LIVF]") in "RD" and motifs._core("[DE]{3,}") == "" and motifs._core("NP.Y") == "NP"


def test_pooling(spark):
    layers = F.array(*(F.array(*(F.array(F.lit(float(a + r)), F.lit(1.0)) for r in range(3))) for a in (0, 10)))
    assert one(spark, scalars.layer_residue_pool(layers)) == [6.0, 1.0] and one(spark, scalars.cls_pick(layers)) == [10.0, 1.0]
