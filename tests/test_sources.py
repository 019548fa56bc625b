import numpy as np
import pytest
from pyspark.sql import functions as F

from lumora.sources import formats, sinks

from .conftest import rows


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_fasta(spark, tmp_path):
    p = write(tmp_path, "a.fasta", ">sp|P1|NAME first\nACD\nEF\n>Q2 other\nGGG\n>u3|PF1|2-9\nKK\n")
    assert rows(formats.fasta(spark, p).select("accession", "seq")) == [("P1", "ACDEF"), ("PF1", "KK"), ("Q2", "GGG")]
    assert rows(formats.fasta(spark, p, "first").select("accession")) == [("Q2",), ("sp",), ("u3",)]
    assert rows(formats.fasta(spark, p, "word").select("accession")) == [("Q2",), ("sp|P1|NAME",), ("u3|PF1|2-9",)]


def test_fasta_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("A", "A" * 130), ("B", "CD")], "accession string, seq string")
    sinks.fasta(df, str(tmp_path / "out"), ["accession"])
    back = formats.fasta(spark, str(tmp_path / "out"), "word").select("accession", "seq")
    assert rows(back) == [("A", "A" * 130), ("B", "CD")]
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.fasta(df, str(tmp_path / "out"))


def test_inline(spark):
    df = spark.createDataFrame([(">h x\nac d\ne",), ("ac de",)], "text string")
    assert rows(formats.inline(df)) == [("Input_Sequence", "ACDE"), ("h x", "ACDE")]


def test_tables(spark, tmp_path):
    t = formats.tsv(spark, write(tmp_path, "m.tsv", 'Entry\tProtein names\tLength\nP1\ta "b"\t5\nP2\n'))
    assert rows(t) == [("P1", 'a "b"', "5"), ("P2", "", "")] and t.columns == ["accession", "protein_name", "length"]
    c = formats.csv(spark, write(tmp_path, "m.csv", "a,b\n1,x\n,\n2,y\n"))
    assert rows(c) == [(1, "x"), (2, "y")]


def test_hits(spark, tmp_path):
    line = "P1 - 300 Pkinase PF00069.28 264 1e-50 170 0.1 1 1 2e-60 {e} {s} 0.1 1 264 5 280 4 281 0.95 a b c\n"
    p = write(tmp_path, "x.domtblout", "# c\n" + line.format(e="1e-3", s="99.5") + line.format(e="0.5", s="1.0") + "short line\n")
    assert rows(formats.hits(spark, p, 0.01).drop("hit_pos")) == [("P1", "PF00069", "Pkinase", 4, 281, 278, 0.001, 99.5)]
    assert formats.hits(spark, p).count() == 2


def test_clusters(spark, tmp_path):
    p = write(tmp_path, "x.clstr", ">Cluster 0\n0\t100aa, >A1... *\n1\t90aa, >B2... at 85.50%\n>Cluster 1\n0\t80aa, >C3... *\n")
    assert rows(formats.clusters(spark, p)) == [(0, "A1", 100, True, None), (0, "B2", 90, False, 85.5), (1, "C3", 80, True, None)]


def test_ids(spark, tmp_path):
    assert rows(formats.ids(spark, write(tmp_path, "ids.txt", "b\n\n a \nb\n"))) == [("a",), ("b",)]
    with pytest.raises(ValueError):
        formats.ids(spark, write(tmp_path, "none.txt", "\n"))


def test_json_and_profile(spark, tmp_path):
    assert formats.json_document(spark, str(tmp_path / "no.json")) is None
    assert formats.json_document(spark, write(tmp_path, "y.json", '{"a": {"b": 1}}')).first().a.b == 1
    assert formats.profile_version(spark, write(tmp_path, "p.hmm", "HMMER3/f\nNAME  X\nACC   PF00069.28\nACC   other\n")).first().version == "PF00069.28"


def test_manifest_and_matrix(spark, tmp_path):
    import hashlib

    d = tmp_path / "files"
    d.mkdir()
    (d / "a.txt").write_text("hello")
    f = formats.files(spark, str(d)).first()
    assert f.size_bytes == 5 and f.sha256 == hashlib.sha256(b"hello").hexdigest()
    np.save(tmp_path / "m.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    assert rows(formats.matrix(spark, str(tmp_path / "m.npy")).select("row", F.col("embedding").cast("string"))) == [(0, "[0.0, 1.0]"), (1, "[2.0, 3.0]"), (2, "[4.0, 5.0]")]
