from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumora.llm import tokens as T
from lumora.llm.text import slices

from ..conftest import rows

pytestmark = pytest.mark.skipif(not Path(T.MODEL).exists(), reason="no vocabulary")
HARD = ["", None, "  a  b ", "▁x ▁", "日本語 テキスト 😀 \x00 x\ty\n\nz  ", "a" * 300, "    ", "Hello wörld", "x\r\n y", "word " * 500, "nospace" * 200]


def encoded(texts, dropout, seed=17, variants=4):
    v, out = T.vocabulary(T.MODEL), []
    for lo, hi, raw, off in slices(pa.array(texts, pa.string())):
        out += [r.tolist() for r in T.encode_slice(v, raw, off, np.arange(lo, hi), dropout, seed, variants)]
    return out


def test_without_dropout_as_the_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=T.MODEL)
    plain = [t for t in HARD if t and "▁" not in t]
    assert encoded(plain, 0.0) == [sp.encode(t) for t in plain]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=4), st.sampled_from([0.0, 0.1, 0.6, 1.0]))
def test_round_trip(texts, dropout):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert [T.decode(x) for x in encoded(texts, dropout)] == texts


def test_agenda_equals_rounds():
    v = T.vocabulary(T.MODEL)
    rnd = np.random.Generator(np.random.PCG64(3))
    words = ["▁" + "".join(rnd.choice(list("theonaringst"), rnd.integers(1, 47))) for _ in range(300)]
    ids = [np.array([v.by_char[ord(c)] for c in w], dtype=np.int32) for w in words]
    bounds, chunks = np.concatenate(([0], np.cumsum([len(x) for x in ids]))), np.arange(300, dtype=np.uint64) * np.uint64(7919)
    for p in (0.0, 0.1, 0.4):
        got, b = T.merge_all(v, np.concatenate(ids), bounds, chunks, p)
        assert all(got[b[i] : b[i + 1]].tolist() == T.agenda(v, ids[i].tolist(), int(chunks[i]), p) for i in range(300))


def test_dropout_varies_and_is_stable(spark):
    text = "the informational thing " * 50
    (a,), (b,), (c,) = encoded([text], 0.2), encoded([text], 0.2), encoded([text], 0.2, seed=18)
    assert a == b and a != c and len(a) > len(encoded([text], 0.0)[0])
    kinds = {tuple(a[i : i + 4]) for i in range(len(a))}
    assert len(kinds) > 12  # one phrase, several segmentations
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(HARD)] + [(None, "x", 0)], "doc_id long, text string, ids long")
    out = T.encode(df)
    assert out.where("lossless").count() == len(HARD) + 1 and T.encode(df.limit(0)).count() == 0
    assert rows(T.decode_all(out.where("doc_id is not null"))) == sorted((i, t or "") for i, t in enumerate(HARD))
    assert rows(T.encode(df.repartition(3)).select("doc_id", "n_tokens")) == rows(out.select("doc_id", "n_tokens"))


@pytest.mark.parametrize("dropout", [0.1, 0.5])
def test_each_occurrence_is_drawn_on_its_own(dropout):
    v, word = T.vocabulary(T.MODEL), "informational"
    ids = np.array([v.by_char[ord(c)] for c in "▁" + word], dtype=np.int32)
    docs = [" ".join([word] * 400)] * 3
    raw, off = np.frombuffer("".join(docs).encode(), dtype=np.uint8), np.cumsum([0, *(len(t) for t in docs)])
    got = [x.tolist() for x in T.encode_slice(v, raw, off, np.array([5, 6, 5]), dropout, 17, T.VARIANTS)]
    assert got[0] == got[2] != got[1]
    kinds, at = set(), 0
    for _ in range(400):  # each word by itself
        n = next(n for n in range(1, 99) if T.decode(got[0][at : at + n]) == word)
        kinds.add(tuple(got[0][at : at + n]))
        at += n
    assert len(kinds) > 4
    keys = np.arange(500, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    have, cps = T.Known(), np.tile(np.array([32, *map(ord, word)]), 500)
    for _ in range(2):  # afresh, and with agendas known
        flat, start, size = T.draw(v, have, cps, np.tile(ids, 500), np.arange(501) * len(ids), np.full(500, 77, dtype=np.uint64), keys, dropout)
        assert [flat[a : a + n].tolist() for a, n in zip(start, size, strict=True)] == [T.agenda(v, ids.tolist(), int(k), dropout) for k in keys]


def test_memory_of_a_worker_changes_nothing(monkeypatch):
    texts = [t for t in HARD if t] * 3 + ["informational things 日 x " * 40]
    v = T.vocabulary(T.MODEL)
    raws = list(slices(pa.array(texts, pa.string()), 400))
    run = lambda have: [r.tolist() for lo, hi, raw, off in raws for r in T.encode_slice(v, raw, off, np.arange(lo, hi), 0.2, 3, 0, have)]
    afresh, have = run(None), T.Known()
    assert run(have) == afresh == run(have)
    monkeypatch.setattr(T, "KNOWN", 20)
    assert run(T.Known()) == afresh
