import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lumora.llm import text as T

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t,日z9 ", max_size=30)), min_size=1, max_size=8)


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_words_and_hashes(texts, limit):
    for table, pattern in ((T.SPACED, r"[^\x20\x09-\x0D]+"), (T.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        by_word, seen = {}, 0
        for lo, hi, raw, off in T.slices(pa.array(texts, pa.string()), limit):
            w = T.Words(raw, off, table)
            h = w.hashes()
            for i in range(lo, hi):
                want = re.findall(pattern, low(texts[i]))
                a, b = w.bounds[i - lo], w.bounds[i - lo + 1]
                assert [w.low[s:e].tobytes().decode() for s, e in zip(w.starts[a:b], w.ends[a:b], strict=True)] == want
                for word, x in zip(want, h[a:b].tolist(), strict=True):
                    assert by_word.setdefault(word, x) == x
            seen += hi - lo
        assert seen == len(texts) and len(set(by_word.values())) == len(by_word)


def test_sliced_arrays():
    a = pa.array(["x", "ab cd", None, "ef"]).slice(1)
    got = [w for lo, hi, raw, off in T.slices(a) for w in [T.Words(raw, off, T.SPACED).counts.tolist()]]
    assert got == [[2, 0, 1]] and list(T.slices(pa.array([], pa.string()))) == []


def test_shingles():
    raw, off = np.frombuffer(b"a b c d e f a b c d e f|a b|", dtype=np.uint8), np.array([0, 23, 27, 27])
    sets = T.shingle_sets(T.Words(raw, off, T.SPACED), 5)
    assert [len(s) for s in sets] == [6, 1, 0]
