import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumora.llm import chat as C

from ..conftest import rows

TEXT = st.lists(st.sampled_from(["<|im_start|>", "<|im_end|>", "<|", "|>", "\x1b", "\x1be", "l", "\n", "a", "é", "assistant", " "]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=5))
def test_round_trip(turns):
    shown = [C.render_turn(r, t) for r, t in turns]
    whole = "".join(x for x, _, _ in shown)
    assert [(r, t) for r, t, _, _ in C.parse(whole)] == turns


@pytest.mark.parametrize("bad", ["x", "<|im_start|>", "<|im_start|>user\nx", "<|im_start|>user<|im_end|>\n", "<|im_start|>u\n<|im_start|>v\nx<|im_end|>\n"])
def test_grammar_refuses(bad):
    with pytest.raises(C.ParseError):
        list(C.parse(bad))


def test_plain_text_is_not_escaped():
    assert C.render_turn("user", "a <| b \x1be |>")[0] == "<|im_start|>user\na <| b \x1be |><|im_end|>\n"


def test_digests(spark):
    data = [(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", "a"), (1, 2, "assistant", None), (2, None, "system", "s"), (2, 0, None, "x"), (None, 0, "user", "q")]
    df = spark.createDataFrame([(*r, 7) for r in data], "conv_id long, turn long, role string, text string, rendered int")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r[0]: tuple(r)[1:5] for r in rows(C.digests(C.render(df)))}
    assert got[1] == (3, sha("user\na\nassistant\nb<|im_end|>\nassistant\n\n"), 11, sha("b<|im_end|>"))
    assert got[2] == (2, sha("system\ns\n\nx\n"), 0, sha("")) and got[None][0] == 1
    assert C.digests(C.render(df.limit(0))).count() == 0


def test_repeated_rows_are_turns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert [tuple(r)[:5] for r in rows(C.digests(C.render(df)))] == [(1, 4, sha("user\na\n" * 2 + "assistant\nb\n" * 2), 2, sha("bb"))]
