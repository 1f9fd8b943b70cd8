import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lodeweave.llm import splitting as sp

PARTS = st.sampled_from(["a", "bb", "word", "x" * 9, "y" * 10, "z" * 11, "q" * 25, " ", "\n", "\n\n", ". ", "! ", "\t", "é🙂", "字字字。", "。"])


def check(text, limit, overlap):
    ps = sp.pieces(text, limit, overlap)
    assert ps[0][0] == 0 and ps[-1][1] == len(text)
    assert all(0 <= b - a <= limit for a, b, _ in ps)
    for (a, b, kind), (c, d, _) in zip(ps, ps[1:]):
        assert a < c <= b < d
        if kind not in ("forced", "sentence"):
            assert text[b - 1] in sp.BREAKS or text[b] in sp.BREAKS
    hard = len(text) > limit and any(len(m) > limit for m in re.findall(r"[^ \t\r\n]+", text))
    assert hard == any(sp.cuts_long_run(text, b, limit) for _, b, _ in ps)
    return ps


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=80), st.integers(0, 5))
def test_properties(parts, overlap):
    check("".join(parts), 10, overlap)


def test_balanced_and_strong_boundaries():
    text = "\n\n".join(" ".join(["Some words make a sentence."] * 30) for _ in range(6))
    ps = check(text, 2000, 200)
    assert {k for *_, k in ps[:-1]} <= {"paragraph", "sentence"}
    assert max(b - a for a, b, _ in ps) - min(b - a for a, b, _ in ps) < 900


def test_overlap_of_unspaced_text():
    chinese = "".join("这是一个没有空格的句子" * (k % 4 + 1) + "。" for k in range(400))
    for text in (chinese, ("字" * 1500 + " ") * 3, "x" * 9000, "word " * 2000):
        ps = check(text, 2000, 200)
        assert all(150 <= b - c <= 250 for (_, b, _), (c, _, _) in zip(ps, ps[1:])), ps
    assert {k for *_, k in check(chinese, 2000, 200)[:-1]} == {"sentence"}


def test_a_run_of_nearly_the_limit_is_not_cut():
    ps = check("word " * 300 + "x" * 1990 + " " + "word " * 300, 2000, 200)
    assert "forced" not in {k for *_, k in ps}


def test_pieces_are_added_where_targets_cannot_be_reached():
    text = ("y" * 1100 + " ") * 40  # one run a piece, far more pieces than by length
    assert len(check(text, 2000, 200)) >= 35


def test_assets(spark):
    long_text, run = "word " * 500, "x" * 2500
    schema = "identifier string, field_name string, description struct<plain string, html string>, content struct<plain string, html string>"
    rows = [("a", "clash", (long_text, None), (None, f"<p>{run}</p>")), ("a", "clash", (long_text, None), (None, f"<p>{run}</p>")), ("b", "c", None, ("short", None)), ("c", "c", (None, None), ("y" * 2000, None)), (None, "c", (long_text, None), None)]
    df = spark.createDataFrame(rows, schema)
    assert {tuple(r) for r in sp.oversized_texts(df).collect()} == {("a", "description", 0), ("a", "content", 1)}
    got = sorted(sp.split_assets(df).where("field_name = 'description'").collect(), key=lambda r: r["piece_no"])
    assert [r["piece_no"] for r in got] == list(range(len(got))) and all(r["piece"] == long_text[r["start"] : r["end"]] for r in got)
    assert sp.split_assets(df.limit(0)).count() == 0
