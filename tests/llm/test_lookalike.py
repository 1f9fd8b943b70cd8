import pytest

from lodeweave.llm import lookalike as lk
from lodeweave.llm import pairs


def _forms(spark, texts):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, form string")
    return {r["doc_id"]: r["form"] for r in lk.canonical_text(df).collect()}


SAME = [
    ("café au lait", "café au lait"), ("wide text 12", "ｗｉｄｅ　ｔｅｘｔ １２"), ("zero width", "ze​ro­ ﻿width⁠"), ("a b c", "  a b\n\tc "),
    ("office flag", "oﬃce ﬂag"), ("Paypal", "Раураl"), ("well-known", "well‑known"), ("ą̈x", "ą̈x"), ("Kelvin", "Kelvin"), ("가나", "가나"), ("vi", "ⅴi"),
]
DIFFERENT = [("cafe", "café"), ("m2", "m²"), ("Case", "case"), ("a b", "ab"), ("1 l", "l l"), ("x ... y", "x y")]


def test_forms(spark):
    forms = _forms(spark, [t for pair in SAME + DIFFERENT for t in pair])
    for k, (a, b) in enumerate(SAME):
        assert forms[2 * k] == forms[2 * k + 1], (a, b)
    for k, (a, b) in enumerate(DIFFERENT, len(SAME)):
        assert forms[2 * k] != forms[2 * k + 1], (a, b)


def test_nulls_blank_long_and_emoji(spark):
    long_text = "é" * 20_000 + " end"
    forms = _forms(spark, [None, "", " ​\n", long_text, "👍🏽 ok 🙂"])
    assert forms[0] is None and forms[1] == forms[2] == "" and forms[3] == long_text and forms[4] == "👍🏽 ok 🙂"


def test_repeated_rows_and_keys(spark):
    df = spark.createDataFrame([(1, "café é"), (1, "café é"), (1, "thé é"), (None, "café é")], "doc_id long, text string")
    assert sorted(r["form"] for r in lk.canonical_text(df).collect()) == ["café é"] * 3 + ["thé é"]


def test_pairs_and_large_groups(spark):
    rows = [(1, "café"), (2, "café"), (3, "café"), (4, "tea"), (5, "tea"), (6, "​"), (7, " "), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in lk.lookalike_pairs(df).collect()} == {(1, 2), (1, 3)}
    many = spark.createDataFrame([(i, "x" + "​" * (i % 4)) for i in range(40)], "doc_id long, text string")
    got = {tuple(r) for r in lk.lookalike_pairs(many, expand=8).collect()}
    assert {(0, i) for i in range(40) if i % 4} <= got and len(got) < 60
    linked = {x for p in got for x in p}
    assert linked == set(range(40))
    assert lk.lookalike_pairs(df.limit(0)).count() == 0


def test_large_groups_give_every_pair(spark, monkeypatch):
    monkeypatch.setattr(pairs, "CHUNK", 4, raising=False)
    monkeypatch.setattr(pairs, "BLOCK", 16, raising=False)
    kind = lambda i: 0 if i < 50 else i % 4
    rows = [(i, "x" + "\u200b" * kind(i)) for i in range(90)] + [(100, "y"), (101, "y\u200b")]
    got = [tuple(r) for r in lk.lookalike_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if kind(i) != kind(j)} | {(100, 101)}
    assert len(got) == len(want) and set(got) == want


def test_compact_form_links_all_variants(spark):
    rows = [(i, "x" + "\u200b" * (i % 4)) for i in range(40)]
    got = {tuple(r) for r in lk.lookalike_pairs(spark.createDataFrame(rows, "doc_id long, text string"), expand=8).collect()}
    assert {(1, 2), (1, 3), (2, 3)} <= got


@pytest.mark.parametrize("base", list("AEOaeocpxy"))
def test_tables_fold_listed_letters(spark, base):
    to = dict(lk.tables(spark)[0])
    assert all(to[other] == base for other in lk.LOOKALIKES[base])


def test_every_composite_comes_out_composed(spark):
    import unicodedata as u

    folds = lk.confusables(spark)
    every = [c for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x30000))) if u.decomposition(c)[:1] not in ("", "<") or 0xAC00 <= ord(c) <= 0xD7A3]
    words = [w for c in every for w in (c, u.normalize("NFD", c))]
    forms = {r["word"]: r["form"] for r in lk._canonical_words(spark, spark.createDataFrame([(w,) for w in set(words)], "word string")).collect()}
    assert len(every) > 12_000
    for c in every:
        form = forms[c]
        assert form == forms[u.normalize("NFD", c)] and u.is_normalized("NFC", form), hex(ord(c))
        if not set(u.normalize("NFD", c)) & folds.keys() and c not in folds:
            assert form == u.normalize("NFC", c), hex(ord(c))


def test_look_alikes_of_other_scripts(spark):
    same = [("A", "Ꭺ"), ("o", "օ"), ("u", "ս"), ("o", "ⲟ"), (":", "꞉"), ("a/b", "a⁄b"), ("a/b", "a∕b"), ("한국어", "한국어"), ("কো", "কো")]
    other = [("a", "α"), ("i", "ı"), ("0", "O"), ("l", "1"), ("-", "–"), ("'", "’"), ("2", "²")]
    forms = _forms(spark, [t for pair in same + other for t in pair])
    for k, (a, b) in enumerate(same + other):
        assert (forms[2 * k] == forms[2 * k + 1]) == (k < len(same)), (a, b)


def test_keys_agree_with_forms(spark):
    texts = [t for pair in SAME + DIFFERENT for t in pair] + ["", None, "​"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    forms = {r["doc_id"]: r["form"] for r in lk.canonical_text(df).collect()}
    keys = {r["doc_id"]: r["group"] for r in lk.form_keys(df).collect()}
    assert set(keys) == {i for i, f in forms.items() if f}
    for i in keys:
        for j in keys:
            assert (keys[i] == keys[j]) == (forms[i] == forms[j]), (texts[i], texts[j])
