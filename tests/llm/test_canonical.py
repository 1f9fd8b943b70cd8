import random

import pytest

from lodeweave.llm import canonical as cn

LIST = [
    (1, "base", "license", "olc-by-3.0", "Open Ledger Commons Attribution 3.0"), (2, "base", "license", "olc-by-4.0", "Open Ledger Commons Attribution 4.0"),
    (3, "base", "license", "olc-by-sa-4.0", "Open Ledger Commons Attribution ShareAlike 4.0"), (4, "base", "license", "copperleaf-2.0", "Copperleaf General Licence 2.0"),
    (5, "base", "license", "quillon-1.2", "Quillon Software Licence 1.2"), (6, "base", "ml_tasks", "crop-row-detection", None), (7, "base", "ml_tasks", "crop-row-segmentation", None),
    (8, "base", "ml_tasks", "sketch-colorization", None), (9, "base", "ml_tasks", "bird-call-recognition", None), (10, "base", "ml_tasks", "bird-call-classification", None),
]
MEANT = [
    ("license", "OLC BY v4", 2), ("license", "Open Ledger Commons Atribution, ver. 3.0", 1), ("license", "https://licences.example/olc-by-sa/4.0/legalcode", 3),
    ("license", "the Coppelreaf General Licence 2 (full text)", 4), ("license", "ｏｌｃ－ｂｙ－３．０", 1), ("license", "Attribution-ShareAlike (Open Ledger Commons) - 4.0", 3),
    ("license", "Quillon", 5), ("license", "licence = olc-by-4.0", 2), ("license", "olc-by-3.0 licence", 1), ("ml_tasks", "CropRowDetection", 6), ("ml_tasks", "detection of crop rows", 6),
    ("ml_tasks", "crop row segm.", 7), ("ml_tasks", "Sketch Colorisation", 8), ("ml_tasks", "task_ids: bird call recogn", 9), ("ml_tasks", "crop-row-detectoin", 6),
]
NONE = [("license", x) for x in ("olc-by-5.0", "olc", "olc-by", "unknown", "", " ", "crop-row-detection", "Moorhen licence 1.0")] + [("ml_tasks", x) for x in ("crop row forecasting", "bird call", "detection", "olc-by-4.0")]


@pytest.fixture(scope="module")
def matchers():
    return cn.matchers(list((f, i, v, t, 1) for i, _, f, v, t in LIST))


@pytest.mark.parametrize("field,value,want", MEANT)
def test_meant(matchers, field, value, want):
    assert matchers[field].match(value) == want


@pytest.mark.parametrize("field,value", NONE)
def test_none(matchers, field, value):
    assert matchers[field].match(value) is None


def test_rows(spark):
    valid = spark.createDataFrame(LIST, "valid_id long, asset_type string, field string, value string, title string")
    rows = [(i, f, v, "clash") for i, (f, v, _) in enumerate(MEANT)] * 2 + [(100, "license", "olc-by-4.0", "x"), (101, "license", None, "x"), (102, None, "olc by v4", "x"), (103, "other", "x", "x"), (None, "license", "OLC BY v4", "x")]
    values = spark.createDataFrame(rows, "value_id long, field string, original_value string, valid_id string")
    assert {tuple(r) for r in cn.mapped_found(values, valid).collect()} == {(i, w) for i, (_, _, w) in enumerate(MEANT)}
    every = {r["value_id"]: r for r in cn.mapped_rows(values, valid).collect()}
    assert every[100]["literal"] and every[100]["valid_id"] == 2 and every[101]["valid_id"] is None and every[103]["valid_id"] is None
    assert {(r["field"], r["original_value"]) for r in cn.misses(values, valid).collect()} == {("license", None), (None, "olc by v4"), ("other", "x")}
    assert cn.mapped_found(values.limit(0), valid).count() == 0 and cn.mapped_found(values, valid.limit(0)).count() == 0


def test_distance():
    assert cn.distance("abc", "acb", 3) == pytest.approx(0.85)
    assert cn.distance("abc", "abbc", 3) == pytest.approx(0.6)
    assert cn.distance("abc", "xyz", 1) == 2


def test_size_of_the_list_is_checked(spark, monkeypatch):
    monkeypatch.setattr(cn, "MAX_ENTRIES", 3)
    with pytest.raises(ValueError):
        cn.reference(spark.createDataFrame(LIST, "valid_id long, asset_type string, field string, value string, title string"))


def test_long_words_many_layers_and_many_readings():
    m = cn.Matcher([(1, "court-ruling-classification", None, 0), (2, "mit", None, 0), (3, "image-segmentation", None, 0)])
    assert m.match("courtrulingclassificaiton") == 1 and m.match("courtrulingclassifacation") == 1 and m.match("courtrulingclassifiication") == 1
    assert m.match("courtrulingsegmentationxyz") is None
    assert m.match("license: licence: license: licence: license: licence: mit") == 2
    assert m.match("license: " * 20 + "image segmentation") == 3
    # 2 to the power of 7 readings of the words, of which only the farthest is listed
    pairs = [(f"{c * 5}xx", f"{c * 5}yz") for c in "abcdefg"]
    every = [(10 + i, x, None, 0) for i, p in enumerate(pairs) for x in p]
    many = cn.Matcher([*every, (99, " ".join(y for _, y in pairs), None, 0)])
    readings = [[(x, 0.1), (y, 0.2)] for x, y in pairs]
    assert dict(cn._products(readings, many.beginnings))[tuple(y for _, y in pairs)] == pytest.approx(1.4)


def test_digits_of_an_unlisted_edition_are_no_slips():
    m = cn.Matcher([(1, "thornbury-artistic-2.0", "Thornbury Artistic Licence 2.0", 0)])
    assert m.match("thornbury-artistic-0.9 licence") is None
    assert m.match("thornbury-artistic-2.0 licence") == 1 and m.match("thornburyartisticlicense 2.0") == 1


def test_three_doubled_letters_are_found():
    lexicon = cn.Lexicon(["misspelling", "committee", "aabbccdd"])
    assert dict(lexicon.near("mmissspellingg"))["misspelling"] < 2


def test_every_word_within_its_bound_is_found():
    rng = random.Random(4)
    lexicon = cn.Lexicon(["misspelling", "abbba", "aabbccdd", "transposition", "committee", "abcdef", "été"])
    for word in lexicon.words:
        for _ in range(400):
            typed = list(word)
            for _ in range(rng.randrange(1, 4)):
                k, how = rng.randrange(len(typed)), rng.randrange(5)
                if how < 3:
                    typed.insert(k, typed[k])
                elif how == 3 and k + 1 < len(typed):
                    typed[k], typed[k + 1] = typed[k + 1], typed[k]
                else:
                    typed[k] = rng.choice("abcdefgté")
            typed = "".join(typed)
            want = {(w, d) for w in lexicon.words if (d := cn.distance(typed, w, cn._allowed(w))) <= cn._allowed(w)}
            assert set(lexicon.near(typed)) == want, typed


def test_wording_is_a_parameter():
    entries = [(1, "olc-by-4.0", None, 0)]
    assert cn.Matcher(entries).match("Rechte: OLC-BY-4.0") is None
    wording = cn.Wording(labels=cn.WORDING.labels + "|rechte")
    assert cn.Matcher(entries, wording).match("Rechte: OLC-BY-4.0") == 1
