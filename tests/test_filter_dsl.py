import pytest

from lodeweave.plans import filter_dsl as dsl
from lodeweave.schema import FieldSpec, Registry

REG = Registry([FieldSpec("n", "long", "numerical"), FieldSpec("s"), FieldSpec("l", is_list=True), FieldSpec("d", kind="date"), FieldSpec("b", "boolean"), FieldSpec("name", text_match=True), FieldSpec("e", values=("Red", "Blue"))])


def f(field, *exprs, join="AND"):
    return dsl.Filter(field, join, tuple(dsl.Expression(v, o) for o, v in exprs))


@pytest.fixture(scope="module")
def df(spark):
    rows = [
        (1, 5, "Ab", ["x", None], "2020-01-01T10:00:00", True, "Big red house", "Red"), (2, 7, "cd", ["X", "y"], "2020-01-01T12:00:00", False, "small HOUSE", "blue"),
        (3, None, None, None, None, None, None, None), (4, 9, "ab", [], "bad", True, "", "Red"),
    ]
    return spark.createDataFrame(rows, "id int, n long, s string, l array<string>, d string, b boolean, name string, e string")


@pytest.mark.parametrize(
    "filters,want",
    [
        ([f("n", (">", 5))], {2, 4}), ([f("n", ("<", 6), (">", 8), join="OR")], {1, 4}), ([f("n", ("==", "7"))], {2}), ([f("n", ("!=", 7))], {1, 4}),
        ([f("s", ("==", "AB"))], {1, 4}), ([f("s", ("!=", "AB"))], {2}), ([f("l", ("==", "X"))], {1, 2}), ([f("l", ("!=", "x"))], {4}),
        ([f("d", (">=", "2020-01-01T11:00:00"))], {2}), ([f("d", (">", "2020-01-01"), ("<", "2020-01-02"))], {1, 2}), ([f("b", ("==", "true"))], {1, 4}),
        ([f("name", ("==", "the house"))], {1, 2}), ([f("name", ("!=", "red"))], {2, 4}), ([f("e", ("==", "BLUE"))], {2}), ([], {1, 2, 3, 4}),
        ([f("n", (">", 4)), f("s", ("==", "ab"))], {1, 4}),
    ],
)
def test_rows(df, filters, want):
    assert {r["id"] for r in df.where(dsl.compile_filters(filters, REG)).collect()} == want


def test_exclusion_and_intersection(df):
    assert {r["id"] for r in df.where(dsl.compile_filters([f("n", (">", 4))], REG, [2], "id")).collect()} == {1, 4}
    a, b = f("n", (">", 5)), f("s", ("==", "ab"))
    one = {r["id"] for r in df.where(dsl.compile_filters([a], REG)).collect()} & {r["id"] for r in df.where(dsl.compile_filters([b], REG)).collect()}
    assert {r["id"] for r in df.where(dsl.compile_filters([a, b], REG)).collect()} == one


@pytest.mark.parametrize(
    "bad",
    [f("zz", ("==", 1)), f("n", ("==", "x")), f("n", ("==", 1.5)), f("n", ("==", True)), f("s", (">", "a")), f("d", ("==", "2020-01-01")), f("l", (">", "a")), f("b", ("==", "maybe")), f("e", ("==", "green")), f("s", ("==", None)), f("s", ("==", 3)), f("n", join="AND"), f("n", ("==", 1), join="XOR"), f("n", *[("==", i) for i in range(6)])],
)
def test_refused(bad):
    with pytest.raises(ValueError):
        dsl.compile_filters([bad], REG)


def test_limits_and_parsing():
    with pytest.raises(ValueError):
        dsl.compile_filters([f("n", (">", 1))] * 6, REG)
    assert dsl.Filter.parse({"field": "n", "logical_operator": "OR", "expressions": [{"processed_value": 3, "comparison_operator": ">"}]}) == f("n", (">", 3), join="OR")
    with pytest.raises(ValueError):
        dsl.Filter.parse({"field": "n", "expressions": [{"value": None, "comparison_operator": ">"}]})
    assert dsl.condition({"field": "n", "expressions": [{"value": "x", "comparison_operator": ">"}, {"value": 4, "comparison_operator": ">"}]}, REG) == f("n", (">", 4))
    assert dsl.condition({"field": "n", "expressions": [{"value": "NONE", "comparison_operator": ">"}]}, REG) is None
    assert dsl.condition({"field": "other", "expressions": []}, REG) is None
    assert dsl.validate_query("cats", 10) == "cats"
    for bad in (("", 1), ("  ", 1), ("x" * 201, 1), ("x", 0), ("x", 101)):
        with pytest.raises(ValueError):
            dsl.validate_query(*bad)
    assert dsl.validate_asset_type("all", [], ["a"]) == "all"
    for bad in (("all", ["a"], ["a"], False), ("b", ["a"], ["a"]), ("a", [], ["a"])):
        with pytest.raises(ValueError):
            dsl.validate_asset_type(*bad)


def test_scalar_filters_reach_the_scan(spark, df, tmp_path):
    df.write.parquet(str(tmp_path / "t"))
    plan = spark.read.parquet(str(tmp_path / "t")).where(dsl.compile_filters([f("n", (">=", 6))], REG)).select("id")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(n,6)" in plan and "ReadSchema: struct<id:int,n:bigint>" in plan


def test_registry():
    r = Registry.of("datasets")
    assert r["geo_coverage"].spark_type.simpleString() == "array<string>" and len(r.struct()) == 24
    assert r.filter_schema("feature_count")["properties"]["expressions"]["items"]["properties"]["comparison_operator"]["enum"] == list(r["feature_count"].operators)
    assert any(x["field"] == "license" for x in r.field_schema())
    with pytest.raises(ValueError):
        Registry.of("projects")
