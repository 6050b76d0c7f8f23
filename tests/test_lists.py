import pytest
from pyspark.sql import functions as F

from lorekeep.operators import lists as L
from lorekeep.plans import expressions as X


def value(spark, text, names=None):
    made = X.compile_expression(text, names or {})
    return spark.range(1).select(made.column.alias("v")).first().v


@pytest.mark.parametrize("text,expected", [("1 + 2 * 3", 7), ("7 / 2", 3), ("-7 / 2", -3), ("7 % 3 == 1 && !false", True), ("'a' + \"b\"", "ab"), ("size('héy')", 3), ("1 < 2 ? 'y' : 'n'", "y"), ("lists.flatten([[1, 2], [3]])", [1, 2, 3]), ("lists.slice([1, 2, 3, 4], 1, 3)", [2, 3]), ("lists.range(4)", [0, 1, 2, 3]), ("size(lists.range(0))", 0), ("lists.sum([0.5, 0.25])", 0.75), ("lists.distinct(['a', 'b', 'a'])", ["a", "b"]), ("[1, 2, 3].filter(x, x > 1).map(x, x * 10)", [20, 30]), ("[1, 2].all(x, x > 0)", True), ("2 in [1, 2]", True), ("{'a': 1}['a']", 1), ("'a,b'.split(',')", ["a", "b"]), ("['a', 'b'].join('-')", "a-b"), ("int('12') + 1", 13), ("math.greatest(3, 5)", 5), ("'Ab'.lowerAscii().startsWith('a')", True)])
def test_expressions(spark, text, expected):
    assert value(spark, text) == expected


@pytest.mark.parametrize("text", ["1 +", "item", "1 + 'a'", "1 < 'a'", "[1, 'a']", "'a' && true", "size(1)", "(" * 40 + "1" + ")" * 40, "1 ? 2 : 3", "x" * 5000, "lists.sum(['a'])"])
def test_refused(text):
    with pytest.raises(X.ExpressionError):
        X.compile_expression(text, {})


@pytest.mark.parametrize("text", ["lists.slice([1, 2], 1, 5)", "lists.range(-1)", "lists.range(2000000)", "1 / 0", "lists.sum([9223372036854775807, 1])"])
def test_failures_raise(spark, text):
    with pytest.raises(Exception):
        value(spark, text)


def test_filter_example(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 11)], "item bigint")
    kept = L.filter_items(df, "item", "item % 2 == 0", "item / 4")
    assert sorted(r.item for r in kept.collect()) == [2, 4, 8]
    assert L.kept_and_dropped(df, kept).first().dropped == 7
    two = L.filter_items(df, "item", "item > 3", limit=2)
    assert [r.item for r in two.collect()] == [4, 5] and L.kept_and_dropped(df, two).first().dropped == 8


def test_stable_descending_sort(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "b")], "pos bigint, k string")
    got = [r.pos for r in L.sort_items(df, "pos", F.col("k"), descending=True).orderBy("position").collect()]
    assert got == [1, 3, 0, 2]


def test_validate_never_stops_early(spark):
    df = spark.createDataFrame([(0, None, 5), (1, "abcdef", 50)], "i bigint, s string, n bigint")
    rules = L.constraint("s", required=True, max_length=3) + L.constraint("n", maximum=10)
    got = {(r["index"], r.path, r.rule) for r in L.validate_items(df, "i", rules).collect()}
    assert got == {(0, "s", "required"), (1, "s", "max_length"), (1, "n", "maximum")}


def test_json_paths(spark):
    df = spark.createDataFrame([('{"a":[{"n":1},{"n":2},{"n":3}],"b":{"c":"x"}}',), ("{",), (None,)], "j string")
    for path, want in [("$.b.c", '"x"'), ("$.a[-1].n", "3"), ("$.a[0:2].n", "[1,2]"), ("$.a[*].n", "[1,2,3]"), ("$.a[0,2].n", "[1,3]"), ("$.z", None), ("$.a[7]", None)]:
        assert [r[0] for r in df.select(X.json_path(F.col("j"), path)).collect()] == [want, None, None], path
    with pytest.raises(X.ExpressionError):
        X.json_path(F.col("j"), "$..a")


def test_one_value(spark):
    assert L.transform_value(spark, {"a": 2, "b": "x"}, "a bigint, b string", {"n": ("bigint", "a + 1"), "t": ("string", None)}) == {"n": 3, "t": ""}
    rules = [*L.constraint("b", min_bytes=3, type="string"), *L.constraint("a", maximum=1, required=True)]
    assert [v["rule"] for v in L.validate_value(spark, {"a": 2, "b": "é"}, "a bigint, b string", rules)] == ["min_bytes", "maximum"]
    assert L.validate_value(spark, {"a": None, "b": None}, "a bigint, b string", rules)[0]["rule"] == "required"


def test_valid_and_invalid_rows(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, [1]), (3, None)], "i int, v array<int>")
    good, bad = L.partition_items(df, "i", L.constraint("v", max_items=2))
    assert sorted(r.i for r in good.collect()) == [2, 3] and [(r.i, r.violations[0].rule) for r in bad.collect()] == [(1, "max_items")]
