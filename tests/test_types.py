from pyspark.sql import types as T

from binscope.operators.types import get_data_types


def _types(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return {(r.column_name, r.data_type) for r in get_data_types(df).collect()}


def test_all_null_is_unsupported(spark):
    assert _types(spark, [(None,)] * 5, "x double") == {("x", "Unsupported")}


def test_bools_are_numeric_never_categorical(spark):
    assert _types(spark, [(True,), (False,)] * 20, "b boolean") == {("b", "Numeric")}


def test_numeric_strings(spark):
    vals = ["1e5", " 7 ", "+5", "1.", "inf", ""] * 10 + [str(i) for i in range(40)]
    assert _types(spark, [(v,) for v in vals], "s string") == {("s", "Numeric")}


def test_bad_numeric_strings(spark):
    for bad in ["1d", "NaN", "1_000", "0x1A", "1,000"]:
        vals = [str(i) for i in range(60)] + [bad]
        got = _types(spark, [(v,) for v in vals], "s string")
        assert ("s", "Numeric") not in got, bad


def test_date_strings(spark):
    vals = [f"2024-01-{d:02d}" for d in range(1, 29)] * 2
    assert _types(spark, [(v,) for v in vals], "s string") == {("s", "DateTime")}


def test_mixed_date_strings_not_datetime(spark):
    vals = [f"2024-01-{d:02d}" for d in range(1, 29)] + ["2024-01-03 04:05:06"]
    assert ("s", "DateTime") not in _types(spark, [(v,) for v in vals], "s string")


def test_compact_dates_are_numeric(spark):
    vals = [f"202401{d:02d}" for d in range(1, 29)]
    assert _types(spark, [(v,) for v in vals], "s string") == {("s", "Numeric")}


def test_null_ints_parity(spark):
    rows = [(i % 3,) for i in range(29)] + [(None,)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("x", T.IntegerType())]))
    on = {(r.column_name, r.data_type) for r in get_data_types(df).collect()}
    off = {(r.column_name, r.data_type) for r in get_data_types(df, int_parity=False).collect()}
    assert on == {("x", "Numeric")}
    assert off == {("x", "Categorical")}


def test_declared_categorical_has_two_types(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)], "x double")
    got = {r.data_type for r in get_data_types(df, declared_categorical=["x"]).collect()}
    assert got == {"Categorical", "Numeric"}


def test_text_against_id(spark):
    text = ["the cat sat on the mat and the dog ran"] * 3 + [f"id{i}" for i in range(50)]
    ids = [f"x-{i}" for i in range(60)]
    assert _types(spark, [(v,) for v in text], "s string") == {("s", "Text")}
    assert _types(spark, [(v,) for v in ids], "s string") == {("s", "Id")}


def test_driver_tables_match_fixture_map(spark, sf001):
    df = spark.read.parquet(f"{sf001}/lineitem.parquet")
    got = {r.column_name: r.data_type for r in get_data_types(df).collect()}
    assert got["l_linenumber"] == "Categorical"
    assert got["l_returnflag"] == "Categorical"
    assert got["l_quantity"] == "Numeric"
    assert got["l_shipdate"] == "DateTime"
    emb = spark.read.parquet(f"{sf001}/embeddings.parquet")
    got = {r.column_name: r.data_type for r in get_data_types(emb).collect()}
    assert got["embedding"] == "Unsupported"


def test_dates_of_many_shapes(spark):
    from binscope.operators.types import get_data_types
    days = [(f"2024-{m:02d}-{d:02d}T01:02:03.{m}{d:05d}", f"2024-{m:02d}-{d:02d}T00:00:00Z", f"2024-{m:02d}-{d:02d} 10:00:00-05:30",
             f"{d} {'Jan Feb Mar Apr'.split()[m - 1]} 2024", f"{'January February March April'.split()[m - 1]} {d}, 2024",
             f"{d} {'Jan Feb Mar Apr'.split()[m - 1]} 2024" if d % 2 else f"2024-{m:02d}-{d:02d}", f"2024-{m:02d}-{d + 10:02d}" + "x" * 50)
            for m in range(1, 5) for d in range(1, 21)]
    df = spark.createDataFrame(days, "a string, b string, c string, d string, e string, mixed string, long string")
    got = {r.column_name: r.data_type for r in get_data_types(df).collect()}
    assert {got[c] for c in "abcde"} == {"DateTime"} and "DateTime" not in (got["mixed"], got["long"])


def test_date_shapes_pass_the_gate(spark):
    """Every format's own values begin like a date, so the gate never hides one from the parser."""
    import datetime as dt
    import re

    from binscope.functions.exprs import DATETIME_FORMATS, DATETIME_MAX
    from binscope.operators.types import DATE_START_RE
    one = spark.createDataFrame([(dt.datetime(2024, 3, 7, 4, 5, 6, 123456),)], "t timestamp")
    for fmt in DATETIME_FORMATS:
        text = one.selectExpr(f"date_format(t, \"{fmt}\")").first()[0]
        assert re.match(DATE_START_RE, text) and len(text) <= DATETIME_MAX, (fmt, text)
        got = _types(spark, [(text,), (text.replace("2024", "2023"),)] * 2, "s string")
        assert got == {("s", "DateTime")}, (fmt, text)


def test_many_tokens_equals_the_tokeniser(spark):
    from pyspark.sql import functions as F

    from binscope.functions.exprs import tokens
    from binscope.operators.types import MANY_TOKENS_RE, MIN_TOKENS_FOR_TEXT
    vals = ["abcdef", "a b c", "a b cd", "a-b-c", "a-b-cd", "1.5% 2 x", "1.5 2.5 3.5", "中文中文中", "中文中文中文", "", " " * 5,
            " " * 6, "a.5b.5c.5", "\n\n\n\n\n\n", "12.34.56.78.90", "x😀y😀z😀"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    for r in df.select("v", (F.size(tokens(F.col("v"))) > MIN_TOKENS_FOR_TEXT).alias("a"),
                       F.col("v").rlike(MANY_TOKENS_RE).alias("b")).collect():
        assert r["a"] == r["b"], r


def test_text_without_blanks_counts_tokens(spark):
    many = [("中文字符测试" + chr(0x4E00 + i),) for i in range(40)]
    assert _types(spark, many, "s string") == {("s", "Text")}
    # six tokens, yet none more than three times: an Id
    few = [("".join(chr(0x4E00 + 10 * i + j) for j in range(6)),) for i in range(40)]
    assert _types(spark, few, "s string") == {("s", "Id")}
    dates = [(f"2024-01-{d:02d}T00:00:00",) for d in range(1, 29)]
    assert _types(spark, dates, "s string") == {("s", "DateTime")}


def test_types_read_a_column_once_and_ship_no_text(spark, tmp_path, monkeypatch):
    """Each column is in one scan; texts too long for a date are not a shuffle key."""
    from binscope.operators import types as C
    rows = [(i, i / 3, f"some longer text of the row {i} that nobody should shuffle", f"2024-01-{i % 28 + 1:02d}")
            for i in range(500)]
    spark.createDataFrame(rows, "i int, x double, t string, d string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    numbers, values = C.distinct_values(df, df.columns)
    read = [d._jdf.queryExecution().executedPlan().toString() for d in (numbers, values)]
    assert [p.count("FileScan") for p in read] == [1, 1]
    assert "ReadSchema: struct<i:int,x:double>" in read[0] and "ReadSchema: struct<t:string,d:string>" in read[1]
    texts = {r["date_text"] for r in values.select("date_text").distinct().collect()}
    assert texts == {None, *{f"2024-01-{i + 1:02d}" for i in range(28)}}
    # blanks decide the text column: no second scan
    monkeypatch.setattr(C, "string_long", lambda *a: (_ for _ in ()).throw(AssertionError("tokens were counted")))
    got = {(r.column_name, r.data_type) for r in C.get_data_types(df).collect()}
    assert got == {("i", "Numeric"), ("x", "Numeric"), ("t", "Text"), ("d", "DateTime")}


def test_types_of_empty_and_odd_columns(spark):
    assert _types(spark, [], "s string, x int") == {("s", "Unsupported"), ("x", "Unsupported")}
    rows = [(float("nan"), 0.0, None)] * 5 + [(float("nan"), -0.0, None)] * 5
    df = spark.createDataFrame(rows, "`a.b` double, z double, n string")
    from binscope.operators.types import column_stats
    got = {r.column_name: (r.n_null, r.n_distinct) for r in column_stats(df).collect()}
    assert got == {"a.b": (10, 0), "z": (0, 1), "n": (10, 0)}
