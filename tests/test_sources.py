import os
import tempfile

from binscope.sources.readers import detect_encoding, read_table


def _write(path, text, enc):
    with open(path, "w", encoding=enc) as f:
        f.write(text)


def test_gb18030_and_utf8_give_same_table(spark):
    d = tempfile.mkdtemp(prefix="binscope-src-")
    text = "名,值\n甲,1\n乙,2\n丙,3\n"
    _write(os.path.join(d, "gb.csv"), text, "gb18030")
    _write(os.path.join(d, "u8.csv"), text, "utf8")
    assert detect_encoding(spark, os.path.join(d, "gb.csv")) == "GB18030"
    a = sorted(tuple(r) for r in read_table(spark, os.path.join(d, "gb.csv")).collect())
    b = sorted(tuple(r) for r in read_table(spark, os.path.join(d, "u8.csv")).collect())
    assert a == b == [("丙", 3), ("乙", 2), ("甲", 1)]


def test_tsv_split_on_tab(spark):
    d = tempfile.mkdtemp(prefix="binscope-src-")
    _write(os.path.join(d, "t.TSV"), "a\tb\n1\tx,y\n2\tz\n", "utf8")
    df = read_table(spark, os.path.join(d, "t.TSV"))
    assert df.columns == ["a", "b"]
    assert sorted(r.b for r in df.collect()) == ["x,y", "z"]


def test_json_records_and_errors(spark):
    d = tempfile.mkdtemp(prefix="binscope-src-")
    _write(os.path.join(d, "r.json"), '[{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]', "utf8")
    assert read_table(spark, os.path.join(d, "r.json")).count() == 2
    import pytest
    with pytest.raises(ValueError):
        read_table(spark, os.path.join(d, "missing.csv"))
    _write(os.path.join(d, "x.dat"), "1", "utf8")
    with pytest.raises(ValueError):
        read_table(spark, os.path.join(d, "x.dat"))


def test_xml_in_gb18030(spark):
    d = tempfile.mkdtemp(prefix="binscope-src-")
    xml = ('<?xml version="1.0" encoding="GB18030"?>\n<rows>\n<row><名>甲</名><值>1</值></row>\n'
           '<row><名>乙</名><值>2</值></row>\n</rows>\n')
    _write(os.path.join(d, "t.xml"), xml, "gb18030")
    df = read_table(spark, os.path.join(d, "t.xml"))
    assert sorted((r["名"], int(r["值"])) for r in df.collect()) == [("乙", 2), ("甲", 1)]


def test_replace_in_text_file(spark):
    from binscope.sources.readers import replace_in_text_file
    d = tempfile.mkdtemp(prefix="binscope-src-")
    lines = ["<b>Data Profile</b>", "profile of data"]
    mapping = {"Data": "Table", "Table Profile": "Report", "of": "for"}
    _write(os.path.join(d, "in.html"), "\n".join(lines) + "\n", "utf8")
    out = replace_in_text_file(spark, os.path.join(d, "in.html"), os.path.join(d, "out"), mapping)
    expected = []
    for line in lines:          # ordered literal replacements, as str.replace does them
        for old, new in mapping.items():
            line = line.replace(old, new)
        expected.append(line)
    assert sorted(r.value for r in out.collect()) == sorted(expected)
    assert "<b>Report</b>" in expected


def test_json_forms_and_blank_lines(spark, tmp_path):
    import pytest
    from binscope.sources import readers as R
    lines, array, text = tmp_path / "l.json", tmp_path / "a.json", tmp_path / "t.txt"
    lines.write_text("\n".join('{"a": %d, "b": "x"}' % i for i in range(5)) + "\n")
    array.write_text('[\n {"a": 1, "b": "x"},\n {"a": 2, "b": "y"}\n]')
    assert R.read_table(spark, str(lines)).count() == 5
    assert R.read_table(spark, str(array)).count() == 2
    text.write_text("one\n\n   \ntwo�\n")
    assert R.detect_encoding(spark, str(text)) == "utf8"
    got = [r.value for r in R.replace_in_text_file(spark, str(text), str(tmp_path / "o"), {"o": "0"}).collect()]
    assert got == ["0ne", "", "   ", "tw0�"]
    with pytest.raises(ValueError):
        R.read_table(spark, str(tmp_path / "missing.csv"))
    arrays = spark.createDataFrame([([1, 2],)], "bins array<int>")
    p = R.write_report_tables({"t": arrays}, str(tmp_path / "out"), "csv")["t"]
    assert spark.read.option("header", "true").csv(p).first()["bins"] == "[1, 2]"
    with pytest.raises(ValueError):
        R.write_report_tables({"t": arrays}, str(tmp_path / "out"), "orc2")


def test_json_lines_with_bad_lines_keep_every_record(spark, tmp_path):
    from binscope.sources import readers as R
    good = ['{"a": %d, "b": "甲 {x} [%d]"}' % (i, i) for i in range(50)]
    pretty = '[\n {\n  "a": 100,\n  "b": "p"\n },\n {\n  "a": 101,\n  "b": "q"\n }\n]\n'
    last, first, mixed, gb = (tmp_path / n for n in ("last", "first", "mi xed", "gb"))
    for d in (last, first, mixed, gb):
        d.mkdir()
    (last / "1.json").write_text("\n".join(good[:25]) + "\n", "utf8")
    (last / "2.json").write_text("\n".join(good[25:]) + '\n{"a": 7, "b": "cut', "utf8")
    (first / "1.json").write_text('{"a": 7,\n' + "\n".join(good), "utf8")
    (mixed / "1 x.json").write_text(pretty, "utf8")
    (mixed / "2 [y].json").write_text("not json\n" + "\n\n".join(good), "utf8")
    (gb / "1.json").write_text("\n".join([*good[:9], "bad", *good[9:]]), "gb18030")
    want = {(i, f"甲 {{x}} [{i}]") for i in range(50)}
    for path, more in ((last, set()), (first, set()), (f"{tmp_path}/mi*", {(100, "p"), (101, "q")}), (gb, set())):
        got = R.read_table(spark, str(path), fmt="json").collect()
        assert {(r.a, r.b) for r in got if r._corrupt_record is None} == want | more
        assert len(got) == len(want | more) + 1
    (tmp_path / "pretty.json").write_text(pretty)
    (tmp_path / "nested.json").write_text('{"rows": [\n{"x": 1},\n{"x": 2},\n{"x": 3}\n], "n": 3}')
    assert R.read_table(spark, str(tmp_path / "pretty.json")).count() == 2
    assert [x.x for x in R.read_table(spark, str(tmp_path / "nested.json")).first().rows] == [1, 2, 3]


def test_json_form_is_decided_by_parsing(spark, tmp_path):
    """Mostly broken lines, or lines that look like an array, are still lines; a text that parses is one."""
    from binscope.sources.readers import read_json_table
    good = ['{"a": 1}', '{"a": 2}', '{"a": 3}']
    cases = {"broken": (["{bad", "x", "y}", *good[:2]], 2), "bracketed": (["[bad", *good, "tail]"], 3),
             "array": (["[", '{"a": 1},', '{"a": 2}', "]"], 2), "pretty": (['[{"a":', "1}, {", '"a": 5}]'], 2)}
    for name, (lines, n) in cases.items():
        path = tmp_path / f"{name}.json"
        path.write_text("\n".join(lines))
        rows = read_json_table(spark, str(path)).collect()
        assert sum(r["a"] is not None for r in rows) == n, name
    both = tmp_path / "both"
    both.mkdir()
    for name in ("broken", "array"):
        (both / f"{name}.json").write_text("\n".join(cases[name][0]))
    assert sum(r["a"] is not None for r in read_json_table(spark, str(both)).collect()) == 4


def test_json_and_csv_are_read_in_a_session_without_javas_charset_list(spark):
    """The default encoding has a name that Spark knows by itself."""
    from binscope.sources.readers import read_delimited, read_json_table
    d = tempfile.mkdtemp(prefix="binscope-src-")
    _write(os.path.join(d, "r.json"), '{"a": 1, "b": "名"}\n{"a": 2, "b": "y"}\n', "utf8")
    _write(os.path.join(d, "gb.json"), '{"a": 1, "b": "名"}\n', "gb18030")
    _write(os.path.join(d, "t.csv"), "a,b\n1,名\n", "utf8")
    key, before = "spark.sql.legacy.javaCharsets", spark.conf.get("spark.sql.legacy.javaCharsets")
    try:
        for multi_line in (False, None):
            spark.conf.set(key, "false")
            assert [r.b for r in read_json_table(spark, os.path.join(d, "r.json"), multi_line=multi_line).orderBy("a").collect()] == ["名", "y"]
            assert spark.conf.get(key) == "false"
        assert read_delimited(spark, os.path.join(d, "t.csv")).first().b == "名"
        assert read_json_table(spark, os.path.join(d, "gb.json"), "GB18030", False).first().b == "名"
    finally:
        spark.conf.set(key, before)
