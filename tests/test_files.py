from __future__ import annotations

import datetime
import glob
import os

import pytest
from pyspark.sql import functions as F

from ferrywright.plans.convert import convert_table
from ferrywright.sinks.files import as_text, write_csv
from ferrywright.sinks.insert_script import insert_statements, write_insert_script
from ferrywright.sources import landing as L
from ferrywright.spec import ColumnSpec, TableSpec


def text_of(path):
    parts = sorted(glob.glob(os.path.join(path, "part-*")))
    return "".join(open(p, encoding="utf-8", newline="").read() for p in parts)


def put(folder, name, content, encoding="utf-8"):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(content)
    return path


def people(spark):
    return spark.createDataFrame([(1, "Alice"), (2, None), (3, "a,b"), (4, 'say "hi"')], "id int, name string").coalesce(1)


def test_csv_file(spark, tmp_path):
    write_csv(people(spark), str(tmp_path / "out"))
    assert text_of(tmp_path / "out") == 'id,name\n1,Alice\n2,\\N\n3,"a,b"\n4,"say ""hi"""\n'


def test_csv_without_header_and_with_other_layout(spark, tmp_path):
    layout = L.CsvLayout(sep=";", header=False, null_marker="NULL", line_sep="\r", null_overrides={"NAME": "-"})
    write_csv(people(spark), str(tmp_path / "out"), layout)
    assert text_of(tmp_path / "out") == '1;Alice\r2;-\r3;a,b\r4;"say ""hi"""\r'


def test_markers_and_escape_of_a_layout(spark, tmp_path):
    layout = L.CsvLayout(escape="\\", null_overrides={"name": "-"})
    write_csv(people(spark), str(tmp_path / "out"), layout, quote_all=True)
    assert text_of(tmp_path / "out").splitlines()[4] == '"4","say \\"hi\\""'
    back = L.split_malformed(L.read_landing(spark, str(tmp_path / "out"), ["id", "name"], layout))[0]
    assert [r["name"] for r in back.orderBy("id").collect()] == ["Alice", None, "a,b", 'say "hi"']


def test_csv_in_key_order(spark, tmp_path):
    write_csv(spark.range(2000).repartition(6), str(tmp_path / "out"), L.CsvLayout(header=False), order=["id"])
    assert text_of(tmp_path / "out").split() == [str(i) for i in range(2000)]


def test_values_as_landing_text(spark):
    row = spark.createDataFrame(
        [(True, 5000.0, datetime.datetime(1980, 12, 17, 1, 2, 3, 999), datetime.date(1980, 12, 17), bytearray(b"\x00\xff"))],
        "a boolean, b double, c timestamp_ntz, d date, e binary",
    )
    assert tuple(as_text(row).first()) == ("true", "5000", "19801217010203", "19801217000000", "00ff")


def test_reading_what_others_write(spark, tmp_path):
    content = 'a,b,c\n1,,"x\ny"\n 2, \\N,"q ""r"""\n3,"",\\n\nshort,row\nlong,row,with,more\n4,"\\N",é\n'
    path = put(tmp_path, "s.t.csv", content)
    rows = L.read_landing(spark, path, ["a", "b", "c"])
    good, bad = L.split_malformed(rows)
    assert {tuple(r) for r in good.collect()} == {
        ("1", "", "x\ny"), ("2", None, 'q "r"'), ("3", "", "\\n"), ("4", None, "é"),
    }
    assert {(r["reason"], r["value"]) for r in bad.collect()} == {
        ("CSV_SHAPE", "short,row"), ("CSV_SHAPE", "long,row,with,more"),
    }


def test_stray_quotes_belong_to_the_value(spark, tmp_path):
    path = put(tmp_path, "s.t.csv", 'a,b\nx"y,1\n"p"q",2\n')
    assert [tuple(r) for r in L.split_malformed(L.read_landing(spark, path, ["a", "b"]))[0].collect()] == [
        ('x"y', "1"), ('p"q', "2"),
    ]


SPEC = TableSpec("S", "T", (ColumnSpec("A", "INT"), ColumnSpec("B", "INT"), ColumnSpec("C", "INT")), "postgres")


def test_columns_are_matched_by_header(spark, tmp_path):
    put(tmp_path, "s.t.csv", "c,a\n3,1\n")
    assert L.read_table(spark, str(tmp_path), SPEC).drop(L.CORRUPT).collect() == [("1", None, "3")]
    put(tmp_path, "s.t.csv", "c,x\n3,1\n")
    with pytest.raises(ValueError, match="'x'"):
        L.read_table(spark, str(tmp_path), SPEC)


def test_a_swapped_header_is_not_read_by_position(spark, tmp_path):
    path = put(tmp_path, "s.t.csv", "b,a\n1,2\n")
    with pytest.raises(Exception, match="header"):
        L.read_landing(spark, path, ["a", "b"]).collect()
    assert L.read_landing(spark, path, ["B", "A"]).count() == 1


def test_rows_keep_file_order(spark, tmp_path):
    put(tmp_path, "a.csv", "k\n" + "".join(f"{i}\n" for i in range(50)))
    put(tmp_path, "b.csv", "k\n" + "".join(f"{i}\n" for i in range(50, 80)))
    rows = L.read_landing(spark, str(tmp_path), ["k"], position=True)
    assert [int(r["k"]) for r in rows.orderBy(*L.POSITION).collect()] == list(range(80))


@pytest.mark.parametrize("name,codec", [("GBK", "gbk"), ("LATIN1", "latin-1"), ("LATIN9", "iso8859-15"),
                                        ("WINDOWS-1252", "cp1252"), ("SHIFT_JIS", "shift_jis")])
def test_legacy_charsets(spark, tmp_path, name, codec):
    word = {"gbk": "中文,零", "shift_jis": "日本"}.get(codec, "café")
    path = put(tmp_path, "s.t.csv", f'a\n"{word}"\n', codec)
    assert L.read_landing(spark, path, ["a"], L.CsvLayout(encoding=name)).first()["a"] == word


def test_header_is_all_text(spark, tmp_path):
    path = put(tmp_path, "s.t.csv", "ID,NAME\n1,2\n")
    assert L.read_header(spark, path) == ["ID", "NAME"]


def test_landing_counts(spark, tmp_path):
    put(tmp_path, "hr.emp.csv", 'a,b\n1,"x\ny"\n2,z\n')
    put(tmp_path, "hr.dept.csv", "a\n1\n")
    put(tmp_path, "web.logs.raw.csv", "a\n")
    put(tmp_path, "readme.csv", "a\n1\n")
    got = {(r["schema"], r["table"]): r["rows"] for r in L.landing_counts(spark, str(tmp_path)).collect()}
    assert got == {("hr", "emp"): 2, ("hr", "dept"): 1}


def script(spark, tmp_path, rows, dialect, size=100, **options):
    df = spark.createDataFrame(rows, "id int, name string").repartition(4)
    return text_of(write_insert_script(df, str(tmp_path), "S", "T", ["id"], dialect, size, **options))


def test_insert_script(spark, tmp_path):
    text = script(spark, tmp_path, [(1, "Alice"), (2, "Bob")], "postgres")
    assert text == 'BEGIN;\n\nINSERT INTO "S"."T" ("id", "name")\nVALUES\n  (1, \'Alice\'),\n  (2, \'Bob\');\n\nCOMMIT;\n\n'


def test_insert_script_batches(spark, tmp_path):
    text = script(spark, tmp_path, [(i, f"n{i}") for i in range(7)], "oracle", 3)
    assert text.count("INSERT INTO") == 3 and text.count("COMMIT;") == 3 and text.count("BEGIN;") == 3
    assert [line.strip()[:2] for line in text.splitlines() if line.startswith("  (")] == [f"({i}" for i in range(7)]


def test_insert_script_for_mysql(spark, tmp_path):
    text = script(spark, tmp_path, [(1, None)], "mysql", truncate=True)
    assert text.startswith("TRUNCATE TABLE `S`.`T`;\n\nINSERT INTO `S`.`T` (`id`, `name`)")
    assert "BEGIN" not in text and "COMMIT" not in text and "(1, NULL);" in text


def test_insert_script_without_quotes(spark, tmp_path):
    assert "INSERT INTO S.T (id, name)" in script(spark, tmp_path, [(1, "a")], "postgres", quote=False)


def test_statements_take_one_shuffle_after_numbering(spark):
    df = spark.range(1000).select("id", F.lit("x").alias("v"))
    plan = insert_statements(df, "s", "t", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and "hashpartitioning(batch" not in plan


CSV = 'id,name,code\n1,"a,b",007\n2,\\N,12.5\n10,it\'s,x\n3,,-\n'


def test_convert_to_csv_keeps_order(spark, tmp_path):
    put(tmp_path / "in", "s.t.csv", CSV)
    path = convert_table(spark, str(tmp_path / "in"), str(tmp_path / "out"), "S", "T", "csv")
    assert text_of(path) == CSV


def test_convert_to_script(spark, tmp_path):
    put(tmp_path / "in", "s.t.csv", CSV)
    path = convert_table(spark, str(tmp_path / "in"), str(tmp_path / "out"), "s", "t", "sql", dialect="oracle")
    lines = [line.strip() for line in text_of(path).splitlines() if line.startswith("  (")]
    assert lines == ["(1, 'a,b', 007),", "(2, NULL, 12.5),", "(10, 'it''s', 'x'),", "(3, NULL, '-');"]


def test_convert_refuses_misshapen_rows(spark, tmp_path):
    put(tmp_path / "in", "s.t.csv", "a,b\n1\n")
    with pytest.raises(Exception, match="misshapen row"):
        convert_table(spark, str(tmp_path / "in"), str(tmp_path / "out"), "s", "t", "csv")
    with pytest.raises(ValueError):
        put(tmp_path / "in", "s.t.csv", "a\n1\n")
        convert_table(spark, str(tmp_path / "in"), str(tmp_path / "out"), "s", "t", "xlsx")
