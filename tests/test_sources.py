"""Readers and writers."""

import pytest

from gridsight.sources import sinks, text


def write(tmp_path, name, content, encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(content.encode(encoding))
    return str(path)


def test_separators(spark, tmp_path):
    for sep in (",", ";", "\t"):
        path = write(tmp_path, f"a{ord(sep)}.csv", sep.join("ab") + "\n" + sep.join("12") + "\n")
        assert text.read_any(spark, path).collect() == [(1, 2)]
    assert text.sniff_separator("a;b\tc,d") == "\t"


def test_headers_and_leftovers(spark, tmp_path):
    path = write(tmp_path, "h.csv", "1,1,,1,,Name,name,\n1,2,x,3,,4,5,\n6,7,x,8,,9,10,u\n"
                                    "6,7,x,8,,9,10,\n")
    df = text.read_csv(spark, path)
    assert df.columns == ["1", "1.1", "1.2", "Name", "name.1"]
    assert tuple(df.first()) == (1, 2, 3, 4, 5)


def test_types_and_missing_tokens(spark, tmp_path):
    path = write(tmp_path, "t.csv", "i,d,b,s,m,x\n1,1.5,True,q,NA,1d\n-2,2,FALSE,,n/a,2\n"
                                    "NULL,inf,nan,None,3,3\n")
    df = text.read_csv(spark, path)
    assert dict(df.dtypes) == {"i": "bigint", "d": "double", "b": "boolean", "s": "string",
                               "m": "bigint", "x": "string"}
    assert [tuple(r) for r in df.collect()] == [
        (1, 1.5, True, "q", None, "1d"), (-2, 2.0, False, None, None, "2"),
        (None, float("inf"), None, None, 3, "3")]


def test_encodings(spark, tmp_path):
    latin = write(tmp_path, "l.csv", "name,n\nZoë,1\n", "latin1")
    assert text.read_csv(spark, latin).first()["name"] == "Zoë"
    real = write(tmp_path, "u.csv", "name,n\nZo�,1\nä,2\n")
    assert {r["name"] for r in text.read_csv(spark, real).collect()} == {"Zo�", "ä"}
    marked = write(tmp_path, "b.csv", "﻿name,n\nä,1\n")
    assert text.read_csv(spark, marked).columns == ["name", "n"]


def test_quotes_and_multiline(spark, tmp_path):
    path = write(tmp_path, "q.csv", 'a,b\n"x, ""y""",1\n"two\nlines",2\n')
    rows = text.read_csv(spark, path, multiline=True).collect()
    assert [tuple(r) for r in rows] == [('x, "y"', 1), ("two\nlines", 2)]


def test_empty(spark, tmp_path):
    for content in ("", "a,b\n", "a,b\n,\n"):
        with pytest.raises(text.EmptyDataset):
            text.read_csv(spark, write(tmp_path, f"e{len(content)}.csv", content))
    with pytest.raises(ValueError):
        text.read_any(spark, "table.xlsx")


def test_json(spark, tmp_path):
    array = write(tmp_path, "a.json", '[\n {"x": 1, "y": null},\n {"x": 2, "y": null}\n]')
    assert [tuple(r) for r in text.read_any(spark, array).collect()] == [(1,), (2,)]
    lines = write(tmp_path, "l.jsonl", '{"x": 1, "z": "q"}\n{"x": 2}\n')
    assert text.read_any(spark, lines).count() == 2
    one = write(tmp_path, "o.json", '[{"x": 1}, {"x": 2}]')
    assert text.read_json(spark, one).count() == 2


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", you', 2.5), (2, None, None)],
                               "i long, s string, d double")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, text.read_csv(spark, str(tmp_path / "c")).collect())) == sorted(
        map(tuple, df.collect()))
    sinks.write_json(df, str(tmp_path / "j"))
    assert '"s":null' in "".join(r[0] for r in spark.read.text(str(tmp_path / "j")).collect())
    sinks.write_parquet(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_row_numbers_follow_files(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for f in range(3):
        (folder / f"part{f}.csv").write_text(
            "n,x\n" + "".join(f"{f * 1000 + i},x\n" for i in range(1000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = text.read_csv(spark, str(folder), row_number=True).orderBy("_row").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["n"] for r in rows] == list(range(3000))


def test_line_breaks_inside_quotes_by_default(spark, tmp_path):
    rows = [(1, "a\nb", "x"), (2, 'say "hi",\n\n"ho"', "y"), (3, "plain", None)]
    sinks.write_csv(spark.createDataFrame(rows, "id int, t string, u string").repartition(2),
                    str(tmp_path / "f"))
    found = text.read_csv(spark, str(tmp_path / "f"), row_number=True)
    assert dict(found.dtypes)["id"] == "bigint"
    assert sorted(tuple(r)[:3] for r in found.collect()) == rows
    plain = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    sinks.write_csv(plain, str(tmp_path / "g"))
    assert not text.spans_lines(spark, str(tmp_path / "g"))
