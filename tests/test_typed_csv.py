"""CSV columns get the types their values fit; see kassa.sources.typed_csv."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from kassa.sources import typed_csv as tc
from kassa.sources.files import latest_snapshot, load_transactions, read_table
from kassa.sources.sinks import write_table

KINDS = {"12": tc.LONG, " -3 ": tc.LONG, "+7": tc.LONG, "007": tc.LONG, "9223372036854775808": tc.TEXT, "1.5": tc.DOUBLE, "1e3": tc.DOUBLE,
         ".5": tc.DOUBLE, "inf": tc.DOUBLE, "-Infinity": tc.DOUBLE, "1d": tc.TEXT, "0x10": tc.TEXT, "1,000": tc.TEXT,
         "2024-03-05": tc.TIMESTAMP, "2024-03-05 06:07": tc.TIMESTAMP, "2024-03-05T06:07:08.123456": tc.TIMESTAMP,
         "2024-13-05": tc.TEXT, "2024-03-05T06:07:08Z": tc.TEXT, "03/05/2024": tc.TEXT, "true": tc.BOOLEAN, "False": tc.BOOLEAN,
         "yes": tc.TEXT, "": 0, "n/a": 0, "NaN": 0, "NULL": 0, None: 0, "word": tc.TEXT}


def test_kind_of_every_value(spark):
    df = spark.createDataFrame([(k,) for k in KINDS], "a string")
    assert {r["a"]: r["k"] for r in df.select("a", tc.kind(F.col("a")).alias("k")).collect()} == KINDS


def test_types_are_joins_in_the_lattice():
    names = {k: tc.type_of(k).simpleString() for k in (0, 1, 2, 4, 6, 8, 3, 10, 12, 16, 31, None)}
    assert names == {0: "double", 1: "boolean", 2: "bigint", 4: "double", 6: "double", 8: "timestamp_ntz", 3: "string",
                     10: "string", 12: "string", 16: "string", 31: "string", None: "string"}
    assert tc.merge_kinds({"a": 2, "b": None}, {"a": 4, "c": 8, "b": 1}) == {"a": 6, "b": 1, "c": 8}
    assert tc.merge_kinds({"a": 2}, {"a": None}) == {"a": 2}


def test_one_aggregate_finds_all_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x,when,flag,gone,note\n1,2,2024-01-01,true,,\"says \"\"hi\"\", twice\"\n2,n/a,2024-01-02 10:00:00,False,NA,  padded  \n")
    (tmp_path / "b.csv").write_text("id,x,when,flag,gone,note\n3,2.5,,true,null,\n")
    df = tc.read_csv(spark, str(tmp_path))
    assert df.schema.simpleString() == "struct<id:bigint,x:double,when:timestamp_ntz,flag:boolean,gone:double,note:string>"
    rows = {r["id"]: r for r in df.collect()}
    assert rows[1]["note"] == 'says "hi", twice' and rows[2]["note"] == "  padded  " and rows[3]["note"] is None
    assert rows[2]["x"] is None and rows[3]["x"] == 2.5 and rows[2]["when"] == dt.datetime(2024, 1, 2, 10)
    texts = tc.read_texts(spark, str(tmp_path / "a.csv"))
    known = tc.kinds(tc.read_texts(spark, str(tmp_path / "b.csv")))
    assert tc.schema_of(texts).simpleString().startswith("struct<id:bigint,x:bigint")
    assert tc.schema_of(texts, known).simpleString().startswith("struct<id:bigint,x:double")
    given = tc.read_csv(spark, str(tmp_path), "id int, x string, flag boolean")
    assert given.schema["id"].dataType.simpleString() == "int" and given.schema["when"].dataType.simpleString() == "string"


def test_files_with_other_headers_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x\n1,2\n")
    (tmp_path / "b.csv").write_text("x,id\n1,2\n")
    with pytest.raises(Exception, match="header"):
        tc.read_texts(spark, str(tmp_path)).collect()


def test_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,date,amount\n")
    df = load_transactions(spark, str(tmp_path / "a.csv"))
    assert df.count() == 0 and [f.dataType.simpleString() for f in df.schema] == ["string", "timestamp_ntz", "string"]


def test_written_tables_come_back_equal(spark, tmp_path):
    when = dt.datetime(2024, 5, 6, 7, 8, 9, 123456)
    rows = [(1, 1.25, when, True, 'a "quoted", text', -5), (2, None, None, None, "  spaces  ", 1 << 60), (3, -1e-300, when, False, None, None)]
    df = spark.createDataFrame(rows, "id long, x double, at timestamp_ntz, ok boolean, note string, n long")
    write_table(df, str(tmp_path / "t"), "csv")
    back = read_table(spark, str(tmp_path / "t"), "csv")
    assert back.schema == df.schema and sorted(back.collect()) == sorted(rows)
    assert latest_snapshot(spark, str(tmp_path / "t*"), schema="id int").schema["x"].dataType.simpleString() == "string"


def test_dates_are_read_from_their_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,amount\n20240305,1\n03/06/2024,2\nnever,n/a\n")
    df = load_transactions(spark, str(tmp_path / "a.csv"))
    assert df.schema["amount"].dataType.simpleString() == "bigint"
    assert [r["Date"] for r in df.collect()] == [dt.datetime(2024, 3, 5), dt.datetime(2024, 3, 6), None]
    assert load_transactions(spark, str(tmp_path / "a.csv"), infer=False).schema["amount"].dataType.simpleString() == "string"
    assert load_transactions(spark, str(tmp_path / "a.csv"), "amount double").schema["amount"].dataType.simpleString() == "double"
