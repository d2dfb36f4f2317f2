import csv

import pytest
from pyspark.sql import functions as F

from fiscalith.operators.rejects import R1_RECORD, BadRecord, parse_record, split_records

GOOD = '2020,Army,0601102A,"Title, with ""quotes""",7,01,"1,234",-5,6.5'


def judge(spark, texts, extra=None):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "raw_id bigint, line_text string")
    for name in extra or ():
        df = df.withColumn(name, F.lit("x"))
    return {r.raw_id: r for r in split_records(df, "raw_id", "line_text", R1_RECORD).collect()}


def test_reasons(spark):
    texts = [
        GOOD,
        '2020,Army,0601102A,"Open,7,01,1,2,3',
        '2020,Army,0601102A, "Blank before",7,01,1,2,3',
        '2020,Army,0601102A,"Tail" x,7,01,1,2,3',
        '2020,Army,0601102A,In"side,7,01,1,2,3',
        "2020,Army,0601102A,T,7,01,1,2",
        "2020,Army,0601102A,T,7,01,1,2,3,4",
        "2020,Army,0601102a,T,7,01,1,2,3",
        "2020,Army, ,T,7,01, ,,",
        "2020,Army,0601102A,T,7,01,+1,2,3",
        '2020,Army,0601102A,T,7,01,1,"12,34",3',
        "2020,Army,0601102A,T,7,01,1,2,1e5",
        "2020,Army,０６０１１０２A,T,7,01,1,2,3",
        '2020,Army,0601102A,"Two\nlines",7,01,1,2,3',
        "2020,Army,0601102A,Two\nlines,7,01,1,2,3",
        GOOD + "\r\n",
    ]
    got = judge(spark, texts)
    want = [
        None, "quoting", "quoting", "quoting", "quoting", "columns", "columns", "pe_number", None, "py_amount", "cy_amount", "by_amount", "pe_number",
        None, None, None,
    ]
    assert [got[i].reason for i in range(len(texts))] == want
    assert got[0].record.pe_title == 'Title, with "quotes"'
    assert (got[0].record.py_amount, got[0].record.cy_amount, got[0].record.by_amount) == (1234.0, -5.0, 6.5)
    assert got[8].record.pe_number is None and got[8].record.py_amount is None
    assert got[14].record.pe_title == "Two\nlines"


def test_first_reason_wins(spark):
    assert judge(spark, ['x,y,bad,"open'])[0].reason == "quoting"
    assert judge(spark, ["2020,Army,bad,T,7,01,bad,bad,bad"])[0].reason == "pe_number"


def test_null_empty_long_repeated_and_clashing(spark):
    long = "2020,Army,0601102A," + "t" * 400_000 + ",7,01,1,2,3"
    got = judge(spark, [None, "", "\n", long, GOOD, GOOD], extra=["__row", "pe_number"])
    assert [got[i].reason for i in range(6)] == ["columns", "columns", "columns", None, None, None]
    assert len(got[3].record.pe_title) == 400_000


def test_empty_table_and_reserved_name(spark):
    assert judge(spark, []) == {}
    with pytest.raises(ValueError):
        split_records(spark.createDataFrame([], "reason bigint, t string"), "reason", "t", R1_RECORD)


def test_parse_record_matches_definition():
    assert parse_record('a,"b""c",,"d,e"') == ["a", 'b"c', "", "d,e"]
    assert parse_record("a,b,") == ["a", "b", ""]
    with pytest.raises(BadRecord):
        parse_record('"a" ,b')


def test_the_reader_decides(monkeypatch):
    def refuses(lines, strict):
        raise csv.Error("refused")

    monkeypatch.setattr(csv, "reader", refuses)
    with pytest.raises(BadRecord) as fault:
        parse_record("a,b,c")
    assert (fault.value.reason, fault.value.detail) == ("quoting", "refused")
    monkeypatch.setattr(csv, "reader", lambda lines, strict: iter([["x"]]))
    assert parse_record("a,b,c") == ["x"]


def test_details(spark):
    got = judge(spark, [GOOD, 'a,"b" c', 'a,"b', 'a,b"c', "a,b"])
    assert [got[i].detail for i in range(5)] == [None, "',' expected after '\"'", "unexpected end of data", "quote inside a field that is not enclosed", None]


@pytest.mark.parametrize(
    "text, fields",
    [
        ("a\nb,c\r\nd", ["a\nb", "c\r\nd"]),
        ('"a\nb","c\r\nd"', ["a\nb", "c\r\nd"]),
        ('a\n,"b\n\ue000"', ["a\n", "b\n\ue000"]),
        ("\ue001\rx,\ue000", ["\ue001\rx", "\ue000"]),
        ('"","""",', ["", '"', ""]),
        ("a\x00b,\x85", ["a\x00b", "\x85"]),
    ],
)
def test_line_breaks_and_signs(text, fields):
    assert parse_record(text) == fields


@pytest.mark.parametrize("text", ['"a"\n,b', 'a\n"b"', 'a,"b"\nc', '"a\n', '"a" "b"', 'a,""b""', '"a"b"c",d'])
def test_quoting_faults(text):
    with pytest.raises(BadRecord):
        parse_record(text)
