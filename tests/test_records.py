import pytest

from kmerloom.operators import records

CASES = {
    "@a,ACGT,FFFF": None,
    '"@a","ACGT","FF""F"': None,
    "@a,ACGT,FFFF\r": None,
    '"@a, b",ACGT,"F,F,"': None,
    None: "columns",
    "": "columns",
    '""': "columns",
    "@a,ACGT": "columns",
    "@a,ACGT,FFFF,": "columns",
    '@a,"ACGT,FFFF': "quoting",
    '@a,"ACGT"x,FFFF': "quoting",
    '@a,AC"GT,FFFF': "quoting",
    '@a,"ACGT" ,FFFF': "quoting",
    'a"b': "quoting",
    "a,ACGT,FFFF": "header",
    "@,ACGT,FFFF": "header",
    "@ x,ACGT,FFFF": "header",
    "@a,,FFFF": "seq",
    "@a,acgt,FFFF": "seq",
    '@a,"AC\nGT",FFFFF': "seq",
    "@a,ACGT,": "quality",
    "@a,ACGT,FF F": "quality",
    "@a,ACGT,FFFFF": "length",
    "@a,ACGT,FFFF\r\r": "quality",
}


@pytest.mark.parametrize("line", CASES)
def test_reason(line):
    parsed = records.parse_one(line)
    assert parsed[3] == CASES[line]
    assert (parsed[0] is None) == (parsed[3] is not None)


def test_values_and_places():
    assert records.parse_one('"@a ""x""",ACGT,"FF,F"')[:3] == ('@a "x"', "ACGT", "FF,F")
    assert records.parse_one('@a,"ACGT"x,FFFF')[4] == 9
    assert records.parse_one("@a," + "A" * 500_000 + "," + "F" * 500_000)[3] is None


def test_stream_resumes_at_a_record():
    text = '@a,ACGT,FFFF\n@b,"AC,FF\n@c,AC,"F,"\n\n"@d",ACG,FFF\nzz\n@e,A,F'
    rows = records.parse_many(text)
    assert [(r[0], r[1], r[4]) for r in rows] == [(0, "@a", None), (13, None, "quoting"), (23, "@c", None), (35, "@d", None), (48, None, "columns"), (51, "@e", None)]
    assert [r[7] for r in rows] == [None, 23, None, None, None, None]
    assert records.parse_many('@a,"A') == [(0, None, None, None, "quoting", 3, -1, 5)]
    assert records.parse_many(None) == records.parse_many("") == records.parse_many("\n\n") == []


def test_frames(spark):
    df = spark.createDataFrame([(1, "@a,A,F", "x"), (1, "@a,A,F", "x"), (2, None, None)], "record_id INT, raw_line STRING, reason STRING")
    good, bad = records.load_records(df)
    assert good.count() == 2 and [(r.record_id, r.parsed.reason) for r in bad.collect()] == [(2, "columns")]
    assert records.parse_records(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        records.parse_records(df, into="reason")
    streams = spark.createDataFrame([("f", "@a,A,F\n@b,C,F"), ("g", None)], "file STRING, body STRING")
    assert [(r.file, r.record_start, r.header) for r in records.parse_streams(streams, "body", ["file"]).collect()] == [("f", 0, "@a"), ("f", 7, "@b")]


def test_lines_become_streams(spark):
    rows = [("f", 1, 7, "@b,A,F"), ("f", 0, 5, '@a,"A'), ("f", 1, 6, None), ("f", 70, 8, "x"), (None, None, 9, "y")]
    df = spark.createDataFrame(rows, "file STRING, n LONG, id LONG, line STRING")
    got = {(r.file, r.block): r.body for r in records.as_streams(df, "file", "n", "id", "line").collect()}
    assert got == {("f", 0): '@a,"A\n\n@b,A,F', ("f", 1): "x", (None, None): "y"}
    found = records.parse_streams(records.as_streams(df, "file", "n", "id", "line"), "body", ["file", "block"]).where("block = 0").orderBy("record_start").collect()
    assert [(r.header, r.reason, r.resumed_at) for r in found] == [(None, "quoting", 7), ("@b", None, None)]
    assert records.as_streams(df.limit(0), "file", "n", "id", "line").count() == 0
