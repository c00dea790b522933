from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliary import schema as S
from foliary.functions import answers as A
from foliary.functions import dates as D
from foliary.functions import encode, render
from foliary.functions import text as X
from foliary.schema import field


def values(spark, inputs, make, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r.o for r in frame.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


def test_strip_knows_unicode_space(spark):
    given = ["  a \x1f", "\t\n", "b c", None]
    assert values(spark, given, X.strip) == ["a", "", "b c", None]
    assert values(spark, given, X.is_blank) == [False, True, False, None]


def test_suffix_follows_the_file_name(spark):
    given = ["a/b/x.PDF", ".txt", "a/.txt", "a/b.c/d", "z.tar.gz", "..txt"]
    assert values(spark, given, X.suffix) == [".pdf", "", "", "", ".gz", ".txt"]
    assert values(spark, given, X.stem) == ["x", ".txt", ".txt", "d", "z.tar", "."]


def test_clean_file_stem_cuts_after_trimming(spark):
    long = "_" + "a" * 59 + " b"
    assert values(spark, ["Été: 2024!", "***", long], X.clean_file_stem) == ["t_2024", "document", "a" * 59 + "_"]
    assert values(spark, ["ok_1", "no-dash", "", "ok\n"], X.is_valid_file_stem) == [True, False, False, False]


def test_decoding_ignores_bad_bytes(spark):
    assert values(spark, [b"a\xffb", "é".encode(), b"\xc3"], X.decoded, "binary") == ["ab", "é", ""]


@pytest.mark.parametrize(
    "text, day",
    [
        ("April 3rd, 2025", "2025-04-03"), ("april 3, 2025", "2025-04-03"), ("2025-04-03", "2025-04-03"),
        ("04/03/2025", "2025-04-03"), ("3rd day of April 2025", "2025-04-03"), ("Apr 3, 2025", None),
        ("02/30/2025", None), ("0000-01-01", None), ("2025", None),
    ],
)
def test_written_date(spark, text, day):
    assert values(spark, [text], lambda c: D.written_date(c).cast("string")) == [day]


def test_two_digit_years(spark):
    given = ["04/77", "4/04", "12/36", "01/37", "10/1998", "13/04", " 07/99 "]
    new = ["1977-04-01", "2004-04-01", "2036-12-01", "1937-01-01", "1998-10-01", None, "1999-07-01"]
    old = ["1877-04-01", "2004-04-01", "2036-12-01", "1937-01-01", "1998-10-01", None, "1899-07-01"]
    assert values(spark, given, lambda c: D.month_year(c, 2026).cast("string")) == new
    assert values(spark, given, lambda c: D.month_year(c, 2026, "reference").cast("string")) == old
    full = values(spark, ["2/29/00", "2/29/01", "1/2/77", "1/2/1977", "1977-01-02"], lambda c: D.full_date(c, 2026).cast("string"))
    assert full == ["2000-02-29", None, "1977-01-02", "1977-01-02", "1977-01-02"]


def test_year_in_text(spark):
    given = ["105,000 (2007)", "2007", "1900", "2100", "12007", "2007 ", "2007x"]
    assert values(spark, given, D.year_in_text) == [2007, 2007, None, None, 2007, 2007, None]


def test_code_fence_only_at_the_start(spark):
    given = ['```json\n{"a":1}\n```', "```{}```", 'x ```{"a":1}```', ' {"a":1} ']
    assert values(spark, given, A.without_fence) == ['{"a":1}', "{}", 'x ```{"a":1}```', '{"a":1}']


def test_only_whole_objects_parse(spark):
    given = ['{"a": 1}', '{"a": 1} x', '{"a": 1} {"a": 2}', '{"a":', "[1]", "1", "", None, "{'a': 1}", "{}"]
    assert values(spark, given, A.is_json_object) == [True] + [False] * 8 + [True]


SHAPE = T.StructType([
    field("n", "bigint", required=True), field("d", "date"), field("l", "array<string>"),
    field("s", T.StructType([field("x"), field("y", "bigint")])), field("e", enum=("p", "q")),
    field("f", "boolean", default=True), field("v", "variant"), field("m", T.MapType(T.StringType(), T.StringType())),
])


def parsed(spark, text):
    frame = spark.createDataFrame([(text,)], "t string").withColumn("raw", A.raw_fields(A.without_fence(F.col("t"))))
    frame = frame.withColumn("r", A.relaxed(F.col("raw"), SHAPE))
    return frame.select(
        "r", A.strict_errors(F.col("raw"), F.col("r"), SHAPE).alias("errors"),
        A.unknown_keys(F.col("raw"), SHAPE).alias("unknown"), A.empty_keys(F.col("raw"), SHAPE).alias("empty"),
    ).first()


def test_relaxed_parse_scrubs_every_level(spark):
    row = parsed(spark, '{"n": "5", "d": "2023-01-01", "l": ["x", " "], "s": {"x": " ", "y": 3}, "e": "p", "m": {"k": ""}, "zz": 1}')
    assert row.r.n == 5 and row.r.d == dt.date(2023, 1, 1) and row.r.l == ["x", None]
    assert row.r.s == T.Row(x=None, y=3) and row.r.m == {"k": None} and row.r.f is True
    assert row.errors == [] and row.unknown == ["zz"]


def test_default_only_for_a_missing_key(spark):
    assert parsed(spark, '{"n": 1, "f": null}').r.f is None
    assert parsed(spark, '{"n": 1, "f": "off"}').r.f is False


@pytest.mark.parametrize(
    "text, errors",
    [
        ("{}", ["n: missing"]), ('{"n": " "}', ["n: null"]), ('{"n": 5.5}', ["n: type"]), ('{"n": 5.0}', []),
        ('{"n": 1, "d": "2023"}', ["d: type"]), ('{"n": 1, "e": "r"}', ["e: enum"]), ('{"n": 1, "l": "x"}', ["l: type"]),
        ("nope", [A.MALFORMED]), ('{"n": 99999999999999999999}', ["n: type"]), ('{"n": 1, "d": "2023-02-30"}', ["d: type"]),
    ],
)
def test_strict_errors(spark, text, errors):
    assert parsed(spark, text).errors == errors


def test_empty_keys(spark):
    assert parsed(spark, '{"n": 1, "l": [ ], "m": {}, "e": "", "d": null}').empty == ["d", "e", "l", "m"]


def test_schema_parts_and_description():
    shape = S.with_lineage(SHAPE)
    assert [len(p.fields) for p in S.parts(shape, 3)] == [3, 3, 2]
    shown = S.describe(T.StructType([field("some_date", "date", required=True), field("some_text", description="a text"),
                                     field("kind", enum=("a", "b"))]))
    assert shown == {
        "some_date": {"type": "string(date)", "required": True},
        "some_text": {"type": "string", "required": False, "description": "a text"},
        "kind": {"type": "enum['a', 'b']", "required": False},
    }


def test_plain_numbers_in_rendered_text(spark):
    given = [10000.0, 12345678.9, 1e7, 0.0005, 1.5]
    assert values(spark, given, render.plain_number, "double") == ["10000.0", "12345678.9", "10000000.0", "0.0005", "1.5"]


def test_map_keys_are_labelled_like_fields(spark):
    given = ["e-mail", "it's_a1b", "ÉCOLE_élan", "x__y", "", "日本a", "UPPER lower"]
    assert values(spark, given, render.key_label) == [render.label(k) for k in given]


def test_markdown_and_html(spark):
    shape = T.StructType([
        field("agreement_title"), field("signed", "date"), field("paid", "boolean"), field("at", "timestamp_ntz"),
        T.StructField("terms", T.StructType([field("net_days", "bigint")])), field("names", "array<string>"),
    ])
    row = ("T & <C>", dt.date(2024, 1, 2), None, dt.datetime(2024, 1, 2, 3, 4, 5), (30,), ["a", "b"])
    frame = spark.createDataFrame([row], shape).select(F.struct("*").alias("r"))
    out = frame.select(
        render.markdown_document(F.col("r"), shape, F.col("r.agreement_title")).alias("md"),
        render.html(F.col("r"), shape).alias("html"),
    ).first()
    assert out.md == "\n".join([
        "# T & <C>", "", "- **Agreement Title:**", "  T & <C>", "- **Signed:**", "  2024-01-02", "- **Paid:**", "  None",
        "- **At:**", "  2024-01-02 03:04:05", "- **Terms:**", "  - **Net Days:**", "    30", "- **Names:**", "  - a", "  - b",
    ])
    assert out.html.startswith("<ul><li><strong>Agreement Title:</strong> T &amp; &lt;C&gt;</li>")
    assert "<li><strong>Terms:</strong><ul><li><strong>Net Days:</strong> 30</li></ul></li>" in out.html
    assert out.html.endswith("<ul><li> a</li><li> b</li></ul></li></ul>")


def test_cells(spark):
    frame = spark.createDataFrame([(None, True, [1], "x")], "a string, b boolean, c array<int>, d string")
    cells = [encode.cell(F.col(f.name), f.dataType).alias(f.name) for f in frame.schema.fields]
    assert tuple(frame.select(*cells).first()) == ("", "true", "[1]", "x")


def test_audit_text(spark):
    parts = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(x).alias("text")) for t, x in (("text", "a\n\nb \n"), ("document", "c"))])
    assert spark.range(1).select(X.audit_text(parts)).first()[0] == "content[0] (text):\n  a\n\n  b\ncontent[1] (document):\n  c"


@pytest.mark.parametrize("text,errors", [
    ('{"s": "x", "l": ["a"], "o": {"a": 1, "t": "u"}, "e": ["p"]}', []),
    ('{"s": 5, "l": ["a"]}', ["s: type"]),
    ('{"s": ["a"], "l": [{"a": 1}]}', ["s: type", "l[0]: type"]),
    ('{"s": {"x": 1}, "o": {"a": "x", "t": 7}}', ["s: type", "o.a: type", "o.t: type"]),
    ('{"s": null, "l": [1, "b"], "o": [1], "e": ["p", "z"]}', ["l[0]: type", "o: type", "e[1]: enum"]),
    ('{"s": "5", "l": [], "o": {"a": 12.0, "t": null}, "e": []}', []),
])
def test_kinds_of_values(spark, text, errors):
    shape = T.StructType([field("s"), field("l", "array<string>"), field("o", "struct<a:bigint,t:string>"), field("e", "array<string>", enum=("p", "q"))])
    rows = spark.createDataFrame([(text,)], "t string").select("t", A.raw_fields(F.col("t")).alias("raw"))
    rows = rows.withColumn("r", A.relaxed(F.col("raw"), shape))
    assert rows.select(A.strict_errors(F.col("raw"), F.col("r"), shape)).first()[0] == errors


NESTED = T.StructType([
    field("owner", T.StructType([
        field("name", required=True), field("kind", enum=("home", "work"), default="home"), field("since", "date"),
        field("at", T.StructType([field("street", required=True), field("floor", "bigint", required=True)])),
    ]), required=True),
    field("all", T.ArrayType(T.StructType([field("street", required=True), field("n", "bigint"), field("ok", "boolean", default=True)])), required=True),
    field("marks", T.ArrayType(T.StringType(), containsNull=False)), field("rates", T.MapType(T.StringType(), T.DoubleType())),
    field("grid", T.ArrayType(T.ArrayType(T.LongType()))),
])


@pytest.mark.parametrize("text,errors", [
    ('{"owner": {"name": "a"}, "all": []}', []),
    ('{"owner": {}, "all": [{"street": "x"}, {"street": null}, {"n": 1}]}', ["owner.name: missing", "all[1].street: null", "all[2].street: missing"]),
    ('{"owner": {"name": "a", "kind": "moon", "since": "2024", "at": {"street": " ", "floor": "2"}}, "all": "x"}',
     ["owner.kind: enum", "owner.since: type", "owner.at.street: null", "all: type"]),
    ('{"owner": {"name": 5, "at": [1]}, "all": [5, null, {"street": ["a"], "n": "many", "ok": "on"}]}',
     ["owner.name: type", "owner.at: type", "all[0]: type", "all[2].street: type", "all[2].n: type"]),
    ('{"owner": "me", "all": null, "marks": ["a", null, 3], "rates": {"a": 1, "b": "2.5", "c": "x", "d": null}, "grid": [[1], ["2", "x"], 3]}',
     ["owner: type", "all: null", "marks[1]: null", "marks[2]: type", "rates.c: type", "grid[1][1]: type", "grid[2]: type"]),
])
def test_nested_records_are_checked_by_path(spark, text, errors):
    rows = spark.createDataFrame([(text,)], "t string").select(A.raw_fields(F.col("t")).alias("raw"))
    rows = rows.withColumn("r", A.relaxed(F.col("raw"), NESTED))
    assert rows.select(A.strict_errors(F.col("raw"), F.col("r"), NESTED)).first()[0] == errors


def test_nested_defaults_and_unknown_keys(spark):
    text = '{"owner": {"name": "a", "kind": null}, "all": [{"street": "x"}, {"street": "y", "ok": false}], "z": 1, "b": null}'
    rows = spark.createDataFrame([(text,)], "t string").select(A.raw_fields(F.col("t")).alias("raw"))
    rows = rows.withColumn("r", A.relaxed(F.col("raw"), NESTED))
    got = rows.select("r", A.strict_errors(F.col("raw"), F.col("r"), NESTED, True).alias("e")).first()
    assert got.r.owner.kind is None and [x.ok for x in got.r["all"]] == [True, False]
    assert got.e == ["b: unknown", "z: unknown"]
    inner = '{"owner": {"name": "a"}, "all": []}'
    filled = spark.createDataFrame([(inner,)], "t string").select(A.relaxed(A.raw_fields(F.col("t")), NESTED).alias("r")).first()
    assert filled.r.owner.kind == "home"


def test_declared_parsers_run_before_validation(spark):
    shape = T.StructType([field("day", "date", parse="written_date"), field("due", "date", parse="full_date:2025"), field("year", "bigint", parse="year_in_text")])
    text = '{"day": "April 3rd, 2025", "due": "4/5/24", "year": "105,000 (2007)"}'
    rows = spark.createDataFrame([(text,), ('{"day": "someday", "due": "2024-01-02", "year": 1999}',)], "t string").select(A.raw_fields(F.col("t")).alias("raw"))
    got = [(str(r.v.day), str(r.v.due), r.v.year, r.e) for r in rows.select(A.relaxed(F.col("raw"), shape).alias("v"), A.strict_errors(F.col("raw"), A.relaxed(F.col("raw"), shape), shape).alias("e")).collect()]
    assert got == [("2025-04-03", "2024-04-05", 2007, []), ("None", "2024-01-02", 1999, ["day: type"])]
