import datetime as dt
import decimal
import hashlib
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import keys

KEEP = {"ignoreNullFields": "false"}


def round_trip(df):
    """The same text by the long way: parse the row as VARIANT and print it again."""
    return F.to_json(F.parse_json(F.to_json(F.struct("*"), KEEP)))


def both(df):
    return df.select(keys.canonical_json(df).alias("a"), round_trip(df).alias("b")).collect()


SCHEMA = "b string, a double, `C c` long, d boolean, e float, f decimal(20,6), g array<double>, " \
    "h struct<z: int, a: string>, i timestamp_ntz, j date, `é` binary"
EDGE_DOUBLES = [
    0.0, -0.0, 1.0, -1.0, 23.0, 1.5, 100.0, 1e2, 1e6, 9999999.0, 1e7, 1.25e7, 1e20, 1e-3, 9.99e-4, 1e-300,
    4.9e-324, 1.7976931348623157e308, 0.1, 1 / 3, 123456.789, float("nan"), float("inf"), float("-inf"), None,
]


def test_edge_values_match_the_long_way(spark):
    rows = [
        ('a"\\/\b\t\n\x01\x1f\x7f é &<>()   😀', d, None if n % 3 == 0 else n * 10**15, n % 2 == 0,
         d if d is None or abs(d) < 3e38 or d != d else 1.0e-5,
         None if n % 4 == 0 else decimal.Decimal(n) / 8, [d, None, 2.0], (n, None) if n % 5 else None,
         dt.datetime(2024, 1, 1, 0, 0, n, 123456), dt.date(2024, 1, 1 + n), b"x&" if n % 2 else None)
        for n, d in enumerate(EDGE_DOUBLES)
    ]
    for a, b in both(spark.createDataFrame(rows, SCHEMA)):
        assert a == b


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(
    st.text(st.characters(exclude_categories=["Cs"])) | st.none(),
    st.floats(width=64) | st.integers(-10**9, 10**9).map(float) | st.none(),
    st.integers(-2**63, 2**63 - 1) | st.none(),
), min_size=1, max_size=60))
def test_any_values_match_the_long_way(spark, rows):
    for a, b in both(spark.createDataFrame(rows, "s string, x double, n long")):
        assert a == b


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_decimals_and_floats_match_the_long_way(spark, ansi):
    values = ["0", "1", "-1", "100", "0.5", "-0.50", "123.456789", "0.000001", "-0.0000001", "99999", "1e-18",
              "10.10", "100000", "0.1", "3.4028235", "1e-5", "null"]
    columns = [f"try_cast(v as decimal({p},{s})) as d{p}_{s}"
               for p, s in ((5, 0), (20, 0), (38, 0), (9, 2), (18, 3), (38, 6), (20, 7), (38, 18))]
    columns += ["cast(try_cast(v as double) as float) as f", "cast(try_cast(v as double) * 1e30 as float) as g",
                "cast(try_cast(v as double) / 1e30 as float) as h", "cast(try_cast(v as double) * 12345677 as float) as i"]
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = spark.createDataFrame([(v,) for v in values], "v string").selectExpr(*columns)
        big = spark.sql(f"select cast('{'9' * 38}' as decimal(38,0)) a, float('nan') b, float('-inf') c")
        for a, b in both(df) + both(big):
            assert a == b
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_members_are_in_byte_order_and_nulls_kept(spark):
    df = spark.sql("select 1 as b, cast(null as string) as C, 2 as `é`, 3 as a, cast(null as double) as _x")
    text = df.select(keys.canonical_json(df)).first()[0]
    assert text == '{"C":null,"_x":null,"a":3,"b":1,"é":2}'
    assert list(json.loads(text)) == sorted(df.columns, key=lambda n: n.encode())


def test_key_is_sha256_of_escaped_text(spark):
    df = spark.createDataFrame([("R&D <x> (y) ",)], "t string")
    escaped = '{"t":"R\\u0026D \\u003cx\\u003e \\u2028y\\u2029 "}'
    key, = df.select(keys.row_key(df)).first()
    assert key == hashlib.sha256(escaped.encode()).hexdigest()


def test_separators(spark):
    df = spark.createDataFrame([("(a) b ",)], "t string")
    literal, other = df.select(keys.json_escape(F.col("t")), keys.json_escape(F.col("t"), "unicode")).first()
    assert literal == "\\u2028a\\u2029 b "
    assert other == "(a)\\u2028b\\u2029"
    # the character function works modulo 256, which is why the literal form hits parentheses
    assert spark.sql("select chr(8232), chr(8233)").first()[:] == ("(", ")")


def test_column_order_does_not_matter_but_every_value_does(spark):
    df = spark.range(50).select(
        F.col("id"), (F.col("id") / 7).alias("x"), F.col("id").cast("string").alias("s"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id)").alias("t"))
    one = {r[0] for r in df.select(keys.row_key(df)).collect()}
    turned = df.select(*reversed(df.columns))
    assert one == {r[0] for r in turned.select(keys.row_key(turned)).collect()}
    for c, change in (("id", F.col("id") + 1000), ("x", F.col("x") + 1), ("s", F.concat("s", F.lit(" "))),
                      ("t", F.col("t") + F.expr("interval 1 millisecond"))):
        other = df.withColumn(c, change)
        assert not one & {r[0] for r in other.select(keys.row_key(other)).collect()}


def test_rows_that_share_a_key(spark):
    """Decimal scale and microseconds are not part of the text."""
    df = spark.sql("""select cast('1.50' as decimal(5,2)) x, timestamp_ntz'2024-01-01 00:00:00.000001' t
        union all select cast('1.500' as decimal(5,3)), timestamp_ntz'2024-01-01 00:00:00.000999'""")
    assert df.select(keys.row_key(df)).distinct().count() == 1


def test_business_key_is_null_when_a_part_is(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 1), ("", 2)], "x string, y int")
    got = [r[0] for r in df.select(keys.business_key("x", "y")).collect()]
    assert got == ["a_1", None, None, "_2"]


def test_names(spark):
    df = spark.createDataFrame([("AFFW",), ("TC25T",), ("COEP",)], "id string")
    names = keys.derived_names(F.col("id"), "erp", "hub.v_", "Erp")
    rows = df.select(names["table_name"], names["view_name"], names["query_name"]).collect()
    assert [r[0] for r in rows] == ["tb_AffwErp", "tb_Tc25tErp", "tb_CoepErp"]
    assert rows[1][1:] == ("hub.v_tc25t_erp", "extract-erp-TC25T")
    flat = keys.derived_names(F.col("id"), "ledger", "v_", "Led", pascal=False)
    assert df.select(flat["table_name"]).first()[0] == "tb_AFFWLed"


def test_a_taken_name_is_refused(spark):
    with pytest.raises(ValueError):
        keys.with_key(spark.sql("select 1 as key"))
    with pytest.raises(ValueError):
        keys.canonical_json(spark.sql("select 1 as a, 2 as a"))


def test_key_is_computed_once(spark):
    a = spark.range(10).select(F.col("id"), F.col("id").cast("string").alias("s"))
    keyed = keys.with_key(a)
    joined = keyed.join(keyed.select("key"), "key", "left_anti")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("sha2") == 2  # once per side, none in a null test


def test_escaping_parts_equals_escaping_the_whole(spark):
    df = spark.sql("""select '<a> (b) & c' as `x<(&)>`, 1 as `n(1)`, 2.5D as `d&`, array('(', '<') as g,
        timestamp_ntz'2024-01-01 00:00:00' as `t>`, cast(null as string) as `q"\\\\(`""")
    whole = F.sha2(keys.json_escape(keys.canonical_json(df)), 256)
    assert df.select(keys.row_key(df) == whole).first()[0]
    a, b = both(df)[0]
    assert a == b


def test_adjacent_texts_share_a_writer(spark):
    df = spark.range(3).selectExpr("id", "id * 2.0D as x", "string(id) as s", "string(id) as t", "string(id) as u")
    plan = df.select(keys.row_key(df))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StructsToJsonEvaluator(") == 2  # one, and its length


def test_wide_rows(spark):
    """Hundreds of columns, as in the largest sources."""
    columns = [f"string(id + {i}) as `S{i:03}`" for i in range(300)] + [f"(id + {i}) / 4 as `D{i:03}`" for i in range(40)]
    df = spark.range(50).selectExpr(*columns)
    for a, b in both(df):
        assert a == b


def test_keys_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    found = set()
    try:
        for name in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", name)
            df = spark.range(3).selectExpr(
                "id", "timestamp_seconds(1700000000 + id) at", "array(timestamp_seconds(id)) many",
                "named_struct('t', timestamp_seconds(id)) one", "timestamp_ntz'2024-01-01 00:00:00' plain")
            found.add(tuple(r[0] for r in df.select(keys.row_key(df)).collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert len(found) == 1
