import hashlib
import json

import pytest
from pyspark.sql import functions as F, types as T

from goldseam.functions.encoding import row_text
from goldseam.operators import fingerprint as ops


def sample(spark):
    return spark.createDataFrame(
        [(i, f"n{i % 5}", i / 4 if i % 7 else None, i % 2 == 0) for i in range(300)],
        "id bigint, name string, amount double, flag boolean",
    )


def prints(df):
    return (
        ops.dataset_fingerprint(df, "d").first().data_fingerprint,
        ops.merkle_fingerprint(df, "d").first().data_fingerprint,
    )


def test_same_rows_same_print_however_they_lie(spark):
    df = sample(spark)
    base = prints(df)
    assert prints(df.repartition(7)) == base
    assert prints(df.orderBy(F.desc("id")).coalesce(1)) == base


def test_any_change_shows(spark):
    df = sample(spark)
    base = prints(df)
    changed = [
        df.where("id <> 3"),
        df.unionByName(df.where("id = 3")),
        df.withColumn("name", F.when(F.col("id") == 3, "n4").otherwise(F.col("name"))),
        df.withColumn("amount", F.when(F.col("id") != 3, F.col("amount"))),
        df.withColumn("amount", F.coalesce("amount", F.lit(0.0))),
        df.withColumnRenamed("name", "Name"),
        df.select("name", "id", "amount", "flag"),
        df.withColumn("id", F.col("id").cast("string")),
    ]
    for other in changed:
        got = prints(other)
        assert got[0] != base[0] and got[1] != base[1]


def test_swapped_cells_and_lookalike_texts_differ(spark):
    def encoded(values, schema):
        df = spark.createDataFrame([values], schema)
        return df.select(row_text(df).alias("t")).first().t

    texts = {
        encoded(("ab", "c"), "x string, y string"),
        encoded(("a", "bc"), "x string, y string"),
        encoded((None, "N"), "x string, y string"),
        encoded(("N", None), "x string, y string"),
        encoded(("1", "1"), "x string, y string"),
        encoded((1, "1"), "x bigint, y string"),
        encoded((1.0, "1"), "x double, y string"),
        encoded((float("inf"), "1"), "x double, y string"),
        encoded((float("nan"), "1"), "x double, y string"),
    }
    assert len(texts) == 9


def test_empty_table_has_a_print(spark):
    empty = spark.createDataFrame([], "id bigint")
    got = ops.dataset_fingerprint(empty, "d").first()
    assert got.row_count == 0 and len(got.data_fingerprint) == 64
    assert ops.merkle_fingerprint(empty, "d").first().row_count == 0


def test_merkle_tree_depends_on_the_rows_alone(spark):
    df = sample(spark)
    first = ops.merkle_fingerprint(df, "d").first()
    again = ops.merkle_fingerprint(df.repartition(7), "d").first()
    assert first.row_count == 300 and first.data_fingerprint == again.data_fingerprint
    assert ops.merkle_fingerprint(df.limit(299), "d").first().data_fingerprint != first.data_fingerprint


def test_timestamps_do_not_depend_on_the_session_zone(spark):
    df = spark.sql("SELECT 1 AS id, timestamp'2024-03-31 01:30:00+00:00' AS at")
    base = prints(df)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        again = prints(df)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert again == base


def test_json_cells_ignore_key_order(spark):
    a = spark.sql("""SELECT parse_json('{"a":1,"b":[2]}') AS v""")
    b = spark.sql("""SELECT parse_json('{"b":[2],"a":1}') AS v""")
    assert prints(a) == prints(b)


def test_gold_fingerprint_is_plain_sha256_of_canonical_json(spark):
    columns = [("id", "int64"), ("amount", "float64")]
    text = json.dumps(
        {"format_version": 1, "columns": [{"name": n, "dtype": d} for n, d in columns]},
        sort_keys=True, separators=(",", ":"),
    )
    df = spark.createDataFrame(
        [(1, columns)], "format_version int, columns array<struct<name:string,dtype:string>>"
    )
    assert ops.gold_fingerprint(df).first().fingerprint == hashlib.sha256(text.encode()).hexdigest()


def test_provenance_fingerprint_is_plain_sha256_of_canonical_json(spark):
    fact = {
        "format_version": 1, "source_primary_key": ["id", "line"], "source_row_count": 3,
        "source_schema_fingerprint": "a" * 64, "source_dataset_fingerprint": "b" * 64,
    }
    df = spark.createDataFrame(
        [(fact["source_primary_key"], 3, "a" * 64, "b" * 64)],
        "source_primary_key array<string>, source_row_count bigint, "
        "source_schema_fingerprint string, source_dataset_fingerprint string",
    )
    text = json.dumps(fact, sort_keys=True, separators=(",", ":"))
    got = ops.provenance_fingerprint(df).first()
    assert got.provenance_fingerprint == hashlib.sha256(text.encode()).hexdigest()
    bad = ops.provenance_fingerprint(df.withColumn("source_primary_key", F.array().cast("array<string>")))
    assert bad.first().provenance_error == "INVALID_PRIMARY_KEY"


def test_schema_fingerprint_sees_a_widened_column(spark):
    def metadata(length):
        row = ("d", 0, "name", "character varying", None, None, None, "YES", length, "s", "t", None, None, None)
        return spark.createDataFrame(
            [row],
            "dataset string, ordinal int, column_name string, data_type string, numeric_precision int, "
            "numeric_scale int, datetime_precision int, is_nullable string, character_maximum_length int, "
            "udt_schema string, udt_name string, domain_schema string, domain_name string, collation_name string",
        )

    got = ops.schema_fingerprint(metadata(20)).first().schema_fingerprint
    text = json.dumps(
        [["name", "character varying", None, None, None, "YES", 20, "s", "t", None, None, None]],
        separators=(",", ":"),
    )
    assert got == hashlib.sha256(text.encode()).hexdigest()
    assert got != ops.schema_fingerprint(metadata(200)).first().schema_fingerprint


def test_payload_cells_round_trip(spark):
    df = spark.sql(
        "SELECT 1.50BD AS m, date'2024-01-02' AS d, timestamp_ntz'2024-01-02 03:04:05' AS t, "
        "double('inf') AS f, 'a\"b' AS s, parse_json('{\"x\":[1]}') AS j, CAST(NULL AS BIGINT) AS n"
    )
    cells = ops.encode_payload_cells(df).first().asDict()
    payload = (
        '{"format_version":2,"column_order":[],"dtypes":{},"data":{'
        + ",".join(f'"{k}":[{v}]' for k, v in cells.items())
        + "}}"
    )
    back = ops.decode_payloads(
        spark.createDataFrame([(1, payload)], "payload_id int, payload string")
    ).collect()
    got = {r.column: (r.kind, r.text, r.intact) for r in back}
    assert got == {
        "m": ("decimal", "1.50", True), "d": ("date", "2024-01-02", True),
        "t": ("python_datetime", "2024-01-02T03:04:05", True), "f": ("positive_infinity", "inf", True),
        "s": ("string", 'a"b', True), "j": ("raw_json", '{"x":[1]}', True), "n": ("null", None, True),
    }


def test_uuid_columns_are_tagged_by_metadata(spark):
    schema = T.StructType([T.StructField("u", T.StringType(), metadata={"logical": "uuid"})])
    df = spark.createDataFrame([("00000000-0000-0000-0000-00000000000a",)], schema)
    plain = spark.createDataFrame([("00000000-0000-0000-0000-00000000000a",)], "u string")
    assert prints(df) != prints(plain)


def test_variants_differ_by_type_and_publish_as_they_are(spark, tmp_path):
    from goldseam.operators.cast import Cast, cast_decision, with_cast
    from goldseam.sources.publish import PublicationRefused, Publisher

    day = spark.sql("SELECT 1 AS id, cast(date'2024-01-01' AS variant) AS v, 'x' AS w")
    text = spark.sql("SELECT 1 AS id, cast('2024-01-01' AS variant) AS v, 'x' AS w")
    assert prints(day) != prints(text)
    same = "SELECT 1 AS id, cast({} AS variant) AS v"
    one = {x: prints(spark.sql(same.format(x))) for x in ("1", "1.0BD", "1D", "true", "'1'", "date'1970-01-02'")}
    assert len(set(one.values())) == len(one)
    publisher = Publisher(spark, str(tmp_path / "versions"))
    mixed = spark.sql("SELECT id, v FROM VALUES (1, cast(2 AS variant)), (2, cast('2' AS variant)) AS t(id, v)")
    mixed = mixed.select("id", mixed.v.alias("v", metadata={"logical": "object"}))
    print_ = ops.measure(mixed).first().data_fingerprint
    gold = [("id", "int64"), ("v", "object")]
    publisher.publish("typed_view", mixed, "a" * 16, 2, gold, "2024-01-01 00:00:00", None, print_)
    shown = spark.sql("SELECT schema_of_variant(v) AS s FROM typed_view ORDER BY id").collect()
    assert [r.s for r in shown] == ["BIGINT", "STRING"]
    texts = mixed.select("id", mixed.v.cast("string").alias("v"))
    with pytest.raises(PublicationRefused):
        publisher.publish("typed_view", texts, "b" * 16, 2, gold, "2024-01-02 00:00:00")
    nested = spark.sql(
        "SELECT 1 AS id, named_struct('a', 1, 'b', array('x')) AS s, map('k', 1.5D) AS m, "
        "array(map('k', named_struct('z', true))) AS n, map(1, 2) AS odd"
    )
    decisions = cast_decision(nested, [Cast(c, "object") for c in ("s", "m", "n")], ["id"]).collect()
    assert {d.status for d in decisions} == {"SAFE"}
    assert cast_decision(nested, [Cast("odd", "object")], ["id"]).first().status == "UNSAFE"
    assert with_cast(nested, Cast("s", "object")).selectExpr("s:a::int").first()[0] == 1
    json = [("id", "int64"), ("s", "json"), ("m", "json"), ("n", "json"), ("odd", "json")]
    publisher.publish("nested_view", nested, "c" * 16, 1, json, "2024-01-01 00:00:00")
    assert spark.table("nested_view").selectExpr("s:b[0]::string").first()[0] == "x"


def test_decimals_and_case_in_publication(spark, tmp_path):
    from goldseam.sources.publish import PublicationRefused, Publisher, StaleRollback, version_table

    publisher = Publisher(spark, str(tmp_path / "versions"))
    gold = [("a", "decimal")]

    def frame(kind):
        return spark.sql(f"SELECT cast(1 AS {kind}) AS a")

    publisher.publish("dec_view", frame("decimal(10,2)"), "1" * 16, 1, gold, "2024-01-01 00:00:00")
    with pytest.raises(PublicationRefused):
        publisher.publish("dec_view", frame("decimal(30,9)"), "2" * 16, 1, gold, "2024-01-02 00:00:00")
    for i in "34":
        publisher.publish("dec_view", frame("decimal(10,2)"), i * 16, 1, gold, f"2024-01-0{i} 00:00:00")
    with pytest.raises(StaleRollback):
        publisher.rollback("dec_view", "4" * 16, version_table("dec_view", "1" * 16), "2024-01-05 00:00:00")
    publisher.rollback("dec_view", "4" * 16, version_table("dec_view", "3" * 16), "2024-01-05 00:00:00")
    twice = spark.createDataFrame([(1, 2)], "Id long, x long").withColumnRenamed("x", "id2")
    with pytest.raises(PublicationRefused):
        spark.conf.set("spark.sql.caseSensitive", "true")
        try:
            two = twice.withColumnRenamed("id2", "id")
            publisher.publish("c_view", two, "5" * 16, 1, [("Id", "int64"), ("id", "int64")], "2024-01-01 00:00:00")
        finally:
            spark.conf.set("spark.sql.caseSensitive", "false")


def test_payload_decimals_have_no_limit(spark):
    big = "123456789012345678901234567890"
    payload = (
        '{"format_version":2,"column_order":["a"],"dtypes":{"a":"object"},"data":{"a":['
        + ",".join('{"__type__":"decimal","value":"%s"}' % v for v in (big, "1E+400", "-0.5", "x", "1.2.3"))
        + "]}}"
    )
    got = ops.decode_payloads(spark.createDataFrame([("p", payload)], "payload_id string, payload string"))
    assert [r.intact for r in got.orderBy("row").collect()] == [True, True, True, False, False]


def test_type_of_a_variant_is_asked_once_on_each_level():
    from goldseam.functions import encoding

    sql = encoding._variant_sql("v", encoding.LEVELS)
    assert sql.count("schema_of_variant(") == encoding.LEVELS + 1
    assert sql.count("'map<string,variant>'") == sql.count("'array<variant>'") == encoding.LEVELS


def test_texts_of_nested_cells(spark):
    from goldseam.functions.encoding import cell_text

    df = spark.sql(
        "SELECT array(1Y, null) AS a, array(true) AS b, array(1.50BD) AS c, map('b', 1L, 'a', null) AS d,"
        " array(timestamp'1970-01-01 00:00:01Z') AS e, array(date'2020-01-02') AS f,"
        " parse_json('{\"b\": [1, \"x\"], \"a\": 1.5}') AS g, parse_json('[[]]') AS h"
    )
    row = df.select(*[cell_text(f).alias(f.name) for f in df.schema.fields]).first()
    assert list(row) == [
        "j50:[2:10:00000000008:BIGINT=110:00000000019:VOID=null",
        "j31:[1:10:000000000012:BOOLEAN=true",
        "j30:[1:10:000000000011:DECIMAL=1.5",
        "j30:{2:1:a9:VOID=null1:b8:BIGINT=1",
        "j36:[1:10:000000000017:TIMESTAMP=1000000",
        'j36:[1:10:000000000017:DATE="2020-01-02"',
        'j78:{2:1:a11:DECIMAL=1.51:b52:[2:10:00000000008:BIGINT=110:000000000110:STRING="x"',
        "j21:[1:10:00000000003:[0:",
    ]
