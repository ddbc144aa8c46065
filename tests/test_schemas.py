import itertools

import pytest
from pyspark.sql import functions as F, types as T

from spark_rows import rows
from goldseam.functions.dtypes import UnsupportedTypeError, canonical_spark_type, logical_dtype
from goldseam.operators import delta, governance, profile
from goldseam.plans.migration import schema_rows


def schemas(spark, observed, gold):
    return schema_rows(spark, {"d": observed}), schema_rows(spark, {"d": gold})


def test_observe_counts_nan_as_null_and_zero_once(spark):
    df = spark.createDataFrame(
        [(1, "a", 0.0), (2, "a", -0.0), (3, None, float("nan")), (4, "x" * 100, None)],
        "id int, name string, v double",
    )
    got = rows(profile.observe_schema(df, "d"), "ordinal", "column", "dtype", "null_count", "unique_count")
    assert got == [(0, "id", "int64", 0, 4), (1, "name", "object", 1, 2), (2, "v", "float64", 2, 1)]


def test_observe_long_texts_that_share_a_prefix(spark):
    df = spark.createDataFrame([("x" * 80 + str(i % 3),) for i in range(9)], "t string")
    assert profile.observe_schema(df, "d").first().unique_count == 3


def test_observe_nested_and_timed_columns(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (array(1, 2), timestamp_ntz'2024-01-01', true, 1.5BD), "
        "(array(1, 2), timestamp_ntz'2024-01-02', false, 1.5BD), (NULL, NULL, NULL, NULL) AS t(a, t, b, m)"
    )
    got = rows(profile.observe_schema(df, "d"), "column", "dtype", "null_count", "unique_count")
    assert got == [("a", "json", 1, 1), ("b", "bool", 1, 2), ("m", "decimal", 1, 1), ("t", "datetime", 1, 2)]


def test_observe_empty_table(spark):
    got = rows(profile.observe_schema(spark.createDataFrame([], "a int, b string"), "d"),
               "column", "null_count", "unique_count")
    assert got == [("a", 0, 0), ("b", 0, 0)]


def test_one_hot_value_is_counted_exactly(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("v"))
    got = profile.observe_schema(df, "d").first()
    assert (got.null_count, got.unique_count) == (2000, 1000)


def test_trusted_types_refuse_the_unknown(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(UnsupportedTypeError):
        profile.observe_schema_trusted(df, "d", {"a": "money"})


def test_interval_columns_are_refused():
    with pytest.raises(UnsupportedTypeError):
        logical_dtype(T.StructField("i", T.DayTimeIntervalType()))
    assert canonical_spark_type(T.StructField("m", T.DecimalType(20, 9))) == T.DecimalType(20, 9)
    assert canonical_spark_type(T.StructField("s", T.ShortType())) == T.LongType()


def test_json_objects_equal_up_to_key_order_count_once(spark):
    df = spark.createDataFrame(
        [('{"a":1,"b":2}',), ('{"b":2,"a":1}',), ('{"a":1}',), ("not json",), (None,)], "v string"
    )
    assert profile.json_unique_count(df, "v").first()["unique_count"] == 3


def test_key_proof(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (None, 3)], "a int, b int")
    got = profile.key_proof(df, "d", ["a", "b"]).first()
    assert (got.row_count, got.null_key_rows, got.surplus_rows, got.proved) == (4, 1, 1, False)
    assert profile.key_proof(df.limit(0), "d", ["a"]).first().proved


def test_equal_constraint_names_do_not_mix(spark):
    constraints = spark.createDataFrame(
        [("shared", "s", "s", "table_a", "PRIMARY KEY"), ("shared", "s", "s", "table_b", "FOREIGN KEY")],
        "constraint_name string, constraint_schema string, table_schema string, table_name string, "
        "constraint_type string",
    )
    usage = spark.createDataFrame(
        [("shared", "s", "s", "table_a", "a_id", 1), ("shared", "s", "s", "table_b", "ref_id", 1)],
        "constraint_name string, constraint_schema string, table_schema string, table_name string, "
        "column_name string, ordinal_position int",
    )
    assert profile.discover_keys(constraints, usage).collect() == [("s", "table_a", ["a_id"])]


def test_added_and_reordered(spark):
    got = delta.schema_delta(*schemas(
        spark, [("value", "int64"), ("id", "int64"), ("extra", "object")], [("id", "int64"), ("value", "int64")]
    )).first()
    assert (got.missing_columns, got.new_columns, got.type_mismatches, got.reorder_event) == (
        [], ["extra"], [], True,
    )


def test_names_are_case_sensitive(spark):
    got = delta.schema_delta(*schemas(spark, [("Customer_ID", "int64")], [("customer_id", "int64")])).first()
    assert (got.missing_columns, got.new_columns) == (["customer_id"], ["Customer_ID"])


def test_delta_agrees_with_sets_and_lists(spark):
    names = ["a", "b", "c"]
    variants = [list(p) for n in range(1, 4) for p in itertools.permutations(names, n)]
    observed, gold = {}, {}
    for i, (o, g) in enumerate(itertools.product(variants, variants)):
        observed[str(i)] = [(n, "int64" if (i + len(n)) % 2 else "object") for n in o]
        gold[str(i)] = [(n, "int64") for n in g]
    found = delta.schema_delta(schema_rows(spark, observed), schema_rows(spark, gold)).collect()
    assert len(found) == len(observed)
    for r in found:
        o, g = observed[r.dataset], gold[r.dataset]
        on, gn = [n for n, _ in o], [n for n, _ in g]
        assert r.missing_columns == sorted(set(gn) - set(on))
        assert r.new_columns == sorted(set(on) - set(gn))
        assert r.reorder_event == (on != gn)
        assert [m["column"] for m in r.type_mismatches] == [
            n for n, d in g if n in on and dict(o)[n] != d
        ]


def eligibility(spark, **changes):
    base = {
        "dataset": "d", "reorder_event": True, "missing_columns": [], "new_columns": [],
        "type_mismatches": [], "observed_order": ["b", "a"], "gold_order": ["a", "b"],
        "observed_types": {"a": "int64", "b": "object"}, "gold_types": {"a": "int64", "b": "object"},
    }
    schema = (
        "dataset string, reorder_event boolean, missing_columns array<string>, new_columns array<string>, "
        "type_mismatches array<string>, observed_order array<string>, gold_order array<string>, "
        "observed_types map<string,string>, gold_types map<string,string>"
    )
    row = {**base, **changes}
    names = [part.split()[0] for part in schema.replace("map<string,string>", "m").split(", ")]
    return delta.reorder_eligibility(
        spark.createDataFrame([tuple(row[n] for n in names)], schema)
    ).first().outcome


@pytest.mark.parametrize(
    "changes,outcome",
    [
        ({}, "ELIGIBLE"),
        ({"reorder_event": None}, "INVALID_DELTA"),
        ({"type_mismatches": None}, "INVALID_DELTA"),
        ({"reorder_event": False, "missing_columns": ["x"]}, "NOT_REORDER_EVENT"),
        ({"missing_columns": ["x"], "new_columns": ["y"]}, "MISSING_COLUMNS"),
        ({"new_columns": ["y"], "type_mismatches": ["a"]}, "NEW_COLUMNS"),
        ({"type_mismatches": ["a"]}, "TYPE_MISMATCHES"),
        ({"observed_order": []}, "INVALID_OBSERVED_ORDER"),
        ({"observed_order": ["a", None]}, "INVALID_OBSERVED_ORDER"),
        ({"observed_order": ["a", "a"], "gold_order": None}, "DUPLICATE_OBSERVED_COLUMN"),
        ({"gold_order": None}, "INVALID_GOLD_ORDER"),
        ({"gold_order": ["b", "b"]}, "DUPLICATE_GOLD_COLUMN"),
        ({"observed_order": ["a", "b"]}, "ALREADY_ORDERED"),
        ({"observed_order": ["b"]}, "COLUMN_COUNT_MISMATCH"),
        ({"observed_order": ["b", "c"]}, "COLUMN_MEMBERSHIP_MISMATCH"),
        ({"observed_types": None, "gold_types": None}, "OBSERVED_SCHEMA_INCONSISTENT"),
        ({"observed_types": {"a": "int64"}, "gold_types": None}, "GOLD_SCHEMA_INCONSISTENT"),
        ({"observed_types": {"a": "int64"}}, "OBSERVED_SCHEMA_INCONSISTENT"),
        ({"gold_types": {"a": "int64", "c": "object"}}, "GOLD_SCHEMA_INCONSISTENT"),
        ({"gold_types": {"a": "int64", "b": "int64"}}, "DTYPE_MISMATCH"),
    ],
)
def test_reorder_outcomes_in_their_order(spark, changes, outcome):
    assert eligibility(spark, **changes) == outcome


def proposals(spark, observed, gold):
    found = governance.propose_repairs(*schemas(spark, observed, gold)).orderBy("proposal_ordinal")
    return [(r.action, r.confidence) for r in found.collect()]


def test_rename_needs_one_for_one_and_equal_types(spark):
    assert proposals(spark, [("new_name", "int64")], [("old_name", "int64")]) == [
        ("RENAME_COLUMN new_name -> old_name", 0.85)
    ]
    assert proposals(spark, [("new_name", "object")], [("old_name", "int64")]) == []
    assert proposals(spark, [("x", "int64"), ("y", "int64")], [("old_name", "int64")]) == []


def test_reorder_is_proposed_alone(spark):
    assert proposals(spark, [("b", "object"), ("a", "int64")], [("a", "int64"), ("b", "object")]) == [
        ('REORDER_COLUMNS TO ["a","b"]', 0.9)
    ]


def test_casts_come_in_gold_order_strict_first(spark):
    got = proposals(spark, [("b", "object"), ("a", "object")], [("a", "int64"), ("b", "bool")])
    assert got == [
        ("CAST_COLUMN a TO int64", 0.85), ("CAST_COLUMN a TO int64 WITH_DROP_INVALID", 0.7),
        ("CAST_COLUMN b TO bool", 0.85), ("CAST_COLUMN b TO bool WITH_DROP_INVALID", 0.7),
    ]


def test_nothing_to_do(spark):
    assert proposals(spark, [("a", "int64")], [("a", "int64")]) == []


def test_selection_keeps_rows_first_then_confidence_then_proposal_order(spark):
    plans = spark.createDataFrame(
        [
            ("x", 0, "CAST_COLUMN a TO int64 WITH_DROP_INVALID", 0.95), ("x", 1, "CAST_COLUMN a TO int64", 0.85),
            ("x", 2, "CAST_COLUMN b TO int64", 0.85), ("y", 0, "CAST_COLUMN a TO int64", 0.7),
            ("z", 0, "CAST_COLUMN a TO int64 WITH_DROP_INVALID", 0.95),
        ],
        "dataset string, proposal_ordinal int, action string, confidence double",
    )
    assert rows(governance.select_plan(plans), "dataset", "proposal_ordinal") == [("x", 1), ("z", 0)]


def test_thresholds_are_inclusive(spark):
    df = spark.createDataFrame([(0.92,), (0.9199,), (0.8,), (0.7999,)], "c double")
    got = [r[0] for r in df.select(governance.governance_decision(F.col("c"))).collect()]
    assert got == ["AUTO_APPROVE", "REQUIRES_HUMAN_APPROVAL", "REQUIRES_HUMAN_APPROVAL", "QUARANTINE"]


def test_signature_must_be_equal_and_appending_is_not(spark):
    def signature(names):
        return schema_rows(spark, {"t": [(n, "bigint") for n in names]}).withColumnRenamed("dtype", "database_type")

    published = signature(["a", "b"])
    def compatible(names):
        return delta.signature_compat(published, signature(names)).first().compatible

    assert compatible(["a", "b"])
    assert not compatible(["a", "b", "c"]) and not compatible(["b", "a"]) and not compatible(["a"])
    assert delta.signature_compat(published.limit(0), signature(["a"])).first().compatible


@pytest.mark.parametrize(
    "text", ["object->int64,", "object-int64", "object -> int64", "object->decimal", "object->int64,object->int64", "a->b->c"]
)
def test_malformed_allowlists_are_refused(text):
    with pytest.raises(governance.AllowlistError):
        governance.parse_allowlist(text)


def test_allowlist_text():
    assert governance.parse_allowlist(None) == governance.parse_allowlist("  ") == []
    assert governance.parse_allowlist("Object->INT64, int64->float64") == [
        ("object", "int64"), ("int64", "float64"),
    ]


@pytest.mark.parametrize(
    "action,error,canonical",
    [
        ('REORDER_COLUMNS TO ["a","b"]', None, True),
        ('REORDER_COLUMNS TO [ "a" , "b" ]', None, False),
        ('REORDER_COLUMNS TO ["a\\u0062"]', None, False),
        ('REORDER_COLUMNS TO ["ü \\" ]"]', None, True),
        ('REORDER_COLUMNS TO ["a"] ["b"]', "INVALID_REORDER", False),
        ('REORDER_COLUMNS TO ["a",null]', "INVALID_REORDER", False),
        ('REORDER_COLUMNS TO {"a":1}', "INVALID_REORDER", False),
        ('REORDER_COLUMNS TO ["a",]', "INVALID_REORDER", False),
        ("REORDER_COLUMNS TO ['a']", "INVALID_REORDER", False),
        ('REORDER_COLUMNS  TO ["a"]', "INVALID_REORDER", False),
    ],
)
def test_reorder_actions(spark, action, error, canonical):
    got = governance.parse_actions(spark.createDataFrame([(action,)], "action string")).first()
    assert got.error == error
    assert (got.canonical_text == action) == canonical
