"""The summed fingerprint of wide lanes, against hashlib, and where approval and publication use it."""

import hashlib
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from goldseam.functions.encoding import row_text, schema_header
from goldseam.operators import fingerprint as ops
from goldseam.plans import evidence
from goldseam.plans.migration import Table, approve, execute_live, open_ticket
from goldseam.session import shared_folder
from goldseam.sources.publish import PublicationRefused, Publisher

AS_OF = "2024-05-01 00:00:00"


def by_hand(df):
    """The definition, row by row."""
    sums = [0] * ops.SET_LANES
    texts = [r[0] for r in df.select(row_text(df)).collect()]
    for text in texts:
        long = hashlib.shake_128(hashlib.sha256(text.encode()).digest()).digest(2 * ops.SET_LANES)
        for i in range(ops.SET_LANES):
            sums[i] += int.from_bytes(long[2 * i : 2 * i + 2], "little")
    lanes = ",".join(map(str, sums)) if texts else ""
    header = f"{schema_header(df)}|{ops.SET_LANES}x16|{len(texts)}|{lanes}"
    return len(texts), hashlib.sha256(header.encode()).hexdigest()


def sample(spark, n=300):
    return spark.range(n).select(
        "id", F.concat(F.lit("n"), F.col("id") % 5).alias("name"), F.when(F.col("id") % 7 > 0, F.col("id") / 4).alias("x")
    )


def measured(df):
    row = ops.measure_set(df).first()
    return row.row_count, row.set_fingerprint


def test_equal_to_its_definition(spark):
    df = sample(spark)
    assert measured(df) == by_hand(df)
    assert measured(df.unionByName(df).repartition(5)) == by_hand(df.unionByName(df))
    assert measured(df.limit(0)) == by_hand(df.limit(0))
    assert ops.set_fingerprint(df, "d").first().data_fingerprint == measured(df)[1]


def test_the_sum_beside_it_is_that_of_measure(spark):
    for df in (sample(spark), sample(spark, 0), sample(spark, 1)):
        row = ops.measure_set(df).first()
        assert (row.row_count, row.data_fingerprint) == tuple(ops.measure(df).first())


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="test tables not here")
def test_query_equals_its_definition(spark):
    found = entry_module.queries()["set_fingerprint"](spark, "/root/testdata/sf0.001").collect()
    for row in found:
        df = spark.read.parquet(f"/root/testdata/sf0.001/{row.dataset}.parquet")
        assert (row.row_count, row.data_fingerprint) == by_hand(df)
    assert len(found) == 3


def test_batches_and_order_make_no_difference(spark):
    df = sample(spark)
    base = measured(df)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert measured(df.repartition(4)) == base
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert measured(df.orderBy(F.desc("id")).coalesce(1)) == base


def test_copies_count_beyond_the_width_of_a_lane(spark):
    """65,536 copies are zero in every lane modulo 2^16; whole sums still tell the rows apart."""
    copies = spark.range(65536)
    one, other = copies.select(F.lit("a").alias("v")), copies.select(F.lit("b").alias("v"))
    assert measured(one) != measured(other)


def test_every_change_shows(spark):
    df = sample(spark)
    changed = [
        df.where("id <> 3"),
        df.unionByName(df.where("id = 3")),
        df.withColumn("name", F.when(F.col("id") == 3, "n4").otherwise(F.col("name"))),
        df.withColumn("x", F.coalesce("x", F.lit(0.0))),
        df.withColumnRenamed("name", "Name"),
        df.select("name", "id", "x"),
        df.withColumn("id", F.col("id").cast("string")),
        df.limit(0),
    ]
    assert len({measured(d) for d in [df, *changed]}) == len(changed) + 1


def test_evidence_with_sets_is_the_same_evidence(spark):
    texts = spark.createDataFrame([(str(i), str(i * 3)) for i in range(50)], "id string, amount string")
    for df in (texts, texts.limit(0), texts.unionByName(spark.createDataFrame([("x", "abc")], texts.schema))):
        for action in ("CAST_COLUMN amount TO int64", "RENAME_COLUMN amount -> total", "DROP_COLUMN amount"):
            plain = evidence.gather(df, action, ["id"])
            wide = evidence.gather(df, action, ["id"], sets=True)
            assert replace(wide, source_set=None, output_set=None, corrected=None) == replace(plain, corrected=None)
            assert wide.source_set == measured(df)[1]
            if wide.corrected is not None:
                assert wide.output_set == measured(wide.corrected)[1]


def test_one_exchange_of_lanes_and_no_second_scan(spark, tmp_path):
    sample(spark).write.parquet(str(tmp_path / "t"))
    plan = ops.measure_set(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("hashpartitioning") == 1
    assert "SortAggregate" not in plan


def test_approval_and_publication_need_the_set(spark):
    df = spark.createDataFrame([(1, "10"), (2, "20")], "id bigint, amount string")
    gold, pairs = [("id", "int64"), ("amount", "int64")], [("object", "int64")]
    table = Table(df, ["id"], gold)
    ticket = open_ticket(table, "sales", "CAST_COLUMN amount TO int64", 0.85, "t1", "v1", pairs)
    approval = approve(ticket, df, "ann")
    assert approval.approved and approval.output_set_fingerprint
    assert approve(replace(ticket, set_fingerprint="0" * 64), df, "ann").outcome == "REPLAY_DIFFERS:DATASET_FINGERPRINT"
    publisher = Publisher(spark, shared_folder(spark, "set-prints"))

    def live(**changes):
        return execute_live(
            ticket, replace(approval, **changes), df, publisher, "set_sales", "5" * 32, AS_OF,
            confirmed=True, allowed_pairs=pairs,
        )

    assert live(output_set_fingerprint=None).outcome == "NO_APPROVED_FINGERPRINT"
    assert live(output_set_fingerprint="0" * 64).outcome == "OUTPUT_MISMATCH"
    assert live().published
    cast = df.withColumn("amount", F.col("amount").cast("bigint"))
    with pytest.raises(PublicationRefused):
        publisher.publish("set_other", cast, "6" * 32, 2, gold, AS_OF, expected_set="0" * 64)
    publisher.publish("set_third", cast, "7" * 32, 2, gold, AS_OF, expected_set=approval.output_set_fingerprint)
