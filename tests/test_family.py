import random

from pyspark.sql import functions as F

from goldseam.plans.migration import Table, read_family, schema_rows, simulate, simulate_family
from spark_rows import rows

PAIRS = [("object", "int64")]


def test_family_routes_as_single_tables_do(spark, tmp_path):
    rng = random.Random(11)
    wishes = [
        [("id", "int64"), ("column_name", "int64"), ("w", "object")],
        [("id", "int64"), ("column_name", "float64"), ("w", "object")],
        [("id", "int64"), ("column_name", "object"), ("w", "bool")],
        [("id", "int64"), ("w", "object"), ("column_name", "object")],
        [("id", "int64"), ("column_name", "object"), ("w", "decimal")],
        [("id", "int64"), ("column_name", "object"), ("w", "object")],
    ]
    single, folders, gold, backed = {}, [], {}, []
    for t in range(12):
        name = f"t {t}" if t == 7 else f"t{t}"
        data = [
            (i, rng.choice(["1", "2", "0.5" if t % 4 else "3"]), rng.choice(["true", "false", "yes" if t > 7 else "0", None]))
            for i in range(0 if t == 6 else 20)
        ]
        folder = str(tmp_path / name)
        spark.createDataFrame(data, "id int, column_name string, w string").coalesce(1).write.parquet(folder)
        folders.append(folder)
        gold[name] = wishes[t % 6]
        if t % 2:
            backed.append((name,))
        single[name] = Table(spark.read.parquet(folder), ["id"], gold[name], bool(t % 2))
    family = read_family(spark, folders)
    wanted = schema_rows(spark, gold)
    got = simulate_family(family, wanted, PAIRS, spark.createDataFrame(backed, "dataset string"))
    want = simulate(spark, single, PAIRS)
    order = ["dataset", "action", "status", "route"]
    assert rows(got, *order) == rows(want, *order)
    assert len({r[3] for r in rows(got, *order)}) >= 4


def test_plan_does_not_grow_with_the_number_of_tables(spark):
    def plan_size(tables):
        data = spark.range(tables * 2).select(
            F.concat(F.lit("t"), F.col("id") % tables).alias("dataset"), F.col("id").cast("string").alias("v")
        )
        gold = spark.range(tables).select(
            F.concat(F.lit("t"), "id").alias("dataset"), F.lit(0).alias("ordinal"), F.lit("v").alias("column"),
            F.when(F.col("id") % 2 == 0, "int64").otherwise("float64").alias("dtype"),
        )
        found = simulate_family(data, gold)
        assert found.where("status = 'SAFE'").count() == tables
        return len(found._jdf.queryExecution().optimizedPlan().toString().splitlines())

    assert plan_size(4) == plan_size(2000)


def test_empty_family(spark):
    data = spark.createDataFrame([], "dataset string, v string")
    gold = spark.createDataFrame([], "dataset string, ordinal int, column string, dtype string")
    assert simulate_family(data, gold).collect() == []
