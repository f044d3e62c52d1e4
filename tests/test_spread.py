import math

from pyspark.sql import functions as F

from sievelight.operators.ranks import with_places
from sievelight.plans.session import stored
from sievelight.sources.tables import spread


def test_parts_do_not_grow_with_the_table(spark, tmp_path):
    for n in (1_000, 40_000):
        path = str(tmp_path / str(n))
        spark.range(n).select("id", F.sha2(F.col("id").cast("string"), 256).alias("t")).coalesce(1).write.parquet(path)
        df = spark.read.parquet(path)
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        parts = spread(df, "id", part_bytes=100_000)
        cores = spark.sparkContext.defaultParallelism
        assert parts.rdd.getNumPartitions() == max(cores, math.ceil(size / 100_000))
        assert parts.count() == n
        assert spread(df, "id").rdd.getNumPartitions() == cores


def test_stored_rows_are_made_once_for_several_orders(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def costly(i):
        made.add(1)
        return i

    rows = stored(spark.range(300).select(costly("id").alias("i")), "test")
    up, down = with_places(rows.orderBy("i")), with_places(rows.orderBy(F.desc("i")))
    assert up.join(down, "i").where(up["rank"] + down["rank"] == 301).count() == 300
    assert made.value == 300
