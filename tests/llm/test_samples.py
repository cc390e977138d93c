from siltstone.session import drawn


def test_every_partition_keeps_its_share(spark):
    got = [r["id"] for r in drawn(spark.range(0, 20000, 1, 8), 4000, 20000, 5).collect()]
    assert len(got) == len(set(got)) == 4000
    assert all(380 <= sum(i // 2500 == part for i in got) <= 620 for part in range(8))
    assert drawn(spark.range(30), 4000, 30, 5).count() == 30 and drawn(spark.range(0), 10, 0, 5).count() == 0


def test_the_sample_is_the_same_in_every_partitioning(spark):
    rows = spark.range(5000).selectExpr("id", "cast(id % 7 as string) s")
    pick = lambda df: sorted(r["id"] for r in drawn(df, 500, 5000, 3).collect())
    assert pick(rows) == pick(rows.repartition(3)) == pick(rows.orderBy("s", "id"))
    same = spark.range(5000).selectExpr("0 as id")
    assert drawn(same, 500, 5000, 3).count() <= 1
