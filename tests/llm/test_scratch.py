"""Intermediate tables and the one session setting the operators make."""

from trackml.llm import scratch


def test_batches_are_bounded_unless_the_session_says(spark):
    key = scratch._BATCH
    before = spark.conf.getAll.get(key)
    try:
        spark.conf.unset(key)
        scratch.bound_batches(spark)
        assert spark.conf.get(key) == str(scratch.BATCH_ROWS)
        for chosen in ("10000", "77"):
            spark.conf.set(key, chosen)
            scratch.bound_batches(spark)
            assert spark.conf.get(key) == chosen
    finally:
        spark.conf.unset(key)
        if before is not None:
            spark.conf.set(key, before)


def test_tables_are_read_back_and_freed(spark):
    own = scratch.Scratch(spark, "t")
    table = own.put("x", spark.range(5))
    assert sorted(r.id for r in table.collect()) == [0, 1, 2, 3, 4]
    path = own._tables["x"][0]
    own.drop("x")
    assert spark.read.schema("id long").parquet(path).count() == 0
