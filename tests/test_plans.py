from tessella.plans import durable, sized, skew


def test_blocks_cover_every_row_once(spark):
    df = spark.range(25).withColumnRenamed("id", "q")
    parts = sized.blocks(df, "q", most=10)
    assert len(parts) == 3 and sorted(r.q for p in parts for r in p.collect()) == list(range(25))
    assert len(sized.blocks(df, "q")) == 1


def test_broadcast_only_within_the_bound(spark):
    df = spark.range(25).withColumnRenamed("id", "q")
    plan = lambda d: df.join(d, "q")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(sized.small_or_not(df, 25)) and "broadcast" not in plan(sized.small_or_not(df, 24))


def test_hot_and_cold_keys_join_alike(spark):
    big = spark.createDataFrame([(i, "h" if i % 2 else f"k{i % 7}") for i in range(200)] + [(999, None)], "i int, k string")
    index = spark.createDataFrame([("h", 1), ("k0", 2), ("k9", 3)], "k string, v int")
    hot = skew.hot_keys(big, ["k"], floor=60)
    assert [r.k for r in hot.collect()] == ["h"]
    for how in ("left", "inner"):
        a = skew.lookup_join(big, index, ["k"], how, hot).select("i", "k", "v").collect()
        b = skew.lookup_join(big, index, ["k"], how).select("i", "k", "v").collect()
        assert sorted(map(str, a)) == sorted(map(str, b))
    assert skew.hot_keys(big, ["k"]) is None


def test_checkpoint_folder_is_set_once(spark):
    first = durable.ensure_checkpoint_dir(spark)
    assert durable.ensure_checkpoint_dir(spark) == first
    assert durable.cut(spark.range(3)).count() == 3
    assert durable.spread(spark.range(4, numPartitions=1)).rdd.getNumPartitions() > 1
