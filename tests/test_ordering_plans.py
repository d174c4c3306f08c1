"""Skew-safe ordering equals a plain window; plans have the intended shape."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tests.conftest import SF_SMALL
from tuneframe.operators.ordering import number_rows, running_sum
from tuneframe.plans import fixtures as FX
from tuneframe.operators import artifacts as A
from tuneframe.sources.files import file_listing


def _skewed(spark):
    # one key holds a third of the rows, ties broken by id, some null keys
    base = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 97 == 1, F.lit(None))
        .otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("g"),
        (F.col("id") * 7919 % 1000).alias("o"), F.col("id"), (F.col("id") % 13).alias("v"))
    return base


def test_number_rows_equals_window(spark):
    df = _skewed(spark)
    w = Window.partitionBy("g").orderBy("o", "id")
    want = {(r.id, r.rn) for r in df.select("id", F.row_number().over(w).alias("rn")).collect()}
    got = {(r.id, r.rn) for r in number_rows(df, ["g"], ["o", "id"], "rn", n_ranges=16).collect()}
    assert got == want


def test_number_rows_string_and_timestamp_keys(spark):
    df = _skewed(spark).withColumn("s", F.concat(F.lit("p/"), F.col("o").cast("string"))) \
        .withColumn("t", F.timestamp_seconds(F.col("o") * 3600))
    for order in (["s", "id"], ["t", "id"]):
        w = Window.partitionBy("g").orderBy(*order)
        want = {(r.id, r.rn) for r in df.select("id", F.row_number().over(w).alias("rn")).collect()}
        got = {(r.id, r.rn) for r in number_rows(df, ["g"], order, "rn", n_ranges=8).collect()}
        assert got == want


def test_running_sum_equals_window(spark):
    df = _skewed(spark)
    w = Window.partitionBy("g").orderBy("o", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = {(r.id, r.s) for r in df.select("id", F.sum("v").over(w).alias("s")).collect()}
    got = {(r.id, r.s) for r in running_sum(df, ["g"], ["o", "id"], "v", "s", n_ranges=16).collect()}
    assert got == want


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_group_is_split_before_the_window(spark):
    df = _skewed(spark)
    plan = _plan(number_rows(df, ["g"], ["o", "id"], "rn", n_ranges=16))
    # the window is partitioned by (group, range), never by the group alone,
    # and the offsets join reuses that partitioning (one exchange of the rows)
    import re
    assert re.search(r"Exchange hashpartitioning\(_tf_gkey#\d+, _tf_obkt#\d+", plan)
    assert not re.search(r"Exchange hashpartitioning\(g#\d+, ", plan)


def test_missing_shards_limits_before_shuffle(spark):
    plan = _plan(A.missing_shards(FX.shard_index(spark, SF_SMALL), FX.shard_files(spark, SF_SMALL)))
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_listing_is_made_in_tasks(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x" * 10)
    plan = file_listing(spark, str(tmp_path), recursive=True)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "FileScan" not in plan


def test_parquet_scans_are_pruned(spark):
    df = FX.artifacts(spark, SF_SMALL).select("upload_id", "pos")
    plan = _plan(df)
    assert "text" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_no_cross_joins_in_any_query(spark):
    from tuneframe.plans import catalog
    catalog.load_all()
    for name, fn in catalog.QUERIES.items():
        plan = _plan(fn(spark, SF_SMALL))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_hot_group_with_tied_first_key_is_split_by_second(spark):
    # one group, one timestamp for every row: only the id can split it
    df = spark.range(0, 4000).select(F.lit("hot").alias("g"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("t"),
                                     F.col("id"))
    numbered = number_rows(df, ["g"], ["t", "id"], "rn", n_ranges=16)
    assert {(r.id, r.rn) for r in numbered.collect()} == {(i, i + 1) for i in range(4000)}
    from tuneframe.operators import ordering as O
    ranged = O._with_ranges(df, ["g"], ["t", "id"], 16)
    assert ranged.select("_tf_obkt").distinct().count() >= 8


def test_each_line_is_parsed_once_per_wrapper(spark):
    import __spark_entry__ as E
    plan = _plan(E.queries()["record_check"](spark, SF_SMALL))
    assert plan.count("from_json(ArrayType(MapType(StringType,StringType,true)") == 1
    assert plan.count("from_json(MapType(StringType,MapType(StringType,StringType,true)") == 1
    # the variant pair exists once, inside the branch for non-objects
    assert plan.count("from_json(ArrayType(VariantType,true)") == 1


def test_hot_group_of_strings_with_a_shared_prefix_is_split(spark):
    df = spark.range(0, 3000).select(
        F.lit("hot").alias("g"), F.concat(F.lit("adapter/"), F.format_string("%05d", (F.col("id") * 7) % 3000)).alias("p"),
        F.col("id"))
    w = Window.partitionBy("g").orderBy("p", "id")
    want = {(r.id, r.rn) for r in df.select("id", F.row_number().over(w).alias("rn")).collect()}
    got = {(r.id, r.rn) for r in number_rows(df, ["g"], ["p", "id"], "rn", n_ranges=16).collect()}
    assert got == want
    from tuneframe.operators import ordering as O
    ranged = O._with_ranges(df, ["g"], ["p", "id"], 16)
    assert ranged.select("_tf_obkt").distinct().count() >= 8


def test_hot_group_work_is_spread(spark):
    from tuneframe.operators import ordering as O
    n = 60000
    df = spark.range(0, n).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 1000).alias("g"),
        ((F.col("id") * 2654435761) % 1000003).alias("o"), F.col("id"))
    ranged = O._with_ranges(df, ["g"], ["o", "id"], 64)
    biggest = ranged.groupBy("_tf_gkey", "_tf_obkt").count().agg(F.max("count")).first()[0]
    # a plain per-group window would give one task n/3 rows; here the largest
    # unit of work is about (n/3)/64
    assert biggest < n / 3 / 16


def test_neighbor_values_equal_lag_and_lead(spark):
    from tuneframe.operators.ordering import neighbor_values
    df = _skewed(spark).withColumn("s", F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.col("id").cast("string")))
    w = Window.partitionBy("g").orderBy("o", "id")
    for step, fn, p in ((-1, F.lag, "prev_"), (1, F.lead, "next_")):
        want = {(r.id, r.a, r.b) for r in df.select("id", fn("s").over(w).alias("a"), fn("v").over(w).alias("b")).collect()}
        got_df = neighbor_values(df, ["g"], ["o", "id"], ["s", "v"], step, n_ranges=16)
        got = {(r.id, r[f"{p}s"], r[f"{p}v"]) for r in got_df.collect()}
        assert got == want
        exists = {(r.id, r[f"{p}exists"]) for r in got_df.collect()}
        want_exists = {(r.id, r.e) for r in df.select("id", fn(F.lit(1)).over(w).isNotNull().alias("e")).collect()}
        assert exists == want_exists


def test_results_do_not_depend_on_partitioning_or_aqe(spark):
    from tuneframe.operators.ordering import neighbor_values
    df = _skewed(spark)
    base_n = {(r.id, r.rn) for r in number_rows(df, ["g"], ["o", "id"], "rn").collect()}
    base_l = {(r.id, r.prev_v) for r in neighbor_values(df, ["g"], ["o", "id"], ["v"]).collect()}
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert {(r.id, r.rn) for r in number_rows(df, ["g"], ["o", "id"], "rn").collect()} == base_n
        assert {(r.id, r.prev_v) for r in neighbor_values(df, ["g"], ["o", "id"], ["v"]).collect()} == base_l
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_one_plan_whatever_the_size_or_skew(spark):
    from tuneframe.operators.ordering import neighbor_values
    for n in (0, 10, 5000):
        df = spark.range(0, n).select((F.col("id") % 500).alias("g"), ((F.col("id") * 31) % 977).alias("o"), "id")
        w = Window.partitionBy("g").orderBy("o", "id")
        got = number_rows(df, ["g"], ["o", "id"], "rn", n_ranges=16)
        assert {(r.id, r.rn) for r in got.collect()} == \
            {(r.id, r.rn) for r in df.select("id", F.row_number().over(w).alias("rn")).collect()}
        assert "hashpartitioning(_tf_gkey" in _plan(got)
        lagged = neighbor_values(df, ["g"], ["o", "id"], ["id"], -1, n_ranges=16)
        assert {(r.id, r.prev_id) for r in lagged.collect()} == \
            {(r.id, r.p) for r in df.select("id", F.lag("id").over(w).alias("p")).collect()}


def test_five_thousand_two_column_hot_keys(spark):
    from tuneframe.operators import ordering as O
    df = spark.range(0, 20000).select((F.col("id") % 5000).alias("a"), F.when(F.col("id") % 5000 > 9, F.lit("x")).alias("b"))
    keyed = df.withColumn("_tf_gkey", F.struct("a", "b"))
    hot = keyed.select("_tf_gkey").distinct()
    assert hot.count() == 5000
    assert O._marked(keyed, hot).where(O._HEAVY).count() == 20000


def test_one_planning_job(spark):
    """The split is planned by one job; its answer holds hot groups only."""
    from tuneframe.operators import ordering as O
    df = _skewed(spark).withColumn("_tf_gkey", F.struct("g")).withColumn("k0", F.col("o").cast("double")) \
        .withColumn("k1", F.when(F.col("id") % 5 > 0, F.col("id").cast("double")))
    sc = spark.sparkContext
    sc.setJobGroup("ordering-plan", "one plan")
    try:
        hot, cuts = O._plan_split(df, ["k0", "k1"], 16)
        jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("ordering-plan")]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert [r["_tf_gkey"]["g"] for r in hot.collect()] == ["hot"]
    assert all(5 <= len(c) <= 16 and c == sorted(set(c)) for c in cuts)
    # Adaptive execution may give every stage of the one query a job of its own.
    assert len({s for j in jobs for s in j.stageIds}) <= 4


def test_many_hot_groups_and_small_sketches(spark, monkeypatch):
    from tuneframe.operators import ordering as O
    monkeypatch.setattr(O, "SKETCH", 8)
    df = spark.range(0, 4000).select((F.sqrt(F.col("id")) / 8).cast("int").alias("g"), (F.col("id") * 7919 % 997).alias("o"), "id")
    w = Window.partitionBy("g").orderBy("o", "id")
    want = {(r.id, r.rn) for r in df.select("id", F.row_number().over(w).alias("rn")).collect()}
    for n in (2, 16, 100):
        assert {(r.id, r.rn) for r in number_rows(df, ["g"], ["o", "id"], "rn", n_ranges=n).collect()} == want


def test_dataset_validation_reads_the_text_twice_at_most(spark, tmp_path):
    import re
    from tuneframe.operators import validation as V
    (tmp_path / ("a" * 32 + "_d.jsonl")).write_text('{"k": 1}\n' * 100)
    (tmp_path / ("b" * 32 + "_e.jsonl")).write_text("")
    df = V.validate_files(spark, str(tmp_path), ("k",), 100)
    assert sorted((r.filename, r.record_count) for r in df.collect()) == [("d.jsonl", 100), ("e.jsonl", 0)]
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # the lines once, the split offsets once (metadata columns only)
    assert len(re.findall(r"FileScan text", plan)) == 2
    assert len(re.findall(r"FileScan text \[value", plan)) == 1


def test_job_state_plans_hash_aggregates(spark):
    from tuneframe.plans import catalog
    catalog.load_all()
    plan = _plan(catalog.QUERIES["job_state"](spark, SF_SMALL))
    assert "HashAggregate" in plan and "SortAggregate" not in plan
