import pytest
from pyspark.sql import functions as F

from skyloom.operators import catalog as C
from skyloom.operators import compare as K
from skyloom.operators import maps as M
from skyloom.plans.fixtures import view
from skyloom.sources import io, schema

SF = "/root/testdata/sf0.001"


def test_steps_round_trip_and_prune(spark, tmp_path):
    p = view(spark, SF, "particles")
    io.write_steps(p, f"{tmp_path}/p")
    back = io.scan_steps(spark, f"{tmp_path}/p", 1993, 1995, columns=["step", "x"])
    assert back.count() == p.where("step BETWEEN 1993 AND 1995").count()
    assert "PartitionFilters: [isnotnull(step" in back._jdf.queryExecution().toString()
    assert io.scan_steps(spark, f"{tmp_path}/p", steps=[1994]).count() == p.where("step = 1994").count()


def test_scan_names(spark, tmp_path):
    spark.createDataFrame([(1, 2.0)], "id long, old_mass double").write.parquet(f"{tmp_path}/t")
    assert io.scan(spark, f"{tmp_path}/t", ["mass"], aliases={"old_mass": "mass"}).columns == ["mass"]
    with pytest.raises(ValueError, match="no columns"):
        io.scan(spark, f"{tmp_path}/t", ["mass"])
    assert io.inspect(io.scan(spark, f"{tmp_path}/t")).count() == 2
    assert {f.name for f in schema.MAP_HYDRO.fields} >= {"idx", "tsz", "xray4"}


def test_lists_and_membership(spark, tmp_path):
    (tmp_path / "steps.txt").write_text("10 12\n11\n")
    assert [tuple(r) for r in io.step_list(spark, f"{tmp_path}/steps.txt").collect()] == [(0, 10), (1, 12), (2, 11)]
    view(spark, SF, "membership_a").write.parquet(f"{tmp_path}/m")
    m = io.membership(spark, {"all": f"{tmp_path}/m", "big": f"{tmp_path}/m"})
    assert m.groupBy("source").count().count() == 2


def test_map_sinks(spark, tmp_path):
    m = view(spark, SF, "map_sparse")
    io.write_map(m, f"{tmp_path}/map")
    assert spark.read.parquet(f"{tmp_path}/map").count() == m.count()
    io.write_dense(m, f"{tmp_path}/dense", 8, ("rho",))
    assert spark.read.parquet(f"{tmp_path}/dense/rho").count() == 768 * m.select("step").distinct().count()
    io.write_rescaled(m, f"{tmp_path}/scaled", "go", 8)
    field = spark.read.parquet(f"{tmp_path}/scaled").schema["rho"]
    assert field.dataType.simpleString() == "float" and field.metadata["comment"] == "mass density"


def test_pixel_sinks(spark, tmp_path):
    rows = spark.range(100).selectExpr("id", "id % 7 AS pix", "cast(id % 2 as int) AS step", "'a' AS zrange")
    io.write_by_pixel(rows, f"{tmp_path}/pix")
    assert spark.read.parquet(f"{tmp_path}/pix").where("pix = 3 AND step = 1").count() == rows.where("pix = 3 AND step = 1").count()
    io.write_slabs(rows, f"{tmp_path}/slab", 3)
    offsets = spark.read.parquet(f"{tmp_path}/slab/offsets")
    assert offsets.agg(F.sum("count_idx")).first()[0] == 100


def test_text_sinks(spark, tmp_path):
    cells = spark.createDataFrame([(0, 1, 5), (2, 0, 7)], "i int, j int, n long")
    io.write_histogram2d(cells, f"{tmp_path}/h", 3, value="n")
    assert sorted(tuple(r) for r in io.read_histogram2d(spark, f"{tmp_path}/h", 3).where("value > 0").collect()) == [(0, 1, 5.0), (2, 0, 7.0)]
    lines = [r.value for r in spark.read.text(f"{tmp_path}/h").collect()]
    assert lines == ["i,0,1,2", "0,0,5,0", "1,0,0,0", "2,7,0,0"]
    m = view(spark, SF, "map_sparse")
    io.write_logs(M.map_qa(m, ("rho", "vel"), 8), f"{tmp_path}/log", "least", ["rho", "vel"])
    assert len(spark.read.text(f"{tmp_path}/log").collect()) == 1 + m.select("step").distinct().count()
    io.write_sample(view(spark, SF, "particles"), f"{tmp_path}/s", 0.1, ("id", "replication", "x"))
    sizes = {r.step: r["count"] for r in view(spark, SF, "particles").groupBy("step").count().collect()}
    got = {r.step: r["count"] for r in spark.read.parquet(f"{tmp_path}/s").groupBy("step").count().collect()}
    assert got == {k: (n + 5) // 10 for k, n in sizes.items()}  # halves go up
    assert spark.read.parquet(f"{tmp_path}/s").select("id", "replication", "x").exceptAll(view(spark, SF, "particles").select("id", "replication", "x")).count() == 0


def test_rows_are_read_at_their_offsets(spark, tmp_path):
    rows = spark.range(2000).select((F.col("id") % 3).cast("int").alias("step"), (F.col("id") * 7919 % 40).alias("pix"), "id").repartition(5)
    io.write_slabs(rows, f"{tmp_path}/slab", 8)
    for wanted in ([3], [0, 39], list(range(40)), [41], [12, 13, 14]):
        pixels = spark.createDataFrame([(p,) for p in wanted * 2], "pix long")
        got = io.read_pixels(spark, f"{tmp_path}/slab", pixels)
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in rows.where(F.col("pix").isin(wanted)).collect())
    files = len(spark.read.parquet(f"{tmp_path}/slab/rows").inputFiles())
    one = io.pixel_ranges(spark, f"{tmp_path}/slab", spark.createDataFrame([(3,)], "pix long")).collect()
    assert len({r.file for r in one}) == 3 < files  # a file for each step
    io.write_dense(rows.groupBy("step", F.col("pix").alias("idx")).agg(F.sum("id").cast("double").alias("v")), f"{tmp_path}/dense", 2, ("v",))
    back = io.read_places(spark, f"{tmp_path}/dense/v", ["idx", "v"])
    assert back.count() == 3 * 48 and back.where("place <> idx").count() == 0


def test_slabs_of_many_rows_are_written_by_more_tasks(spark, tmp_path):
    # half of all rows are of one pixel and step
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 3).cast("int").alias("step"), F.when(F.col("id") % 2 == 0, 20).otherwise(F.col("id") * 7919 % 40).alias("pix"), "id")
    io.write_slabs(rows.repartition(5), f"{tmp_path}/slab", 2, task_rows=250)
    at = spark.read.parquet(f"{tmp_path}/slab/rows").groupBy("step", F.input_file_name().alias("file")).agg(F.count("*").alias("n"), F.min("pix").alias("lo"), F.max("pix").alias("hi")).collect()
    task = lambda r: r.file.rsplit("/", 1)[1].split("-")[1]
    sizes = {t: sum(r.n for r in at if task(r) == t) for t in {task(r) for r in at}}
    assert sum(sizes.values()) == 4000 and max(sizes.values()) <= 500
    for step in range(3):
        ordered = sorted((r for r in at if r.step == step), key=lambda r: r.file)
        assert all(a.hi <= b.lo for a, b in zip(ordered, ordered[1:]))
    for wanted in ([20], [3, 39], list(range(40))):
        got = io.read_pixels(spark, f"{tmp_path}/slab", spark.createDataFrame([(p,) for p in wanted], "pix long"))
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in rows.where(F.col("pix").isin(wanted)).collect())


def test_keyed_tables_need_no_exchange(spark, tmp_path):
    rows = spark.range(400).select((F.col("id") % 3).cast("int").alias("step"), (F.col("id") % 50).alias("id"), F.lit(0).alias("replication"), F.col("id").alias("x"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a, b = (io.write_keyed(df, f"keyed_{n}", f"{tmp_path}/{n}", ("id", "replication"), 4) for n, df in (("a", rows), ("b", rows.where("id < 40"))))
        pairs = K.aligned(a.dropDuplicates(["id", "replication"]), b.dropDuplicates(["id", "replication"]), ("id", "replication"), ("x",))
        left = C.drop_repeated_next_step(a, ("id", "replication"), ("x",))
        for df in (pairs, left):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
        assert pairs.count() == 50 and pairs.where("in_a AND in_b").count() == 40
        plain = C.drop_repeated_next_step(rows, ("id", "replication"), ("x",))
        assert sorted(map(tuple, left.collect())) == sorted(map(tuple, plain.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE IF EXISTS keyed_a")
        spark.sql("DROP TABLE IF EXISTS keyed_b")


def test_only_files_that_may_hold_ids_are_read(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") * 3).alias("tag"), F.lit(1).alias("x"))
    io.write_ranged(rows.repartition(4), f"{tmp_path}/r", "tag", 50)
    assert len(spark.read.parquet(f"{tmp_path}/r/rows").inputFiles()) == 50
    for wanted in ([3], [0, 14997], [4, 5], [-7, 10**9], [], list(range(0, 15000, 30))):
        ids = spark.createDataFrame([(w,) for w in wanted * 2], "tag long")
        files = io.files_of_ids(spark, f"{tmp_path}/r", ids, "tag").count()
        assert files <= len(wanted) and (wanted != [-7, 10**9] or files == 0)
        assert sorted(r.tag for r in io.read_ids(spark, f"{tmp_path}/r", ids, "tag").collect()) == sorted(w for w in wanted if w % 3 == 0 and 0 <= w < 15000)
