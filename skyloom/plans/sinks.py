"""Queries that write to the shared folder and read back: the sinks and scans, with the SQL of what must come back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import geometry as G
from ..functions import physics as P
from ..operators import catalog as C
from ..operators import compare as K
from ..operators import maps as M
from ..sources import io
from ..sources.folders import shared_dir
from .fixtures import view
from .queries import DENSE, DRAW, KEYS, LC, MAP, OCT, QUERIES, SPEC, SQL, TIE, hist_sql, md5_draw, query, single
from .sql import AREA, NSIDE, centres, ring, rings


@query("SELECT step, id, replication, x, vx FROM $particles WHERE step BETWEEN 1996 AND 1998")
def s1_scan_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Particles by step, written and a range of steps read back."""
    path = shared_dir(spark)
    io.write_steps(view(spark, sf_dir, "particles"), path)
    return io.scan_steps(spark, path, 1996, 1998, columns=["step", "id", "replication", "x", "vx"])


@query("SELECT k, fof_halo_tag, fof_halo_mass AS mass FROM $halos_a")
def s2_scan_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns under their old names."""
    path = shared_dir(spark)
    view(spark, sf_dir, "halos_a").write.parquet(path)
    return io.scan(spark, path, ["k", "fof_halo_tag", "mass"], aliases={"fof_halo_mass": "mass"})


@query("SELECT id, replication, x, y, z, vx, vy, vz, a, phi FROM $lightcone_a ")
def s3_scan_lightcone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: a lightcone table by its schema."""
    path, lc = shared_dir(spark), view(spark, sf_dir, "lightcone_a")
    lc.write.parquet(path)
    return io.scan(spark, path, [*KEYS, *LC], schema=lc.schema)


@query("SELECT *, 'all' AS source FROM $membership_a UNION ALL SELECT *, 'big' FROM $membership_b")
def s5_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership tables with their source."""
    paths = {"all": shared_dir(spark), "big": shared_dir(spark)}
    for s, name in (("all", "membership_a"), ("big", "membership_b")):
        view(spark, sf_dir, name).write.parquet(paths[s])
    return io.membership(spark, paths)


@query("SELECT step, idx, rho FROM $map_sparse WHERE step IN (SELECT step FROM $map_sparse GROUP BY step HAVING sum(rho) > (SELECT sum(rho) FROM $map_sparse)/8)")
def s9_step_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of a text file."""
    table, listed, m = shared_dir(spark), shared_dir(spark), view(spark, sf_dir, "map_sparse")
    io.write_steps(m, table)
    heavy = m.groupBy("step").agg(F.sum("rho").alias("n")).join(F.broadcast(m.agg((F.sum("rho") / 8).alias("least"))), F.col("n") > F.col("least"))
    heavy.select(F.col("step").cast("string")).coalesce(1).write.text(listed)
    return io.scan_steps(spark, table).join(io.step_list(spark, listed).select("step"), "step", "left_semi").select("step", "idx", "rho")


@query("SELECT name, type, (SELECT count(*) FROM $membership_b) AS n FROM (VALUES ('fof_halo_tag', 'bigint'), ('id', 'bigint')) t(name, type)")
def s11_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns, types and rows of a table."""
    return io.inspect(view(spark, sf_dir, "membership_b"))


@query("SELECT step, idx, SIG(rho) AS rho, SIG(vel) AS vel, SIG(phi) AS phi FROM $map_sparse")
def s12_map_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps by step in pixel order."""
    path = shared_dir(spark)
    io.write_map(view(spark, sf_dir, "map_sparse"), path)
    return single(io.scan_steps(spark, path, columns=["step", "idx", *MAP]), *MAP)


@query("SELECT step, idx, SIG(rho) AS rho, SIG(vel) AS vel FROM dense", DENSE)
def s13_dense_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each map, every pixel in order."""
    path = shared_dir(spark)
    io.write_dense(view(spark, sf_dir, "map_sparse"), path, NSIDE, ("rho", "vel"))
    rho, vel = (io.scan_steps(spark, f"{path}/{v}", columns=["step", "idx", v]) for v in ("rho", "vel"))
    return single(rho.join(vel, ["step", "idx"]), "rho", "vel")


@query(
    """SELECT CASE WHEN a < 0.75e0 THEN 'far' ELSE 'near' END AS zrange, ring AS pix, step, count(*) AS n, sum(id)::BIGINT AS ids FROM rn GROUP BY ALL""",
    ring("$particles", "rn", 1),
)
def s16_by_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders by range of distance, pixel and step."""
    path = shared_dir(spark)
    rows = G.with_ring_pixel(view(spark, sf_dir, "particles"), "x", "y", "z", 1).withColumn("zrange", F.when(F.col("a") < 0.75, "far").otherwise("near"))
    io.write_by_pixel(rows, path)
    return io.scan(spark, path).groupBy("zrange", F.col("pix").cast("long").alias("pix"), "step").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(
    """SELECT step, pixel_id, coalesce(sum(n) OVER (PARTITION BY step ORDER BY pixel_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_idx, n AS count_idx, ids
FROM (SELECT step, ring AS pixel_id, count(*) AS n, sum(id)::BIGINT AS ids FROM rn GROUP BY ALL)""",
    ring("$particles", "rn", NSIDE),
)
def s17_slabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of pixels, and where each pixel's rows start."""
    path = shared_dir(spark)
    io.write_slabs(G.with_ring_pixel(view(spark, sf_dir, "particles"), "x", "y", "z", NSIDE), path, 6)
    rows = io.scan_steps(spark, f"{path}/rows").groupBy(F.col("step").alias("s"), "pix").agg(F.sum("id").alias("ids"))
    offsets = io.scan_steps(spark, f"{path}/offsets")
    return offsets.join(rows, (F.col("step") == F.col("s")) & (F.col("pixel_id") == F.col("pix"))).select("step", "pixel_id", "start_idx", "count_idx", "ids")


@query(
    "SELECT p.step, p.id, p.replication, p.ring AS pix, SIG(p.x) AS x FROM rn p JOIN oct o ON p.ring = o.pix WHERE o.inside",
    rings(NSIDE),
    centres(NSIDE),
    OCT,
    ring("$particles", "rn", NSIDE),
)
def s17_rows_by_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of an octant's pixels, read at their offsets."""
    path = shared_dir(spark)
    io.write_slabs(G.with_ring_pixel(view(spark, sf_dir, "particles"), "x", "y", "z", NSIDE), path, 6)
    rows = io.read_pixels(spark, path, C.octant_mask(spark, NSIDE).where("inside"))
    return single(rows.select("step", "id", "replication", "pix", "x"), "x")


@query("SELECT step, idx AS place, SIG(vel) AS vel FROM dense", DENSE)
def s13_values_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense map read by place, which is the pixel's number."""
    path = shared_dir(spark)
    io.write_dense(view(spark, sf_dir, "map_sparse"), path, NSIDE, ("vel",))
    return single(io.read_places(spark, f"{path}/vel", ["vel"]), "vel")


@query(
    f"""SELECT step, k, fof_halo_tag, SIG(x) AS x FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY u, k, fof_halo_tag) AS nth, count(*) OVER (PARTITION BY step) AS n
FROM (SELECT k % 5 AS step, k, fof_halo_tag, fof_halo_center_x AS x, {DRAW} AS u FROM $halos_a)) WHERE nth <= round(n*0.15e0)""",
)
def s14_sample_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exact share of each step, written and read back."""
    path = shared_dir(spark)
    h = view(spark, sf_dir, "halos_a").select((F.col("k") % 5).alias("step"), "k", "fof_halo_tag", F.col("fof_halo_center_x").alias("x"))
    io.write_sample(h, path, 0.15, ("k", "fof_halo_tag"), draw=md5_draw("k", "fof_halo_tag"))
    return single(io.scan_steps(spark, path).select(F.col("step").cast("long").alias("step"), "k", "fof_halo_tag", "x"), "x")


@query(f"SELECT bin, SIG(fraction) AS fraction FROM ({hist_sql('(v - 10e0)/(390e0/30)', 30, '$values')})")
def s20_histogram_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A histogram as text."""
    path = shared_dir(spark)
    io.write_histogram(QUERIES["a4_linear_histogram"](spark, sf_dir), path)
    return single(spark.read.csv(path, header=True, schema="bin int, fraction double"), "fraction")


@query(
    f"""SELECT r.i::INT AS i, c.j::INT AS j, SIG(coalesce(n, 0)/(SELECT count(*) FROM $halos_a)::DOUBLE) AS value FROM range(12) r(i) CROSS JOIN range(12) c(j) LEFT JOIN (
  SELECT i, j, count(*) AS n FROM (SELECT trunc((log10(s) - log10(1.3e-3))/((log10(9.17e-2) - log10(1.3e-3))/12)) AS i,
    trunc((log10(m) - log10(1.3e10))/((log10(7e12) - log10(1.3e10))/12)) AS j FROM (SELECT {SPEC["spin"][0]} AS s, fof_halo_mass AS m FROM $halos_a)) GROUP BY ALL) h ON h.i = r.i AND h.j = c.j AND h.j > 0""",
)
def s20_histogram2d_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spin over mass as a matrix of text, in fractions of all halos."""
    path = shared_dir(spark)
    io.write_histogram2d(QUERIES["a8_spin_by_mass"](spark, sf_dir), path, 12)
    return single(io.read_histogram2d(spark, path, 12), "value")


def keyed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view in 8 buckets of its particle keys."""
    path = shared_dir(spark)
    return io.write_keyed(view(spark, sf_dir, name), path.rpartition("/")[2].replace("-", "_"), path, KEYS, 8)


@query(SQL["j7_drop_repeated"])
def j7_keyed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The difference with the next step over a table that is kept by its keys, without an exchange."""
    return C.drop_repeated_next_step(keyed(spark, sf_dir, "particles"), KEYS, TIE)


@query(SQL["j1_match_counts"])
def j1_keyed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lightcones that are kept by their keys, aligned without an exchange."""
    return K.match_counts(K.aligned(keyed(spark, sf_dir, "lightcone_a"), keyed(spark, sf_dir, "lightcone_b"), KEYS, LC))


@query("SELECT m.fof_halo_tag, m.id FROM $membership_a m WHERE m.fof_halo_tag IN (SELECT fof_halo_tag FROM $id_list)")
def j10_ids_by_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of listed halos from the files whose ranges can hold them."""
    path = shared_dir(spark)
    io.write_ranged(view(spark, sf_dir, "membership_a"), path, "fof_halo_tag", 50)
    return io.read_ids(spark, path, view(spark, sf_dir, "id_list"), "fof_halo_tag")


@query("SELECT count(*) AS n, 0::BIGINT AS n_out_of_order FROM $map_sparse")
def o1_sorted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1: each file of a map is in order of step and pixel."""
    path = shared_dir(spark)
    io.write_map(view(spark, sf_dir, "map_sparse"), path)
    rows = spark.read.parquet(path).select("step", "idx", "_metadata.file_path", "_metadata.row_index")
    last = F.lag("idx").over(W.partitionBy("step", "file_path").orderBy("row_index"))
    return rows.withColumn("last", last).agg(F.count("*").alias("n"), F.count_if(F.col("last") >= F.col("idx")).alias("n_out_of_order"))


@query(
    f"""SELECT step, idx, CAST(CAST(CASE WHEN rho > 0 THEN rho*2.5e0 ELSE rho END AS FLOAT) AS DOUBLE) AS rho, CAST(CAST(CASE WHEN rho > 0 THEN vel/rho/{AREA} ELSE vel END AS FLOAT) AS DOUBLE) AS vel,
'mass density' AS rho_is FROM $map_sparse""",
)
def s19_rescaled_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rescaled maps in single precision with a description."""
    path = shared_dir(spark)
    io.write_rescaled(view(spark, sf_dir, "map_sparse"), path, "go", NSIDE, 2.5)
    back = io.scan_steps(spark, path)
    return back.select("step", "idx", F.col("rho").cast("double").alias("rho"), F.col("vel").cast("double").alias("vel"), F.lit(back.schema["rho"].metadata["comment"]).alias("rho_is"))


@query("SELECT step, SIG(max(rho)) AS rho, SIG(max(vel)) AS vel, SIG(max(phi)) AS phi FROM dense GROUP BY 1", DENSE)
def s21_step_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line for each step, one value for each map."""
    path = shared_dir(spark)
    io.write_logs(M.map_qa(M.densify(view(spark, sf_dir, "map_sparse"), NSIDE), MAP, NSIDE), path, "most", list(MAP))
    return single(spark.read.csv(path, header=True, schema="step int, rho double, vel double, phi double"), *MAP)


@query("SELECT idx, SIG(sum(rho)) AS rho, SIG(sum(vel)) AS vel, SIG(sum(phi)) AS phi FROM $map_sparse GROUP BY 1")
def s22_summed_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map summed over steps."""
    path = shared_dir(spark)
    M.stack_maps(view(spark, sf_dir, "map_sparse"), MAP).write.parquet(path)
    return single(io.scan(spark, path, ["idx", *MAP]), *MAP)


@query("SELECT ring AS idx, SIG(sum(mass*mu*uu/(x*x + y*y + z*z))) AS tsz FROM rn GROUP BY 1", "gas AS (SELECT * FROM $particles WHERE mask & 4 <> 0)", ring("gas", "rn", NSIDE))
def s24_map_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map as text, in ranges of pixels."""
    path = shared_dir(spark)
    io.write_text(M.sz_map(view(spark, sf_dir, "particles"), NSIDE).select("idx", "tsz"), path, ("idx",))
    return single(spark.read.csv(path, header=True, schema="idx long, tsz double"), "tsz")


@query("SELECT id, SIG(sqrt(x*x + y*y + z*z)) AS distance FROM $lightcone_a a WHERE NOT EXISTS (SELECT 1 FROM $lightcone_b b WHERE b.id = a.id AND b.replication = a.replication)")
def s26_missing_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of the rows that the other table lacks, as text."""
    path = shared_dir(spark)
    gone = K.missing_rows(view(spark, sf_dir, "lightcone_a"), view(spark, sf_dir, "lightcone_b"), KEYS).where("side = 'a'")
    io.write_text(gone.select("id", P.distance(F.col("x"), F.col("y"), F.col("z")).alias("distance")), path)
    return single(spark.read.csv(path, header=True, schema="id long, distance double"), "distance")


@query("SELECT h.step, h.fof_halo_tag, m.id FROM $id_list h JOIN $membership_a m USING (fof_halo_tag)")
def s25_selected_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of listed halos, by step."""
    path = shared_dir(spark)
    ids = view(spark, sf_dir, "id_list")
    io.write_steps(view(spark, sf_dir, "membership_a").join(ids, "fof_halo_tag"), path)
    return io.scan_steps(spark, path, columns=["step", "fof_halo_tag", "id"])


@query("SELECT count(*) AS n, count(*) FILTER (fof_halo_count % 9 = 4) AS n_different FROM $halos_a")
def j12_row_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two tables hold the same tags row by row, both written in one order."""
    a = view(spark, sf_dir, "halos_a").select("k", "fof_halo_tag", "fof_halo_count").orderBy("k", "fof_halo_tag")
    b = a.withColumn("fof_halo_tag", F.col("fof_halo_tag") + F.when(F.col("fof_halo_count") % 9 == 4, 1).otherwise(0))
    paths = [shared_dir(spark), shared_dir(spark)]
    for df, path in zip((a, b), paths, strict=True):
        df.select("fof_halo_tag").write.parquet(path)
    return K.same_order(*[spark.read.parquet(path) for path in paths], "fof_halo_tag")
