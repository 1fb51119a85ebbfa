"""Times the headline queries over $BENCH_SF_DIR and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from skyloom.plans import queries as Q

HEADLINE = (
    "flagship j7_drop_repeated a14_interp_map a14_fine_map a15_hydro_maps a15_fine_maps a15_xray_maps a19_halo_cut_maps a22_sz_map a17_map_qa j1_compare_lightcones j2_compare_halos j4_membership "
    "j5_match_by_position j5_match_counts j6_match_properties a3_distributions a8_halo_histograms a9_projected_counts a21_pixel_offsets o3_exact_sample j14_grid_interpolate"
).split()


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC",
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    Q.QUERIES["a20_gas_summary"](spark, sf_dir).collect()  # starts the executors' code
    seconds = {}
    for name in HEADLINE:
        began = time.time()
        Q.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    total = round(sum(seconds.values()), 3)
    rates = {n: round(rows / s) for n, s in seconds.items()}
    print(json.dumps({"metric": "headline queries", "value": total, "unit": "sec", "queries": seconds, "rows_per_sec": rates, "lineitem_rows": rows, "sf": os.path.basename(sf_dir)}))
    spark.stop()


if __name__ == "__main__":
    main()
