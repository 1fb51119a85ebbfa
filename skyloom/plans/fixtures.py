"""Views over the star-schema tables that have the shape of simulation output.

The text of a view is SQL that Spark and DuckDB both read; `$name` stands for a table or an earlier view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "particles": """
SELECT l_orderkey AS id, l_linenumber AS replication, CAST(year(l_shipdate) AS INT) AS step,
       l_extendedprice/1e3 - 50.1234e0 AS x,
       ((l_suppkey*37 + l_partkey*11) % 101) - 50.3e0 AS y,
       l_quantity - 25.7e0 AS z,
       l_tax*1e3 - 41e0 AS vx, l_discount*1e3 - 47e0 AS vy, l_quantity*3e0 - 61e0 AS vz,
       (l_extendedprice - 5e4)/7e0 AS phi,
       1e0/(1e0 + (2002 - CAST(year(l_shipdate) AS INT))*1e-1) AS a,
       l_extendedprice*1e6 AS mass, l_quantity*l_quantity*1e2 AS uu, 0.59e0 + l_tax AS mu,
       l_extendedprice*1e1 AS rho, l_tax/4e0 AS zmet, 0.24e0 + l_discount/1e1 AS yhe,
       CASE WHEN l_returnflag = 'R' THEN 4 ELSE 0 END + l_linenumber % 4 AS mask,
       l_orderkey AS fof_halo_tag
FROM $lineitem""",
    "lightcone_a": """
SELECT id, replication, min(x) AS x, min(y) AS y, min(z) AS z, min(vx) AS vx, min(vy) AS vy,
       min(vz) AS vz, min(a) AS a, min(phi) AS phi
FROM $particles GROUP BY id, replication""",
    "lightcone_b": """
SELECT id, replication, x + 1e-3*(id % 5) AS x, y, z*(1e0 + 1e-4*(id % 3)) AS z, vx, vy + 1e-2*(id % 2) AS vy,
       vz, a, phi
FROM $lightcone_a WHERE id % 17 <> 0
UNION ALL
SELECT id + 10000000, replication, x, y, z, vx, vy, vz, a, phi FROM $lightcone_a WHERE id % 23 = 0""",
    "halos_a": """
WITH h AS (
  SELECT o_orderkey AS k,
         CASE WHEN o_orderkey % 7 = 3 THEN -(o_orderkey + 281474976710656*(1 + o_orderkey % 3)) ELSE o_orderkey END AS fof_halo_tag,
         CAST(20 + o_orderkey % 5000 AS INT) AS fof_halo_count, o_totalprice*1e7 AS fof_halo_mass,
         ((o_orderkey*7919) % 100003)/100003e0*256e0 AS fof_halo_center_x,
         ((o_orderkey*104729) % 99991)/99991e0*256e0 AS fof_halo_center_y,
         ((o_custkey*1299709 + o_orderkey*31) % 99989)/99989e0*256e0 AS fof_halo_center_z,
         ((o_orderkey*271) % 1999) - 999.5e0 AS fof_halo_com_vx,
         ((o_orderkey*613) % 1999) - 999.5e0 AS fof_halo_com_vy,
         ((o_orderkey*997) % 1999) - 999.5e0 AS fof_halo_com_vz,
         o_totalprice*(((o_orderkey*37) % 101) - 50.3e0)*1e4 AS fof_halo_angmom_x,
         o_totalprice*(((o_orderkey*41) % 101) - 50.3e0)*1e4 AS fof_halo_angmom_y,
         o_totalprice*(((o_orderkey*43) % 101) - 50.3e0)*1e4 AS fof_halo_angmom_z,
         CASE WHEN o_orderkey % 11 = 0 THEN -101e0 ELSE o_totalprice*9e6 END AS sod_halo_mass,
         0.1e0 + o_totalprice/1e6 AS sod_halo_radius,
         CASE WHEN o_orderkey % 11 = 0 THEN -101e0 ELSE 3e0 + (o_orderkey % 97)/1e1 END AS sod_halo_cdelta
  FROM $orders)
SELECT * FROM h UNION ALL SELECT * FROM h WHERE k % 401 = 5""",
    "halos_b": """
SELECT k, fof_halo_tag, fof_halo_count, fof_halo_mass*(1e0 + 1e-3*(k % 4)) AS fof_halo_mass,
       fof_halo_center_x + 1e-3*(k % 9) AS fof_halo_center_x,
       fof_halo_center_y - 1e-3*(k % 9) AS fof_halo_center_y, fof_halo_center_z,
       fof_halo_com_vx, fof_halo_com_vy, fof_halo_com_vz,
       fof_halo_angmom_x, fof_halo_angmom_y, fof_halo_angmom_z,
       sod_halo_mass*(1e0 + 5e-3*(k % 5)) AS sod_halo_mass, sod_halo_radius,
       sod_halo_cdelta + 1e-2*(k % 3) AS sod_halo_cdelta
FROM $halos_a WHERE k % 29 <> 0""",
    "membership_a": """
SELECT l_orderkey AS fof_halo_tag, l_partkey AS id FROM $lineitem""",
    "membership_b": """
SELECT l_orderkey AS fof_halo_tag, l_partkey + CASE WHEN l_suppkey % 19 = 0 THEN 1 ELSE 0 END AS id
FROM $lineitem WHERE l_quantity > 2""",
    "sod_bins": """
SELECT l_orderkey AS fof_halo_bin_tag, l_linenumber AS sod_halo_bin, sum(l_extendedprice) AS sod_halo_bin_mass,
       min(l_quantity) AS sod_halo_bin_radius, max(l_discount) AS sod_halo_bin_rho, CAST(count(*) AS INT) AS sod_halo_bin_count
FROM $lineitem GROUP BY l_orderkey, l_linenumber""",
    "id_list": """
SELECT CAST(year(o_orderdate) AS INT) AS step, o_orderkey AS fof_halo_tag FROM $orders WHERE o_totalprice > 490000""",
    "map_sparse": """
SELECT CAST(year(l_shipdate) AS INT) AS step, l_partkey % 768 AS idx,
       sum(l_quantity) AS rho, sum(l_tax*1e3 - 41e0) AS vel, sum(l_discount*1e3 - 47e0) AS phi
FROM $lineitem WHERE l_partkey % 5 <> 0 GROUP BY 1, 2""",
    "values": """
SELECT event_id AS id, value AS v, CAST(user_id AS DOUBLE) AS m, event_type AS src FROM $events""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame; a name that is no view is a table."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = set(re.findall(r"\$(\w+)", VIEWS[name]))
    return spark.sql(re.sub(r"\$(\w+)", r"{\1}", VIEWS[name]), **{u: view(spark, sf_dir, u) for u in used})


def with_views(body: str, *ctes: str) -> str:
    """One DuckDB statement: the views that body and ctes use as common table expressions, then ctes, then body."""
    found: dict[str, str] = {}

    def add(text: str) -> None:
        for name in re.findall(r"\$(\w+)", text):
            if name in VIEWS and name not in found:
                add(VIEWS[name])
                found[name] = VIEWS[name]

    add(body + " ".join(ctes))
    parts = [f"fx_{n} AS ({t})" for n, t in found.items()] + list(ctes)
    text = ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
    return re.sub(r"\$(\w+)", lambda m: f"fx_{m[1]}" if m[1] in VIEWS else m[1], text)
