"""Table schemas, named by what they hold."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(text: str, kind: T.DataType) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in text.split()]


_STEP = [T.StructField("step", T.IntegerType())]
_IDS = [T.StructField("replication", T.IntegerType()), T.StructField("id", T.LongType())]
PARTICLES_GO = T.StructType(_fields("x y z vx vy vz phi a dt", T.FloatType()) + _IDS + _STEP)
PARTICLES_HYDRO = T.StructType(_fields("x y z vx vy vz phi a dt mass uu mu rho zmet yhe", T.FloatType()) + _fields("mask", T.IntegerType()) + _IDS + _STEP)
HALO_PARTICLES = T.StructType(PARTICLES_HYDRO.fields + _fields("fof_halo_tag", T.LongType()))
LIGHTCONE = T.StructType(_IDS + _fields("x y z vx vy vz a phi", T.FloatType()))
PROFILE_BINS = T.StructType(
    _fields("fof_halo_bin_tag", T.LongType()) + _fields("sod_halo_bin sod_halo_bin_count", T.IntegerType())
    + _fields("sod_halo_bin_mass sod_halo_bin_radius sod_halo_bin_rho sod_halo_bin_rho_ratio sod_halo_bin_rad_vel", T.FloatType())
)
MEMBERSHIP = T.StructType(_fields("fof_halo_tag id", T.LongType()) + _fields("source", T.StringType()))
HALO_LIGHTCONE = T.StructType(
    _fields("x y z vx vy vz fof_mass sod_mass sod_radius sod_cdelta sod_cdelta_error a", T.FloatType()) + _fields("rotation replication", T.IntegerType())
    + _fields("id", T.LongType()) + _STEP
)
MAP_GO = T.StructType(_STEP + _fields("idx", T.LongType()) + _fields("phi vel rho", T.DoubleType()))
MAP_HYDRO = T.StructType(MAP_GO.fields + _fields("xray1 xray2 xray3 xray4 temp ksz tsz", T.DoubleType()))
ID_LIST = T.StructType(_fields("id step", T.LongType()))
#: Shorter names of catalogue columns in written samples.
SHORT = {"fof_halo_center_x": "x", "fof_halo_center_y": "y", "fof_halo_center_z": "z", "fof_halo_mass": "mass"}
