"""Equal-area pixel geometry on the sphere (Gorski et al. 2005) as Spark SQL expressions.

Longer formulas are added to a DataFrame step by step, so that Catalyst sees each intermediate value once and keeps it in
whole-stage code generation. nside is a power of two for the nested order. Directions need not be of unit length; the null
vector has a null pixel.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAU = 2 * math.pi


def stepped(df: DataFrame, drop: bool, **steps: str) -> DataFrame:
    """Adds each expression in turn; with drop, the last one is sealed and the others are taken off again."""
    *before, last = steps
    for name in before if drop else steps:
        df = df.withColumn(name, F.expr(steps[name]))
    return sealed(df, **{last: steps[last]}).drop(*before) if drop else df


def sealed(df: DataFrame, **last: str | Column) -> DataFrame:
    """Adds expressions by a generator of one row. Catalyst pushes no filter through it: one on a pixel, such as the one
    that it adds for a join, would else be pushed down as the whole formula, at each of its steps anew."""
    fields = [(F.expr(t) if isinstance(t, str) else t).alias(n) for n, t in last.items()]
    return df.select(*[F.col(c) for c in df.columns if c not in last], F.inline_outer(F.array(F.struct(*fields))))


def _direction(x: str, y: str, z: str, n: int) -> dict[str, str]:
    return {
        "_r": f"nullif(sqrt(({x})*({x}) + ({y})*({y}) + ({z})*({z})), 0D)",
        "_z": f"({z}) / _r",
        "_za": "abs(_z)",
        "_tt": f"least(pmod(atan2({y}, {x}), {TAU!r}D) / {math.pi / 2!r}D, 3.9999999999999996D)",
        "_eq": "_za <= 0.6666666666666666D",
        "_tp": "_tt - floor(_tt)",
        "_t": f"{n} * sqrt(3D * (1D - _za))",
        "_jp": f"if(_eq, floor({n} * (0.5D + _tt) - 0.75D * {n} * _z), floor(_tp * _t))",
        "_jm": f"if(_eq, floor({n} * (0.5D + _tt) + 0.75D * {n} * _z), floor((1D - _tp) * _t))",
    }


def with_ring_pixel(df: DataFrame, x: str, y: str, z: str, nside: int, name: str = "pix") -> DataFrame:
    """The RING pixel of the direction (x, y, z), given as SQL expressions."""
    n = nside
    return stepped(
        df,
        True,
        **_direction(x, y, z, n),
        _ir=f"if(_eq, {n} + 1 + _jp - _jm, _jp + _jm + 1)",
        _ip=f"if(_eq, pmod(shiftright(_jp + _jm - {n} + (1 - _ir % 2) + 1, 1), 4 * {n}), pmod(floor(_tt * _ir), 4 * _ir))",
        **{
            name: f"cast(case when _eq then {2 * n * (n - 1)}L + (_ir - 1) * {4 * n} + _ip when _z > 0 then 2 * _ir * (_ir - 1) + _ip "
            f"else {12 * n * n}L - 2 * _ir * (_ir + 1) + _ip end as long)"
        },
    )


def gathered(df: DataFrame, v: str, name: str) -> DataFrame:
    """Moves bit 2b of v to bit b."""
    df = df.withColumn(name, F.expr(f"({v}) & {0x5555555555555555}L"))
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        df = df.withColumn(name, F.expr(f"({name} | shiftright({name}, {shift})) & {mask}L"))
    return df


def with_nest_pixel(df: DataFrame, x: str, y: str, z: str, nside: int, name: str = "pix") -> DataFrame:
    """The NESTED pixel of the direction (x, y, z)."""
    n = nside
    df = stepped(
        df,
        False,
        **_direction(x, y, z, n),
        _q="least(3L, floor(_tt))",
        _cp=f"least(_jp, {n - 1}L)",
        _cm=f"least(_jm, {n - 1}L)",
        _a=f"_jp div {n}",
        _b=f"_jm div {n}",
        _face="case when _eq then case when _a = _b then _a % 4 + 4 when _a < _b then _a % 4 else _b % 4 + 8 end when _z > 0 then _q else _q + 8 end",
        _ix=f"case when _eq then _jm % {n} when _z > 0 then {n} - _cm - 1 else _cp end",
        _iy=f"case when _eq then {n} - _jp % {n} - 1 when _z > 0 then {n} - _cp - 1 else _cm end",
    )
    for c in ("_ix", "_iy"):
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            df = df.withColumn(c, F.expr(f"(cast({c} as long) | shiftleft(cast({c} as long), {shift})) & {mask}L"))
    df = sealed(df, **{name: f"cast(_face * {n * n}L + _ix + 2 * _iy as long)"})
    return df.drop("_r", "_z", "_za", "_tt", "_eq", "_tp", "_t", "_jp", "_jm", "_q", "_cp", "_cm", "_a", "_b", "_face", "_ix", "_iy")


def with_ring_of_nest(df: DataFrame, nest: str, nside: int, name: str = "ring") -> DataFrame:
    """NESTED to RING by the position inside the base face."""
    n = nside
    df = df.withColumn("_face", F.expr(f"({nest}) div {n * n}L")).withColumn("_in", F.expr(f"({nest}) % {n * n}L"))
    df = gathered(gathered(df, "_in", "_ix"), "shiftright(_in, 1)", "_iy")
    df = stepped(
        df,
        False,
        _jr=f"(_face div 4 + 2) * {n} - _ix - _iy - 1",
        _nr=f"case when _jr < {n} then _jr when _jr > {3 * n} then {4 * n} - _jr else {n} end",
        _before=f"case when _jr < {n} then 2 * _nr * (_nr - 1) when _jr > {3 * n} then {12 * n * n}L - 2 * (_nr + 1) * _nr else {2 * n * (n - 1)}L + (_jr - {n}) * {4 * n} end",
        _jf="(_face % 4) * 2 + if(_face div 4 = 1, 0, 1)",
        _jq=f"shiftright(_jf * _nr + _ix - _iy + 1 + if(_jr between {n} and {3 * n}, (_jr - {n}) % 2, 0), 1)",
        _jw="case when _jq > 4 * _nr then _jq - 4 * _nr when _jq < 1 then _jq + 4 * _nr else _jq end",
    )
    return sealed(df, **{name: "cast(_before + _jw - 1 as long)"}).drop("_face", "_in", "_ix", "_iy", "_jr", "_nr", "_before", "_jf", "_jq", "_jw")


def _ring(i: str, n: int, p: str) -> dict[str, str]:
    """Start, size, z and shift of ring number i, with prefix p."""
    return {
        f"{p}j": f"case when {i} < {n} then {i} when {i} > {3 * n} then {4 * n} - {i} else {n} end",
        f"{p}size": f"4 * {p}j",
        f"{p}start": f"case when {i} < {n} then 2 * {p}j * ({p}j - 1) when {i} > {3 * n} then {12 * n * n}L - 2 * {p}j * ({p}j + 1) else {2 * n * (n - 1)}L + ({i} - {n}) * {4 * n} end",
        f"{p}z": f"case when {i} < {n} then 1D - {p}j * {p}j / {float(3 * n * n)!r}D when {i} > {3 * n} then -1D + {p}j * {p}j / {float(3 * n * n)!r}D else (4D - 2D * {i} / {n}) / 3D end",
        f"{p}shift": f"if({i} between {n} and {3 * n}, 1 - ({i} - {n}) % 2, 1)",
    }


def with_direction_of_ring(df: DataFrame, pix: str, nside: int, names: tuple[str, str, str] = ("vx", "vy", "vz")) -> DataFrame:
    """The unit vector to the centre of a RING pixel."""
    n, x, y, z = nside, *names
    cap = 2 * n * (n - 1)
    df = stepped(
        df,
        False,
        _p=f"cast({pix} as long)",
        _i=f"case when _p < {cap} then floor((1D + sqrt(1D + 2D * _p)) / 2D) when _p >= {12 * n * n - cap} then {4 * n} - floor((1D + sqrt(2D * ({12 * n * n} - _p) - 1D)) / 2D) "
        f"else (_p - {cap}) div {4 * n} + {n} end",
        **_ring("_i", n, "_g"),
        _phi=f"(_p - _gstart + 0.5D * _gshift) * {TAU!r}D / _gsize",
        _s="sqrt((1D - _gz) * (1D + _gz))",
    )
    return sealed(df, **{x: "_s * cos(_phi)", y: "_s * sin(_phi)", z: "_gz"}).drop("_p", "_i", "_gj", "_gsize", "_gstart", "_gz", "_gshift", "_phi", "_s")


def centres_of_nest(face: int, ix: np.ndarray, iy: np.ndarray, nside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors to the centres of the pixels at (ix, iy) in a base pixel, for use inside of tasks."""
    n = nside
    ring = (face // 4 + 2) * n - ix - iy - 1
    cap = np.minimum(np.minimum(ring, 4 * n - ring), n)
    z = np.where(cap < n, np.sign(2 * n - ring) * (1 - cap * cap / (3 * n * n)), (2 * n - ring) * 2 / (3 * n))
    phi = math.pi / 4 * (face % 4 * 2 + (face // 4 != 1) + (ix - iy) / cap)
    s = np.sqrt((1 - z) * (1 + z))
    return s * np.cos(phi), s * np.sin(phi), z


def with_nest_of_ring(df: DataFrame, ring: str, nside: int, name: str = "nest") -> DataFrame:
    """RING to NESTED, exact because a pixel's centre is well inside of it."""
    df = with_direction_of_ring(df, ring, nside, ("_cx", "_cy", "_cz"))
    return with_nest_pixel(df, "_cx", "_cy", "_cz", nside, name).drop("_cx", "_cy", "_cz")


def _between_rings(x: str, y: str, z: str, n: int) -> dict[str, str]:
    """Colatitude, longitude and the ring above; the ring below is the next one, and rings 0 and 4n are the poles."""
    return {
        "_r": f"nullif(sqrt(({x})*({x}) + ({y})*({y}) + ({z})*({z})), 0D)",
        "_z": f"({z}) / _r",
        "_theta": f"atan2(sqrt(({x})*({x}) + ({y})*({y})), {z})",
        "_phi": f"pmod(atan2({y}, {x}), {TAU!r}D)",
        "_cap": f"cast(floor({n} * sqrt(3D * (1D - abs(_z)))) as long)",
        "_u": f"case when abs(_z) <= 0.6666666666666666D then cast(floor({n} * (2D - 1.5D * _z)) as long) when _z > 0 then _cap else {4 * n - 1} - _cap end",
    }


def _pair(p: str) -> dict[str, str]:
    """The two pixels p and q of a ring at a longitude, and the weight w of q."""
    return {
        f"{p}pos": f"_phi * {p}size / {TAU!r}D - 0.5D * {p}shift",
        f"{p}k": f"cast(floor({p}pos) as long)",
        f"{p}w": f"{p}pos - {p}k",
        f"{p}p": f"{p}start + pmod({p}k, {p}size)",
        f"{p}q": f"{p}start + pmod({p}k + 1, {p}size)",
    }


def _shares(n: int) -> dict[str, str]:
    """From the colatitudes _ath and _bth of the rings: what is dealt to the ring above, to that below, and evenly around a pole."""
    return {
        "_wt": f"case when _u = 0 then _theta / _bth when _u = {4 * n - 1} then (_theta - _ath) / ({math.pi!r}D - _ath) else (_theta - _ath) / (_bth - _ath) end",
        "_pole": f"case when _u = 0 then (1D - _wt) / 4D when _u = {4 * n - 1} then _wt / 4D else 0D end",
        "_ua": "if(_u = 0, 0D, 1D - _wt)",
        "_ub": f"if(_u = {4 * n - 1}, 0D, _wt)",
    }


def _across(ring: str, pix: str, n: int) -> str:
    """The pixel itself, or the one on the other side of the pole in place of a ring that is one."""
    last = 12 * n * n - 4
    return f"if(_u = 0, ({pix} + 2) % 4, {pix})" if ring == "above" else f"if(_u = {4 * n - 1}, {last} + ({pix} + 2 - {last}) % 4, {pix})"


def with_interpolation(df: DataFrame, x: str, y: str, z: str, nside: int, name: str = "near") -> DataFrame:
    """array<struct<pix, w>> of the four RING pixels around a direction, with weights that add up to 1.

    Weights are linear in longitude inside the rings above and below, and linear in colatitude between them. Between a pole
    and the ring next to it, the distance to the pole deals the rest evenly to the four pixels of that ring.
    """
    n, own = nside, set(df.columns)
    df = stepped(df, False, **_between_rings(x, y, z, n))
    for p, i in (("_a", "greatest(_u, 1L)"), ("_b", f"least(_u + 1, {4 * n - 1}L)")):
        df = stepped(df, False, **{f"{p}i": i}, **_ring(f"{p}i", n, p), **{f"{p}th": f"acos({p}z)"}, **_pair(p))
    df = stepped(df, False, **_shares(n))
    entries = [(_across(ring, f"{p}{c}", n), f"{u} * {w} + _pole") for ring, p, u in (("above", "_a", "_ua"), ("below", "_b", "_ub")) for c, w in (("p", f"(1D - {p}w)"), ("q", f"{p}w"))]
    listed = ", ".join(f"named_struct('pix', cast({p} as long), 'w', {w})" for p, w in entries)
    df = df.withColumn(name, F.expr(f"if(_r is null, null, array({listed}))"))
    return df.drop(*[c for c in df.columns if c not in own and c != name])


def interpolation_rows(df: DataFrame, x: str, y: str, z: str, nside: int, columns: list[str]) -> DataFrame:
    """(columns, pix, w): the four entries of ``with_interpolation`` as rows, for directions that are not null.

    The formulas are cut in three by generators of two rows, one for each ring and then one for each pixel of it. So no
    generated method is too large for the JVM to compile, and the ring formulas stand in one of them once.
    """
    n = nside
    df = stepped(df, False, **_between_rings(x, y, z, n)).select(*columns, "_theta", "_phi", "_u", F.explode(F.array(F.lit(True), F.lit(False))).alias("_above"))
    both = {c: e for p, i in (("_a", "greatest(_u, 1L)"), ("_b", f"least(_u + 1, {4 * n - 1}L)")) for c, e in ({f"{p}i": i} | _ring(f"{p}i", n, p)).items() if c[2:] in ("i", "j", "z")}
    df = stepped(df, False, **both, _ath="acos(_az)", _bth="acos(_bz)", **_shares(n), _i="if(_above, _ai, _bi)", **_ring("_i", n, "_g"), **_pair("_g"), _o="if(_above, _ua, _ub)")
    pix = {c: f"cast(if(_above, {_across('above', f'_g{c}', n)}, {_across('below', f'_g{c}', n)}) as long)" for c in "pq"}
    df = stepped(df, False, _pp=pix["p"], _pq=pix["q"], _wp="_o * (1D - _gw) + _pole", _wq="_o * _gw + _pole")
    return df.select(*columns, F.inline(F.expr("array(named_struct('pix', _pp, 'w', _wp), named_struct('pix', _pq, 'w', _wq))")))


def _tile(band: str, k: str, size: str, shift: str, n: int, rings: int) -> str:
    """The tile of pixel number k of a ring: its band of rings and its sector of longitude, about as wide as the band is high."""
    least = f"greatest(least({band} * {rings}, {4 * n} - ({band} + 1) * {rings} + 1, {n}), 0L)"  # the smallest ring of the band has 4 times this many pixels; a band with a ring next to a pole is one tile
    return f"{band} * {1 << 32}L + (2 * {k} + {shift}) * greatest(({least} - 1) * 4 div {rings}, 1L) div (2 * {size})"


def with_tile(df: DataFrame, x: str, y: str, z: str, nside: int, rings: int, name: str = "tile") -> DataFrame:
    """A tile near to a direction, that of its first interpolation pixel: cheaper than all four of them."""
    n, own = nside, df.columns
    df = stepped(df, False, **_between_rings(x, y, z, n), _i="greatest(_u, 1L)", **_ring("_i", n, "_g"), **_pair("_g"), _band=f"_i div {rings}")
    return sealed(df, **{name: f"cast({_tile('_band', 'pmod(_gk, _gsize)', '_gsize', '_gshift', n, rings)} as long)"}).select(*own, name)


def interpolation_tiles(df: DataFrame, x: str, y: str, z: str, nside: int, columns: list[str], rings: int) -> DataFrame:
    """(columns, tile, near): the interpolation pixels of a direction by the tile that holds them, near is array<struct<pix, w>>.

    Tiles are bands of `rings` rings cut into sectors; the caps are one tile each. Most directions have their four pixels in
    one tile and so are one row; only at the borders of tiles they are two or more.
    """
    n = nside
    df = stepped(df, False, **_between_rings(x, y, z, n)).select(*columns, "_theta", "_phi", "_u")
    rows = {c: e for p, i in (("_a", "greatest(_u, 1L)"), ("_b", f"least(_u + 1, {4 * n - 1}L)")) for c, e in ({f"{p}i": i} | _ring(f"{p}i", n, p)).items()}
    df = stepped(df, False, **rows, _ath="acos(_az)", _bth="acos(_bz)", **_shares(n))
    keep = [f"{p}{c}" for p in ("_a", "_b") for c in ("i", "size", "start", "shift")]
    df = sealed(df.select(*columns, "_phi", "_u", *keep, "_pole", *[F.col(c).alias(f"{c}_") for c in ("_ua", "_ub")]), _share_a="_ua_", _share_b="_ub_").drop("_ua_", "_ub_")
    df = stepped(df, False, **_pair("_a"), **_pair("_b"))
    parts = {}
    for ring, p, u in (("above", "_a", "_share_a"), ("below", "_b", "_share_b")):
        for c, w, k in (("p", f"(1D - {p}w)", f"pmod({p}k, {p}size)"), ("q", f"{p}w", f"pmod({p}k + 1, {p}size)")):
            parts |= {f"{p}{c}_t": _tile(f"({p}i div {rings})", k, f"{p}size", f"{p}shift", n, rings), f"{p}{c}_x": _across(ring, f"{p}{c}", n), f"{p}{c}_y": f"{u} * {w} + _pole"}
    df = sealed(df, **{k: f"cast({e} as {'double' if k.endswith('y') else 'long'})" for k, e in parts.items()}).select(*columns, *parts)
    four = [k[:-2] for k in parts if k.endswith("_t")]
    near = ", ".join(f"named_struct('pix', {c}_x, 'w', {c}_y)" for c in four)
    marked = ", ".join(f"named_struct('t', {c}_t, 'e', named_struct('pix', {c}_x, 'w', {c}_y))" for c in four)
    tiles = ", ".join(f"{c}_t" for c in four)
    same = " AND ".join(f"{four[0]}_t = {c}_t" for c in four[1:])
    split = f"transform(array_distinct(array({tiles})), t -> named_struct('tile', t, 'near', transform(filter(array({marked}), m -> m.t = t), m -> m.e)))"
    return df.select(*columns, F.inline(F.expr(f"if({same}, array(named_struct('tile', {four[0]}_t, 'near', array({near}))), {split})")))


def parent_pixel(nest: str | Column, levels: int) -> Column:
    """The NESTED pixel that holds this one, `levels` halvings of nside up."""
    return F.shiftright(F.col(nest) if isinstance(nest, str) else nest, 2 * levels)


def grid_pixel(x: Column, y: Column, box: float, n: int) -> Column:
    """The cell of a flat periodic n x n grid over a box; positions at most one box outside are wrapped once."""
    wrap = lambda c: F.when(c >= box, c - box).when(c < 0, c + box).otherwise(c)
    cell = lambda c: F.pmod((wrap(c) / F.lit(box / n)).cast("int"), F.lit(n))
    return (cell(x) * n + cell(y)).cast("long")


def cell3d(x: Column, y: Column, z: Column, size: float) -> Column:
    """The cube of that size that holds a position: a key for joins by distance."""
    return F.struct(*[F.floor(c / size).cast("long").alias(n) for c, n in ((x, "cx"), (y, "cy"), (z, "cz"))])
