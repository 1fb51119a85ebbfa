"""DuckDB text of the pixel formulas and of rounding, for the queries' SQL."""

from __future__ import annotations

import re

NSIDE = 8
AREA = f"(4*pi()/{12 * NSIDE * NSIDE}e0)"


def sig(text: str) -> str:
    """Replaces SIG(x) by x in single precision: both engines round to it alike, and sums differ only far below it."""
    while (m := re.search(r"SIG\(", text)) is not None:
        depth, k = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[k], 0)
            k += 1
        text = f"{text[: m.start()]}CAST(CAST({text[m.end() : k - 1]} AS FLOAT) AS DOUBLE){text[k:]}"
    return text


def direction(src: str, out: str, n: int, x: str = "x", y: str = "y", z: str = "z") -> str:
    """CTEs that add r_, z_, t_ (longitude in quarter turns), jp_ and jm_."""
    return f"""{out}_a AS (SELECT *, nullif(sqrt({x}*{x} + {y}*{y} + {z}*{z}), 0e0) AS r_, atan2({y}, {x}) AS f_ FROM {src}),
{out}_b AS (SELECT *, {z} / r_ AS z_, (CASE WHEN f_ < 0 THEN f_ + 2*pi() ELSE f_ END) / (pi()/2) AS t_ FROM {out}_a),
{out}_c AS (SELECT *, abs(z_) <= 2e0/3 AS e_,
  CAST(CASE WHEN abs(z_) <= 2e0/3 THEN floor({n}*(0.5e0 + t_) - 0.75e0*{n}*z_) ELSE floor((t_ - floor(t_))*{n}*sqrt(3*(1 - abs(z_)))) END AS BIGINT) AS jp_,
  CAST(CASE WHEN abs(z_) <= 2e0/3 THEN floor({n}*(0.5e0 + t_) + 0.75e0*{n}*z_) ELSE floor((1 - t_ + floor(t_))*{n}*sqrt(3*(1 - abs(z_)))) END AS BIGINT) AS jm_
  FROM {out}_b)"""


def ring(src: str, out: str, n: int, x: str = "x", y: str = "y", z: str = "z") -> str:
    """CTEs ending in one named out, which adds ring to src."""
    return f"""{direction(src, out, n, x, y, z)},
{out}_d AS (SELECT *, CASE WHEN e_ THEN {n} + 1 + jp_ - jm_ ELSE jp_ + jm_ + 1 END AS i_ FROM {out}_c),
{out} AS (SELECT *, CASE WHEN e_ THEN {2 * n * (n - 1)} + (i_ - 1)*{4 * n} + ((jp_ + jm_ - {n} + 2 - i_ % 2) // 2) % {4 * n}
  WHEN z_ > 0 THEN 2*i_*(i_ - 1) + CAST(floor(t_*i_) AS BIGINT) % (4*i_)
  ELSE {12 * n * n} - 2*i_*(i_ + 1) + CAST(floor(t_*i_) AS BIGINT) % (4*i_) END AS ring FROM {out}_d)"""


def nest(src: str, out: str, n: int, x: str = "x", y: str = "y", z: str = "z") -> str:
    """CTEs ending in one named out, which adds nest to src."""
    bits = n.bit_length() - 1
    spread = lambda v: " + ".join(f"(({v} >> {b}) & 1)*{4**b}" for b in range(bits)) or "0"
    return f"""{direction(src, out, n, x, y, z)},
{out}_d AS (SELECT *,
  CASE WHEN e_ THEN CASE WHEN jp_//{n} = jm_//{n} THEN jp_//{n} % 4 + 4 WHEN jp_//{n} < jm_//{n} THEN jp_//{n} % 4 ELSE jm_//{n} % 4 + 8 END
    WHEN z_ > 0 THEN least(3, CAST(floor(t_) AS BIGINT)) ELSE least(3, CAST(floor(t_) AS BIGINT)) + 8 END AS face_,
  CASE WHEN e_ THEN jm_ % {n} WHEN z_ > 0 THEN {n} - 1 - least(jm_, {n - 1}) ELSE least(jp_, {n - 1}) END AS u_,
  CASE WHEN e_ THEN {n} - 1 - jp_ % {n} WHEN z_ > 0 THEN {n} - 1 - least(jp_, {n - 1}) ELSE least(jm_, {n - 1}) END AS v_ FROM {out}_c),
{out} AS (SELECT *, face_*{n * n} + {spread("u_")} + 2*({spread("v_")}) AS nest FROM {out}_d)"""


def rings(n: int) -> str:
    """A CTE rings(i, start, size, z, shift)."""
    return f"""rings AS (SELECT i, CASE WHEN i < {n} THEN 2*i*(i - 1) WHEN i > {3 * n} THEN {12 * n * n} - 2*({4 * n} - i)*({4 * n} - i + 1) ELSE {2 * n * (n - 1)} + (i - {n})*{4 * n} END AS start,
  CASE WHEN i < {n} THEN 4*i WHEN i > {3 * n} THEN 4*({4 * n} - i) ELSE {4 * n} END AS size,
  CASE WHEN i < {n} THEN 1 - i*i/{3 * n * n}e0 WHEN i > {3 * n} THEN ({4 * n} - i)*({4 * n} - i)/{3 * n * n}e0 - 1 ELSE 4e0/3 - 2e0*i/{3 * n}e0 END AS rz,
  CASE WHEN i BETWEEN {n} AND {3 * n} AND (i - {n}) % 2 = 1 THEN 0e0 ELSE 0.5e0 END AS shift FROM range(1, {4 * n}) r(i))"""


def centres(n: int) -> str:
    """CTEs ending in pixels(pix, px, py, pz), after rings(n)."""
    return f"""pixels AS (SELECT start + k AS pix, sqrt((1 - rz)*(1 + rz))*cos((k + shift)*2*pi()/size) AS px, sqrt((1 - rz)*(1 + rz))*sin((k + shift)*2*pi()/size) AS py, rz AS pz
  FROM rings, range(0, {4 * n}) k(k) WHERE k < size)"""


def interpolation(src: str, out: str, n: int) -> str:
    """CTEs, after rings(n), ending in one named out: src with pix and w, a row for each of the four pixels."""
    return f"""{out}_a AS (SELECT *, row_number() OVER () AS row_, z / nullif(sqrt(x*x + y*y + z*z), 0e0) AS z_, atan2(sqrt(x*x + y*y), z) AS th_,
  CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2*pi() ELSE atan2(y, x) END AS ph_ FROM {src}),
{out}_b AS (SELECT *, CAST(CASE WHEN abs(z_) <= 2e0/3 THEN floor({n}*(2 - 1.5e0*z_)) WHEN z_ > 0 THEN floor({n}*sqrt(3*(1 - z_))) ELSE {4 * n - 1} - floor({n}*sqrt(3*(1 + z_))) END AS BIGINT) AS up_
  FROM {out}_a WHERE z_ IS NOT NULL),
{out}_c AS (SELECT s.*, side, r.start, r.size, acos(r.rz) AS rt_, ph_*r.size/(2*pi()) - r.shift AS pos_
  FROM {out}_b s, (VALUES (0), (1)) o(side), rings r WHERE r.i = up_ + side),
{out}_d AS (SELECT *, CAST(floor(pos_) AS BIGINT) AS k_, pos_ - floor(pos_) AS fr_,
  max(CASE WHEN side = 0 THEN rt_ END) OVER (PARTITION BY row_) AS ta_, max(CASE WHEN side = 1 THEN rt_ END) OVER (PARTITION BY row_) AS tb_ FROM {out}_c),
{out}_e AS (SELECT *, CASE WHEN ta_ IS NULL THEN th_/tb_ WHEN tb_ IS NULL THEN (th_ - ta_)/(pi() - ta_) ELSE (th_ - ta_)/(tb_ - ta_) END AS wt_ FROM {out}_d),
{out}_f AS (SELECT *, start + (k_ + side2 + size) % size AS pix, (CASE WHEN side2 = 0 THEN 1 - fr_ ELSE fr_ END)*(CASE WHEN side = 0 THEN 1 - wt_ ELSE wt_ END) AS w
  FROM {out}_e, (VALUES (0), (1)) q(side2)),
{out} AS (SELECT * EXCLUDE (side2) FROM (
  SELECT * FROM {out}_f
  UNION ALL SELECT * EXCLUDE (pix, w, p), p AS pix, (1 - wt_)/4 AS w FROM (SELECT *, unnest([0, 1, 2, 3]) AS p FROM {out}_f WHERE ta_ IS NULL AND side2 = 0)
  UNION ALL SELECT * EXCLUDE (pix, w, p), p AS pix, wt_/4 AS w FROM (SELECT *, unnest([{12 * n * n - 4}, {12 * n * n - 3}, {12 * n * n - 2}, {12 * n * n - 1}]) AS p FROM {out}_f WHERE tb_ IS NULL AND side2 = 0)))"""
