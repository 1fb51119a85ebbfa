"""Per-row physics and catalogue formulas as Columns. Inputs are widened to double."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lower 48 bits: the tag inside an encoded, negative halo tag.
TAG_BITS = 0x0000FFFFFFFFFFFF


@dataclass(frozen=True)
class Constants:
    """Physical constants in CGS units; all can be replaced, as simulations differ in what they assume."""

    solar_mass: float = 1.98892e33
    megaparsec: float = 3.085677581e24
    proton_mass: float = 1.672621637e-24
    electron_mass: float = 9.10938356e-28
    thomson: float = 6.6524587158e-25
    light_speed: float = 2.99792458e10
    boltzmann: float = 1.3806488e-16
    gamma: float = 5.0 / 3.0
    mu: float = 0.59
    primordial_helium: float = 0.24
    hubble: float = 0.6766


def decode_tag(tag: Column) -> Column:
    """The halo tag of a fragment tag: negative ones carry it in their lower 48 bits."""
    return F.when(tag < 0, (-tag).bitwiseAND(F.lit(TAG_BITS))).otherwise(tag)


def dist2(x: Column, y: Column, z: Column) -> Column:
    return x * x + y * y + z * z


def distance(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(dist2(x, y, z))


def v_los(x: Column, y: Column, z: Column, vx: Column, vy: Column, vz: Column) -> Column:
    """Velocity along the line of sight; null at the observer."""
    return F.try_divide(vx * x + vy * y + vz * z, distance(x, y, z))


def speed(vx: Column, vy: Column, vz: Column) -> Column:
    return F.sqrt(vx * vx + vy * vy + vz * vz)


def spin(lx: Column, ly: Column, lz: Column, mass: Column) -> Column:
    return F.try_divide(speed(lx, ly, lz), mass)


def axis_ratios(prefix: str) -> tuple[Column, Column]:
    """e1/e3 and e2/e3 of the norms of the eigenvectors in columns prefix1X, prefix1Y ... prefix3Z."""
    norms = [speed(*[F.col(f"{prefix}{k}{c}") for c in "XYZ"]) for k in (1, 2, 3)]
    return F.try_divide(norms[0], norms[2]), F.try_divide(norms[1], norms[2])


def gas_temperature(uu: Column, mu: Column, a: Column, k: Constants = Constants(), uu_cgs: float = 1e10) -> Column:
    """Kelvin, from specific internal energy in comoving code units of uu_cgs erg/g."""
    return F.lit((k.gamma - 1) * k.proton_mass / k.boltzmann * uu_cgs) * mu * uu * a * a


def gas_state(mass: Column, rho: Column, zmet: Column, yhe: Column, a: Column, k: Constants = Constants()) -> dict[str, Column]:
    """SPH volume (cm3), density (g/cm3), hydrogen fraction, metal-free helium fraction and hydrogen density (1/cm3), all physical.

    mass and rho are in solar masses over h and comoving (Mpc/h)^3.
    """
    density = rho * F.lit(k.solar_mass / k.megaparsec**3 * k.hubble**2) / (a * a * a)
    hydrogen = F.lit(1.0) - yhe - zmet
    helium = F.try_divide(yhe, hydrogen)
    return {
        "volume": F.try_divide(mass, rho) * F.lit(k.megaparsec**3 / k.hubble**3) * (a * a * a),
        "density": density,
        "hydrogen": hydrogen,
        "helium_ratio": helium / (F.lit(1.0) + helium),
        "n_h": density * hydrogen / F.lit(k.proton_mass),
    }


def sz_weights(mass: Column, mu: Column, uu: Column, a: Column, d2: Column, v: Column, mode: str = "adiabatic", electrons: Column | None = None) -> tuple[Column, Column]:
    """(thermal, kinetic) weights of a gas particle before unit factors.

    'adiabatic' takes the electrons from the mass, 'ne' from a given number for each unit of mass.
    """
    if mode == "adiabatic":
        return F.try_divide(mass * mu * uu, d2), F.try_divide(mass * v, d2 * a)
    if mode == "ne" and electrons is not None:
        return F.try_divide(electrons * mass * mu * uu, d2), F.try_divide(electrons * mass * v, d2 * a)
    raise ValueError("mode is 'adiabatic', or 'ne' with a column of electrons")


def sz_factors(k: Constants = Constants(), sample_rate: float = 1.0, pixel_size: float = 1.0, helium_electrons: float = 2.0) -> dict[str, float]:
    """Factors from weights to the Compton y, the kinetic decrement and the flux for each unit of solid angle, for a pixel's solid angle.

    Masses are in solar masses over h and distances in comoving Mpc/h, so a power of h is left of mass over distance squared.
    """
    mu_electron = 2.0 / (2.0 - k.primordial_helium)
    free = (1.0 - k.primordial_helium * (1.0 - helium_electrons / 4.0)) / (1.0 - k.primordial_helium / 2.0)
    electrons = k.thomson * free / mu_electron * k.solar_mass / k.megaparsec**2 * k.hubble / (sample_rate * pixel_size)
    return {
        "tsz": (k.gamma - 1) * electrons / (k.electron_mass * k.light_speed**2) * 1e10,
        "ksz": -electrons / k.proton_mass * 1e5 / k.light_speed,
        "xray": 1.0 / (sample_rate * pixel_size * 4 * math.pi),
    }


def xray_flux(luminosity: Column, d2: Column, a: Column, k: Constants = Constants()) -> Column:
    """Weight of a band at the observer, L a^2 / d^2, for a distance squared in comoving (Mpc/h)^2; the factor of 4 pi is in ``sz_factors``."""
    return F.try_divide(luminosity * a * a * F.lit(k.hubble**2), d2 * F.lit(k.megaparsec**2))


def metal_ratio(zmet: Column, hydrogen: Column, solar: float = 0.7381 / 0.0134) -> Column:
    """Metals over hydrogen in units of the sun's; solar is the sun's hydrogen over metals."""
    return F.try_divide(F.lit(solar) * zmet, hydrogen)


def luminosity(volume: Column, n_h: Column, log_table: Column) -> Column:
    """erg/s of a band from the logarithm of luminosity over hydrogen density squared."""
    return volume * n_h * n_h * F.pow(F.lit(10.0), log_table)


def rel_change(new: Column, old: Column) -> Column:
    return F.try_divide(new - old, old)


def null_if_fill(c: Column, fill: float = -101.0) -> Column:
    """Null where a property was not measured, which catalogues mark by a fill value."""
    return F.when(c != fill, c)


def _index(v: Column, n: int) -> Column:
    cell = F.when(~F.isnan(v) & (F.abs(v) < 2e9), v).cast("int")
    return F.when((cell >= 0) & (cell < n), cell)


def linear_bin(c: Column, lo: float, hi: float, n: int) -> Column:
    """Bin number by truncation toward zero, null outside of 0 to n-1; values just below lo fall in bin 0."""
    return _index((c.cast("double") - F.lit(float(lo))) / F.lit((hi - lo) / n), n)


def log_bin(c: Column, lo: float, hi: float, n: int) -> Column:
    """As linear_bin in log10; values without a logarithm have no bin."""
    width = (math.log10(hi) - math.log10(lo)) / n
    return _index((F.log10(c.cast("double")) - F.lit(math.log10(lo))) / F.lit(width), n)


def mass_window(c: Column, lo: float, hi: float | None = None, closed: str = "none") -> Column:
    """lo < c < hi, or with closed='left' lo <= c < hi; without hi only the lower cut."""
    low = c >= lo if closed == "left" else c > lo
    return low if hi is None else low & (c < hi)


def has_bit(mask: Column, bit: int = 2) -> Column:
    """Whether a species bit is set; bit 2 marks gas by default."""
    return mask.bitwiseAND(F.lit(1 << bit)) != 0
