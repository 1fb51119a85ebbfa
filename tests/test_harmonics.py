import math
from decimal import Decimal, getcontext

import numpy as np
import pytest

from skyloom.operators import harmonics as S


def precise(m, lmax, z):
    """The recursion in 60 digits, which has no underflow."""
    getcontext().prec = 60
    z = Decimal(z)
    four_pi = Decimal("12.566370614359172953850573533118011536788677597500423283899778")
    now = (Decimal(2 * m + 1) / four_pi).sqrt()
    for k in range(1, m + 1):
        now *= -((1 - z * z) * (2 * k - 1) / (2 * k)).sqrt()
    before, out = Decimal(0), {m: now}
    for el in range(m + 1, lmax + 1):
        a = (Decimal(4 * el * el - 1) / (el * el - m * m)).sqrt()
        b = (Decimal((el - 1) ** 2 - m * m) / (4 * (el - 1) ** 2 - 1)).sqrt()
        before, now = now, a * (z * now - b * before)
        out[el] = now
    return out


@pytest.mark.parametrize("m", [0, 1, 700, 1200, 2500, 3990])
def test_legendre_functions_up_to_l_4000(m):
    sines = [0.02, 0.42, 0.9]
    z = [math.sqrt(1 - s * s) for s in sines]
    got = dict(S.legendre(m, 4000, np.array(z)))
    for k, x in enumerate(z):
        want = precise(m, 4000, x)
        for el in (m, min(4000, m + 1), (m + 4000) // 2, 3000, 4000):
            if el >= m:
                assert got[el][k] == pytest.approx(float(want[el]), rel=1e-9, abs=1e-12), (el, x)
    if m == 1200:
        assert abs(got[3000][1]) > 0.5


def coefficients(lmax, seed):
    rng = np.random.default_rng(seed)
    return [(el, m, float(rng.normal()), float(rng.normal()) if m else 0.0) for el in range(lmax + 1) for m in range(el + 1)]


@pytest.mark.parametrize(("nside", "lmax", "rows", "most"), [(8, 16, coefficients(16, 1), 2e-4), (16, 16, coefficients(16, 1), 1e-6), (8, 8, [(7, 3, 1.0, -0.5)], 1e-6), (4, 8, [(0, 0, 2.0, 0.0), (8, 8, 0.0, 1.0)], 2e-4)])
def test_rounds_bring_back_the_coefficients(spark, nside, lmax, rows, most):
    alm = spark.createDataFrame(rows, "l int, m int, re double, im double")
    sky = S.synthesis(alm, nside, lmax).cache()
    assert sky.count() == 12 * nside * nside
    want = {(el, m): complex(re, im) for el, m, re, im in rows}
    off = {}
    for rounds in (0, 3):
        found = {(r.l, r.m): complex(r.re, r.im) for r in S.harmonics(sky, nside, lmax, "v", rounds=rounds).collect()}
        assert len(found) == (lmax + 1) * (lmax + 2) // 2
        off[rounds] = max(abs(found[k] - want.get(k, 0)) for k in found)
    assert off[3] < most and off[3] < off[0] / 100, off


def test_synthesis_against_the_plain_sum(spark):
    nside, rows = 4, coefficients(6, 3)
    got = {r.idx: r.v for r in S.synthesis(spark.createDataFrame(rows, "l int, m int, re double, im double"), nside, 6).collect()}
    for i in range(1, 4 * nside):
        first, size, shift, z = S.ring_shape(i, nside)
        p = {(el, m): v[0] for m in range(7) for el, v in S.legendre(m, 6, np.array([z]))}
        for k in range(size):
            phi = 2 * math.pi * (k + shift) / size
            want = sum((1 if m == 0 else 2) * p[el, m] * (complex(re, im) * complex(math.cos(m * phi), math.sin(m * phi))).real for el, m, re, im in rows)
            assert got[first + k] == pytest.approx(want, abs=1e-10)
