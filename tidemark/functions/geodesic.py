"""Length of lines on the WGS84 ellipsoid, for Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

import tidemark.functions.shipping  # noqa: F401

A, FLAT = 6378137.0, 1 / 298.257223563


def inverse(lon1, lat1, lon2, lat2):
    """Vincenty's inverse problem, vectorised; nearly antipodal pairs, which a road's
    neighbouring vertices never are, keep the last iterate."""
    b = A * (1 - FLAT)
    u1, u2 = np.arctan((1 - FLAT) * np.tan(np.radians(lat1))), np.arctan((1 - FLAT) * np.tan(np.radians(lat2)))
    apart = np.radians(lon2 - lon1)
    lam = apart.copy()
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(100):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
            cs = s1 * s2 + c1 * c2 * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss > 0, c1 * c2 * sl / ss, 0.0)
            ca2 = 1 - sa * sa
            cm = np.where(ca2 > 0, cs - 2 * s1 * s2 / ca2, 0.0)
            k = FLAT / 16 * ca2 * (4 + FLAT * (4 - 3 * ca2))
            new = apart + (1 - k) * FLAT * sa * (sigma + k * ss * (cm + k * cs * (2 * cm * cm - 1)))
            moved = np.abs(new - lam).max(initial=0)
            lam = new
            if moved < 1e-13:
                break
        w = ca2 * (A * A - b * b) / (b * b)
        big = 1 + w / 16384 * (4096 + w * (w * (320 - 175 * w) - 768))
        small = w / 1024 * (256 + w * (w * (74 - 47 * w) - 128))
        ds = small * ss * (cm + small / 4 * (cs * (2 * cm * cm - 1) - small / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
        return b * big * (sigma - ds)


@F.pandas_udf(DoubleType())
def geodesic_length(xs: pd.Series, ys: pd.Series) -> pd.Series:
    """Metres along the vertices given by arrays of longitudes and latitudes; null for null."""
    out = []
    for x, y in zip(xs, ys, strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        x, y = np.asarray(x, float), np.asarray(y, float)
        out.append(float(inverse(x[:-1], y[:-1], x[1:], y[1:]).sum()) if len(x) > 1 else 0.0)
    return pd.Series(out, dtype="float64")
