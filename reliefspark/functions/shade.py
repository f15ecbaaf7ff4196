"""Per-cell shading maths: slope, illumination, codes, stretches, blends.

Codes are bytes: 0 means "no data", 1..255 carry the value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from reliefspark.functions.geo import _c

# Light azimuths of the multidirectional shading, bands (m) of the multiscale composite.
MULTI_AZIMUTHS = (225.0, 270.0, 315.0, 360.0)
MSTP_BANDS = {"local": (1.5, 5.0), "meso": (12.0, 27.0), "broad": (55.0, 100.0)}


def clean_height(z, declared: float | None = None) -> Column:
    """Height with every form of "no data" turned into NULL.

    NaN and values beyond +-9000 always count as no data, a declared value additionally.
    """
    z = _c(z).cast("double")
    missing = F.isnan(z) | (F.abs(z) > 9000.0)
    if declared is not None and not math.isnan(declared):
        missing = missing | (z == F.lit(float(declared)))
    return F.when(~missing, z)


def code_unit(value: Column) -> Column:
    """0..1 -> 1..255, NULL -> 0."""
    return F.coalesce(
        F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)) * 254.0 + 1.0).cast("int"), F.lit(0))


def slope_degrees(p, q) -> Column:
    p, q = _c(p), _c(q)
    return F.degrees(F.atan(F.sqrt(p * p + q * q)))


def slope_code(p, q) -> Column:
    return F.coalesce(F.floor(slope_degrees(p, q) * 254.0 / 90.0 + 1.0).cast("int"), F.lit(0))


def hillshade(p, q, azimuth: float, altitude: float = 25.0, z_factor: float = 1.0) -> Column:
    """Lambertian illumination 0..1 from the gradient (p to the east, q to the south)."""
    p, q = _c(p) * F.lit(float(z_factor)), _c(q) * F.lit(float(z_factor))
    alt, az = math.radians(altitude), math.radians(azimuth)
    lit = F.lit(math.sin(alt)) + F.lit(math.cos(alt)) * (F.lit(math.cos(az)) * q - F.lit(math.sin(az)) * p)
    return F.greatest(F.lit(0.0), lit / F.sqrt(p * p + q * q + 1.0))


def hillshade_multi(p, q, altitude: float = 25.0, z_factor: float = 1.0) -> Column:
    """Four lights, each weighted by the squared sine between light and aspect."""
    p, q = _c(p), _c(q)
    steep = p * p + q * q
    total, weight = F.lit(0.0), F.lit(0.0)
    for azimuth in MULTI_AZIMUTHS:
        sin_az, cos_az = math.sin(math.radians(azimuth)), math.cos(math.radians(azimuth))
        # sin(azimuth - aspect) from the gradient; level ground counts as facing north
        across = q * F.lit(sin_az) + p * F.lit(cos_az)
        w = F.when(steep > 0, across * across / steep).otherwise(F.lit(sin_az * sin_az))
        total = total + w * hillshade(p, q, azimuth, altitude, z_factor)
        weight = weight + w
    return total / weight


def stretch(value, low, high) -> Column:
    """Linear 0..1 between two bounds; equal bounds give 0.5."""
    value, low, high = _c(value), _c(low), _c(high)
    unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))
    return F.when(high > low, unit).when(value.isNotNull(), 0.5)


def gamma(unit, exponent: float) -> Column:
    return F.pow(_c(unit), F.lit(float(exponent)))


def mirror_gamma(unit, exponent: float) -> Column:
    """Gamma taken from the white end: the background goes white, hollows stay dark."""
    return F.lit(1.0) - F.pow(F.lit(1.0) - _c(unit), F.lit(float(exponent)))


def overlay(base: Column, top: Column) -> Column:
    return F.when(base <= 0.5, base * top * 2.0).otherwise(
        F.lit(1.0) - (F.lit(1.0) - base) * (F.lit(1.0) - top) * 2.0)


def rrim_red(slope_deg) -> Column:
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(slope_deg) / 45.0))
    return F.floor(F.pow(share, 0.7) * 255.0).cast("int")


def rrim_grey(unit_lrm) -> Column:
    return F.floor(F.pow(_c(unit_lrm), 0.8) * 255.0).cast("int")


def vat_code(svf_code, opos_code, slope_code_, exponent: float = 2.0) -> Column:
    """Blend of sky view, positive openness and slope; gamma last; no sky view -> black."""
    s = _c(svf_code).cast("double") / 255.0
    o = _c(opos_code).cast("double") / 255.0
    steep = _c(slope_code_).cast("double") / 255.0
    blend = (s * 0.5 + overlay(s, o) * 0.5) * (F.lit(1.0) - steep * 0.5)
    return F.when(_c(svf_code) == 0, 0).otherwise(
        F.floor(F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), blend)), F.lit(float(exponent))) * 254.0 + 1.0)
        .cast("int"))


def deviation(z, smooth_z, smooth_z2) -> Column:
    """Standardised position: distance to the local mean in local standard deviations."""
    z, m, m2 = _c(z), _c(smooth_z), _c(smooth_z2)
    return (z - m) / (F.sqrt(F.greatest(m2 - m * m, F.lit(0.0))) + 1e-3)


def deviation_code(value: Column, limit: float = 2.5) -> Column:
    """Deviation within +-limit as a code (own range)."""
    return code_unit((_c(value) + F.lit(float(limit))) / F.lit(2.0 * limit))


def e4mstp_channel(mstp_code, svf_code, opos_code, oneg_code, slope_code_, fine_code, broad_code,
                   exponent: float = 0.8) -> Column:
    """One colour channel of the composite in the manner of e4MSTP.

    Own weights: openness difference at half strength over the two relief residuals, darkened by slope,
    sky view multiplied at a quarter, the multiscale channel laid over at 90 %.  No openness -> black.
    """
    def unit(code):
        return _c(code).cast("double") / 255.0

    difference = (unit(opos_code) - unit(oneg_code) + 1.0) / 2.0
    relief = (unit(fine_code) + unit(broad_code)) / 2.0
    base = (difference * 0.5 + relief * 0.5) * (F.lit(1.0) - unit(slope_code_) * 0.5)
    shaded = base * (F.lit(0.75) + unit(svf_code) * 0.25)
    mixed = shaded * 0.1 + overlay(shaded, unit(mstp_code)) * 0.9
    return F.when(_c(opos_code) == 0, 0).otherwise(
        F.floor(F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mixed)), F.lit(float(exponent))) * 254.0 + 1.0)
        .cast("int"))
