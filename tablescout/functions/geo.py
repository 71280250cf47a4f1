"""Great-circle distances and the latitude/longitude box as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tablescout import fixed_values as V


def acos_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Spherical law of cosines; the cosine is clamped, resolution near zero is about 1e-4 km."""
    a, b = F.radians(lat1), F.radians(lat2)
    cosine = F.cos(a) * F.cos(b) * F.cos(F.radians(lon2) - F.radians(lon1)) + F.sin(a) * F.sin(b)
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine))
    return F.lit(V.EARTH_RADIUS_KM) * F.acos(clamped)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """True haversine, exact near zero."""
    half_lat = F.sin(F.radians(lat2 - lat1) / F.lit(2.0))
    half_lon = F.sin(F.radians(lon2 - lon1) / F.lit(2.0))
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(V.EARTH_RADIUS_KM) * F.lit(2.0) * F.atan2(F.sqrt(chord), F.sqrt(F.lit(1.0) - chord))


def box_bounds(lat: Column, lon: Column, max_km: Column) -> dict[str, Column]:
    """Box edges. No wrap at the antimeridian or poles; narrower than the circle far north or south."""
    half_lat = max_km / F.lit(V.KM_PER_DEGREE)
    narrowed = F.greatest(F.lit(V.MIN_COS_LATITUDE), F.cos(F.radians(lat)))
    half_lon = max_km / (F.lit(V.KM_PER_DEGREE) * narrowed)
    return {
        "lat_min": lat - half_lat,
        "lat_max": lat + half_lat,
        "lon_min": lon - half_lon,
        "lon_max": lon + half_lon,
    }


def has_position(lat: Column, lon: Column) -> Column:
    """Whether a position can take part in a search: both numbers there, and neither beyond a billion degrees."""
    return (F.abs(lat) < 1e9) & (F.abs(lon) < 1e9)


def box_condition(lat: Column, lon: Column, bounds: dict[str, Column]) -> Column:
    """Inclusive at both ends."""
    return lat.between(bounds["lat_min"], bounds["lat_max"]) & lon.between(bounds["lon_min"], bounds["lon_max"])


def price_limit(preferred_price: Column) -> Column:
    """-1 switches the price filter off."""
    return F.when(preferred_price <= 0, F.lit(-1)).otherwise(preferred_price)


def attribute_condition(rating: Column, price: Column, min_rating: Column, max_price: Column) -> Column:
    """A filter that is on drops a null rating or price."""
    return ((min_rating <= 0) | (rating >= min_rating)) & ((max_price < 0) | (price <= max_price))
