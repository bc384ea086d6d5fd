"""Exact coordinates and times from GPS values."""

from __future__ import annotations

from fractions import Fraction

from lumenlake.kernels.limits import ParseError, need


def decimal(value, ref) -> float | None:
    """Degrees of (deg, min, sec) and a reference; None if either is missing, an error if present but invalid.

    The sum is an exact fraction, rounded once.
    """
    if value is None or ref is None:
        return None
    need(isinstance(value, tuple) and len(value) == 3 and all(isinstance(v, (int, Fraction)) and not isinstance(v, bool) for v in value), "coordinate needs three numbers")
    need(isinstance(ref, str), "coordinate reference is not text")
    degrees, minutes, seconds = map(Fraction, value)
    need(degrees >= 0 and 0 <= minutes < 60 and 0 <= seconds < 60, "coordinate is out of range")
    sign = ref.strip().upper()
    need(sign in ("N", "S", "E", "W"), "coordinate reference is invalid")
    exact = degrees + minutes / 60 + seconds / 3600
    return float(-exact if sign in "SW" else exact)


def number(value) -> float | None:
    return float(value) if isinstance(value, (int, Fraction, float)) and not isinstance(value, bool) else None


ALTITUDE = {
    0: (1, "positive ellipsoidal height"), 1: (-1, "negative ellipsoidal height"),
    2: (1, "positive sea-level altitude"), 3: (-1, "negative sea-level altitude"),
}


def altitude(value, ref) -> tuple[float | None, int | None, str | None]:
    """Signed altitude, its reference and what that says."""
    high = number(value)
    code = ref[0] if isinstance(ref, bytes) and len(ref) == 1 else ref if isinstance(ref, int) else None
    if high is None:
        return None, code, None
    if ref is None:
        return high, None, "reference not provided"
    if code in ALTITUDE:
        sign, text = ALTITUDE[code]
        return sign * abs(high), code, text
    return high, code, f"unknown EXIF reference ({code if code is not None else ref})"


def time_text(value) -> str | None:
    if not (isinstance(value, tuple) and len(value) == 3):
        return None
    parts = [number(v) for v in value]
    if any(p is None for p in parts):
        return None
    hours, minutes, seconds = parts
    if not (0 <= hours < 24 and 0 <= minutes < 60 and 0 <= seconds < 60):
        return None
    text = f"{int(seconds):02d}" if seconds.is_integer() else f"{seconds:06.3f}".rstrip("0").rstrip(".")
    return f"{int(hours):02d}:{int(minutes):02d}:{text} UTC"


def date_text(value) -> str | None:
    if not isinstance(value, str):
        return None
    parts = value.split(":")
    return "-".join(parts) if [len(p) for p in parts] == [4, 2, 2] else value


def location(tags: dict) -> dict:
    """The location summary of a GPS directory given as name to value."""
    out = dict.fromkeys(("latitude", "longitude", "altitude", "altitude_ref", "altitude_reference", "gps_date", "gps_time", "image_direction", "error"))
    out["gps_detected"] = bool(tags)
    try:
        out["latitude"] = decimal(tags.get("GPSLatitude"), tags.get("GPSLatitudeRef"))
        out["longitude"] = decimal(tags.get("GPSLongitude"), tags.get("GPSLongitudeRef"))
    except ParseError as e:
        out["error"] = str(e)
    out["altitude"], out["altitude_ref"], out["altitude_reference"] = altitude(tags.get("GPSAltitude"), tags.get("GPSAltitudeRef"))
    out["gps_date"], out["gps_time"] = date_text(tags.get("GPSDateStamp")), time_text(tags.get("GPSTimeStamp"))
    out["image_direction"] = number(tags.get("GPSImgDirection"))
    return out
