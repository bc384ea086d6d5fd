"""Texts of a capture: date, exposure, aperture, lens."""

from __future__ import annotations

from datetime import datetime
from fractions import Fraction

ISO_TAGS = ("PhotographicSensitivity", "ISOSpeed", "StandardOutputSensitivity", "RecommendedExposureIndex")


def date_time(value) -> tuple[str | None, str | None]:
    if not isinstance(value, str):
        return None, None
    try:
        at = datetime.strptime(value, "%Y:%m:%d %H:%M:%S")
    except ValueError:
        return value, None
    return at.strftime("%Y-%m-%d"), at.strftime("%H:%M:%S")


def exact(value) -> Fraction | None:
    return Fraction(value) if isinstance(value, (int, Fraction)) and not isinstance(value, bool) else None


def exposure(value) -> str | None:
    x = exact(value)
    if x is None or x <= 0:
        return None
    return f"1/{round(1 / x)} s" if x < 1 else f"{float(x):g} s"


def aperture(value) -> str | None:
    x = exact(value)
    return None if x is None else f"f/{float(x):g}"


def focal(value) -> str | None:
    x = exact(value)
    return None if x is None else f"{float(x):g} mm"


def lens(make, model) -> str | None:
    make = make.strip() if isinstance(make, str) else ""
    model = model.strip() if isinstance(model, str) else ""
    if make and model and not model.casefold().startswith(make.casefold()):
        return f"{make} {model}"
    return model or make or None


def summary(tags: dict) -> dict:
    date, time = date_time(tags.get("DateTimeOriginal"))
    iso = next((tags[n] for n in ISO_TAGS if isinstance(tags.get(n), int)), None)
    return {
        "date": date, "time": time, "exposure": exposure(tags.get("ExposureTime")), "iso": iso, "aperture": aperture(tags.get("FNumber")),
        "focal_length": focal(tags.get("FocalLength")), "lens": lens(tags.get("LensMake"), tags.get("LensModel")),
    }
