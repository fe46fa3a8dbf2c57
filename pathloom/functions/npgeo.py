"""Vectorised geometry in numpy, for the Arrow kernels."""

from __future__ import annotations

import numpy as np

EARTH_KM = 6371.0


def haversine_m(lat1, lon1, lat2, lon2):
    """Great-circle distance in metres."""
    lat1, lon1, lat2, lon2 = (np.radians(x) for x in (lat1, lon1, lat2, lon2))
    a = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    a = np.clip(a, 0.0, 1.0)
    return 2000.0 * EARTH_KM * np.arctan2(np.sqrt(a), np.sqrt(1 - a))


def text_time(micros: np.ndarray) -> np.ndarray:
    """Microseconds since 1970 as ``yyyy-MM-dd HH:mm:ss``."""
    s = np.datetime_as_string(np.asarray(micros, "int64").astype("datetime64[us]").astype("datetime64[s]"))
    return np.char.replace(s, "T", " ").astype(object) if len(s) else np.empty(0, object)
