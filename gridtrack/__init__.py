"""Features of gridded time series found, followed and described on Spark."""

import importlib

_HOMES = {
    "api": ("SimpleTracker", "ExchangeTracker", "HealpixTracker", "Tracker", "load", "preprocess"),
    "operators.exchange": ("Rules", "exchange_link"),
    "operators.linking": ("link",),
    "operators.spectral": ("filter_frame", "map_frames", "regrid", "spectral_filter", "taper", "to_healpix", "to_polar_stereo", "wind_derivatives", "wind_frames"),
    "operators.tracks": ("compare", "splice", "statistics"),
    "functions.sql": ("register_functions",),
    "session": ("session",),
    "sources.formats": ("read_imilast", "read_json", "write"),
    "sources.gridded": ("register",),
}
_HOME = {name: home for home, names in _HOMES.items() for name in names}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module gridtrack has no attribute {name}")
    return getattr(importlib.import_module(f"gridtrack.{_HOME[name]}"), name)
