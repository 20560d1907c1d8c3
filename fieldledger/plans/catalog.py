"""Imports every plan module, so that the registry is complete."""
from . import effects, entities, ingest, pages, profile, recommend, series, streams, text, units  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
