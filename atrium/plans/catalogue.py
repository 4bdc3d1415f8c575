"""Registry of the venue queries: each module registers its own when it is imported."""

from __future__ import annotations

from . import build, corridors, features, frames, grids, labels, legacy, quality, routes, taps, text, views  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
