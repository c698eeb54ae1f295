"""All queries on the driver's tables, by name."""

from __future__ import annotations

from . import q_calendar, q_evaluate, q_forecast, q_scalars, q_series, q_sources, q_spatial, q_streaming, q_zonal  # noqa: F401
from .base import ORACLE_SQL, QUERIES  # noqa: F401
