"""Registered queries and the SQL each one is checked against."""

from placewise.catalog import commerce, files, indices, media, registry, scalars, spatial  # noqa: F401
from placewise.catalog.base import ORACLES, QUERIES  # noqa: F401
