"""Every query with its SQL twin; importing this package fills the registry."""

from boxeval.queries import boards, boxes, files, governance, groups, ranking, rasters, sources, streams  # noqa: F401
from boxeval.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
