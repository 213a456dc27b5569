"""All registered queries of the voxel engine."""

from . import file_queries, model_queries, queries, voxel_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
