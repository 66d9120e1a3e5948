"""Spark-native analytics for large-scale candidate screening."""

from sievegrid.session import build_session

__all__ = ["build_session"]
