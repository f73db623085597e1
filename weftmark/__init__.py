"""Retail and event analytics as Spark DataFrame jobs."""

from weftmark.config import DetectorParams

__all__ = ["DetectorParams"]
