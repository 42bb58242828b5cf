"""Spark-native analytics over image-product catalogs, correspondences and rasters."""

from skyquilt.session import get_session

__all__ = ["get_session"]
