"""Raster flood simulation and earthwork search as Spark queries."""
