"""Spark-native analytics for collections of short flight-tone recordings."""

from flighttone.params import DEFAULT, Params

__all__ = ["DEFAULT", "Params"]
