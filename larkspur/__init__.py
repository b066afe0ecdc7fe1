"""Larkspur: keyed collections, search, vectors, graphs and temporal data as Spark DataFrame operators."""

__version__ = "0.1.0"
