"""Tessera: qualifier-aware time-series analytics on PySpark."""
