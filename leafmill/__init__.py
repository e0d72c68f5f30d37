"""Leafmill: document analytics written as PySpark DataFrame plans."""
