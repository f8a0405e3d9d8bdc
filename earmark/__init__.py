"""Segment-vector matching and robustness evaluation as PySpark DataFrame operators."""
