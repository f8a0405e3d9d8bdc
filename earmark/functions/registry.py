"""Plug-in points: named transforms over sample tables and named metrics over evaluation tables.

A plug-in is a function from DataFrames to a DataFrame, so it is planned and distributed like the
built-in operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Transform = Callable[..., DataFrame]
Metric = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]

_transforms: dict[str, Transform] = {}
_metrics: dict[str, Metric] = {}


def transform(name: str) -> Callable[[Transform], Transform]:
    """Register `fn(samples, **params)` under the name used in transform chains."""
    def wrap(fn: Transform) -> Transform:
        _transforms[name] = fn
        return fn

    return wrap


def metric(name: str) -> Callable[[Metric], Metric]:
    """Register `fn(candidates, summary, truth)` as an additional table of an evaluation."""
    def wrap(fn: Metric) -> Metric:
        _metrics[name] = fn
        return fn

    return wrap


def transforms() -> dict[str, Transform]:
    return dict(_transforms)


def metrics() -> dict[str, Metric]:
    return dict(_metrics)
