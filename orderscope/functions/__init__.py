"""Column expressions shared by the operators."""

from orderscope.functions import buckets, metrics, timeutil

__all__ = ["buckets", "metrics", "timeutil"]
