"""DataFrame -> DataFrame operators: the order model, reports and data-quality jobs."""

from orderscope.operators import model, quality, reports

__all__ = ["model", "quality", "reports"]
