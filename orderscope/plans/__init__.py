"""Wiring of operators into the full model (and its materialised tables), plus SQL views and jobs."""

from orderscope.plans.commerce import OPERATOR_NAMES, CommerceModel, ModelParams

__all__ = ["CommerceModel", "ModelParams", "OPERATOR_NAMES"]
