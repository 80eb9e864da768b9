"""orderscope: marketplace order analytics on Spark.

Nine raw tables -> one row per order -> delivered-order fact -> reports and
data-quality checks, all as lazy DataFrame -> DataFrame operators.
"""

from orderscope.plans.commerce import CommerceModel, ModelParams, OPERATOR_NAMES
from orderscope.session import get_session

__all__ = ["CommerceModel", "ModelParams", "OPERATOR_NAMES", "get_session"]
