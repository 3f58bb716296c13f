"""Lazy, order-aware pipelines on PySpark DataFrames."""

from .flow import Flow
from .operators.base import Desc, EmptyFlow, NoOrder, NotFound
from .operators.custom import Collector

__all__ = ["Collector", "Desc", "EmptyFlow", "Flow", "NoOrder", "NotFound"]
