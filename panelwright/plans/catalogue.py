"""All registered queries."""

from panelwright.plans import q_aggregate, q_domain, q_join, q_scan, q_stat, q_window  # noqa: F401
from panelwright.plans.registry import QUERIES

__all__ = ["QUERIES"]
