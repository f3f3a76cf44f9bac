"""Importing the groups registers their checks."""

from palisade.checks import live_checks, report_checks, static_checks, traffic_checks  # noqa: F401
from palisade.checks.registry import ORACLE, SPARK

__all__ = ["ORACLE", "SPARK"]
