"""The registry of reports, with SQL for those that SQL can express."""

from . import base, experiment_reports, interval_reports, panel_reports, stream_reports, summary_reports, table_reports  # noqa: F401
from .panel_reports import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
