"""Parameterised reports over the wide tables.

``REPORTS`` maps a report's name to its function; each takes
:class:`ReportTables` and keyword parameters and returns a DataFrame.
"""

from entitylake.plans.reports import affiliations, insights, pairs, sentiment, trends
from entitylake.plans.reports.common import ANY, REPORTS, ReportTables

__all__ = ["ANY", "REPORTS", "ReportTables", "affiliations", "insights", "pairs", "sentiment", "trends"]
