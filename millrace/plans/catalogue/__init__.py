"""Every operator as a runnable query over the given tables, with equivalent SQL where there is one."""

from millrace.plans.catalogue import flows, grids, models, profiles, regimes, scans, series  # noqa: F401
from millrace.plans.catalogue.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
