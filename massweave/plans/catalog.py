"""All registered queries and their SQL."""

from __future__ import annotations

from massweave.plans import formulas, matching, peaks, signals, spectra
from massweave.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "formulas", "matching", "peaks", "signals", "spectra"]
