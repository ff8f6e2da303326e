"""All queries of the catalogue engine, by name."""

from __future__ import annotations

from . import classifiers, comparisons, designs, detection, imaging, matching, photometry, protocols, residuals, selections
from .registry import ORACLES, QUERIES

MODULES = (selections, matching, comparisons, designs, imaging, residuals, photometry, protocols, classifiers, detection)
__all__ = ["MODULES", "ORACLES", "QUERIES"]
