"""All registered queries of the measurement operators, and their SQL."""

from __future__ import annotations

from plumbline.plans import calibration, changes, metrics, numerics, records, reliability, rubrics, seeds

_FAMILIES = [metrics, calibration, reliability, numerics, seeds, rubrics, records, changes]

QUERIES = {name: query for family in _FAMILIES for name, query in family.QUERIES.items()}
ORACLE_SQL = {name: text for family in _FAMILIES for name, text in family.ORACLE_SQL.items()}
