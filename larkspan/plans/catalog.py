"""All registered queries of the library and their SQL."""

from __future__ import annotations

from larkspan.plans import corpora, detection, files, gating, measurement

_PARTS = (detection, gating, measurement, corpora, files)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: text for part in _PARTS for name, text in part.ORACLES.items()}
