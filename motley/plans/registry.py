"""Every registered query of the library and its SQL equivalent, by name."""

from __future__ import annotations

from motley.plans import audit, cluster, corpus, evaluate, inference, language, results, selection, series, stats, structure, text, texteval, vectors

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (text, corpus, results, stats, series, vectors, selection, evaluate, audit, cluster, inference, texteval, structure, language):
    QUERIES.update(_module.R.queries)
    ORACLES.update(_module.R.oracles)
