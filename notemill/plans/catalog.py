"""All queries by name, and the SQL that each must agree with."""

from __future__ import annotations

from notemill.plans import analysis_queries, care_queries, clinical_queries, context_queries, detail_queries, final_queries, index_queries, monitor_queries, note_queries, scoring_queries, state_queries, stream_queries, text_queries

_PARTS = (text_queries, monitor_queries, clinical_queries, scoring_queries, context_queries, stream_queries, note_queries, care_queries, final_queries, index_queries, state_queries, analysis_queries, detail_queries)
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _part in _PARTS:
    QUERIES.update(_part.QUERIES)
    ORACLES.update(_part.ORACLES)
