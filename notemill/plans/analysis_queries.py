"""The analysis of all notes in one pass; what it finds must be what each module finds alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from notemill.operators import analysis as A
from notemill.operators import frequencies
from notemill.plans import care_queries, clinical_queries, context_queries, note_queries, scoring_queries
from notemill.plans.clinical_queries import NOTES, _scan_sql
from notemill.plans.context_queries import REF
from notemill.sources import notes as N

#: Modules and the query that each must agree with.
ALONE = {"entities": "ner_rules", "phi": "phi_detect", "vitals": "vitals_extract", "medications": "med_extract", "allergies": "allergy_extract", "temporal": "temporal_extract", "determinants": "sdoh_extract", "sections": "sections_parse"}
_KNOWN = {**clinical_queries.ORACLES, **context_queries.ORACLES, **scoring_queries.ORACLES, **note_queries.ORACLES, **care_queries.ORACLES}


def analysis_spans(spark, sf):
    """note_id, module, start, end of everything that the one pass finds."""
    told = A.analyse(N.notes(spark, sf), REF, "note_id", modules=list(ALONE))
    each = []
    for m in ALONE:
        low, high = ("header_start", "header_end") if m == "sections" else ("start", "end")
        each.append(F.transform(m, lambda x: F.struct(F.lit(m).alias("module"), x[low].alias("start"), x[high].alias("end"))))
    return told.select("note_id", F.inline(F.concat(*each)))


def analysis_notes(spark, sf):
    """note_id, doc_type, grade, risk_level, n_entities, n_drugs, errors: with a component of the user's own whose rule is broken, which harms no other."""
    told = A.analyse(N.notes(spark, sf), REF, "note_id", own={"broken": [("(unclosed",)]})
    return told.select("note_id", "document_type.doc_type", "quality.grade", "risk.risk_level", F.size("entities").cast("bigint").alias("n_entities"), F.size("medications").cast("bigint").alias("n_drugs"), F.array_join(F.map_keys("component_errors"), ",").alias("errors"))


def dose_frequencies(spark, sf):
    return frequencies.extract(N.notes(spark, sf), "note_id")


def _spans_sql() -> str:
    at = lambda m: "header_start, header_end" if m == "sections" else 'start, "end"'
    return " union all ".join(f"""select note_id, '{m}' as module, {at(m).replace(", ", " as start, ", 1) if m == "sections" else at(m)}{' as "end"' if m == "sections" else ""} from ({_KNOWN[q]})""" for m, q in ALONE.items())


_COUNTS = "".join(f" left join (select note_id, count(*) as {n} from ({_KNOWN[q]}) group by note_id) as c_{n} using (note_id)" for n, q in (("n_entities", "ner_rules"), ("n_drugs", "med_extract")))
_LABELS = "".join(f" join (select note_id, {c} from ({_KNOWN[q]})) as r_{c} using (note_id)" for q, c in (("doc_class", "doc_type"), ("quality_scores", "grade"), ("risk_total", "risk_level")))
# in these notes no two of the rules' matches overlap
_TIMES = "case rule when 0 then 1 when 1 then case lower(match) " + " ".join(f"when '{k}' then {n}" for k, (n, _) in frequencies.CODES.items()) + " end when 4 then 0 else 1 end"
_PERIOD = "case rule when 0 then regexp_extract(match, '[0-9]+')::double when 1 then case lower(match) " + " ".join(f"when '{k}' then {h}" for k, (_, h) in frequencies.CODES.items()) + " end end"
FREQUENCIES = f"""with {NOTES}, f as ({" union all ".join(_scan_sql("notes", "note_id", r[0], f"{i} as rule") for i, r in enumerate(frequencies.RULES))})
select note_id, start, "end", match, round(({_TIMES}) * 24 / ({_PERIOD}), 6)::double as times_per_day, round(({_PERIOD}) / ({_TIMES})::double, 6)::double as interval_hours, ends_with(lower(match), 'prn') as as_needed from f"""
ORACLES = {
    "dose_frequencies": FREQUENCIES,
    "analysis_spans": _spans_sql(),
    "analysis_notes": f"with {NOTES} select note_id, doc_type, grade, risk_level, coalesce(n_entities, 0) as n_entities, coalesce(n_drugs, 0) as n_drugs, 'broken' as errors from notes{_COUNTS}{_LABELS}",
}
QUERIES = {name: globals()[name] for name in ORACLES}
