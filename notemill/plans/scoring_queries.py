"""Scoring, medications, social determinants and assertions over synthetic notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from notemill.functions import spans as S
from notemill.operators import assertions as A
from notemill.operators import entities as E
from notemill.operators import medications as M
from notemill.operators import scoring as R
from notemill.operators import social as D
from notemill.plans.clinical_queries import APART, ICD, NOTES, _codes, _fold_sql, _scan_sql
from notemill.sources import notes as N


def icd_rules(spark, sf):
    return R.icd_codes(N.notes(spark, sf), "note_id")


def icd_chapter(spark, sf):
    return _codes(spark, sf).groupBy(R.chapter(F.col("icd_code")).alias("chapter")).agg(F.count("*").alias("n"))


def risk_total(spark, sf):
    return R.risk(N.notes(spark, sf), "note_id")


def risk_interactions(spark, sf):
    return R.interactions(M.extract(N.notes(spark, sf), "note_id").select("note_id", "generic"), "note_id", "generic")


def med_extract(spark, sf):
    return M.extract(N.notes(spark, sf), "note_id")


def med_totals(spark, sf):
    return M.extract(N.notes(spark, sf), "note_id").groupBy("generic", "route", "frequency").agg(F.count("*").alias("n"), F.round(F.avg("dose"), 6).alias("avg_dose"))


def sdoh_extract(spark, sf):
    return D.extract(N.notes(spark, sf), "note_id")


def sdoh_summary(spark, sf):
    return D.extract(N.notes(spark, sf), "note_id").groupBy("domain", "sentiment").agg(F.count("*").alias("n"))


CONDITIONS = r"(?i)\b(?:fever|pneumonia|hypertension|heart failure|diabetes mellitus|chest pain|stroke|COPD|pulmonary embolism|myocardial infarction)\b"


def assertion_status(spark, sf):
    n = N.notes(spark, sf)
    return A.detect(S.scan(n, CONDITIONS, "note_id", before=A.BEFORE, after=A.AFTER)).select("note_id", "start", "match", "status", "assertion_confidence")


def assertion_totals(spark, sf):
    n = N.notes(spark, sf)
    return A.detect(E.extract(n, "note_id", before=A.BEFORE, after=A.AFTER)).groupBy("type", "status").agg(F.count("*").alias("n"))


def _hits(keys) -> str:
    return " + ".join(f"contains(t, '{k}')::int" for k in keys)


ICD_SQL = "with " + NOTES + ", l as (select note_id, lower(text) as t from notes), h as (" + " union all ".join(f"select note_id, {i} as i, '{c}' as code, round(least({p}e0 + 0.03e0 * ({_hits(k)} - 1), 1), 4) as confidence, {_hits(k)} as n from l" for i, (k, c, _, p) in enumerate(R.ICD_RULES)) + ")"


def _cat(values: str) -> str:
    return f"case when len({values}) > 0 then round(least(list_max({values}) * 0.6e0 + list_sum({values}) * 0.4e0 / len({values}), 1) * 100, 2) else 0 end"


def _list(parts) -> str:
    return "list_filter([" + ", ".join(f"case when {c} then {v!r}::double end" for c, v in parts) + "], lambda x: x is not null)"


RISK_SQL = f"""with {NOTES}, l as (select note_id, lower(text) as t, text from notes),
v as (select note_id, {_list([(f"contains(t, '{d}')", w * (w * 0.8)) for d, w in R.HIGH_RISK.items()])} as a, {_list([(f"contains(t, '{d}')", w * w) for d, w in R.URGENT.items()])} as b, {_list([(f"regexp_matches(text, '{p}')", 0.75 * 0.7) for p in R.FOLLOW_UP])} as c from l),
s as (select note_id, {_cat('a')} as medication_risk, {_cat('b')} as diagnostic_complexity, {_cat('c')} as follow_up_urgency from v),
o as (select *, round(least(medication_risk * 0.35e0 + diagnostic_complexity * 0.4e0 + follow_up_urgency * 0.25e0, 100), 4) as overall_score from s)
select *, case when overall_score >= 80 then 'critical' when overall_score >= 60 then 'high' when overall_score >= 35 then 'moderate' else 'low' end as risk_level from o"""


def _first_sql(context: str, rules, default: str) -> str:
    out = "case"
    for p, name in rules:
        q = p.replace("'", "''")
        out += f" when regexp_matches({context}, '{q}') then " + (f"'q' || regexp_extract({context}, '{q}', 1) || 'h'" if "{0}" in name else f"'{name}'")
    return out + f" else {default} end"


MED = f"""with {NOTES}, raw as ({_scan_sql('notes', 'note_id', M.pattern(M.DRUGS), '1 as one')}),
near as (select raw.note_id, start, "end" as stop, lower(match) as drug, substring(text, "end" + 1, 120) as c, substring(text, greatest(start - 60, 0) + 1, start - greatest(start - 60, 0)) as b, regexp_matches(text, '{M.SECTION}') as sec from raw join notes using (note_id)),
att as (select *, case drug {" ".join(f"when '{k}' then '{v}'" for k, v in M.DRUGS.items())} end as generic, try_cast(replace(regexp_extract(c, '{M.DOSE}', 1), ',', '') as double) as dose, nullif(lower(regexp_extract(c, '{M.DOSE}', 3)), '') as unit,
 {_first_sql('c', M.ROUTES, "'unknown'")} as route, {_first_sql('c', M.FREQUENCIES, 'null')} as frequency, regexp_matches(c, '{M.PRN}') as prn, {_first_sql("(b || ' ' || c)", M.STATUSES, "'unknown'")} as status from near),
cf as (select *, round(least(0.5e0 + case when dose is not null then 0.15e0 else 0 end + case when route <> 'unknown' then 0.1e0 else 0 end + case when frequency is not null then 0.1e0 else 0 end + case when sec then 0.1e0 else 0 end + case when generic <> drug then 0.05e0 else 0 end, 1), 3) as confidence from att),
fo as ({_fold_sql('cf', 'note_id', '-confidence, start', APART, 'struct_pack(start := start, stop := stop, drug := drug, generic := generic, dose := dose, unit := unit, route := route, frequency := frequency, prn := prn, status := status, confidence := confidence)')}),
med as (select note_id, s.drug as drug, s.generic as generic, s.dose as dose, s.unit as unit, s.route as route, s.frequency as frequency, s.prn as prn, s.status as status, s.confidence as confidence, s.start as start, s.stop as "end" from fo)"""
SDOH = f"""with {NOTES}, raw as ({" union all ".join(_scan_sql('notes', 'note_id', r[0], f"{i} as rule, '{r[1]}' as domain, '{r[2]}' as sentiment, {r[3]}::double as confidence, '{r[4]}' as trigger") for i, r in enumerate(D.RULES))}),
fo as ({_fold_sql('raw', 'note_id', '-confidence, start, rule', APART, 'struct_pack(start := start, stop := "end", domain := domain, sentiment := sentiment, trigger := trigger, confidence := confidence, match := match)')}),
sd as (select note_id, s.domain as domain, s.sentiment as sentiment, s.trigger as trigger, s.confidence as confidence, s.start as start, s.stop as "end", s.match as match from fo)"""
PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in R.INTERACTIONS)
ORACLES = {
    "icd_rules": ICD_SQL + " select note_id, k as rank, code, confidence from (select *, row_number() over (partition by note_id order by confidence desc, i)::int as k from h where n > 0) where k <= 10",
    "icd_chapter": f"with c as (select {ICD}[(o_orderkey % {len(ICD)} + 1)::int] as icd_code from orders) select case left(icd_code, 1) {' '.join(f"when '{x}' then '{v}'" for k, v in R.CHAPTERS.items() for x in k)} end as chapter, count(*) as n from c group by 1",
    "risk_total": RISK_SQL,
    "risk_interactions": MED + f" select distinct x.note_id, least(a, b) || ' + ' || greatest(a, b) as pair from (values {PAIRS}) p(a, b) join med x on x.generic = a join med y on y.generic = b and x.note_id = y.note_id",
    "med_extract": MED + " select * from med",
    "med_totals": MED + " select generic, route, frequency, count(*) as n, round(avg(dose), 6) as avg_dose from med group by all",
    "sdoh_extract": SDOH + " select * from sd",
    "sdoh_summary": SDOH + " select domain, sentiment, count(*) as n from sd group by all",
}
QUERIES = {name: globals()[name] for name in (*ORACLES, "assertion_status", "assertion_totals")}
