"""Clinical operators over synthetic notes (and over documents where its text has something to find)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.functions import spans as S
from notemill.operators import comorbidity as C
from notemill.operators import entities as E
from notemill.operators import phi as P
from notemill.operators import sections as X
from notemill.operators import vitals as V
from notemill.sources import notes as N
from notemill.sources.scan import spread


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id")


def notes_table(spark, sf):
    return N.notes(spark, sf).select("note_id", "patient_id", F.md5("text").alias("md5"))


def phi_documents(spark, sf):
    return P.detect(_docs(spark, sf), types=["EMAIL", "PHONE", "IP_ADDRESS", "URL"])


def phi_detect(spark, sf):
    return P.detect(N.notes(spark, sf), "note_id", types=PHI_TYPES)


def _phi(spark, sf, strategy):
    return P.replaced(N.notes(spark, sf).select("note_id", "text"), strategy, types=PHI_TYPES).select("note_id", F.md5("text").alias("md5"), F.length("text").cast("bigint").alias("n"))


def phi_redact(spark, sf):
    return _phi(spark, sf, "redact")


def phi_mask(spark, sf):
    return _phi(spark, sf, "mask")


def phi_surrogate(spark, sf):
    return _phi(spark, sf, "surrogate")


def phi_totals(spark, sf):
    return phi_detect(spark, sf).groupBy("type").agg(F.count("*").alias("n"))


def vitals_extract(spark, sf):
    return V.extract(N.notes(spark, sf), "note_id")


def vitals_summary(spark, sf):
    return V.summary(V.extract(N.notes(spark, sf), "note_id"))


def vitals_bmi(spark, sf):
    return V.body_mass(N.notes(spark, sf), "note_id")


def ner_rules(spark, sf):
    return E.extract(N.notes(spark, sf), "note_id").select("note_id", "type", "start", "end", "match")


def ner_modifiers(spark, sf):
    return E.with_modifiers(E.extract(N.notes(spark, sf), "note_id")).groupBy("type", "is_negated", "is_uncertain").agg(F.count("*").alias("n"))


def sections_parse(spark, sf):
    return X.parse(N.notes(spark, sf), "note_id")


def section_at(spark, sf):
    """Entities and headers in one reading of the texts, put together in the text's row."""
    n, header = S.found(N.notes(spark, sf).select("note_id", "text"), [*E.RULES, (X.HEADER,)]), len(E.RULES)
    ours = lambda yes: F.filter("spans", lambda x: (x["rule"] == header) == yes)
    kept = F.transform(E.told(ours(False)), lambda x: F.struct(x["type"], x["start"]))
    return n.select(F.inline(X.placed(kept, X.told(ours(True), F.col("text"))))).groupBy("type", "section").agg(F.count("*").alias("n"))


ICD = ["I21.9", "E11.9", "E11.2", "I50.1", "C50.9", "C78.0", "K70.4", "K73.2", "J44.1", "N18.3", "B20", "Z00.0", "M05.2"]


def _codes(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select("o_custkey", F.element_at(F.lit(ICD), (F.col("o_orderkey") % len(ICD) + 1).cast("int")).alias("icd_code"))


def charlson_codes(spark, sf):
    return C.match_codes(_codes(spark, sf), "o_custkey")


def charlson_index(spark, sf):
    return C.index(C.match_codes(_codes(spark, sf), "o_custkey"), "o_custkey")


def charlson_text(spark, sf):
    return C.match_text(N.notes(spark, sf), "note_id")


def charlson_batch(spark, sf):
    return charlson_index(spark, sf).groupBy("risk_group").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("avg_score"), F.max("score").alias("max_score"))


def charlson_age(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", (F.col("p_partkey") % 70 + 30).alias("age"))
    s = C.age_points(F.col("age"))
    return p.select("p_partkey", s.alias("points"), F.round(C.mortality(s), 4).alias("ten_year_mortality"), C.risk_group(s).alias("risk_group"))


def _raw(pattern: str) -> str:
    """The pattern for RE2: without look-around, which these notes never need."""
    for look in (r"(?<!\d[./])", r"(?<![/\d])", r"(?!\s*°?\s*[FfCc])", r"(?!000|666|9\d{2})", r"(?!00)", r"(?!0000)"):
        pattern = pattern.replace(look, "")
    return pattern.replace("'", "''")


def _scan_sql(table: str, key: str, pattern: str, extra: str) -> str:
    p = _raw(pattern)
    return f"""select {key}, s.a as start, s.b as "end", s.m as match, {extra} from (select {key}, unnest(list_transform(range(1, len(m) + 1), lambda i: struct_pack(
 a := (list_sum(list_transform(list_slice(p, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(m, 1, i - 1), lambda x: length(x))), 0))::bigint,
 b := (list_sum(list_transform(list_slice(p, 1, i), lambda x: length(x))) + list_sum(list_transform(list_slice(m, 1, i), lambda x: length(x))))::bigint, m := m[i]))) as s
 from (select {key}, regexp_extract_all(text, '{p}') as m, regexp_split_to_array(text, '{p}') as p from {table} where regexp_matches(text, '{p}')))"""


NOTES = f"notes as materialized ({N.SQL.replace('as varchar(12)', 'as varchar')})"


def _fold_sql(source: str, key: str, order: str, keep: str, fields: str) -> str:
    """Greedy fold over each key's spans in an order: `keep` says what becomes of acc and x."""
    return f"""select {key}, unnest(f) as s from (select {key}, list_reduce(list_transform(list({fields} order by {order}), lambda x: [x]), lambda acc, y: {keep}) as f from {source} group by {key})"""


APART = "case when len(list_filter(acc, lambda k: y[1].start < k.stop and k.start < y[1].stop)) > 0 then acc else list_concat(acc, y) end"
LONGER = "case when y[1].start >= acc[-1].stop then list_concat(acc, y) when y[1].stop - y[1].start > acc[-1].stop - acc[-1].start then list_concat(acc[:-2], y) else acc end"


def _phi_sql(table: str, key: str, types: list[str]) -> str:
    """CTEs up to `kept`: the spans of phi.detect."""
    parts = " union all ".join(_scan_sql(table, key, r[0], f"{i} as rule, '{r[1]}' as type, '{r[2]}' as name, {r[3]}::double as base") for i, r in enumerate(P.RULES) if r[1] in types)
    return f"""raw as ({parts}),
near as (select raw.*, substring(t.text, greatest(start - 30, 0) + 1, start - greatest(start - 30, 0)) as pre, substring(t.text, "end" + 1, 30) as post from raw join {table} t using ({key})),
conf as (select *, round(least(greatest(base + case when type = 'NAME' then case when regexp_matches(pre, '(?i)(?:Dr|Mr|Mrs|Ms|Prof|Nurse|Patient|Pt)\\.\\s*$') then 0.05 else 0 end + case when regexp_matches(post, '(?i)diagnosed|presented|reported|complain') then 0.03 else 0 end
  when type = 'PHONE' then case when regexp_matches(pre, '(?i)phone|tel|call|fax|contact|cell|mobile') then 0.08 else 0 end else 0 end, 0), 1), 6) as confidence from near),
grp as (select {key}, type, name, confidence, "end" as stop, case when type = 'MRN' then regexp_extract(match, '{_raw(P.RULES[12][0])}', 1) else match end as g from conf where confidence >= 0.5),
sp as (select {key}, type, name, confidence, stop - length(g) as start, stop, g as match from grp),
fo as ({_fold_sql("sp", key, "start, start - stop, -confidence, stop", LONGER, "struct_pack(start := start, stop := stop, type := type, name := name, match := match, confidence := confidence)")}),
kept as (select {key}, s.type as type, s.name as name, s.start as start, s.stop as "end", s.match as match, s.confidence as confidence from fo)"""


PHI_TYPES = ["NAME", "DATE", "PHONE", "EMAIL", "MRN", "AGE"]
PHI_NOTES = f"with {NOTES}, {_phi_sql('notes', 'note_id', PHI_TYPES)}"
SURROGATE = "case type " + " ".join(f"when '{t}' then {v}[k % {len(v)} + 1]" for t, v in P.SURROGATES.items()) + " else '[' || type || ']' end"


def _replaced_sql(new: str) -> str:
    return PHI_NOTES + f""", num as (select *, row_number() over (partition by note_id, type order by start) - 1 as k from kept),
nw as (select note_id, start, "end" as stop, {new} as new, lag("end", 1, 0) over (partition by note_id order by start) as prev from num),
pieces as (select note_id, string_agg(substring(text, prev + 1, start - prev) || new, '' order by start) as head, max(stop) as last from nw join notes using (note_id) group by note_id)
select n.note_id, md5(coalesce(head || substring(text, last + 1), text)) as md5, length(coalesce(head || substring(text, last + 1), text)) as n from notes n left join pieces using (note_id)"""


def _level(v: str, b: tuple) -> str:
    return f"case when {v} <= {b[0]} then 3 when {v} < {b[1]} then 1 when {v} >= {b[3]} then 4 when {v} > {b[2]} then 2 else 0 end"


def _vitals_sql() -> str:
    parts = []
    for i, r in enumerate(V.RULES):
        if i == 5:  # no unit follows: taken along and left out
            r = (r[0].replace(r"(?!\s*°?\s*[FfCc])", r"(\s*°?\s*[FfCc])?"), *r[1:])
        two = f"lower(regexp_extract(match, '{_raw(r[0])}', 2))" if i in (0, 1, 4, 9, 10, 11, V.FEET) else "null"
        parts.append(f"select note_id, start, \"end\" as stop, {i} as rule, '{r[1]}' as type, '{r[2]}' as unit, {r[3]}::double as confidence, regexp_extract(match, '{_raw(r[0])}', 1)::double as raw, {two} as second from ({_scan_sql('notes', 'note_id', r[0], '1 as one')})" + (f" where regexp_extract(match, '{r[0]}', 2) = ''" if i == 5 else ""))
    val = "case when type = 'temperature' and (second = 'c' or rule = 5 and raw <= 50) then round(raw * 9.0e0 / 5.0e0 + 32.0e0, 1) when type = 'weight' and regexp_matches(second, '^(lb|pound)') then round(raw / 2.2046e0, 1) when rule = 14 then round((raw * 12 + try_cast(second as double)) * 2.54e0, 1) when type = 'height' and regexp_matches(second, '^in') then round(raw * 2.54e0, 1) else raw end"
    ok = "case type " + " ".join(f"when '{t}' then value between {a} and {b}" for t, (a, b) in V.VALID.items()) + " end"
    lvl = "case type " + " ".join(f"when '{t}' then " + (f"greatest({_level('value', b)}, {_level('secondary', V.DIASTOLIC)})" if t == "blood_pressure" else _level("value", b)) for t, b in V.RANGES.items()) + " else 0 end"
    return f"""with {NOTES}, raw as ({" union all ".join(parts)}),
val as (select *, {val} as value, case when type = 'blood_pressure' then second::double end as secondary from raw),
ok as (select *, {lvl} as lvl from val where {ok} and (type <> 'blood_pressure' or (secondary between 10 and 200 and value > secondary))),
fo as ({_fold_sql("(select *, note_id || '/' || type as kk from ok)", "kk", "-confidence, rule, start", APART, "struct_pack(note_id := note_id, type := type, value := value, secondary := secondary, unit := unit, lvl := lvl, confidence := confidence, start := start, stop := stop)")}),
vit as (select s.note_id as note_id, s.type as type, s.value as value, s.secondary as secondary, s.unit as unit, {V.ORDER}[s.lvl + 1] as interpretation, round((s.value + 2 * s.secondary) / 3.0e0, 1) as map_mmhg, s.confidence as confidence, s.start as start, s.stop as "end" from fo)"""


VIT = _vitals_sql()
NER = f"""with {NOTES}, raw as ({" union all ".join(_scan_sql('notes', 'note_id', r[0], f"{i} as rule, '{r[1]}' as type") for i, r in enumerate(E.RULES))}),
fo as ({_fold_sql('raw', 'note_id', 'start, rule', APART, 'struct_pack(start := start, stop := "end", type := type, match := match)')}),
ner as (select note_id, s.type as type, s.start as start, s.stop as "end", s.match as match from fo)"""
SEC = f"""hd as ({_scan_sql('notes', 'note_id', X.HEADER, '1 as one')}),
sec as (select note_id, trim(regexp_replace(lower(match), '[:\\s*]+', ' ', 'g')) as header, start as header_start, "end" as header_end, coalesce(lead(start) over (partition by note_id order by start), length(text)) as body_end from hd join notes using (note_id)),
sc as (select *, coalesce(case header {" ".join(f"when '{k}' then '{v}'" for k, v in X.CATEGORIES.items())} end, 'unknown') as category from sec)"""
PREFIX = "pf(prefix, category, weight) as (values " + ", ".join(f"('{p}', '{c}', {w})" for c, (w, spec) in C.CATEGORIES.items() for p in C._each(spec)) + ")"
CODES = f"""with {PREFIX}, codes as (select o_custkey, {ICD}[(o_orderkey % {len(ICD)} + 1)::int] as icd_code from orders),
pl as (select distinct o_custkey, replace(upper(icd_code), '.', '') as c from codes),
mt as (select distinct o_custkey, category, weight from (select o_custkey, c, category, weight, row_number() over (partition by o_custkey, c order by length(prefix) desc) as k from pl join pf on starts_with(c, prefix)) where k = 1)"""
IDX = CODES + """, kp as (select * from mt m where not exists (select 1 from (values """ + ", ".join(f"('{a}', '{b}')" for a, b in C.PAIRS) + """) p(a, b) join mt g on g.category = p.b where p.a = m.category and g.o_custkey = m.o_custkey)),
ix as (select o_custkey, sum(weight)::bigint as score, string_agg(category, ',' order by category) as categories from kp group by o_custkey),
fx as (select *, round(least(greatest(1 - pow(0.983e0, exp(score * 0.9e0)), 0), 1), 4) as ten_year_mortality, case when score = 0 then 'low' when score <= 2 then 'mild' when score <= 4 then 'moderate' else 'severe' end as risk_group from ix)"""
CTEXT = f"""with {NOTES}, raw as ({" union all ".join(_scan_sql('notes', 'note_id', p, f"'{c}' as category, {C.CATEGORIES[c][0]} as weight") for c, p in C.TEXT.items())}),
cf as (select note_id, category, weight, case when len(regexp_split_to_array(match, '\\s+')) >= 3 then 0.85e0 when len(regexp_split_to_array(match, '\\s+')) = 2 then 0.8e0 when length(match) >= 4 then 0.75e0 else 0.7e0 end as c from raw)"""

ORACLES = {
    "notes_table": f"with {NOTES} select note_id, patient_id, md5(text) as md5 from notes",
    "phi_documents": f"with {_phi_sql('documents', 'doc_id', ['EMAIL', 'PHONE', 'IP_ADDRESS', 'URL'])} select * from kept",
    "phi_detect": PHI_NOTES + " select * from kept",
    "phi_redact": _replaced_sql("'[' || type || ']'"),
    "phi_mask": _replaced_sql("repeat('*', length(match))"),
    "phi_surrogate": _replaced_sql(SURROGATE),
    "phi_totals": PHI_NOTES + " select type, count(*) as n from kept group by type",
    "vitals_extract": VIT + " select * from vit",
    "vitals_summary": VIT + " select type, count(*) as readings, count(*) filter (starts_with(interpretation, 'critical')) as critical from vit group by type",
    "vitals_bmi": VIT + ", p as (select note_id, arg_min(value, start) filter (type = 'weight') as kg, arg_min(value, start) filter (type = 'height') as cm, count(*) filter (type = 'bmi') as has from vit group by note_id) select note_id, round(kg / ((cm / 100) * (cm / 100)), 1) as bmi from p where has = 0 and kg is not null and cm > 0",
    "ner_rules": NER + " select * from ner",
    "ner_modifiers": NER + f""", m as (select type, lower(substring(text, greatest(start - 50, 0) + 1, start - greatest(start - 50, 0))) as pre from ner join notes using (note_id)) select type, regexp_matches(pre, '{E.NEGATED}') as is_negated, regexp_matches(pre, '{E.UNCERTAIN}') as is_uncertain, count(*) as n from m group by all""",
    "sections_parse": f"with {NOTES}, {SEC} select note_id, header, category, header_start, header_end, body_end from sc",
    "section_at": NER + f", {SEC} select type, category as section, count(*) as n from (select ner.type, (select arg_max(category, header_start) from sc where sc.note_id = ner.note_id and header_start <= ner.start) as category from ner) group by all",
    "charlson_codes": CODES + " select * from mt",
    "charlson_index": IDX + " select * from fx",
    "charlson_text": CTEXT + " select note_id, category, weight, max(c) as confidence from cf group by all",
    "charlson_batch": IDX + " select risk_group, count(*) as n, round(avg(score), 6) as avg_score, max(score) as max_score from fx group by risk_group",
    "charlson_age": "with a as (select p_partkey, p_partkey % 70 + 30 as age from part), s as (select p_partkey, case when age < 50 then 0 else least((age - 50) // 10 + 1, 4) end::int as points from a) select p_partkey, points, round(1 - pow(0.983e0, exp(points * 0.9e0)), 4) as ten_year_mortality, case when points = 0 then 'low' when points <= 2 then 'mild' else 'moderate' end as risk_group from s",
}
QUERIES = {name: globals()[name] for name in ORACLES}
