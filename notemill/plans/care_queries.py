"""Dental notes, risk from entities and codes, details of medications and vital signs, multilabel metrics, tagged tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from notemill.functions import spans as S
from notemill.operators import assertions as A
from notemill.operators import dental as D
from notemill.operators import entities as E
from notemill.operators import medications as M
from notemill.operators import metrics as W
from notemill.operators import risk as R
from notemill.operators import scoring as C
from notemill.operators import social as O
from notemill.operators import vitals as V
from notemill.plans.clinical_queries import NER, NOTES, _scan_sql
from notemill.plans.scoring_queries import CONDITIONS
from notemill.sources import notes as N
from notemill.sources.notes import _pick

K = "p_partkey"
#: Dental notes from the part table: one expression for Spark and DuckDB.
DENTAL_PARTS = [
    "'Tooth #'", "cast(p_partkey % 32 + 1 as varchar(12))", "' '", _pick(K, ["MO", "DL", "ML", "B"]), "' '", _pick(K, ["caries", "no caries", "fracture", "periapical lesion", "without decay"]), "'. '",
    "cast(p_partkey % 9 + 1 as varchar(12))", "' mm pocket '", _pick(K, ["bleeding present", "bop +", "dry"]), "', '", _pick(K, ["mobility grade ii", "mobility: 2", "no mobility", "furcation 1", "stable"]), "'. '",
    _pick(K, ["root canal and crown", "scaling and root planing", "prophylaxis, fluoride", "extraction of tooth T", "bitewing radiographs"]), "'. '", _pick(K, ["Periodontitis with bone loss", "Gingivitis", "Healthy"]), "'. CAL: '", "cast(p_partkey % 7 as varchar(12))", "'.'",
]
DENTAL = f"select {K}, " + " || ".join(DENTAL_PARTS) + " as text from part"


def _dental(spark, sf):
    return spark.sql(DENTAL.replace(" from part", " from {part}").replace("as varchar(12)", "as string"), part=spark.read.parquet(f"{sf}/part.parquet"))


def dental_entities(spark, sf):
    return D.extract(_dental(spark, sf), K)


def dental_totals(spark, sf):
    return D.extract(_dental(spark, sf), K).groupBy("type", "kind", "is_negated").agg(F.count("*").alias("n"), F.max("quadrant").alias("quadrant"))


def dental_risk(spark, sf):
    r = D.periodontal_risk(_dental(spark, sf), K)
    return r.withColumns({"factors": F.array_join("factors", ","), "recommendations": F.array_join("recommendations", "; ")})


def dental_codes(spark, sf):
    return D.procedure_codes(_dental(spark, sf), K)


def _gathered(spark, sf, keep=True):
    """Notes with their entities (rule-based ones and conditions, with negation), codes and which words they hold, each in a column. keep: whether the text stays."""
    rules, stay = [*E.RULES, (CONDITIONS, "DISEASE")], ["note_id", *(["text"] if keep else []), "held"]
    n = S.found(N.notes(spark, sf).select("note_id", "text"), rules, before=E.LEFT, keep=keep, words=R.TERMS, first=True)
    # of the entities that stand for themselves, those of the types that the scores ask for
    asked = F.filter("spans", lambda x: x["rule"].isin([i for i, r in enumerate(rules) if r[1] in R.TYPES]))
    low = F.transform(asked, lambda x: F.struct(x["rule"], x["match"], F.lower(x["pre"]).alias("pre")))
    n = n.select(*stay, F.transform(low, lambda x: F.struct(S.field(rules, 1, x["rule"]).alias("type"), x["match"], (S.may(x["pre"], E.NEGATED) & x["pre"].rlike(E.NEGATED)).alias("is_negated"))).alias("entities"))
    return C.with_codes(n, has=R.known("held")).select(*stay, "entities", F.transform("codes", lambda c: F.struct(c["code"], c["confidence"])).alias("codes"))


def risk_assess(spark, sf):
    r = R.assess(_gathered(spark, sf), "note_id", entities="entities", codes="codes", held="held")
    return r.withColumn("recommendations", F.array_join("recommendations", "; "))


def risk_unit(spark, sf):
    r = R.unit_score(_gathered(spark, sf, keep=False), "note_id", entities="entities", codes="codes", held="held")
    return r.withColumns({"factors": F.array_join("factors", ","), "recommendations": F.array_join("recommendations", "; ")})


def med_details(spark, sf):
    return M.details(N.notes(spark, sf), "note_id")


def vitals_trend(spark, sf):
    """Notes with a line of words for signs and of trends put to them."""
    n = N.notes(spark, sf)
    line = F.element_at(F.lit(TREND_LINES), (F.col("note_id") % len(TREND_LINES) + 1).cast("int"))
    return V.described(n.select("note_id", F.concat("text", F.lit("\n"), line).alias("text")), "note_id")


TREND_LINES = ["Patient afebrile, pulse improving", "tachycardic and febrile, worsening", "hypotensive but stable today", "HR: 88 bpm rising", "hypoxic, bradycardia unchanged"]


def multilabel_metrics(spark, sf):
    return W.multilabel(_labels(spark, sf), "id", "label", "truth", "guess")


def _labels(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    labels = F.explode(F.lit([f"L{i}" for i in range(6)]))
    each = o.select("id", labels.alias("label")).withColumn("i", F.substring("label", 2, 1).cast("int"))
    return each.select("id", "label", ((F.col("id") + F.col("i")) % 4 == 0).cast("int").alias("truth"), ((F.col("id") * 3 + F.col("i") * 5) % 7 < 2).cast("int").alias("guess"))


def bio_spans(spark, sf):
    tags = F.element_at(F.lit(TAGS), ((F.col("l_orderkey") * 3 + F.col("l_linenumber") * 5) % len(TAGS) + 1).cast("int"))
    tokens = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("int").alias("place"), tags.alias("tag"), (F.col("l_linenumber") * 10).cast("int").alias("start"), (F.col("l_linenumber") * 10 + F.when(F.col("l_orderkey") % 11 == 0, 0).otherwise(8)).cast("int").alias("end"))
    return E.from_tags(tokens, "doc", "place", "tag")


TAGS = ["O", "B-DRUG", "I-DRUG", "B-TEST", "I-TEST", "O", "I-DRUG"]


def _dental_sql() -> str:
    raw = " union all ".join(_scan_sql("dn", K, r[0], f"{i} as rule") for i, r in enumerate(D.RULES))
    g = lambda i: f"regexp_extract(match, '{D.RULES[i][0]}', 1)"
    table = lambda t: "case lower(match) " + " ".join(f"when '{k}' then '{v}'" for k, v in t.items()) + " end"
    kind = "case rule " + " ".join(f"when {i} then " + (table(D.WORDS[i]) if i in D.WORDS else f"'{r[2]}'") for i, r in enumerate(D.RULES)) + " end"
    number = "case rule " + " ".join(f"when {i} then {g(i)}" for i, r in enumerate(D.RULES) if r[1] == "PERIODONTAL" and "(" in r[0].replace("(?", "")) + " end"
    of = lambda j: "case rule " + " ".join(f"when {i} then {r[j]!r}" for i, r in enumerate(D.RULES)) + " end"
    return f"""with dn as materialized ({DENTAL.replace('as varchar(12)', 'as varchar')}), raw as ({raw}),
tl as (select {K}, {of(1)} as type, {kind} as kind, case when rule = 0 then '#' || {g(0)} when rule = 1 then {g(1)} when rule = 2 then upper({g(2)}) else match end as txt, start, "end" as stop, ({of(3)})::double as confidence, case rule when 0 then {g(0)} when 1 then {g(1)} when 2 then upper({g(2)}) end as tooth,
 try_cast({number} as double) as value, regexp_matches(lower(substring(text, greatest(start - 30, 0) + 1, start - greatest(start - 30, 0))), '{D.NEGATED}') as neg, rule from raw join dn using ({K}) where rule <> {D.SURFACE} or match in ({", ".join(f"'{s}'" for s in D.SURFACES)})),
fo as (select {K}, unnest(f) as s from (select {K}, list_reduce(list_transform(list(struct_pack(type := type, kind := kind, txt := txt, start := start, stop := stop, confidence := confidence, tooth := tooth, value := value, neg := neg) order by start, -confidence, rule), lambda x: [x]),
  lambda acc, y: case when len(list_filter(acc, lambda k: y[1].start < k.stop and k.start < y[1].stop)) > 0 then acc else list_concat(acc, y) end) as f from tl group by {K})),
de as (select {K}, s.type as type, s.kind as kind, s.txt as text, s.start as start, s.stop as "end", s.confidence as confidence, s.tooth as tooth, (case s.kind when 'universal' then (try_cast(s.tooth as int) - 1) // 8 + 1 when 'fdi' then try_cast(s.tooth as int) // 10 end)::int as quadrant, s.value as value, s.neg as is_negated from fo)"""


def _dental_risk_sql() -> str:
    return _dental_sql() + f""", pk as (select {K}, list(value) filter (kind = 'pocket_depth' and value > 0) as d from de group by {K}),
lw as (select dn.{K}, lower(text) as l, d, list_avg(d) as m, list_max(d) as x from dn left join pk using ({K})),
fc as (select {K}, list_filter([case when m > 4 then struct_pack(f := 'elevated_average_pocket_depth', h := (m >= 5)::int) end, case when x >= 6 then struct_pack(f := 'deep_probing_depths', h := 1) end, case when contains(l, 'bleeding') or contains(l, 'bop+') then struct_pack(f := 'bleeding_on_probing', h := 0) end,
 case when contains(l, 'mobility') and (contains(l, 'grade') or contains(l, '1') or contains(l, '2') or contains(l, '3')) then struct_pack(f := 'tooth_mobility', h := 1) end, case when contains(l, 'bone loss') then struct_pack(f := 'radiographic_bone_loss', h := 1) end,
 case when contains(l, 'periodontitis') then struct_pack(f := 'periodontitis_diagnosis', h := 1) end], lambda z: z is not null) as f from lw),
nm as (select {K}, len(f) as n, len(list_filter(f, lambda z: z.h = 1)) as h, list_transform(f, lambda z: z.f) as f from fc),
ad as (select *, list_filter([case when list_contains(f, 'deep_probing_depths') then 'refer to a periodontist' end, case when list_contains(f, 'bleeding_on_probing') then 'oral hygiene instructions and more frequent prophylaxis' end, case when list_contains(f, 'periodontitis_diagnosis') then 'periodontal evaluation and treatment plan' end], lambda z: z is not null) as a from nm)
select {K}, case when n = 0 then 'low' when n > 1 and h >= 2 then 'high' else 'moderate' end as risk, (case when n = 0 then 0.2 when n = 1 then 0.5 when h >= 2 then 0.8 else 0.6 end)::double as risk_score, array_to_string(f, ',') as factors, case when len(a) > 0 then array_to_string(a, '; ') else 'routine maintenance' end as recommendations from ad"""


def _dental_codes_sql() -> str:
    rows = " union all ".join(f"select {K}, {i} as i, '{c}' as code, '{p}' as procedure, (case when contains(' ' || lower(text) || ' ', ' {p} ') then 0.9 else 0.75 end)::double as confidence from dn where contains(lower(text), '{p}')" for i, (p, c) in enumerate(D.CODES))
    return f"with dn as materialized ({DENTAL.replace('as varchar(12)', 'as varchar')}), r as ({rows}), k as (select *, row_number() over (partition by {K} order by confidence desc, i)::int as rank from r) select {K}, rank, code, procedure, confidence from k where rank <= 10"


def _gathered_sql() -> str:
    """CTE ga: note_id, l (text in lower case), text, e (entities), c (codes)."""
    rules = [*E.RULES, (CONDITIONS, "DISEASE")]
    raw = " union all ".join(_scan_sql("notes", "note_id", r[0], f"{i} as rule, '{r[1]}' as type") for i, r in enumerate(rules))
    hits = [(i, "(" + " + ".join(f"contains(lower(text), '{k}')::int" for k in keys) + ")", code, sure) for i, (keys, code, _, sure) in enumerate(C.ICD_RULES)]
    codes = "list_filter([" + ", ".join(f"case when {h} > 0 then struct_pack(o := -round(least({sure}e0 + 0.03e0 * ({h} - 1), 1), 4), i := {i}, code := '{code}') end" for i, h, code, sure in hits) + "], lambda z: z is not null)"
    return f"""with {NOTES}, raw as ({raw}),
fo as (select note_id, list_reduce(list_transform(list(struct_pack(start := start, stop := "end", type := type, match := match) order by start, rule), lambda x: [x]), lambda acc, y: case when len(list_filter(acc, lambda k: y[1].start < k.stop and k.start < y[1].stop)) > 0 then acc else list_concat(acc, y) end) as f from raw group by note_id),
ga as (select n.note_id, text, lower(text) as l, list_transform(coalesce(f, []), lambda z: struct_pack(type := z.type, match := lower(z.match), neg := regexp_matches(lower(substring(text, greatest(z.start - 50, 0) + 1, z.start - greatest(z.start - 50, 0))), '{E.NEGATED}'))) as e,
 list_transform(list_sort({codes})[:10], lambda z: struct_pack(code := z.code, confidence := -z.o)) as c from notes n left join fo using (note_id))"""


def _risk_assess_sql() -> str:
    like = lambda d: f"(contains(m, '{d}') or contains('{d}', m))"
    keep = lambda items: "list_filter([" + ", ".join(items) + "], lambda z: z is not null)"
    named = "flatten(list_transform(m, lambda m: " + keep([f"case when {like(d)} then {w * w!r}::double end" for d, w in C.HIGH_RISK.items()]) + "))"
    written = keep([f"case when contains(l, '{d}') and len(list_filter(m, lambda m: {like(d)})) = 0 then {w * (w * 0.8)!r}::double end" for d, w in C.HIGH_RISK.items()])
    pairs = keep([f"case when list_contains(m, '{a}') and list_contains(m, '{b}') then {0.85 * 0.9!r}::double end" for a, b in C.INTERACTIONS])
    urgent = keep([f"case when contains(l, '{w}') then {v * v!r}::double end" for w, v in C.URGENT.items()])
    letter = "(case upper(left(z.code, 1)) " + " ".join(f"when '{k}' then {v!r}::double" for k, v in C.CODE_WEIGHTS.items()) + " else 0.3e0 end)"
    follow = keep([f"case when regexp_matches(text, '{p}') then {0.75 * 0.7!r}::double end" for p in C.FOLLOW_UP])
    worst = keep([f"case when contains(l, '{w}') then 'urgency_{w}' end" for w, v in C.URGENT.items() if v >= 0.85])
    cat = lambda x: f"case when len({x}) > 0 then round(least(list_max({x}) * 0.6e0 + list_reduce({x}, lambda p, q: p + q, 0.0::double) * 0.4e0 / len({x}), 1) * 100, 4) else 0 end"
    return _gathered_sql() + f""", md as (select *, list_transform(list_filter(e, lambda z: z.type = 'MEDICATION' and not z.neg), lambda z: z.match) as m, len(list_filter(e, lambda z: z.type in ('DISEASE', 'SYMPTOM') and not z.neg)) as active from ga),
pt as (select note_id, list_concat({keep(["case when len(m) >= 5 then least(1, len(m) / 10.0e0) * 0.6e0 end"])}, {named}, {written}, {pairs})::double[] as a, list_concat({urgent}, {keep(["case when active >= 3 then least(1, active / 8.0e0) * 0.55e0 end"])}, list_transform(c, lambda z: {letter} * {letter}))::double[] as b, ({follow})::double[] as f, {worst} as w from md),
ct as (select note_id, w, {cat("a")} as medication_risk, {cat("b")} as diagnostic_complexity, {cat("f")} as follow_up_urgency from pt),
ov as (select *, round(least(0.0e0 + medication_risk * 0.35e0 + diagnostic_complexity * 0.4e0 + follow_up_urgency * 0.25e0, 100), 4) as s from ct)
select note_id, medication_risk, diagnostic_complexity, follow_up_urgency, s as overall_score, case when s >= 80 then 'critical' when s >= 60 then 'high' when s >= 35 then 'moderate' else 'low' end as risk_level,
 array_to_string(list_filter([case when s >= 80 then 'urgent: immediate review' end, case when s >= 80 then 'consider escalation or admission' end, case when s >= 60 and s < 80 then 'urgent follow-up within 48 hours' end, case when s >= 35 and s < 60 then 'follow-up within 2 weeks' end, case when s < 35 then 'standard monitoring' end,
  case when medication_risk >= 60 then 'reconcile medication' end, case when medication_risk >= 35 and medication_risk < 60 then 'review medication list' end, case when diagnostic_complexity >= 60 then 'multi-disciplinary review' end, case when follow_up_urgency >= 50 then 'coordinate care' end,
  case when len(w) > 0 then 'severe: ' || array_to_string(w[:3], ', ') end], lambda z: z is not null)[:6], '; ') as recommendations from ov"""


def _risk_unit_sql() -> str:
    keep = lambda items: "list_filter([" + ", ".join(items) + "], lambda z: z is not null)"
    one = lambda name, w, v="1e0": f"struct_pack(name := {name}, weight := ({w})::double, value := ({v})::double)"
    has = lambda words: "(" + " + ".join(f"contains(l, '{w}')::int" for w in words) + ")"
    lit = lambda s: "'" + s + "'"
    said = [f"case when contains(l, '{w}') then {one(lit(f'urgency_{w}'), weight)} end" for weight, words in R.URGENT for w in words]
    said += [f"case when contains(l, '{w}') then {one(lit(w.replace(' ', '_')), weight)} end" for w, weight in R.CONDITIONS.items()]
    said.append(f"case when {has(R.ISSUES)} >= 5 then {one(lit('multiple_issues'), 0.5, f'least(1, {has(R.ISSUES)} / 10.0e0)')} end")
    many = keep([f"case when len(d) >= 5 then {one(lit('polypharmacy'), 0.5, 'least(1, len(d) / 10.0e0)')} end"])
    risky = "flatten(list_transform(d, lambda x: " + keep([f"case when contains(x.match, '{k}') then {one(lit(f'high_risk_med_{k}'), w)} end" for k, w in R.DRUGS.items()]) + "))"
    disease = "'disease_' || left(x.match, 20)"
    ill = "flatten(list_transform(list_filter(e, lambda x: x.type = 'DISEASE' and not x.neg), lambda x: " + keep([f"case when contains(x.match, '{k}') or contains('{k}', x.match) then {one(disease, w)} end" for k, w in R.CONDITIONS.items()]) + "))"
    weight = "(case " + " ".join(f"when starts_with(z.code, '{s}') then {w!r}::double" for s, w in R.STARTS) + " else 0.3e0 end)"
    icd = "'icd_' || z.code"
    coded = f"list_transform(c, lambda z: {one(icd, weight + ' * z.confidence', 'z.confidence')})"
    words = ", ".join(f"least(1, {has(ws)} * {step!r}::double) as {name}" for name, (step, ws) in R.WORDS.items())
    total = lambda x: f"list_reduce(list_transform({x}, lambda z: z.weight * z.value), lambda p, q: p + q, 0.0::double)"
    shared = " + ".join(f"{n} * {w!r}::double" for n, w in R.SHARES.items())
    return _gathered_sql() + f""", dr as (select *, list_filter(e, lambda x: x.type = 'MEDICATION') as d from ga),
ft as (select note_id, l, list_concat({keep(said)}, {many}, {risky}, {ill}, {coded}) as f from dr),
ct as (select note_id, f, least(1, {total("list_filter(f, lambda z: contains(z.name, 'med') or contains(z.name, 'polypharmacy'))")} / 2) as medication, {words}, {total("list_filter(f, lambda z: z.weight > 0.6e0)")} / greatest(len(list_filter(f, lambda z: z.weight > 0.6e0)), 1) as boost, list_transform(list_filter(f, lambda z: z.weight > 0.7e0), lambda z: z.name) as w from ft),
ov as (select *, least(1, greatest(0, (0.0e0 + {shared}) * 0.7e0 + boost * 0.3e0)) as s from ct)
select note_id, round(s, 6) as overall, case when s >= 0.8e0 then 'critical' when s >= 0.6e0 then 'high' when s >= 0.4e0 then 'moderate' else 'low' end as level, {", ".join(f"round({n}, 6) as {n}" for n in R.SHARES)}, len(f)::int as n_factors, array_to_string(list_transform(f[:10], lambda z: z.name), ',') as factors,
 array_to_string(list_filter([case when s >= 0.8e0 then 'immediate review' end, case when s >= 0.8e0 then 'consider specialist care' end, case when s >= 0.6e0 and s < 0.8e0 then 'follow-up within 72 hours' end, case when s >= 0.4e0 and s < 0.6e0 then 'follow-up within 2 weeks' end, case when medication > 0.6e0 then 'review medication' end,
  case when cardiovascular > 0.6e0 then 'cardiology consultation' end, case when infection > 0.6e0 then 'infectious disease workup' end, case when len(w) > 0 then 'monitor: ' || array_to_string(w[:3], ', ') end], lambda z: z is not null)[:5], '; ') as recommendations from ov"""


def _med_details_sql() -> str:
    unit = "case lower(u) " + " ".join(f"when '{k}' then '{v}'" for k, v in M.DURATION_UNITS.items()) + " else lower(u) end"
    return f"""with {NOTES}, raw as ({_scan_sql('notes', 'note_id', M.pattern(M.DRUGS), '1 as one')}),
cx as (select note_id, start, lower(match) as drug, substring(text, "end" + 1, {M.RIGHT}) as c from raw join notes using (note_id)),
pa as (select *, regexp_extract(c, '{M.DURATION}', 1) as a, regexp_extract(c, '{M.DURATION}', 2) as b, regexp_extract(c, '{M.DURATION}', 3) as u, rtrim(trim(regexp_extract(c, '{M.INDICATION}', 1)), '.,;') as i from cx)
select note_id, start, drug, case when u <> '' then a || case when b <> '' then '-' || b else '' end || ' ' || {unit} end as duration, case when i <> '' and lower(i) not in ({", ".join(f"'{w}'" for w in M.NO_INDICATION)}) then i end as indication from pa"""


def _trend_sql() -> str:
    words = " union all ".join(f"select note_id, start, \"end\" as stop, '{t}' as type, {v}::double as value, '{how}' as interpretation, {i} as rule from ({_scan_sql('tn', 'note_id', p, '1 as one')})" for i, (p, t, v, how) in enumerate(V.WORDS))
    near = "substring(text, greatest(start - 60, 0) + 1, stop + 60 - greatest(start - 60, 0))"
    return f"""with {NOTES}, tn as materialized (select note_id, text || chr(10) || {TREND_LINES}[(note_id % {len(TREND_LINES)} + 1)::int] as text from notes), w as ({words})
select note_id, type, value, interpretation, start, stop as "end", 0.7::double as confidence, case {" ".join(f"when regexp_matches({near}, '{p}') then '{n}'" for p, n in V.TRENDS)} else 'unknown' end as trend from w join tn using (note_id)"""


def sdoh_context(spark, sf):
    return O.in_context(N.notes(spark, sf), "note_id")


def sdoh_z_codes(spark, sf):
    return spark.createDataFrame([(d, c, t) for d, cs in O.Z_CODES.items() for c, t in cs], "domain string, code string, description string")


def assertion_sections(spark, sf):
    return A.in_sections(N.notes(spark, sf), CONDITIONS, "note_id")


def _sdoh_sql() -> str:
    raw = " union all ".join(_scan_sql("notes", "note_id", r[0], f"{i} as rule, '{r[1]}' as domain, '{r[2]}' as sentiment, {r[3]}::double as base, '{r[4]}' as trigger") for i, r in enumerate(O.RULES))
    last = lambda t, side: f"(select max({side}) from {t} where {t}.note_id = raw.note_id and {t}.{side} <= raw.start)"
    codes = "case domain " + " ".join(f"when '{d}' then '{','.join(c for c, _ in cs)}'" for d, cs in O.Z_CODES.items()) + " end"
    cues = O.CUES.replace("'", "''")
    return f"""with {NOTES}, raw as ({raw}), bg as ({_scan_sql('notes', 'note_id', O.BEGINS, '1 as one')}), ed as ({_scan_sql('notes', 'note_id', O.ENDS, '1 as one')}),
cx as (select raw.*, "end" as stop, coalesce({last('bg', '"end"')} > coalesce({last('ed', 'start')}, -1), false) as inside, regexp_matches(substring(text, greatest(start - 40, 0) + 1, start - greatest(start - 40, 0)), '{cues}') as neg from raw join notes using (note_id)),
tl as (select *, neg and sentiment <> 'neutral' as turned from cx),
sr as (select *, case when not turned then sentiment when sentiment = 'adverse' then 'protective' else 'adverse' end as told, round(least(base + case when inside then 0.05e0 else 0 end, 1) * case when turned then 0.85e0 else 1 end, 6) as sure from tl),
fo as (select unnest(f) as s from (select list_reduce(list_transform(list(struct_pack(note_id := note_id, domain := domain, told := told, trigger := trigger, sure := sure, start := start, stop := stop, match := match, neg := neg, inside := inside) order by -sure, start, rule), lambda x: [x]),
  lambda acc, y: case when len(list_filter(acc, lambda k: y[1].start < k.stop and k.start < y[1].stop)) > 0 then acc else list_concat(acc, y) end) as f from sr group by note_id, domain))
select s.note_id as note_id, s.domain as domain, s.told as sentiment, s.trigger as trigger, s.sure as confidence, s.start as start, s.stop as "end", s.match as match, s.neg as negated, s.inside as in_section, {codes.replace('case domain', 'case s.domain')} as z_codes from fo"""


LABELS = "lb as (select o_orderkey as id, 'L' || i as label, ((o_orderkey + i) % 4 = 0)::int as truth, ((o_orderkey * 3 + i * 5) % 7 < 2)::int as guess from orders, range(6) r(i))"
ORACLES = {
    "dental_entities": _dental_sql() + " select * from de",
    "dental_totals": _dental_sql() + " select type, kind, is_negated, count(*) as n, max(quadrant) as quadrant from de group by all",
    "dental_risk": _dental_risk_sql(),
    "dental_codes": _dental_codes_sql(),
    "risk_assess": _risk_assess_sql(),
    "risk_unit": _risk_unit_sql(),
    "med_details": _med_details_sql(),
    "vitals_trend": _trend_sql(),
    "sdoh_context": _sdoh_sql(),
    "sdoh_z_codes": "select * from (values " + ", ".join(f"('{d}', '{c}', '{t}')" for d, cs in O.Z_CODES.items() for c, t in cs) + ") t(domain, code, description)",
    "multilabel_metrics": f"""with {LABELS}, pl as (select label, sum(truth * guess) as tp, sum(guess) as g, sum(truth) as t from lb group by label),
pr as (select *, case when g > 0 then tp / g::double else 0 end as p, case when t > 0 then tp / t::double else 0 end as r from pl), f as (select *, case when p + r > 0 then 2 * p * r / (p + r) else 0 end as f from pr),
ex as (select avg(same) as subset_accuracy from (select id, min((truth = guess)::int)::double as same from lb group by id)), h as (select avg((truth <> guess)::int) as hamming_loss from lb),
m as (select avg(p) as precision_macro, avg(r) as recall_macro, avg(f) as f1_macro, sum(tp) / sum(g)::double as precision_micro, sum(tp) / sum(t)::double as recall_micro, sum(p * t) / sum(t) as precision_weighted, sum(r * t) / sum(t) as recall_weighted, sum(f * t) / sum(t) as f1_weighted from f)
select round(precision_macro, 6) as precision_macro, round(recall_macro, 6) as recall_macro, round(f1_macro, 6) as f1_macro, round(precision_micro, 6) as precision_micro, round(recall_micro, 6) as recall_micro, round(2 * precision_micro * recall_micro / (precision_micro + recall_micro), 6) as f1_micro,
 round(precision_weighted, 6) as precision_weighted, round(recall_weighted, 6) as recall_weighted, round(f1_weighted, 6) as f1_weighted, round(hamming_loss, 6) as hamming_loss, round(subset_accuracy, 6) as subset_accuracy from m, ex, h""",
    "bio_spans": f"""with t as (select l_orderkey as doc, l_linenumber as place, {TAGS}[((l_orderkey * 3 + l_linenumber * 5) % {len(TAGS)} + 1)::int] as tag, (l_linenumber * 10)::int as start, (l_linenumber * 10 + case when l_orderkey % 11 = 0 then 0 else 8 end)::int as stop from lineitem),
r as (select *, sum((tag[1:1] <> 'I')::int) over (partition by doc order by place) as run from t where start < stop),
h as (select *, first_value(tag) over (partition by doc, run order by place) as head from r)
select doc, head[3:] as type, min(start) as start, max(stop) as "end", count(*) as n_tokens from h where head[1:1] = 'B' group by doc, run, head""",
}
QUERIES = {name: globals()[name] for name in (*ORACLES, "assertion_sections")}
