"""Document types, note quality, abbreviations and concepts over synthetic notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from notemill.operators import abbreviations as A
from notemill.operators import concepts as C
from notemill.operators import doctypes as D
from notemill.operators import entities as E
from notemill.operators import note_quality as Q
from notemill.plans.clinical_queries import NER, NOTES, _raw, _scan_sql
from notemill.plans.scoring_queries import CONDITIONS
from notemill.sources import notes as N

#: Lines put to the notes, so that every way to resolve an abbreviation is met.
EXTRA = ["LABS: pt 12 and cr 1.1 today", "Seen in the ed after ambulance arrival, ra 94 spo2", "pe seen by nobody", "MEDICATIONS: one cap daily, n/v/d resolved, s/p repair", "Taken to or. MS unchanged, alert and oriented. DNR/DNI"]


def _extended(spark, sf):
    line = F.element_at(F.lit(EXTRA), (F.col("note_id") % len(EXTRA) + 1).cast("int"))
    return N.notes(spark, sf).select("note_id", F.concat("text", F.lit("\n"), line).alias("text"))


def doc_class(spark, sf):
    return D.classify(N.notes(spark, sf), "note_id")


def doc_class_top(spark, sf):
    ranked = D.scores(N.notes(spark, sf), "note_id").select("note_id", F.posexplode(F.slice("ranked", 1, 3)).alias("rank", "s"))
    return ranked.select("note_id", (F.col("rank") + 1).alias("rank"), F.col("s.type").alias("doc_type"), F.col("s.confidence").alias("confidence"))


def doc_class_batch(spark, sf):
    return doc_class(spark, sf).groupBy("doc_type").agg(F.count("*").alias("n"), F.min("confidence").alias("least"), F.max("confidence").alias("most"))


def quality_scores(spark, sf):
    r = Q.report(N.notes(spark, sf), "note_id")
    return r.withColumn("recommendations", F.array_join("recommendations", "; "))


def quality_batch(spark, sf):
    return Q.batch(Q.report(N.notes(spark, sf), "note_id"))


def abbrev_expand(spark, sf):
    return A.expand(_extended(spark, sf), "note_id")


def abbrev_rewrite(spark, sf):
    return A.rewrite(_extended(spark, sf)).select("note_id", F.md5("text").alias("md5"))


def abbrev_batch(spark, sf):
    found = abbrev_expand(spark, sf)
    return found.groupBy("domain", "resolution").agg(F.count("*").alias("n"), F.sum(F.col("is_ambiguous").cast("bigint")).alias("ambiguous"))


def abbrev_lookup(spark, sf):
    return spark.createDataFrame(A.lookup(), "abbreviation string, expansion string, domain string, is_ambiguous boolean")


def _mentions(spark, sf):
    # the outer form, as Spark else asks for notes with entities first and works all entities out once more
    rows = E.with_others(N.notes(spark, sf), CONDITIONS, "DISEASE", "note_id", before=0).select("note_id", F.inline_outer("entities"))
    return rows.where("start is not null").select("note_id", "type", "start", "match")


def concept_normalise(spark, sf):
    found = C.normalise(_mentions(spark, sf), C.dictionary(spark), "match", "type")
    return found.select("note_id", "type", "start", "match", "cui", "term", "icd10", "confidence", "match_type")


def concept_fuzzy(spark, sf):
    """Names of parts as mentions with a letter left out, so that likeness is needed."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    terms = [n for c in C.CONCEPTS for n in (c[1], *c[2])]
    term = F.element_at(F.lit(terms), (F.col("p_partkey") % len(terms) + 1).cast("int"))
    at = (F.col("p_partkey") % 7 + 2).cast("int")
    mention = F.concat(F.substring(term, F.lit(1), at), F.substring(term, at + 2, F.lit(99)))
    found = C.normalise(p.select("p_partkey", mention.alias("mention")), C.dictionary(spark), "mention")
    return found.select("p_partkey", "mention", "cui", "confidence", "match_type")


def concept_match_rate(spark, sf):
    return C.match_rate(C.normalise(_mentions(spark, sf), C.dictionary(spark), "match", "type", fuzzy=False))


def concept_stats(spark, sf):
    return C.statistics(C.dictionary(spark))


def _q(s: str) -> str:
    return s.replace("'", "''")


def _doc_class_sql() -> str:
    parts = []
    for i, kind in enumerate(D.HEADINGS):
        ps = D.HEADINGS[kind]
        hit = " + ".join(f"regexp_matches(text, '(?i){_q(p)}')::int" for p in ps)
        early = " or ".join(f"(regexp_matches(text, '(?i){_q(p)}') and length(regexp_extract(text, '(?is)^(.*?)(?:{_q(p)})', 1)) < {D.EARLY})" for p in ps)
        words = " + ".join(f"contains(low, '{w}')::int" for w in D.WORDS[kind])
        low, high, sections = D.SHAPES[kind]
        enough = f"s >= {sections}" if sections is not None else "s <= 3"
        parts.append(f"select note_id, {i} as i, '{kind}' as kind, 0.45e0 * (case when h > 0 then least(h / {len(ps)}e0 + case when e then 0.1e0 else 0 end, 1) else 0 end) + 0.3e0 * (w / {len(D.WORDS[kind])}e0) + 0.25e0 * (case when n between {low} and {high} then 0.5e0 else 0 end + case when {enough} then 0.5e0 else 0 end) as total from (select note_id, n, s, {hit} as h, {early} as e, {words} as w from sh)")
    return f"""with {NOTES}, sh as (select *, len(lines) as n, len(list_filter(lines, lambda x: (upper(x) = x and lower(x) <> x and length(x) between 2 and 60) or (ends_with(x, ':') and length(x) <= 80))) as s
  from (select note_id, text, lower(text) as low, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as lines from notes)),
al as ({" union all ".join(parts)}),
rk as (select note_id, kind, round(total, 4) as confidence, row_number() over (partition by note_id order by total desc, i)::int as rank from al where total >= 0.05e0),
dc as (select n.note_id, coalesce(max(kind) filter (rank = 1), 'unknown') as doc_type, coalesce(max(confidence) filter (rank = 1), 0) as confidence, count(kind)::int as n_types from notes n left join rk using (note_id) group by n.note_id)"""


def _quality_sql() -> str:
    titles = "(Dr|Mr|Mrs|Ms|Jr|Sr|vs)[.!?]"
    heads = lambda i: f"regexp_extract_all(text, '{Q.HEADER}', {i})"
    has = [f"len(list_filter(hd, lambda h: contains(h, '{e}') or contains('{e}', h))) > 0" for e in Q.EXPECTED]
    words = lambda p: f"list_distinct(list_transform(regexp_extract_all(text, '{p}', 1), lambda x: lower(x)))"
    recs = [
        ("n < 10", 0, "'very short: ' || n || ' words'"), ("n between 10 and 29", 1, "'short: ' || n || ' words'"), *[(f"not h{i}", 1, f"'no section: {e}'") for i, e in enumerate(Q.EXPECTED)], ("ns = 0", 0, "'no sentences'"), ("ns > 0 and av > 35", 1, "'sentences are long'"),
        ("ns > 0 and av < 3", 1, "'sentences are very short'"), ("lg > 0", 1, "lg || ' sentences over 50 words'"), ("ns > 0 and sr > 0.25e0", 1, "'many abbreviations'"), ("ws > 0.5e0", 1, "'mostly white space'"), ("len(hd) = 0 and n > 50", 1, "'no headers'"),
        ("tr < 0.02e0 and n > 30", 1, "'few medical terms'"), ("tw > 0", 1, "tw || ' paragraphs repeated'"), ("ag > 0", 1, "'contradictions'"),
    ]
    rec = "list_transform(list_sort(list_filter([" + ", ".join(f"case when {c} then struct_pack(l := {lvl}, i := {i}, w := {w}) end" for i, (c, lvl, w) in enumerate(recs)) + "], lambda x: x is not null)), lambda x: x.w)"
    return f"""with {NOTES}, st as (select note_id, text, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as n, length(text) as nc,
 list_transform(list_filter(list_transform(flatten(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), lambda x: string_split(regexp_replace(regexp_replace(x, '{titles}', '\\1', 'g'), '[.!?](\\s+[A-Z]|\\s*$)', chr(1) || '\\1', 'g'), chr(1)))), lambda x: trim(x)), lambda x: x <> ''), lambda x: len(regexp_split_to_array(x, '\\s+'))) as sw,
 list_transform(list_zip({heads(1)}, {heads(2)}, {heads(3)}), lambda g: lower(trim(coalesce(g[1], '') || coalesce(g[2], '') || coalesce(g[3], '')))) as hd,
 len(regexp_extract_all(text, '{Q.SHORT}')) as sc, len(regexp_extract_all(text, '{Q.TERM}')) as tc, len(regexp_extract_all(text, '{Q.ITEM}')) as it, len(regexp_extract_all(text, '{Q.NUMBER}')) as nu,
 list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: length(x)) as ln, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: trim(x)), lambda x: length(x) > 20) as bl,
 len(list_filter(list_intersect({words(Q.DENIED)}, {words(Q.TOLD)}), lambda w: regexp_matches(w, '\\s') or w in ({", ".join(f"'{w}'" for w in Q.PLAIN)}))) as ag from notes),
s2 as (select *, {", ".join(f"{h} as h{i}" for i, h in enumerate(has))}, len(sw) as ns, coalesce(list_sum(sw), 0) / nullif(len(sw), 0)::double as av, len(list_filter(sw, lambda x: x > 50)) as lg, round(sc / greatest(n, 1)::double, 4) as sr, round(tc / greatest(n, 1)::double, 4) as tr,
 (nc - length(translate(text, ' ' || chr(9) || chr(10) || chr(13), '')))::double / nullif(nc, 0) as ws, len(list_filter(hd, lambda h: h in ({", ".join(f"'{k}'" for k in Q.KNOWN)}))) as kn, len(bl) - len(list_distinct(list_transform(bl, lambda x: lower(x)))) as tw,
 coalesce(len(ln) >= 3 and list_aggregate(ln, 'stddev_samp') > 80, false) as rg from st),
s3 as (select *, 100e0 - case when n < 30 then least(40, (30 - n) * 2) else 0 end - (1 - ({" + ".join(f"h{i}::int" for i in range(len(has)))}) / {len(has)}e0) * 40 as c0,
 case when ns = 0 then 0 else 100e0 - case when av > 35 then least(25, (av - 35) * 2) when av < 3 then 15 else 0 end - least(15, lg * 5) - case when sr > 0.25e0 then least(20, (sr - 0.25e0) * 100) else 0 end end as r0,
 100e0 - case when ws > 0.5e0 then 15 when ws < 0.1e0 and nc > 100 then 10 else 0 end - case when len(hd) = 0 and n > 50 then 20 when len(hd) > 0 and kn / len(hd)::double < 0.5e0 then 10 else 0 end as x0,
 70e0 + case when tr >= 0.1e0 then 25 when tr >= 0.05e0 then 15 when tr < 0.02e0 and n > 30 then -15 else 0 end + case when nu >= 5 then 5 when nu = 0 and n > 50 then -5 else 0 end as d0,
 100e0 - least(30, tw * 15) - least(20, ag * 10) as k0 from s2),
s4 as (select *, greatest(0, least(100, case when len(hd) >= 6 then least(100, c0 + 5) else c0 end)) as completeness, greatest(0, least(100, r0)) as readability, greatest(0, least(100, case when it >= 3 then least(100, x0 + 5) else x0 end - case when rg then 5 else 0 end)) as structure,
 greatest(0, least(100, d0)) as information_density, greatest(0, least(100, k0)) as consistency from s3),
s5 as (select *, greatest(0, least(100, completeness * 0.2e0 + readability * 0.2e0 + structure * 0.2e0 + information_density * 0.2e0 + consistency * 0.2e0)) as total from s4),
qu as (select note_id, round(completeness, 2) as completeness, round(readability, 2) as readability, round(structure, 2) as structure, round(information_density, 2) as information_density, round(consistency, 2) as consistency, round(total, 2) as overall,
 case when total >= 90 then 'A' when total >= 80 then 'B' when total >= 70 then 'C' when total >= 60 then 'D' else 'F' end as grade, array_to_string({rec}, '; ') as recommendations, n::int as word_count, ns::int as sentence_count, len(hd)::int as section_count, sha256(text) as text_hash from s5)"""


def _abbrev_sql() -> str:
    plain = A.entries()
    line = f"{[*EXTRA]}"
    ext = NOTES.replace("notes as materialized (", "base as (") + f", notes as materialized (select note_id, text || chr(10) || {line}[(note_id % {len(EXTRA)} + 1)::int] as text from base)"
    spans = " union all ".join(_scan_sql("notes", "note_id", p, "1 as one") for p in A.patterns({*plain, *A.SENSES}))
    ctx = 'lower(substring(text, greatest(start - 50, 0) + 1, start - greatest(start - 50, 0)) || match || substring(text, "end" + 1, 50))'
    whens = []
    for k, senses in A.SENSES.items():
        hits = ["(" + " + ".join(f"contains(ctx, '{w}')::int" for w in words) + ")" for _, _, words in senses]
        by = [f"when section in ({', '.join(repr(h) for h, o in A.SECTIONS.items() if o.get(k) == e)}) then struct_pack(e := '{e}', d := '{d}', c := 0.9e0, r := 'section')" for e, d, _ in senses if any(o.get(k) == e for o in A.SECTIONS.values())]
        said = [f"when {h} > 0 and {h} = greatest({', '.join(hits)}) then struct_pack(e := '{e}', d := '{d}', c := least(0.9e0, 0.7e0 + {h} * 0.05e0), r := 'context')" for h, (e, d, _) in zip(hits, senses)]
        whens.append(f"when '{k}' then case {' '.join(by + said)} else struct_pack(e := '{senses[0][0]}', d := '{senses[0][1]}', c := 0.6e0, r := 'default') end")
    whens += [f"when '{k}' then struct_pack(e := '{e}', d := '{d}', c := {c}e0, r := 'unambiguous')" for k, (d, e, c) in plain.items()]
    known = "case " + " ".join(f"when contains(hh, '{h}') then '{h}'" for h in A.SECTIONS) + " end"
    surer = "y[1].confidence > acc[-1].confidence or (y[1].confidence = acc[-1].confidence and y[1].stop - y[1].start > acc[-1].stop - acc[-1].start)"
    keep = f"case when y[1].start >= acc[-1].stop then list_concat(acc, y) when {surer} then list_concat(acc[:-2], y) else acc end"
    return f"""with {ext}, raw as ({spans}),
hd as (select note_id, start, lower(trim(rtrim(trim(translate(match, chr(10) || chr(9) || chr(13), '   ')), ':-'))) as hh from ({_scan_sql('notes', 'note_id', A.header_pattern(), '1 as one')})),
hs as (select note_id, start, {known} as name from hd where {known} is not null),
cx as (select note_id, start, "end" as stop, match, lower(match) as key, {ctx} as ctx, (select arg_max(name, hs.start) from hs where hs.note_id = raw.note_id and hs.start <= raw.start) as section from raw join notes using (note_id)),
so as (select *, case key {" ".join(whens)} end as s from cx),
tl as (select note_id, start, stop, match, s.e as expansion, round(s.c, 4) as confidence, s.d as domain, s.r as resolution from so),
fo as (select note_id, unnest(f) as s from (select note_id, list_reduce(list_transform(list(struct_pack(start := start, stop := stop, match := match, expansion := expansion, confidence := confidence, domain := domain, resolution := resolution) order by start, start - stop), lambda x: [x]), lambda acc, y: {keep}) as f from tl group by note_id)),
ab as (select note_id, s.match as abbreviation, s.expansion as expansion, s.start as start, s.stop as "end", s.confidence as confidence, s.domain as domain, s.resolution <> 'unambiguous' as is_ambiguous, s.resolution as resolution from fo where s.confidence >= 0.6e0)"""


def _concept_sql() -> str:
    rows = [(cui, term, icd, group, kind, name.lower()) for cui, term, aliases, _, icd, group in C.CONCEPTS for kind, names in enumerate(([term], aliases)) for name in names]
    values = ", ".join(f"('{a}', '{b}', {repr(c) if c else 'null'}, '{d}', {k}, '{n}', {i})" for i, (a, b, c, d, k, n) in enumerate(rows))
    group = "case type " + " ".join(f"when '{k}' then '{v}'" for k, v in C.GROUPS.items()) + " end"
    return NER + f""", mn as (select note_id, type, start, match from ner union all select note_id, 'DISEASE', start, match from ({_scan_sql('notes', 'note_id', CONDITIONS, '1 as one')})),
di(cui, term, icd10, type_group, kind, name, place) as (values {values}),
ky as (select *, regexp_replace(trim(regexp_replace(lower(match), '\\s+', ' ', 'g')), '[.]+$', '') as key, {group} as g from mn),
cn as (select ky.note_id, ky.type, ky.start, ky.match, arg_min(struct_pack(cui := cui, term := term, icd10 := icd10, kind := kind), kind * 100000 + place) as c from ky left join di on key = name and (g is null or g = type_group) group by all),
co as (select note_id, type, start, match, c.cui as cui, c.term as term, c.icd10 as icd10, case c.kind when 0 then 1.0e0 when 1 then 0.95e0 else 0e0 end as confidence, case c.kind when 0 then 'exact' when 1 then 'alias' else 'none' end as match_type from cn)"""


def _ratio_sql(pairs: str) -> str:
    """key, name, ratio of pairs (key, name): characters in the longest equal stretch, the first of these in key, then in name, and so on to its left and right, over the mean length."""
    same = "coalesce(list_min(list_filter(range(0, least(ahi - i, bhi - j)), lambda d: key[i + d + 1] <> name[j + d + 1])), least(ahi - i, bhi - j))"
    best = f"list_reverse_sort(flatten(list_transform(range(alo, ahi), lambda i: list_transform(range(blo, bhi), lambda j: struct_pack(k := {same}, i := -i, j := -j)))))[1]"
    rows = "[struct_pack(a := alo, b := -x.i, c := blo, d := -x.j, k := 0), struct_pack(a := x.k - x.i, b := ahi, c := x.k - x.j, d := bhi, k := 0), struct_pack(a := 0, b := 0, c := 0, d := 0, k := x.k)]"
    return f"""with recursive seg(key, name, alo, ahi, blo, bhi, k) as (select key, name, 0::bigint, length(key)::bigint, 0::bigint, length(name)::bigint, 0::bigint from ({pairs})
 union all select key, name, r.a, r.b, r.c, r.d, r.k from (select key, name, unnest({rows}) as r from (select *, {best} as x from seg where alo < ahi and blo < bhi) where x.k > 0))
 select key, name, 2.0e0 * sum(k)::double / (length(key) + length(name)) as ratio from seg group by key, name"""


def _normalise_sql() -> str:
    pairs = f"select key, name from (select distinct key from rs), (select distinct name from di) where 2 * least(length(key), length(name)) >= {C.LEAST} * (length(key) + length(name))"
    return CON + f""", rs as (select distinct type, match, key, g from ky where key <> '' and not exists (select 1 from di where name = key and (g is null or g = type_group))),
rt as ({_ratio_sql(pairs)}),
nr as (select type, match, ratio, kind, place, cui, term, icd10, row_number() over (partition by type, match, cui order by kind, place) as k from rs join rt using (key) join di using (name) where ratio >= {C.LEAST} and (g is null or g = type_group)),
fz as (select *, row_number() over (partition by type, match order by ratio desc, kind, place) as r from nr where k = 1)
select note_id, type, start, match, coalesce(co.cui, fz.cui) as cui, coalesce(co.term, fz.term) as term, case when co.cui is null then fz.icd10 else co.icd10 end as icd10,
 case when co.cui is null then coalesce(round(ratio, 4), 0) else co.confidence end as confidence, case when co.cui is null and fz.cui is not null then 'fuzzy' else match_type end as match_type from co left join (select * from fz where r = 1) as fz using (type, match)"""


DOC, QUAL, ABB, CON = _doc_class_sql(), _quality_sql(), _abbrev_sql(), _concept_sql()
ORACLES = {
    "doc_class": DOC + " select * from dc",
    "doc_class_top": DOC + " select note_id, rank, kind as doc_type, confidence from rk where rank <= 3",
    "doc_class_batch": DOC + " select doc_type, count(*) as n, min(confidence) as least, max(confidence) as most from dc group by doc_type",
    "quality_scores": QUAL + " select * from qu",
    "quality_batch": QUAL + " select grade, count(*) as n, round(avg(overall), 4) as avg_score, min(overall) as min_score, max(overall) as max_score from qu group by grade",
    "abbrev_expand": ABB + " select * from ab",
    "abbrev_rewrite": ABB + """, pc as (select *, lag("end", 1, 0) over (partition by note_id order by start) as prev from ab), jn as (select note_id, string_agg(substring(text, prev + 1, "end" - prev) || ' (' || expansion || ')', '' order by start) as head, max("end") as last from pc join notes using (note_id) group by note_id)
select n.note_id, md5(coalesce(head || substring(text, last + 1), text)) as md5 from notes n left join jn using (note_id)""",
    "abbrev_batch": ABB + " select domain, resolution, count(*) as n, count(*) filter (is_ambiguous) as ambiguous from ab group by all",
    "abbrev_lookup": "select * from (values " + ", ".join(f"('{k}', '{e}', '{d}', {b})" for k, e, d, b in A.lookup()) + ") t(abbreviation, expansion, domain, is_ambiguous)",
    "concept_normalise": _normalise_sql(),
    "concept_match_rate": CON + " select count(*) as total, count(*) filter (match_type <> 'none') as matched, round(count(*) filter (match_type <> 'none') / count(*)::double, 4) as match_rate from co",
    "concept_stats": "select * from (values " + ", ".join(f"('{g}', {sum(c[5] == g for c in C.CONCEPTS)}, {sum(len(c[2]) for c in C.CONCEPTS if c[5] == g)}, {sum(c[5] == g and c[3] is not None for c in C.CONCEPTS)}, {sum(c[5] == g and c[4] is not None for c in C.CONCEPTS)})" for g in ("condition", "medication", "procedure")) + ") t(type_group, concepts, aliases, snomed, icd10)",
}
QUERIES = {name: globals()[name] for name in (*ORACLES, "concept_fuzzy")}
