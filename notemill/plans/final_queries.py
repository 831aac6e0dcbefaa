"""Expansion, re-ranking, summaries, text pairs, stored tables and the composed pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from notemill.operators import analysis as A
from notemill.operators import comorbidity as M
from notemill.operators import entities as E
from notemill.operators import expansion as X
from notemill.operators import scoring as R
from notemill.operators import search
from notemill.operators import summaries as Y
from notemill.plans import clinical_queries, context_queries, note_queries, scoring_queries
from notemill.plans.clinical_queries import NER, NOTES
from notemill.plans.monitor_queries import _pairs, _span_votes
from notemill.sources import notes as N
from notemill.sources import store


def _queries(spark, sf):
    """A query for each part: three of the terms that expansion knows, and others."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    names = ["htn", "heart attack", "shortness of breath", "chest pain", "copd", "fever", "mi", "routine visit", "type 2 diabetes", "anemia"]
    return p.select(F.col("p_partkey").alias("query_id"), F.concat(F.element_at(F.lit(names), (F.col("p_partkey") % 10 + 1).cast("int")), F.lit(" and "), F.element_at(F.lit(names), (F.col("p_partkey") % 7 + 1).cast("int"))).alias("query"))


def query_expand(spark, sf):
    return X.expand(_queries(spark, sf))


def rerank(spark, sf):
    n = N.notes(spark, sf).select(F.col("note_id").alias("doc_id"), "text")
    top = search.bm25(n, "hypertension fever pneumonia").orderBy(F.desc("bm25"), "doc_id").limit(200)
    return X.rerank(top.select(F.lit(1).alias("query_id"), F.lit("hypertension fever pneumonia").alias("query"), "doc_id", "text", F.round(F.col("bm25") / 10, 4).alias("initial")), top_k=20)


def textrank(spark, sf):
    return Y.summarise(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "sentences", "kept", F.length("summary").cast("bigint").alias("n"))


def rouge_l(spark, sf):
    r = Y.rouge_l(_pairs(spark, sf))
    return r.select("pair_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def partial_ner(spark, sf):
    v = _span_votes(spark, sf)
    return Y.partial_matches(v.where("model = 'm0'"), v.where("model = 'm1'")).select("doc_id", F.round("credit", 6).alias("credit"), "n_gold", "n_guess")


def sink_documents(spark, sf):
    return store.documents(spark.read.parquet(f"{sf}/documents.parquet")).drop("content")


def sink_entities(spark, sf):
    return store.entity_rows(E.extract(N.notes(spark, sf), "note_id"), "note_id")


def sink_metrics(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return store.exposition(d.groupBy("lang").agg(F.count("*").alias("n")), "documents_total", "lang", "n")


def sink_audit(spark, sf):
    """The rows that analysing each document would append."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return store.audit_rows(d, "analyse", "rules-1", "doc_id", status=F.when(F.length("text") > 0, 200).otherwise(422))


def sink_predictions(spark, sf):
    r = R.risk(N.notes(spark, sf), "note_id")
    return store.predictions(r, ["risk_level"], "risk", "rules-1", "note_id")


def sink_unprocessed(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("document_id"))
    return store.unprocessed(d, d.where("document_id % 3 = 0"))


def sink_frames(spark, sf):
    return store.server_sent(spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", "n_name"), "nation")


def job_progress(spark, sf):
    """By customer as a job: orders, those that are done, and the share."""
    o = spark.read.parquet(f"{sf}/orders.parquet").groupBy("o_custkey").agg(F.count("*").alias("total"), F.sum((F.col("o_orderstatus") == "F").cast("bigint")).alias("done"))
    return o.withColumn("progress", store.progress(F.col("total"), F.col("done")))


def seed_codes(spark, sf):
    rules = spark.createDataFrame([(c, t) for _, c, t, _ in R.ICD_RULES], "code string, description string")
    return store.new_only(rules, rules.where("code < 'G'"), "code").withColumn("chapter", R.chapter(F.col("code")))


#: Modules of the composed pipeline that give spans or codes, and the query that each must agree with.
MODULES = {
    "entities": "ner_rules", "phi": "phi_detect", "vitals": "vitals_extract", "codes": "icd_rules", "comorbidities": "charlson_text", "medications": "med_extract", "allergies": "allergy_extract", "temporal": "temporal_extract",
    "determinants": "sdoh_extract", "sections": "sections_parse", "relations": "relations", "concepts": "concept_normalise",
}


def pipeline_enhanced(spark, sf):
    """A row a note: how much each module found in its original text, document type, quality grade and risk level.

    One reading of the notes tells all but relations, which need what stands between entities; both are put together in one shuffle of ids without a join.
    Every mention counts as a concept looked up, met or not, so that mentions are counted.
    """
    n = N.notes(spark, sf)
    own = {"conditions": [(scoring_queries.CONDITIONS,)], "illnesses": [(p,) for p in M.TEXT.values()]}
    told = A.analyse(n, context_queries.REF, "note_id", modules=[m for m in A.MODULES if m in MODULES or m in A.WHOLE], own=own)
    sizes = {m: F.size(m) for m in MODULES if m in A.MODULES} | {"comorbidities": F.size(M.categories(F.col("illnesses"))), "concepts": F.size("entities") + F.size("conditions")}
    rows = told.select("note_id", *[c.cast("bigint").alias(m) for m, c in sizes.items()], "document_type.doc_type", "quality.grade", "risk.risk_level")
    every = rows.unionByName(context_queries.relations(spark, sf).select("note_id", F.lit(1).cast("bigint").alias("relations")), allowMissingColumns=True)
    return every.groupBy("note_id").agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MODULES], *[F.max(c).alias(c) for c in ("doc_type", "grade", "risk_level")])


def _enhanced_sql() -> str:
    # each mention is a row, whatever it is like
    known = {**clinical_queries.ORACLES, **context_queries.ORACLES, **scoring_queries.ORACLES, **note_queries.ORACLES, "concept_normalise": note_queries.CON + " select * from co"}
    joins = "".join(f" left join (select note_id, count(*) as {name} from ({known[query]}) group by note_id) as m_{name} using (note_id)" for name, query in MODULES.items())
    rows = "".join(f" join (select note_id, {c} from ({known[query]})) as r_{c} using (note_id)" for query, c in (("doc_class", "doc_type"), ("quality_scores", "grade"), ("risk_total", "risk_level")))
    return f"with {NOTES} select note_id, {', '.join(f'coalesce({name}, 0) as {name}' for name in MODULES)}, doc_type, grade, risk_level from notes{joins}{rows}"


PART = "['htn', 'heart attack', 'shortness of breath', 'chest pain', 'copd', 'fever', 'mi', 'routine visit', 'type 2 diabetes', 'anemia']"
TERMS = [(a, f, "abbreviation", 1) for a, f in X.ABBREVIATIONS if a.isalnum()] + [(f, a, "full form", 2) for a, f in X.ABBREVIATIONS if a.isalnum()] + [(t, o, "synonym", 3) for g in X.SYNONYMS for t in g for o in g if o != t]
ORACLES = {
    "query_expand": f"""with q as (select p_partkey as query_id, {PART}[(p_partkey % 10 + 1)::int] || ' and ' || {PART}[(p_partkey % 7 + 1)::int] as query from part),
t(term, other, source, step) as (values {", ".join(f"('{a}', '{b}', '{c}', {d})" for a, b, c, d in TERMS)}),
w as (select query_id, query, regexp_extract_all(query, '[a-z0-9]+') as w from q),
g as (select distinct query_id, query, unnest(list_concat({", ".join(f"case when len(w) >= {n} then list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(list_slice(w, i, i + {n - 1}), ' ')) else [] end" for n in range(1, 5))})) as term from w),
f as (select query_id, other, min(struct_pack(step := step, source := source)) as s from g join t using (term) where not contains(query, other) group by all),
r as (select *, row_number() over (partition by query_id order by s.step, other)::int as rank from f)
select query_id, rank, other, s.source as source from r where rank <= 10""",
    "sink_documents": "select doc_id as document_id, sha256(text) as content_hash, 'import' as source, false as is_processed from documents",
    "sink_entities": NER + """ select note_id as document_id, type as entity_type, match as text, start as start_char, "end" as end_char, 0.9::double as confidence, 'rules-1' as model_version from ner""",
    "sink_metrics": """select 'documents_total{lang="' || lang || '"} ' || count(*) as line from documents group by lang""",
    "sink_audit": "select 'analyse' as action, 'document' as resource_type, doc_id::varchar as resource_id, sha256(text) as document_hash, 'rules-1' as model_version, case when length(text) > 0 then 200 else 422 end as status_code from documents",
    "sink_predictions": "select note_id as document_id, 'risk' as prediction_type, 'rules-1' as model_name, '{\"risk_level\":\"' || risk_level || '\"}' as result, null::double as confidence from (" + scoring_queries.ORACLES["risk_total"] + ")",
    "sink_unprocessed": "select doc_id as document_id from documents where doc_id % 3 <> 0",
    "sink_frames": """select 'event: nation' || chr(10) || 'data: {"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' || chr(10) || chr(10) as frame from nation""",
    "job_progress": "select o_custkey, count(*) as total, count(*) filter (o_orderstatus = 'F') as done, round(count(*) filter (o_orderstatus = 'F') / count(*)::double, 4) as progress from orders group by o_custkey",
    "seed_codes": "select * from (values " + ", ".join(f"('{c}', '{t}', '{next(v for k, v in R.CHAPTERS.items() if c[0] in k)}')" for _, c, t, _ in R.ICD_RULES if c >= "G") + ") t(code, description, chapter)",
    "pipeline_enhanced": _enhanced_sql(),
}
QUERIES = {name: globals()[name] for name in (*ORACLES, "rerank", "textrank", "rouge_l", "partial_ner")}
