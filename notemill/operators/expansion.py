"""Query expansion by joins with a table of terms, and re-ranking of candidates by rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notemill.functions.text import ABBREVIATIONS, ratio

#: Groups of terms that mean the same.
SYNONYMS = [
    ["hypertension", "high blood pressure", "elevated blood pressure", "htn"], ["myocardial infarction", "heart attack", "mi", "stemi", "nstemi"], ["stroke", "cerebrovascular accident", "cva"],
    ["atrial fibrillation", "afib", "a-fib", "af"], ["diabetes mellitus", "diabetes", "dm", "diabetic"], ["type 2 diabetes", "t2dm", "dm2", "type ii diabetes", "niddm"], ["type 1 diabetes", "t1dm", "dm1", "type i diabetes", "iddm"],
    ["hypothyroidism", "underactive thyroid", "low thyroid"], ["hyperthyroidism", "overactive thyroid", "thyrotoxicosis"], ["shortness of breath", "dyspnea", "dyspnoea", "sob", "breathlessness"],
    ["chronic obstructive pulmonary disease", "copd", "emphysema"], ["pneumonia", "pna", "lung infection"], ["pain", "ache", "discomfort", "tenderness", "soreness"], ["headache", "cephalalgia", "ha"], ["nausea", "queasy", "nauseated"],
    ["fever", "pyrexia", "febrile", "elevated temperature"], ["edema", "oedema", "swelling", "fluid retention"], ["fatigue", "tiredness", "malaise", "lethargy", "asthenia"], ["gastroesophageal reflux", "gerd", "acid reflux", "heartburn"],
    ["constipation", "obstipation", "decreased bowel movements"], ["diarrhea", "diarrhoea", "loose stools"], ["chronic kidney disease", "ckd", "chronic renal failure", "crf"], ["acute kidney injury", "aki", "acute renal failure", "arf"],
    ["anemia", "anaemia"], ["hemorrhage", "haemorrhage"], ["leukemia", "leukaemia"], ["tumor", "tumour"],
]
#: Parts of a re-ranking score.
OVERLAP, ABBREVIATED, SYNONYM, SECTION, DENSITY = 0.35, 0.20, 0.15, 0.15, 0.15
HIGH = r"\b(assessment|plan|impression|diagnosis|conclusion|recommendation|assessment and plan|a/?p|final diagnosis|discharge diagnosis)\b"


def terms(spark: SparkSession) -> DataFrame:
    """term, other, source, step: what a query's term brings in; a small table."""
    full = [(a, f) for a, f in ABBREVIATIONS if a.isalnum()]
    rows = [(a, f, "abbreviation", 1) for a, f in full] + [(f, a, "full form", 2) for a, f in full]
    rows += [(t, o, "synonym", 3) for g in SYNONYMS for t in g for o in g if o != t]
    return spark.createDataFrame(rows, "term string, other string, source string, step int")


def expand(queries: DataFrame, most: int = 10, key: str = "query_id", query: str = "query") -> DataFrame:
    """key, rank, other, source: terms that the query doesn't hold yet, abbreviations first, then by source and alphabet; `most` of them."""
    low = queries.select(key, F.lower(query).alias("_q"), F.regexp_extract_all(F.lower(query), F.lit("[a-z0-9]+"), 0).alias("_w"))
    grams = [F.when(F.size("_w") >= n, F.transform(F.sequence(F.lit(1), F.size("_w") - (n - 1)), _gram(n))).otherwise(F.array().cast("array<string>")) for n in range(1, 5)]
    parts = low.select(key, "_q", F.explode(F.array_distinct(F.flatten(F.array(*grams)))).alias("term"))
    found = parts.join(F.broadcast(terms(queries.sparkSession)), "term").where("not contains(_q, other)")
    first = found.groupBy(key, "other").agg(F.min(F.struct("step", "source")).alias("s"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("s.step", "other"))).where(F.col("rank") <= most)
    return ranked.select(key, "rank", "other", F.col("s.source").alias("source"))


def _gram(n: int):
    return lambda i: F.array_join(F.slice("_w", i, n), " ")


def rerank(candidates: DataFrame, weight: float = 0.4, top_k: int = 10, query: str = "query", text: str = "text", initial: str = "initial", group: str = "query_id", key: str = "doc_id") -> DataFrame:
    """candidates' best top_k by (1 - weight) * rules + weight * initial in each group; ties by key."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0))
    rows = candidates.select(group, key, initial, words(query).alias("_q"), F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0).alias("_all"), F.lower(text).alias("_t"))
    rows = rows.withColumns({"_d": F.array_distinct("_all"), "_hit": F.array_intersect("_q", "_all")})
    n = F.size("_q")
    full = F.create_map(*[x for a, f in ABBREVIATIONS if a.isalnum() for x in (F.lit(a), F.lit(f.split()))])
    same = F.create_map(*[x for t in sorted({t for g in SYNONYMS for t in g if t.isalnum()}) for x in (F.lit(t), F.lit(sorted({w for g in SYNONYMS if t in g for o in g if o != t for w in o.replace("-", " ").split()})))])
    meets = lambda table: F.size(F.filter("_q", lambda q: F.coalesce(F.arrays_overlap(F.element_at(table, q), F.col("_d")), F.lit(False))))
    near = F.regexp_extract_all("_t", F.lit(rf"(?s){HIGH}.{{0,300}}"), 0)
    section = F.coalesce(F.array_max(F.transform(near, lambda w: F.size(F.array_intersect(F.regexp_extract_all(w, F.lit("[a-z0-9]+"), 0), "_q")) / n)), F.lit(0.0))
    density = F.least(F.size("_hit") / F.greatest(F.log(F.size("_all") + 1.0), F.lit(1.0)), F.lit(1.0))
    score = OVERLAP * ratio(F.size("_hit"), n) + ABBREVIATED * F.least(meets(full) / n, F.lit(1.0)) + SYNONYM * F.least(meets(same) / n, F.lit(1.0)) + SECTION * F.least(section, F.lit(1.0)) + DENSITY * density
    scored = rows.select(group, key, F.round((1 - weight) * F.when(n > 0, score).otherwise(0.0) + weight * F.col(initial), 4).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), key)))
    return ranked.where(F.col("rank") <= top_k)
