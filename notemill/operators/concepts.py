"""Concepts for mentions: by preferred term, by alias, then by likeness to either; with type groups."""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Concepts: a parameter; public codes, with some names that notes use for them. identifier, term, aliases, SNOMED, ICD-10, type group.
CONCEPTS = [
    ("C0020538", "Hypertension", ["htn", "hypertensive disease", "raised blood pressure", "high blood pressure", "elevated bp", "arterial hypertension"], "38341003", "I10", "condition"),
    ("C0027051", "Myocardial Infarction", ["mi", "heart attack", "acute coronary infarction", "ami", "acute myocardial infarction", "stemi", "nstemi"], "22298006", "I21.9", "condition"),
    ("C0018802", "Congestive Heart Failure", ["chf", "heart failure", "cardiac decompensation", "hf", "congestive cardiac failure", "cardiac failure"], "42343007", "I50.9", "condition"),
    ("C0004238", "Atrial Fibrillation", ["afib", "auricular fibrillation", "a-fib", "af", "atrial fib"], "49436004", "I48.91", "condition"),
    ("C0011860", "Type 2 Diabetes Mellitus", ["t2dm", "diabetes mellitus", "non insulin dependent diabetes", "type 2 diabetes", "dm2", "dm", "adult onset diabetes", "niddm"], "44054006", "E11", "condition"),
    ("C0038454", "Cerebrovascular Accident", ["stroke", "cva", "apoplexy", "cerebral infarction", "brain attack"], "230690007", "I63.9", "condition"),
    ("C0034065", "Pulmonary Embolism", ["embolism of the lung", "pulmonary thromboembolism", "pe", "pulmonary embolus", "lung embolism"], "59282003", "I26.99", "condition"),
    ("C0024117", "Chronic Obstructive Pulmonary Disease", ["copd", "chronic airflow obstruction", "chronic bronchitis", "emphysema"], "13645005", "J44.1", "condition"),
    ("C0032285", "Pneumonia", ["pneumonitis", "chest infection", "pna", "lung infection", "community acquired pneumonia", "cap"], "233604007", "J18.9", "condition"),
    ("C0017168", "Gastroesophageal Reflux Disease", ["gerd", "reflux oesophagitis", "acid reflux", "reflux", "heartburn"], "235595009", "K21.0", "condition"),
    ("C1561643", "Chronic Kidney Disease", ["ckd", "chronic renal insufficiency", "chronic renal disease", "chronic renal failure", "crf"], "709044004", "N18.9", "condition"),
    ("C0018681", "Headache", ["cephalalgia", "pain in the head", "cephalgia", "head pain"], "25064002", "R51.9", "condition"),
    ("C0004057", "Aspirin", ["acetylsalicylate", "asa", "acetylsalicylic acid"], None, None, "medication"),
    ("C0025598", "Metformin", ["metformin hydrochloride", "glucophage", "metformin hcl"], None, None, "medication"),
    ("C0065374", "Lisinopril", ["lisinopril dihydrate", "zestril", "prinivil"], None, None, "medication"),
    ("C0286651", "Atorvastatin", ["atorvastatin calcium", "lipitor"], None, None, "medication"),
    ("C0043031", "Warfarin", ["warfarin sodium", "coumadin"], None, None, "medication"),
    ("C0024485", "Magnetic Resonance Imaging", ["mri", "nuclear magnetic resonance scan", "mr imaging"], None, None, "procedure"),
]
#: Types of entities to type groups, and how sure each way is.
GROUPS = {"DISEASE": "condition", "SYMPTOM": "condition", "MEDICATION": "medication", "PROCEDURE": "procedure"}
EXACT, ALIAS, LEAST = 1.0, 0.95, 0.80


def dictionary(spark: SparkSession, concepts: list[tuple] | None = None) -> DataFrame:
    """cui, term, snomed, icd10, type_group, place, kind (0 preferred term, 1 alias), name (the key to look up)."""
    rows, at = [], 0
    for cui, term, aliases, snomed, icd, group in concepts or CONCEPTS:
        for kind, names in enumerate(([term], aliases)):
            for name in names:
                rows.append((cui, term, snomed, icd, group, at, kind, name.lower()))
                at += 1
    return spark.createDataFrame(rows, "cui string, term string, snomed string, icd10 string, type_group string, place int, kind int, name string")


def lookup_key(text: Column) -> Column:
    """Lower-cased, trimmed, white space as single spaces, without full stops at the end."""
    return F.rtrim(F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), r"\s", " ")), " +", " "), F.lit("."))


def type_group(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in GROUPS.items() for x in kv])[F.upper(kind)]


def grams(name: Column) -> Column:
    """Pairs of characters, and single ones of names of 3 or fewer: two names as alike as 0.8 have one in common, since their equal stretches are longer than one character on average or both names are that short."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - 1, F.lit(1))), lambda i: F.substring(name, i, F.lit(2)))
    single = F.when(F.length(name) <= 3, F.filter(F.split(name, ""), lambda c: c != "")).otherwise(F.expr("cast(array() as array<string>)"))
    return F.array_distinct(F.concat(pairs, single))


def _ratios(batches):
    for batch in batches:
        ratio = [SequenceMatcher(None, a, b).ratio() for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ratio, pa.float64())], ["key", "name", "ratio"])


def alike(keys: DataFrame, names: DataFrame, least: float = LEAST) -> DataFrame:
    """key, name, ratio of at least `least` (of matched characters): candidates share a pair of characters and fit in length; keys and names are distinct."""
    a = keys.select("key", F.explode(grams(F.col("key"))).alias("gram"))
    b = names.select("name", F.explode(grams(F.col("name"))).alias("gram"))
    n, m = F.length("key"), F.length("name")
    pairs = a.join(b, "gram").where(2 * F.least(n, m) >= least * (n + m)).select("key", "name").distinct()
    return pairs.mapInArrow(_ratios, "key string, name string, ratio double").where(F.col("ratio") >= least)


def normalise(mentions: DataFrame, concepts: DataFrame, text: str = "text", kind: str | None = None, fuzzy: bool = True, least: float = LEAST) -> DataFrame:
    """mentions with cui, term, snomed, icd10, confidence, match_type (exact, alias, fuzzy or none).

    A concept of another type group than the mention's is passed over, and the next way is tried; a mention of no known type takes any. Every distinct
    mention is looked up once, for which the mentions are read once more where likeness counts. Null and blank mentions match nothing.
    """
    group = type_group(F.col(kind)) if kind else F.lit(None).cast("string")
    keyed = mentions.withColumns({"_key": F.coalesce(lookup_key(F.col(text)), F.lit("")), "_group": F.coalesce(group, F.lit(""))})
    # all that can be met exactly, so that the mentions are read once; else what the mentions have
    known = concepts.select(F.col("name").alias("key"), F.explode(F.lit(["", *dict.fromkeys(GROUPS.values())])).alias("group")).distinct().where("key <> ''")
    keys = known if not fuzzy else keyed.select(F.col("_key").alias("key"), F.col("_group").alias("group")).distinct().where("key <> ''")
    # of equal terms the last counts, of equal aliases the first
    names = concepts.withColumn("_k", F.row_number().over(Window.partitionBy("kind", "name").orderBy(F.when(F.col("kind") == 0, -F.col("place")).otherwise(F.col("place"))))).where("_k = 1").drop("_k")
    fits = (F.col("group") == "") | (F.col("group") == F.col("type_group"))
    met = keys.join(names, F.col("key") == F.col("name")).where(fits)
    best = met.groupBy("key", "group").agg(F.min(F.struct("kind", "place", "cui", "term", "snomed", "icd10")).alias("c"))
    best = best.select("key", "group", "c", F.when(F.col("c.kind") == 0, EXACT).otherwise(ALIAS).alias("confidence"), F.when(F.col("c.kind") == 0, "exact").otherwise("alias").alias("match_type"))
    if fuzzy:
        rest = keys.join(best, ["key", "group"], "left_anti")
        ratios = alike(rest.select("key").distinct(), names.select("name").distinct(), least)
        near = rest.join(ratios, "key").join(names, "name").where(fits)
        # an alias counts only if nothing of its concept did before
        near = near.withColumn("_k", F.row_number().over(Window.partitionBy("key", "group", "cui").orderBy("kind", "place"))).where("_k = 1")
        top = near.groupBy("key", "group").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "kind", "place", "cui", "term", "snomed", "icd10")).alias("c"))
        best = best.unionByName(top.select("key", "group", F.struct("c.kind", "c.place", "c.cui", "c.term", "c.snomed", "c.icd10").alias("c"), F.round(-F.col("c.r"), 4).alias("confidence"), F.lit("fuzzy").alias("match_type")))
    best = best.select(F.col("key").alias("_key"), F.col("group").alias("_group"), "c.cui", "c.term", "c.snomed", "c.icd10", "confidence", "match_type")
    out = keyed.join(best, ["_key", "_group"], "left").drop("_key", "_group")
    return out.withColumns({"confidence": F.coalesce("confidence", F.lit(0.0)), "match_type": F.coalesce("match_type", F.lit("none"))})


def match_rate(results: DataFrame) -> DataFrame:
    """One row: total, matched, match_rate."""
    matched = F.sum((F.col("match_type") != "none").cast("bigint"))
    return results.agg(F.count("*").alias("total"), F.coalesce(matched, F.lit(0)).alias("matched"), F.round(F.coalesce(matched / F.count("*"), F.lit(0.0)), 4).alias("match_rate"))


def statistics(concepts: DataFrame) -> DataFrame:
    """By type group: concepts, aliases, and how many have a code of each ontology."""
    own = F.col("kind") == 0
    n = lambda cond: F.sum(cond.cast("bigint"))
    return concepts.groupBy("type_group").agg(n(own).alias("concepts"), n(~own).alias("aliases"), n(own & F.col("snomed").isNotNull()).alias("snomed"), n(own & F.col("icd10").isNotNull()).alias("icd10"))
