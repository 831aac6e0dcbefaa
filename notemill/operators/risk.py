"""Risk from a note's text, entities and codes together: scores of 0 to 100 by category, and a second score of 0 to 1. Both are expressions over the row."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.operators import scoring as R

#: Fixed values of the second score: conditions, drugs and urgency words with weights, weights of codes by their beginning, words and share of each category.
CONDITIONS = {
    "acute myocardial infarction": 0.9, "stroke": 0.9, "pulmonary embolism": 0.9, "sepsis": 0.9, "acute respiratory failure": 0.85, "acute kidney injury": 0.8, "diabetic ketoacidosis": 0.8, "cardiac arrest": 0.95, "heart failure": 0.7,
    "coronary artery disease": 0.65, "chronic kidney disease": 0.6, "cirrhosis": 0.7, "cancer": 0.7, "hiv": 0.6, "copd exacerbation": 0.65, "pneumonia": 0.5, "urinary tract infection": 0.3, "hypertension": 0.4, "diabetes mellitus": 0.45, "obesity": 0.35,
}
DRUGS = {"warfarin": 0.7, "heparin": 0.7, "insulin": 0.6, "digoxin": 0.65, "lithium": 0.65, "methotrexate": 0.7, "prednisone": 0.5, "fentanyl": 0.75, "morphine": 0.7, "oxycodone": 0.7, "diazepam": 0.5, "alprazolam": 0.5}
URGENT = [(0.8, ["stat", "emergent", "critical", "immediate", "urgent", "emergency"]), (0.5, ["acute", "severe", "unstable", "decompensated", "rapid"]), (0.3, ["moderate", "concerning", "abnormal", "significant"])]
ISSUES = ["diagnosis", "symptom", "abnormal", "positive for", "evidence of"]
STARTS = [("I", 0.6), ("E", 0.5), ("C", 0.7), ("D0", 0.7), ("D1", 0.7), ("D2", 0.7), ("D3", 0.7), ("D4", 0.7), ("J", 0.45), ("K", 0.4)]
OTHER_START = 0.3
WORDS = {
    "cardiovascular": (0.2, ["hypertension", "cardiac", "heart", "coronary", "atrial", "myocardial"]), "infection": (0.25, ["infection", "sepsis", "bacterial", "viral", "immunocompromised"]),
    "surgical": (0.2, ["surgery", "operative", "procedure", "incision", "post-op"]), "follow_up": (0.3, ["non-compliant", "missed", "lost to follow", "no show"]),
}
SHARES = {"medication": 0.25, "cardiovascular": 0.25, "infection": 0.2, "surgical": 0.15, "follow_up": 0.15}
#: Types of entities that unit_score() and assess() ask for.
TYPES = ("MEDICATION", "DISEASE", "SYMPTOM")
#: All words that unit_score(), assess() and with_codes() look for, for spans.found().
TERMS = sorted({*(w for _, words in URGENT for w in words), *CONDITIONS, *ISSUES, *(w for _, words in WORDS.values() for w in words), *R.HIGH_RISK, *R.URGENT, *(k for keys, *_ in R.ICD_RULES for k in keys)})


def _factor(name: Column, weight: Column, value: Column) -> Column:
    return F.struct(name.alias("name"), weight.cast("double").alias("weight"), value.cast("double").alias("value"))


def _lit(name: str, weight: float, value: float = 1.0) -> Column:
    return _factor(F.lit(name), F.lit(weight), F.lit(value))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def known(held: str) -> Callable[[str], Column]:
    """Whether a text holds one of TERMS, by the column that spans.found() made of them."""
    at = {w: i for i, w in enumerate(TERMS)}
    return lambda w: F.get(held, F.lit(at[w]))


def _searched(word: str) -> Column:
    return F.contains("_l", F.lit(word))


def unit_score(docs: DataFrame, key: str = "doc_id", text: str = "text", entities: str | None = None, codes: str | None = None, held: str | None = None) -> DataFrame:
    """key, overall (0 to 1, to 6 places), level, the category scores, n_factors, factors (the first ten names), recommendations.

    entities: a column of array<struct<type, match, is_negated>>; codes: a column of array<struct<code, confidence>>; null counts as empty.
    held: a column that says which of TERMS the text holds; the text is not read then.
    """
    has = known("_l") if held else _searched
    count = lambda words: reduce(lambda a, w: a + has(w).cast("int"), words, F.lit(0))
    none_e, none_c = F.expr("cast(array() as array<struct<type:string,match:string,is_negated:boolean>>)"), F.expr("cast(array() as array<struct<code:string,confidence:double>>)")
    e = F.coalesce(F.transform(entities, lambda x: F.struct(x["type"], F.lower(x["match"]).alias("match"), x["is_negated"])), none_e) if entities else none_e
    c = F.coalesce(F.slice(F.col(codes), 1, 10), none_c) if codes else none_c
    t = docs.select(key, (F.col(held) if held else F.lower(F.coalesce(F.col(text), F.lit("")))).alias("_l"), e.alias("_e"), c.alias("_c"))
    said = [F.when(has(w), _lit(f"urgency_{w}", weight)) for weight, words in URGENT for w in words]
    said += [F.when(has(w), _lit(w.replace(" ", "_"), weight)) for w, weight in CONDITIONS.items()]
    issues = count(ISSUES)
    said.append(F.when(issues >= 5, _factor(F.lit("multiple_issues"), F.lit(0.5), F.least(F.lit(1.0), issues / 10))))
    drugs = F.filter("_e", lambda x: x["type"] == "MEDICATION")
    many = F.filter(F.array(_factor(F.lit("polypharmacy"), F.lit(0.5), F.least(F.lit(1.0), F.size(drugs) / 10))), lambda x: F.size(drugs) >= 5)
    risky = F.flatten(F.transform(drugs, lambda x: F.array_compact(F.array(*[F.when(F.contains(x["match"], F.lit(d)), _lit(f"high_risk_med_{d}", w)) for d, w in DRUGS.items()]))))
    sick = F.filter("_e", lambda x: (x["type"] == "DISEASE") & ~x["is_negated"])
    ill = F.flatten(F.transform(sick, lambda x: F.array_compact(F.array(*[F.when(F.contains(x["match"], F.lit(d)) | F.contains(F.lit(d), x["match"]), _factor(F.concat(F.lit("disease_"), F.left(x["match"], F.lit(20))), F.lit(w), F.lit(1.0))) for d, w in CONDITIONS.items()]))))
    weight = lambda code: F.coalesce(*[F.when(F.startswith(code, F.lit(s)), w) for s, w in STARTS], F.lit(OTHER_START))
    coded = F.transform("_c", lambda x: _factor(F.concat(F.lit("icd_"), x["code"]), weight(x["code"]) * x["confidence"], x["confidence"]))
    t = t.select(key, "_l", F.concat(F.array_compact(F.array(*said)), many, risky, ill, coded).alias("f"))
    times = lambda xs: _sum(F.transform(xs, lambda x: x["weight"] * x["value"]))
    drug_factors = F.filter("f", lambda x: F.contains(x["name"], F.lit("med")) | F.contains(x["name"], F.lit("polypharmacy")))
    heavy = F.filter("f", lambda x: x["weight"] > 0.6)
    t = t.select(key, "f", F.least(F.lit(1.0), times(drug_factors) / 2).alias("medication"), *[F.least(F.lit(1.0), count(words) * step).alias(name) for name, (step, words) in WORDS.items()], (times(heavy) / F.greatest(F.size(heavy), F.lit(1))).alias("_boost"))
    shared = reduce(lambda a, n: a + F.col(n) * SHARES[n], SHARES, F.lit(0.0))
    t = t.withColumn("_o", F.least(F.lit(1.0), F.greatest(F.lit(0.0), shared * 0.7 + F.col("_boost") * 0.3)))
    s, watch = F.col("_o"), F.transform(F.filter("f", lambda x: x["weight"] > 0.7), lambda x: x["name"])
    advice = F.slice(F.array_compact(F.array(
        F.when(s >= 0.8, "immediate review"), F.when(s >= 0.8, "consider specialist care"), F.when((s >= 0.6) & (s < 0.8), "follow-up within 72 hours"), F.when((s >= 0.4) & (s < 0.6), "follow-up within 2 weeks"),
        F.when(F.col("medication") > 0.6, "review medication"), F.when(F.col("cardiovascular") > 0.6, "cardiology consultation"), F.when(F.col("infection") > 0.6, "infectious disease workup"),
        F.when(F.size(watch) > 0, F.concat(F.lit("monitor: "), F.array_join(F.slice(watch, 1, 3), ", "))),
    )), 1, 5)
    level = F.when(s >= 0.8, "critical").when(s >= 0.6, "high").when(s >= 0.4, "moderate").otherwise("low")
    return t.select(key, F.round(s, 6).alias("overall"), level.alias("level"), *[F.round(n, 6).alias(n) for n in SHARES], F.size("f").alias("n_factors"), F.transform(F.slice("f", 1, 10), lambda x: x["name"]).alias("factors"), advice.alias("recommendations"))


def assess(docs: DataFrame, key: str = "doc_id", text: str = "text", entities: str | None = None, codes: str | None = None, held: str | None = None) -> DataFrame:
    """key, medication_risk, diagnostic_complexity, follow_up_urgency, overall_score (0 to 100, all to 4 places, as at 2 many are ties), risk_level, recommendations; entities, codes and held as for unit_score(), but the text is read."""
    has = known("_l") if held else _searched
    none_e, none_c = F.expr("cast(array() as array<struct<type:string,match:string,is_negated:boolean>>)"), F.expr("cast(array() as array<struct<code:string,confidence:double>>)")
    e = F.filter(F.coalesce(F.transform(entities, lambda x: F.struct(x["type"], F.lower(x["match"]).alias("match"), x["is_negated"])), none_e), lambda x: ~x["is_negated"]) if entities else none_e
    t = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t"), (F.col(held) if held else F.lower(F.coalesce(F.col(text), F.lit("")))).alias("_l"), e.alias("_e"), (F.coalesce(F.col(codes), none_c) if codes else none_c).alias("_c"))
    t = t.withColumn("_m", F.transform(F.filter("_e", lambda x: x["type"] == "MEDICATION"), lambda x: x["match"]))
    found = lambda pairs: F.array_compact(F.array(*[F.when(c, v) for c, v in pairs]))
    like = lambda m, d: F.contains(m, F.lit(d)) | F.contains(F.lit(d), m)
    many = found([(F.size("_m") >= 5, F.least(F.lit(1.0), F.size("_m") / 10.0) * 0.6)])
    named = F.flatten(F.transform("_m", lambda m: F.array_compact(F.array(*[F.when(like(m, d), F.lit(w * w)) for d, w in R.HIGH_RISK.items()]))))
    written = found([(has(d) & ~_any_like(d), F.lit(w * (w * 0.8))) for d, w in R.HIGH_RISK.items()])
    pairs = found([(F.array_contains("_m", a) & F.array_contains("_m", b), F.lit(0.85 * 0.9)) for a, b in R.INTERACTIONS])
    urgent = found([(has(w), F.lit(v * v)) for w, v in R.URGENT.items()])
    active = F.size(F.filter("_e", lambda x: x["type"].isin("DISEASE", "SYMPTOM")))
    several = found([(active >= 3, F.least(F.lit(1.0), active / 8.0) * 0.55)])
    letter = lambda x: F.coalesce(F.create_map(*[F.lit(y) for kv in R.CODE_WEIGHTS.items() for y in kv])[F.upper(F.left(x["code"], F.lit(1)))], F.lit(0.3))
    coded = F.transform("_c", lambda x: letter(x) * letter(x))
    follow = found([(F.col("_t").rlike(p), F.lit(0.75 * 0.7)) for p in R.FOLLOW_UP])
    worst = F.array_compact(F.array(*[F.when(has(w), F.lit(f"urgency_{w}")) for w, v in R.URGENT.items() if v >= 0.85]))
    t = t.select(key, F.concat(many, named, written, pairs).alias("_a"), F.concat(urgent, several, coded).alias("_b"), follow.alias("_f"), worst.alias("_w"))
    t = t.select(key, "_w", *[R._category(F.col(c), 4).alias(name) for c, name in zip(("_a", "_b", "_f"), R.CATEGORIES)])
    t = t.withColumn("overall_score", F.round(F.least(reduce(lambda a, c: a + F.col(c) * R.CATEGORIES[c], R.CATEGORIES, F.lit(0.0)), F.lit(100.0)), 4))
    s, m = F.col("overall_score"), F.col("medication_risk")
    advice = F.slice(F.array_compact(F.array(
        F.when(s >= 80, "urgent: immediate review"), F.when(s >= 80, "consider escalation or admission"), F.when((s >= 60) & (s < 80), "urgent follow-up within 48 hours"), F.when((s >= 35) & (s < 60), "follow-up within 2 weeks"), F.when(s < 35, "standard monitoring"),
        F.when(m >= 60, "reconcile medication"), F.when((m >= 35) & (m < 60), "review medication list"), F.when(F.col("diagnostic_complexity") >= 60, "multi-disciplinary review"), F.when(F.col("follow_up_urgency") >= 50, "coordinate care"),
        F.when(F.size("_w") > 0, F.concat(F.lit("severe: "), F.array_join(F.slice("_w", 1, 3), ", "))),
    )), 1, 6)
    level = F.when(s >= 80, "critical").when(s >= 60, "high").when(s >= 35, "moderate").otherwise("low")
    return t.select(key, *R.CATEGORIES, "overall_score", level.alias("risk_level"), advice.alias("recommendations"))


def _any_like(drug: str) -> Column:
    """Whether a medication of the row was taken for the drug."""
    return F.exists("_m", lambda m: F.contains(m, F.lit(drug)) | F.contains(F.lit(drug), m))
