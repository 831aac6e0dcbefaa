"""Assertion status of entities: negated, possible, family, hypothetical or conditional, by triggers in the entity's sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.functions import spans as S

#: Triggers before an entity as (pattern, status, priority, scope in characters).
PRE = [
    (r"\bno\s+(?:evidence\s+of\s+)?", "absent", 3, 40), (r"\bnot\s+(?:any\s+)?", "absent", 3, 40), (r"\bdenies?\s+(?:any\s+)?", "absent", 4, 60), (r"\bdenying\s+", "absent", 4, 60),
    (r"\bwithout\s+(?:any\s+)?", "absent", 3, 50), (r"\bnegative\s+for\s+", "absent", 5, 50), (r"\babsence\s+of\s+", "absent", 5, 40), (r"\bno\s+signs?\s+of\s+", "absent", 5, 50),
    (r"\bno\s+complaints?\s+of\s+", "absent", 5, 50), (r"\bfree\s+of\s+", "absent", 4, 40), (r"\bresolved\s+", "absent", 3, 30), (r"\bno\s+further\s+", "absent", 4, 50),
    (r"\bno\s+(?:new|acute|significant)\s+", "absent", 4, 50), (r"\bno\s+longer\s+(?:has|have|experiencing)\s+", "absent", 5, 60), (r"\bruled\s+out\s+", "absent", 4, 40), (r"\bno\s+history\s+of\s+", "absent", 5, 50),
    (r"\bnever\s+(?:had|has|have)\s+", "absent", 5, 50),
    (r"\bpossible\s+", "possible", 3, 40), (r"\bprobable\s+", "possible", 3, 40), (r"\blikely\s+", "possible", 2, 40), (r"\bsuspected\s+", "possible", 4, 40), (r"\bsuspicious\s+(?:for\s+)?", "possible", 4, 50),
    (r"\bmay\s+(?:have\s+|be\s+)?", "possible", 2, 40), (r"\bmight\s+(?:have\s+|be\s+)?", "possible", 2, 40), (r"\bconcern\s+(?:for|about)\s+", "possible", 4, 50), (r"\brule\s+out\s+", "possible", 5, 40),
    (r"\br/o\s+", "possible", 5, 30), (r"\bquestionable\s+", "possible", 3, 40), (r"\bconsistent\s+with\s+", "possible", 2, 40),
    (r"\bfamily\s+history\s+(?:of\s+)?(?:significant\s+for\s+)?", "family", 6, 60), (r"\bfamilial\s+", "family", 5, 40),
    (r"\b(?:mother|father|sister|brother|parent|sibling|grandmother|grandfather|aunt|uncle|cousin)\s+(?:has|had|with|diagnosed\s+with)\s+", "family", 6, 80),
    (r"\bplan\s+(?:to|for)\s+", "hypothetical", 4, 40), (r"\bscheduled\s+for\s+", "hypothetical", 4, 40), (r"\bconsider\s+(?:starting\s+)?", "hypothetical", 3, 40), (r"\bpending\s+", "hypothetical", 3, 30),
    (r"\bunless\s+", "conditional", 3, 40), (r"\bas\s+needed\s+for\s+", "conditional", 3, 40),
]
#: Triggers after an entity, words that end a trigger's scope, and phrases that only look like triggers.
POST = [
    (r"\s+(?:was|were|is|are)\s+(?:not\s+)?(?:absent|negative|ruled\s+out)", "absent", 4, 50), (r"\s+(?:has|have)\s+been\s+ruled\s+out", "absent", 5, 50), (r"\s+(?:has|have)\s+resolved", "absent", 4, 40),
    (r"\s+(?:is|are)\s+unlikely", "absent", 3, 40), (r"\s+(?:is|are)\s+(?:suspected|questionable|equivocal)", "possible", 3, 50), (r"\bruns?\s+in\s+(?:the\s+)?family\b", "family", 5, 40),
]
ENDS = r"(?i)\bbut\b|\bhowever\b|\byet\b|\bthough\b|\balthough\b|\baside\s+from\b|\bexcept\s+(?:for\s+)?|\bother\s+than\b|\bwhich\b|\bthat\s+(?:is|was|are|were)\b|[;:]"
PSEUDO = r"(?i)\bno\s+(?:increase|decrease|change|improvement|worsening)\s+(?:in|of)\s+|\bnot\s+(?:cause|causing|caused)\s+|\bnot\s+(?:only|just|merely)\s+|\bnot\s+necessarily\s+"
PSEUDO_SCOPE, SURE, DEFAULT = 40, 0.90, 0.80
#: What of a text an entity is judged by: no scope is longer than 80 characters.
BEFORE, AFTER = 240, 400


def _best(gaps: Column, rules: list[tuple]) -> Column:
    """The entry of gaps (a distance for each rule, null where it doesn't hold) of the highest priority, then the smallest distance, then the first."""
    priority, scope, status = (F.lit([r[i] for r in rules]) for i in (2, 3, 1))
    held = F.filter(F.transform(gaps, lambda d, i: F.struct((-F.get(priority, i)).alias("p"), d.alias("d"), i.alias("i"), (d.isNotNull() & (d <= F.get(scope, i))).alias("ok"))), lambda s: s["ok"])
    first = F.get(F.array_sort(held), F.lit(0))
    return F.when(F.exists(gaps, lambda d: d.isNotNull()) & first.isNotNull(), F.struct((-first["p"]).alias("priority"), first["d"].alias("distance"), F.get(status, first["i"]).alias("status")))


def detect(entities: DataFrame, own: list[tuple] | tuple = ()) -> DataFrame:
    """entities (match, pre, post: BEFORE and AFTER characters around, ...) with status and assertion_confidence; rows are judged one by one.

    The sentence ends at a newline, or at . ! or ? before white space and a capital. Before an entity a trigger's last occurrence counts, unless a
    scope word follows it; after one its first. A trigger before wins a tie.

    own: more triggers as (pattern, place, status, priority, scope), place being pre, post, pseudo (a phrase that only looks like a trigger) or end (a word that
    ends scopes); those two need no more fields. Statuses may be new ones. Patterns are matched in any case and come after those of the library, which win ties.
    """
    if wrong := [t for t in own if t[1] not in ("pre", "post", "pseudo", "end")]:
        raise ValueError(f"not places of triggers: {wrong}")
    pre_rules, post_rules = ([*rules, *[(p, *rest) for p, at, *rest in own if at == place]] for rules, place in ((PRE, "pre"), (POST, "post")))
    ends, false = ("|".join([known, *[f"(?i:{t[0]})" for t in own if t[1] == place]]) for known, place in ((ENDS, "end"), (PSEUDO, "pseudo")))
    # up to the entity's first character, so that a capital there ends the sentence before it
    head = F.regexp_replace(F.concat("pre", F.left("match", F.lit(1))), r"(?s)^.*(?:[.!?]\s+(?=[A-Z])|\n\s*(?=\S))", "")
    tail = F.regexp_replace(F.col("post"), r"(?s)(?:\n|(?<=[.!?])\s+(?=[A-Z])).*$", "")
    near = entities.withColumns({"_pre": F.left(head, F.greatest(F.length(head) - 1, F.lit(0))), "_post": tail})
    near = near.withColumns({"_low": F.lower("_pre"), "_behind": F.lower("_post")})
    # a trigger's pattern is tried only where a piece of it is met
    after = F.array(*[F.when(S.may(F.col("_low"), p) & F.col("_pre").rlike("(?i)" + p), F.regexp_extract("_pre", rf"(?is)^.*(?:{p})(.*)$", 1)) for p, *_ in pre_rules])
    later = F.array(*[F.when(S.may(F.col("_behind"), p) & F.col("_post").rlike("(?i)" + p), F.length(F.regexp_extract("_post", rf"(?is)^(.*?)(?:{p})", 1))) for p, *_ in post_rules])
    pseudo = F.when(S.may(F.col("_low"), false) & F.col("_pre").rlike(false), F.length(F.regexp_extract("_pre", rf"(?s)^.*(?:{false})(.*)$", 1)))
    near = near.withColumns({"_after": after, "_later": later, "_pseudo": pseudo}).drop("_pre", "_post", "_low", "_behind")
    near = near.withColumn("_gaps", F.transform("_after", lambda g: F.when(~g.rlike(ends), F.length(g))))
    near = near.withColumns({"_a": _best(F.col("_gaps"), pre_rules), "_b": _best(F.col("_later"), post_rules)})
    best = F.when(F.col("_b").isNull() | (F.col("_a.priority") >= F.col("_b.priority")), F.col("_a")).otherwise(F.col("_b"))
    near = near.withColumn("_best", best)
    sure = F.least(F.greatest(SURE + F.col("_best.priority") * 0.02 - F.col("_best.distance") / 10 * 0.01, F.lit(0.5)), F.lit(1.0))
    blocked = F.coalesce(F.col("_pseudo") <= PSEUDO_SCOPE, F.lit(False))
    out = near.withColumns({"status": F.when(blocked, "present").otherwise(F.coalesce("_best.status", F.lit("present"))), "assertion_confidence": F.round(F.when(blocked, SURE).otherwise(F.coalesce(sure, F.lit(DEFAULT))), 6)})
    return out.drop("_after", "_later", "_pseudo", "_gaps", "_a", "_b", "_best")


#: Headers of sections that say what their entities are, and a header that begins any other section.
SECTIONS = [
    (r"(?i)(?:^|\n)\s*(?:family\s+history|FH|family\s+hx)\s*[:\-]", "family"), (r"(?i)(?:^|\n)\s*(?:pertinent\s+negatives?|negatives?)\s*[:\-]", "absent"),
    (r"(?i)(?:^|\n)\s*(?:plan|assessment\s+(?:and|&)\s+plan|A/?P|recommendations?|discharge\s+plan)\s*[:\-]", "hypothetical"),
]
ANY_HEADER = r"(?:^|\n)\s*[A-Z][A-Za-z\s]+:\s*(?:\n|$)"
BY_SECTION = 0.85


def in_sections(docs: DataFrame, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, end, match, status, assertion_confidence, by_section of the matches of pattern: where triggers say nothing else, the section they stand in does.

    The section is that of the last header of SECTIONS before the entity, unless another header stands between.
    """
    rules = [(pattern,), *SECTIONS]
    raw = S.found(docs.select(key, text), rules, text, BEFORE, AFTER)
    heads = F.filter("spans", lambda h: h["rule"] > 0)
    last = lambda x: F.array_max(F.transform(F.filter(heads, lambda h: h["end"] <= x["start"]), lambda h: F.struct(h["end"].alias("at"), h["rule"].alias("rule"))))
    between = lambda x: F.substring(F.col(text), (last(x)["at"] + 1).cast("int"), (x["start"] - last(x)["at"]).cast("int"))
    said = lambda x: F.when(~between(x).rlike(ANY_HEADER), F.element_at(F.lit([s for _, s in SECTIONS]), last(x)["rule"]))
    rows = raw.select(key, F.inline(F.transform(F.filter("spans", lambda x: x["rule"] == 0), lambda x: F.struct(x["start"], x["end"], x["match"], x["pre"], x["post"], said(x).alias("section")))))
    judged = detect(rows)
    by = (F.col("status") == "present") & F.col("section").isNotNull()
    return judged.select(key, "start", "end", "match", F.when(by, F.col("section")).otherwise(F.col("status")).alias("status"), F.when(by, BY_SECTION).otherwise(F.col("assertion_confidence")).alias("assertion_confidence"), by.alias("by_section"))
