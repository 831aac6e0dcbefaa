"""How often something is to be taken: codes, counts a period and intervals as doses a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.functions import spans as S

#: Hours of a period, counts by name, and codes as (count, hours).
HOURS = {"hour": 1, "hr": 1, "day": 24, "daily": 24, "week": 168, "weekly": 168, "month": 720, "monthly": 720}
COUNTS = {"once": 1, "twice": 2, "three times": 3, "four times": 4}
CODES = {"qd": (1, 24), "od": (1, 24), "bid": (2, 24), "tid": (3, 24), "qid": (4, 24), "qhs": (1, 24), "qam": (1, 24), "qpm": (1, 24), "qod": (1, 48), "qwk": (1, 168), "ac": (3, 24), "pc": (3, 24)}
#: The patterns of an interval in hours, a code, a count a period, an interval in any unit, and "as needed" alone.
RULES = [
    (r"(?i)\bq(\d+)h(?:\s*prn)?\b",), (r"(?i)\b(" + "|".join(CODES) + r")\b",), (r"(?i)\b(once|twice|three times|four times)\s+(daily|weekly|monthly)\b",),
    (r"(?i)\bevery\s+(\d+)\s*(hour|hr|day|week|month)s?\b",), (r"(?i)\bprn\b",),
]


def _map(table: dict, i: int | None = None) -> Column:
    return F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, float(v if i is None else v[i]))])


def told(spans: Column) -> Column:
    """start, end, match, times_per_day, interval_hours, as_needed for a text's matches of RULES."""

    def read(x: Column) -> Column:
        g = lambda i, n: F.regexp_extract(x["match"], RULES[i][0], n)
        rule, low = x["rule"], F.lower(x["match"])
        count = F.when(rule == 1, _map(CODES, 0)[low]).when(rule == 2, _map(COUNTS)[F.regexp_replace(F.lower(g(2, 1)), r"\s+", " ")]).when(rule < 4, 1.0)
        hours = F.when(rule == 0, g(0, 1).try_cast("double")).when(rule == 1, _map(CODES, 1)[low]).when(rule == 2, _map(HOURS)[F.lower(g(2, 2))]).when(rule == 3, g(3, 1).try_cast("double") * _map(HOURS)[F.lower(g(3, 2))])
        return F.struct(x["start"], x["end"], x["match"], count.alias("count"), hours.alias("hours"), F.lower(x["match"]).endswith("prn").alias("as_needed"), rule)

    def done(x: Column) -> Column:
        real = x["hours"] > 0
        return F.struct(x["start"], x["end"], x["match"], F.when(real, F.round(x["count"] * 24 / x["hours"], 6)).otherwise(0.0).alias("times_per_day"), F.when(real, F.round(x["hours"] / x["count"], 6)).otherwise(0.0).alias("interval_hours"), x["as_needed"])

    # "q8h prn" is one, not two
    return F.transform(S.apart(F.transform(spans, read), lambda x: [x["start"], x["rule"]]), done)


def extract(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, end, match, times_per_day, interval_hours (0 for an interval of none, or where only "prn" is said), as_needed; none overlap. Null texts have none."""
    return S.found(docs.select(key, text), RULES, text).select(key, F.inline(told(F.col("spans"))))
