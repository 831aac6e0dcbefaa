"""Dictionaries and rules as data: every phrase of every rule set found in one pass of the text.

The rules are a DataFrame of (rules, phrase, entry): drugs, abbreviations, section names, a user's own triggers or detectors. They become one Aho-Corasick
automaton, which takes a text in time that doesn't grow with the number of phrases. Rules are sent to the tasks in parts of bounded size; where there is more than
one part each makes a pass of its own, so that no table of rules is too large.

A phrase matches whatever its case. Where it begins or ends with a letter, a digit or an underscore, none of these may stand next to it.
Offsets are code points, the end exclusive; phrases may contain blanks and any other characters, which must stand in the text as they are.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

#: Characters of all phrases and entries that one automaton is made of, on average: some hundred bytes each in a task.
PART_CHARS = 4_000_000
MATCHES = ArrayType(StructType().add("rules", "string").add("entry", "string").add("start", "long").add("end", "long").add("match", "string"))


def folded(text: str) -> str:
    """Lower-cased without a change of length, so that offsets stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def rule_rows(spark: SparkSession, sets: dict[str, dict[str, str] | list[str]]) -> DataFrame:
    """(rules, phrase, entry) of dictionaries by name; a list's phrases are their own entries."""
    rows = [(name, p, e) for name, phrases in sets.items() for p, e in (phrases.items() if isinstance(phrases, dict) else ((p, p) for p in phrases))]
    return spark.createDataFrame(rows, "rules string, phrase string, entry string")


class Matcher:
    """rules: (rule set, phrase, entry) rows. A phrase may be in many sets and have many entries."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        by: dict[str, list[tuple[str, str]]] = {}
        for name, phrase, entry in rules:
            by.setdefault(folded(phrase), []).append((name, entry))
        self.automaton = ahocorasick.Automaton()
        for phrase, entries in by.items():
            self.automaton.add_word(phrase, (len(phrase), _wordy(phrase[0]), _wordy(phrase[-1]), sorted(set(entries), key=repr)))
        if by:
            self.automaton.make_automaton()
        self.empty = not by

    def __call__(self, text: str) -> list[tuple[str, str, int, int, str]]:
        low, out = folded(text), []
        for last, (n, head, tail, entries) in self.automaton.iter(low) if not self.empty else ():
            a, b = last + 1 - n, last + 1
            if not (head and a and _wordy(text[a - 1]) or tail and b < len(text) and _wordy(text[b])):
                out += [(name, entry, a, b, text[a:b]) for name, entry in entries]
        return out


def _wordy(c: str) -> bool:
    return c == "_" or c.isalnum()


def with_phrases(docs: DataFrame, rules: DataFrame, text: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """docs with a column phrases: every match as (rules, entry, start, end, match), in order of start, end, rules and entry; overlapping ones too.

    Null and empty texts have none, null and empty phrases match nothing, equal rules count once; texts of any length are read whole. Without rules or rows all arrays are empty. docs must
    not have a column phrases. part_chars changes the work, not the result.
    """
    if "phrases" in docs.columns:
        raise ValueError("docs has a column phrases already")
    place, spark = docs.columns.index(text), docs.sparkSession
    rules = rules.select("rules", "phrase", "entry").where("phrase <> ''").distinct()
    size = rules.agg(F.coalesce(F.sum(F.length("phrase") + F.length(F.coalesce("entry", F.lit("")))), F.lit(0))).first()[0]
    parts = -(-size // part_chars) or 1
    rows = docs
    for part in range(parts):
        known = [tuple(r) for r in rules.where(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == part).collect()]
        name = f"_phrases{part}"
        rows = rows.mapInArrow(_pass(spark.sparkContext.broadcast(known), place, [*rows.columns, name]), StructType(list(rows.schema.fields)).add(name, MATCHES))
    return rows.select(*docs.columns, in_order(F.flatten(F.array(*[f"_phrases{p}" for p in range(parts)]))).alias("phrases"))


def _pass(rules, place: int, names: list[str]):
    def run(batches):
        match = Matcher(rules.value)
        for batch in batches:
            found = [match(t) if t else [] for t in batch.column(place).to_pylist()]
            ends = [0]
            for f in found:
                ends.append(ends[-1] + len(f))
            columns = list(zip(*(x for f in found for x in f))) or [()] * 5
            spans = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))], ["rules", "entry", "start", "end", "match"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)], names)

    return run


def in_order(spans: Column) -> Column:
    return F.transform(F.array_sort(F.transform(spans, lambda x: F.struct(x["start"], x["end"], x["rules"], x["entry"], x["match"]))), lambda x: F.struct(x["rules"], x["entry"], x["start"], x["end"], x["match"]))


def leftmost(spans: Column) -> Column:
    """Of the matches of one text those that count where matches may not overlap: in each rule set the leftmost, of those the longest, and so on. With a set's matches in one place all entries stay."""
    by = F.array_sort(F.transform(spans, lambda x: F.struct(x["rules"], x["start"], (-x["end"]).alias("less"), x["entry"], x["match"], x["end"])))
    start = F.struct(F.lit(None).cast("string").alias("rules"), F.lit(-1).cast("bigint").alias("a"), F.lit(-1).cast("bigint").alias("b"), F.filter(by, lambda x: F.lit(False)).alias("kept"))

    def add(acc: Column, x: Column) -> Column:
        fits = acc["rules"].isNull() | (acc["rules"] != x["rules"]) | (x["start"] >= acc["b"]) | ((x["start"] == acc["a"]) & (x["end"] == acc["b"]))
        return F.when(fits, F.struct(x["rules"], x["start"].alias("a"), x["end"].alias("b"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc)

    return in_order(F.aggregate(by, start, add, lambda acc: acc["kept"]))
