"""Findings of round 3: rules tried only where they may match, spans worked out once, whole dictionaries, steps from all rows."""

import re

import pytest
from pyspark.sql import functions as F

from notemill.functions import spans as S
from notemill.llm import hilbert as H
from notemill.operators import abbreviations as A
from notemill.operators import concepts as C
from notemill.operators import doctypes as D
from notemill.operators import entities as E
from notemill.operators import phi as P
from notemill.operators import relations as R
from notemill.operators import scoring as K
from notemill.operators import vitals as V
from notemill.sources import scan


@pytest.mark.parametrize("rules", [E.RULES, V.RULES, P.RULES, [("(?i)" + p,) for ps in D.HEADINGS.values() for p in ps], [("(?i)" + p,) for p in A.patterns(A.entries())]])
def test_needles_lose_no_match(rules):
    """Every piece of a pattern that needles() asks for is in each of its matches, odd characters too."""
    texts = ["BP 120/80, Miſter; aſpirin 5 mg daily", "chief complaint: Aspirin, x-ray, Kg 5 kg", "DISCHARGE SUMMARY n/v/d", "İV 5 mg", ""]
    made = S._compiled([r[0] for r in rules])
    for t in texts:
        assert [(i, m.span()) for i, p, _ in made for m in p.finditer(t)] == [(i, m.span()) for i, p in S._worth(t, made) for m in p.finditer(t)]


def test_needles_tell_pieces():
    assert S.needles(r"(?i)\b(?:days?|weeks?)\s+ago\b") == ["ago"]
    assert S.needles(r"\d+") == [] and S.needles("(unclosed") == []
    assert not re.search("x", "".join(S.needles(r"(?i)a(?:x|b)?c")))


def test_codes_are_worked_out_once(spark):
    """F16: no filter asks for all keywords before the rows are made."""
    d = spark.createDataFrame([(1, "htn and copd"), (2, ""), (3, None)], "doc_id int, text string")
    rows = K.icd_codes(d)
    assert [(r.doc_id, r["rank"], r.code) for r in rows.orderBy("doc_id", "rank").collect()] == [(1, 1, "I10"), (1, 2, "J44.1")]
    assert rows._jdf.queryExecution().optimizedPlan().toString().lower().count("contains(lower") == 0


def test_pairs_without_a_join(spark):
    """the entities' side can't be broadcast, as there is no join."""
    e = spark.createDataFrame([(1, "A", 0, 5, "a", ""), (1, "B", 10, 12, "b", ""), (1, "C", 400, 401, "c", ""), (2, "A", 0, 1, "a", "")], "doc_id int, type string, start long, end long, match string, post string")
    p = R.near_pairs(e)
    assert [(r.doc_id, r.a.type, r.b.type) for r in p.collect()] == [(1, "A", "B")]
    assert "Join" not in p._jdf.queryExecution().executedPlan().toString()


def test_dictionaries_are_whole():
    """Entries that a change had left out."""
    assert {"mi", "ekg", "dm2", "hba1c", "d/c", "dnr/dni", "qid"} <= set(A.entries())
    assert {"nstemi", "high blood pressure", "lipitor"} <= {a for c in C.CONCEPTS for a in c[2]}


def test_steps_come_from_all_rows(spark):
    """of more rows than the former sample, each step's first value is that of the sorted whole."""
    n = 30_000
    rows = spark.range(n).select((F.col("id") * F.col("id") % 7919).alias("v"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("s"))
    every = sorted(r.v for r in rows.collect())
    assert H.cuts(rows, "v") == [every[i * n // 16] for i in range(1, 16)]
    assert H.cuts(rows, "s") == [(["a"] * 10_000 + ["b"] * 10_000)[i * 20_000 // 16] for i in range(1, 16)]
    assert H.cuts(rows.limit(0), "v") == []


def test_notes_are_dealt_by_number(spark):
    rows = spark.range(1000).coalesce(1)
    assert scan.spread(rows, "id", 10).rdd.getNumPartitions() == 100
