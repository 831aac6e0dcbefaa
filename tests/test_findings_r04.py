"""Findings of round 4."""

import os
from difflib import SequenceMatcher

import duckdb
import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from notemill.operators import concepts as C
from notemill.operators import doctypes as D
from notemill.operators import note_quality as Q
from notemill.operators import relations as R
from notemill.operators import search
from notemill.plans import note_queries as NQ

SF = "/root/testdata/sf0.001"


def _db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def test_mentions_are_met_by_likeness_too(spark, monkeypatch):
    """concept_normalise left out the last way, in code and SQL. Here the dictionary's names are misspelled, so that the notes' mentions are like them only."""
    worse = lambda name: name[:3] + name[4:] if len(name) > 6 else name
    monkeypatch.setattr(C, "CONCEPTS", [(cui, worse(term), [worse(a) for a in aliases], *rest) for cui, term, aliases, *rest in C.CONCEPTS])
    monkeypatch.setattr(NQ, "CON", NQ._concept_sql())
    got, want = NQ.concept_normalise(spark, SF), _db().sql(NQ._normalise_sql())
    rows = sorted(map(repr, ([r[c] for c in want.columns] for r in got.collect())))
    assert rows == sorted(map(repr, map(list, want.fetchall())))
    assert sum("'fuzzy'" in r for r in rows) > 100


def test_likeness_in_sql():
    """the ratio of the query's SQL is difflib's."""
    rng = np.random.default_rng(4)
    names = sorted({"".join(rng.choice(list("abc "), int(rng.integers(1, 12)))).strip() or "a" for _ in range(60)})
    con = duckdb.connect()
    con.sql("create table p as select * from (values " + ", ".join(f"('{a}', '{b}')" for a in names[::2] for b in names[1::2]) + ") t(key, name)")
    assert all(ratio == SequenceMatcher(None, a, b).ratio() for a, b, ratio in con.sql(NQ._ratio_sql("select * from p")).fetchall())


ODD = [
    "Dr. Smith saw. Mrs. Lee vs. Mr. X. Then?! Yes . No", "a.\tB c!  \n  HPI: x. y. Z\n\nPLAN:\n1. go\n2) no\n- so \n**Bold one** x", "", None, "   \n \n", ". . .", "r. A Mrs.", "Mrs. Mr", "s. B", "PLAN : a\rASSESSMENT: b", "x\x0by. Z", "x\x1cy", "Ärzte sagen nein. Ja",
    "Patient denies chest pain and reports chest pain. No fever, reports fever", "A block that is long enough here\n \nA BLOCK that is long enough here\n\nshort", "WBC 5 g, 10 mg 3.5 ml BP 120/80 appendicitis pt SOB r/o MI.", "Lines\n" + "w " * 60 + ".\n" + "x " * 51 + "\n", "CHIEF COMPLAINT:", "HOSPITAL COURSE: ok. Follow-up instructions: mg iv site",
]


def test_quality_reads_columns_as_expressions_do(spark):
    """what is told of plain texts by their bytes is what the expressions tell, to the recommendation."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD * 3)], "doc_id int, text string").repartition(2)
    none = docs.withColumn("r", F.lit(None).cast(Q._KIND))
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(Q.report(docs)) == rows(Q.report(none, read="r"))
    told = Q._read(pa.array([t for t in ODD], pa.string())).to_pylist()
    assert [t is None for t in told] == [t is not None and (not t.isascii() or any(c in t for c in "\r\x0b\x1c")) for t in ODD]


def test_places_of_headings_are_those_of_each_text():
    """headings and words looked for a column at a time."""
    import re

    ps = ["(?i)" + p for kind in D.HEADINGS for p in D.HEADINGS[kind]]
    made = D.READ[0](pa.array(ODD, pa.string())).to_pylist()
    for t, got in zip(ODD, made):
        assert got == (None if t is None else {"places": [m.start() + 1 if (m := re.compile(p, re.ASCII).search(t)) else 0 for p in ps], "hits": [sum(w in t.lower() for w in D.WORDS[k]) for k in D.HEADINGS]})


def test_pairs_of_kinds(spark):
    """pairs are those of each row one by one, and only those that a rule asks for."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(40):
        starts = sorted(rng.integers(0, 400, int(rng.integers(0, 9))).tolist())
        rows.append((k, [(str(rng.choice(["MEDICATION", "DISEASE", "DOSAGE", "TEMPORAL"])), s, s + int(rng.integers(1, 30))) for s in starts] if k % 7 else None))
    docs = spark.createDataFrame(rows, "key int, entities array<struct<type: string, start: bigint, end: bigint>>").repartition(2)
    want = [(k, a, b) for k, es in rows for a in es or () for b in es if a[2] <= b[1] <= a[2] + R.MAX_GAP]
    got = lambda kinds: sorted((r.key, tuple(p.a), tuple(p.b)) for r in R.with_pairs(docs, kinds=kinds).collect() for p in r.pairs or ())
    assert got(None) == sorted(want)
    assert got(R.KINDS) == sorted(w for w in want if (w[1][0], w[2][0]) in R.KINDS) != sorted(want)


def test_cosine_reads_its_words_once(spark):
    """F8: all words were weighed three times, once for the query's length."""
    docs = spark.createDataFrame([(1, "red fox red"), (2, "red hen"), (3, None), (None, "blue hen fox")], "doc_id int, text string")
    got = search.cosine(docs, "red blue red")
    w = {r.doc_id: r.w for r in search.tfidf(docs).where("tok = 'red'").collect()}
    # blue stands in a document without a key only
    assert {r.doc_id: round(r.cosine, 9) for r in got.collect()} == {k: round(v, 9) for k, v in w.items()}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LN(") <= 2
    assert search.cosine(docs, "").collect() == []


def test_enhanced_pipeline_reads_notes_once_for_all_modules(spark):
    """each module had a reading of its own; now one for all and one for relations, with its pairs."""
    from notemill.plans import final_queries

    plan = final_queries.pipeline_enhanced(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3 and "Join" not in plan


def test_few_frequent_words_change_nothing(spark, monkeypatch):
    """words that are broadcast and words that are shuffled give the same codes, whichever are which."""
    from notemill.operators import code_classifier as K

    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(words, 8)), str(rng.choice(["A1", "A2", "B1", "C1"]))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, code string")
    asked = docs.unionByName(spark.createDataFrame([(90, "unseen word here", None), (91, "", None), (92, None, None)], docs.schema))
    got = []
    for n in (K.FREQUENT, 9, 1):
        monkeypatch.setattr(K, "FREQUENT", n)
        got.append(sorted(map(tuple, K.predict(asked, K.fit(docs)).collect())))
    assert got[0] == got[1] == got[2] and {r[0] for r in got[0]} == {*range(60), 90, 91, 92}


def test_trends_are_sought_where_their_words_are(spark):
    """which way a sign goes was looked for around each reading of every text."""
    from notemill.operators import vitals as V

    texts = ["VITAL SIGNS:\nBP: 120/80 IMPROVED", "HR: 70 é Stable", "HR: 70 bpm\nVITALS:\nHR: 90 bpm\nPLAN NOW: HR: 80 bpm", "HR: 70 " + "x " * 40 + "worsening", None, ""]
    got = V.in_context(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    assert sorted((r.doc_id, r.value, r.trend, r.in_section) for r in got.collect()) == [(0, 120.0, "improving", True), (1, 70.0, "stable", False), (2, 70.0, "unknown", False), (2, 80.0, "unknown", False), (2, 90.0, "unknown", True), (3, 70.0, "unknown", False)]
    assert "exists(held" in got._jdf.queryExecution().analyzed().toString()
