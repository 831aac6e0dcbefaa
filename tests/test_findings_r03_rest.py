"""Findings of round 3 that were left: texts taken apart once, rules matched by column, pairs scored in their row."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from notemill.functions import spans as S
from notemill.operators import entities as E
from notemill.operators import metrics as M
from notemill.operators import phi as P
from notemill.operators import risk as K
from notemill.operators import scoring as C
from notemill.operators import sections as X
from notemill.operators import summaries as Y
from notemill.operators import vitals as V
from notemill.operators.inverted_index import Index


def test_index_takes_a_text_apart_once(spark, tmp_path, monkeypatch):
    """the words are not found anew beside the generator, once for each word."""
    plans, put = [], Index._put

    def spy(self, rows, name, batch, by=None):
        plans.append((name, rows._jdf.queryExecution().optimizedPlan().toString()))
        put(self, rows, name, batch, by)

    monkeypatch.setattr(Index, "_put", spy)
    index = Index(spark, str(tmp_path / "index"), 2)
    index.add(spark.createDataFrame([(1, "one two two"), (2, ""), (3, None)], "doc_id long, text string"))
    assert dict(plans)["forward"].count("regexp_extract_all") == 1
    assert [(r.doc_id, r.dl) for r in index.alive().orderBy("doc_id").collect()] == [(1, 3), (2, 0), (3, 0)]
    assert {(r.tok, r.df) for r in index.frequencies().collect()} == {("one", 1), ("two", 1)}


TEXTS = ["BP: 120/80 mmHg, 1/120/80 mmHg, T=37 C, T: 99", "aspirin 5 mg\ndaily, aſpirin 5\x0bmg, 5\x1cmg", "SSN 000-12-3456, 123-45-6789", "Weight 5 kg /7 kg \x01 6 kg", "70 kg", "°5 cm", "", None, "PLAN:\nPlan B: x"]


@pytest.mark.parametrize("rules", [E.RULES, V.RULES, P.RULES, [(X.HEADER,)]])
def test_columns_match_as_python_does(rules):
    """Rules matched a column at a time find what Python finds in one text after the other, and stand by column at all."""
    made = S._columned([r[0] for r in rules])
    assert all(column for *_, column in made)
    for after in (0, 5, None):
        want = [[m for i, p, *_ in made for m in S._matches(t, i, p, 3, after)] if t else [] for t in TEXTS]
        for some in (slice(None), slice(1, 3), slice(4, 5), slice(6, 8)):
            column = pa.array(["x", *TEXTS], pa.string()).slice(1)[some]
            assert [[tuple(x.values()) for x in xs] for xs in S._spans(column, made, 3, after).to_pylist()] == want[some]


def test_patterns_that_two_engines_read_differently():
    for p in (r"a$", r"(a|b?)*c*", r"a*", r"(?x) a b", r"(a)\1", r"a{,3}b", r"[[:a]b", r"(?<=x)*", r"(unclosed"):
        assert S.by_column(p) is None
    assert S.by_column(r"(?i)(?<!\d)a(?!b)c") == ("(?i)ac", False) and S.by_column(r"\ba+b") == (r"\ba+b", True)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sections_of_spans_without_a_shuffle(spark):
    """spans meet their headers in the text's row."""
    d = spark.createDataFrame([(1, "aspirin\nPLAN:\ninsulin daily\nMEDS: 5 mg"), (2, None)], "note_id int, text string")
    raw = S.found(d, [*E.RULES, (X.HEADER,)])
    ours = lambda yes: F.filter("spans", lambda x: (x["rule"] == len(E.RULES)) == yes)
    got = raw.select("note_id", F.inline(X.placed(E.told(ours(False)), X.told(ours(True), F.col("text"))))).select("note_id", "type", "start", "section")
    want = X.section_of(E.extract(d, "note_id").select("note_id", "type", "start"), X.parse(d, "note_id"), "note_id")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert "Exchange" not in _plan(got)


def test_body_mass_sends_one_row_a_text(spark):
    """the same as from all readings, with the rules of three types."""
    texts = ["Weight: 80 kg, 82 kg, Height: 200 cm", "Weight 150 lb, height 5 ft 10 in, BP 120/80", "BMI 22 weight 70 kg height 180 cm", "Weight: 80 kg", "", None]
    d = spark.createDataFrame([*enumerate(texts), (None, texts[0]), (0, "Weight: 5 kg")], "doc_id int, text string")
    key = lambda r: str(tuple(r))
    want = sorted(V.body_mass_index(V.extract(d)).collect(), key=key)
    assert want and sorted(V.body_mass(d).collect(), key=key) == want


def test_pairs_are_scored_in_their_row(spark, monkeypatch):
    """n-grams leave no row, and a few pairs are words at a time."""
    monkeypatch.setattr(Y, "PAIRS", 2)
    pairs = spark.createDataFrame([(1, "a b a b", "a b c"), (2, "", ""), (3, None, "x"), (4, "x", "X"), (5, "one two", None)], "pair_id int, ref string, hyp string")
    one = {r.pair_id: (round(r.precision, 6), r.recall, round(r.f1, 6)) for r in M.rouge_n(pairs, 1).collect()}
    assert one == {1: (0.666667, 0.5, 0.571429), 3: (0.0, 0.0, 0.0), 4: (1.0, 1.0, 1.0), 5: (0.0, 0.0, 0.0)}
    assert {r.pair_id: r.precision for r in M.rouge_n(pairs, 2).collect()} == {1: 0.5, 5: 0.0}
    assert "Exchange" not in _plan(M.rouge_n(pairs, 2))
    assert {r.pair_id: r.rouge2.precision for r in Y.rouge(pairs).collect()} == {1: 0.5, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0}


def test_key_findings_ask_for_pieces_first(spark):
    """a pattern is tried only on sentences with one of its pieces; what is found stays."""
    d = spark.createDataFrame([(1, "Nothing to be told here at all. DIAGNOSED with Allergy and a follow-up. Follow up and surgery planned urgently."), (2, None)], "doc_id int, text string")
    rows = Y.key_findings(d)
    assert [(r.doc_id, r["rank"], r.score) for r in rows.orderBy("rank").collect()] == [(1, 1, 3), (1, 2, 2)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "diagnosed)" in plan and "sort_array" in plan


def test_risk_reads_a_text_once_for_all_words(spark):
    """words are found and overlaps dropped in the reading of the text, as one by one; the scores are those of the text itself."""
    texts = [*TEXTS, "ACUTE STROKE, heart", " failure; Kidney HIV", "ſepsis KKD ckd CHF", "chf", "mi stat aspirin 5 mg daily insulin 10 units, denies fever", "prednisone 5 mg", "no show"]
    for some in (slice(None), slice(3, 7), slice(9, 12)):
        column = pa.array(["x", *texts], pa.string()).slice(1)[some]
        assert S.held(column, K.TERMS).tolist() == [[bool(t) and w in t.lower() for w in K.TERMS] for t in texts[some]]
    d = spark.createDataFrame([*enumerate(texts)], "doc_id int, text string")
    order = lambda x: [x["start"], x["rule"]]
    want = S.found(d, E.RULES, before=E.LEFT).select("doc_id", S.apart(F.col("spans"), order).alias("spans"))
    got = S.found(d, E.RULES, before=E.LEFT, keep=False, words=K.TERMS, first=True)
    assert got.select("doc_id", "spans").orderBy("doc_id").collect() == want.orderBy("doc_id").collect()
    for score in (K.unit_score, K.assess):
        read = S.found(d, E.RULES, words=K.TERMS)
        assert score(read, held="held").orderBy("doc_id").collect() == score(d).orderBy("doc_id").collect()
    assert C.with_codes(read, has=K.known("held")).select("codes").collect() == C.with_codes(d).select("codes").collect()
    assert "lower(text" not in K.unit_score(read, held="held")._jdf.queryExecution().optimizedPlan().toString()
