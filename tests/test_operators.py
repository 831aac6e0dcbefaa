"""Hand-made cases for what SQL doesn't check."""

import numpy as np
import pytest

from pyspark.sql import functions as F
from notemill.functions import spans as S
from notemill.operators import abbreviations as B
from notemill.operators import allergies as L
from notemill.operators import assertions as A
from notemill.operators import concepts as C2
from notemill.operators import doctypes as D2
from notemill.operators import entities as E
from notemill.operators import medications as M
from notemill.operators import metrics as W2
from notemill.operators import monitoring as W
from notemill.operators import note_quality as Q2
from notemill.operators import phi as P
from notemill.operators import sections as X
from notemill.operators import social as O
from notemill.operators import summaries as Y
from notemill.operators import temporal as T
from notemill.operators import vitals as V
from notemill.streaming import windows


def spans_of(spark, text, *terms):
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    return S.scan(docs, "(?i)" + "|".join(terms), before=A.BEFORE, after=A.AFTER)


@pytest.mark.parametrize(("text", "term", "status"), [
    ("Patient denies fever.", "fever", "absent"),
    ("Patient has fever.", "fever", "present"),
    ("Possible pneumonia.", "pneumonia", "possible"),
    ("Family history of stroke.", "stroke", "family"),
    ("No cough, but patient has fever.", "fever", "present"),
    ("No fever. Has cough.", "cough", "present"),
    ("No fever\nCough present", "cough", "present"),
    ("No increase in pain.", "pain", "present"),
    ("Pneumonia has been ruled out.", "pneumonia", "absent"),
    ("fever", "fever", "present"),
])
def test_assertions(spark, text, term, status):
    assert [r.status for r in A.detect(spans_of(spark, text, term)).collect()] == [status]


@pytest.mark.parametrize(("text", "pattern", "want"), [("", "a", []), ("bbb", "a", []), ("aba", "a", [(0, 1), (2, 3)]), ("😀a é a", "a", [(1, 2), (5, 6)]), ("aaaa", "aa", [(0, 2), (2, 4)]), (None, "a", [])])
def test_offsets(spark, text, pattern, want):
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert sorted((r.start, r.end) for r in S.scan(docs, pattern).collect()) == want
    assert sorted((r.start, r.end) for r in S.scan_many(docs, [("zz",), (pattern,)]).collect()) == want


def test_psi_of_a_constant_is_zero(spark):
    sides = spark.createDataFrame([("r", 1.0)] * 5 + [("c", 1.0)] * 5, "side string, v double")
    assert W.psi_numeric(sides, "v").first().psi == 0.0


def test_admission_counts_admitted_only(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    e = windows.read(spark, path).selectExpr("user_id as client", "event_id as request_id", "unix_timestamp(cast(ts as timestamp)) as at")
    got = {r.request_id: r.allowed for r in windows.drained(windows.admitted(e, 2, 3600)).collect()}
    times, want = {}, {}
    for r in sorted(spark.read.parquet(path).selectExpr("user_id", "event_id", "unix_timestamp(cast(ts as timestamp)) as at").collect(), key=lambda r: (r["at"], r.event_id)):
        held = [t for t in times.get(r.user_id, []) if t > r["at"] - 3600]
        want[r.event_id] = len(held) < 2
        times[r.user_id] = held + [r["at"]] * want[r.event_id]
    assert got == want


def test_hidden_parts_of_repeated_and_null_keys(spark):
    """Rows that share a key, or have none, are searched each in its own text."""
    docs = spark.createDataFrame([(1, "Dr. John Smith"), (1, "Mary wrote a@b.org"), (None, "c@d.org"), (None, None), (2, "")], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.type, r.match) for r in P.detect(docs).collect()) == [(0, "EMAIL", "c@d.org"), (1, "EMAIL", "a@b.org"), (1, "NAME", "Dr. John Smith")]
    assert sorted((r.text or "") for r in P.replaced(docs).collect()) == ["", "", "Mary wrote [EMAIL]", "[EMAIL]", "[NAME]"]


def test_extractors_on_repeated_and_null_rows(spark):
    docs = spark.createDataFrame([(1, "BP: 120/80 mmHg"), (1, "BP: 150/95 mmHg"), (None, None), (None, "takes aspirin 81 mg daily")], "doc_id bigint, text string")
    assert sorted(r.value for r in V.extract(docs).collect()) == [120.0, 150.0]
    assert [(r.drug, r.dose) for r in M.extract(docs).collect()] == [("aspirin", 81.0)]
    assert {r.type for r in E.extract(docs).collect()} == {"LAB_VALUE", "MEDICATION", "DOSAGE"}
    for found in (X.parse(docs), L.extract(docs), T.extract(docs, "2024-01-01"), O.extract(docs), B.expand(docs)):
        assert found.count() >= 0


def dense_ranks(found):
    """The same ranking with the whole matrix of cosines."""
    import math
    import re

    words = sorted({w for s in found for w in re.findall(r"\w\w+", s.lower())})
    tf = np.array([[re.findall(r"\w\w+", s.lower()).count(w) for w in words] for s in found], float)
    tf = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0)
    w = tf * (np.log((1 + len(found)) / (1 + (tf > 0).sum(axis=0))) + 1)
    norm = np.linalg.norm(w, axis=1, keepdims=True)
    w = w / np.where(norm == 0, 1, norm)
    links = w @ w.T
    np.fill_diagonal(links, 0)
    sums = links.sum(axis=1, keepdims=True)
    links = links / np.where(sums == 0, 1, sums)
    bias = np.array([1 + 0.2 * sum(bool(p.search(s)) for p in Y.IMPORTANT) for s in found])
    bias /= bias.sum()
    score = np.full(len(found), 1 / len(found))
    for _ in range(Y.ROUNDS):
        new = (1 - Y.DAMPING) * bias + Y.DAMPING * links.T @ score
        done, score = math.fsum(abs(new - score)) < Y.ENOUGH, new
        if done:
            break
    return score


def test_sentence_ranks():
    rng = np.random.default_rng(3)
    vocabulary = ["plan", "dose", "acute", "the", "of", "lung", "heart", "x", "rest", "walk", "pain", "biopsy"]
    for n in (2, 3, 20, 120):
        found = [" ".join(rng.choice(vocabulary, int(rng.integers(1, 9)))) for _ in range(n)] + ["x y", "alone here"]
        assert np.allclose(Y.rank_sentences(found), dense_ranks(found), atol=1e-8)
    assert Y.summary_of(["one only sentence"], 0.3, 12) == ["one only sentence"] and Y.summary_of([], 0.3, 12) == []
    assert len(Y.summary_of([f"sentence number {i} of many" for i in range(3000)], 0.3, 12)) == 12


def test_common_subsequence():
    rng = np.random.default_rng(8)
    for _ in range(60):
        a, b = (list(rng.choice(list("abcd"), int(rng.integers(0, 70)))) for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert Y.common_subsequence(a, b) == table[-1, -1]
    assert Y.common_subsequence(["w"] * 20_000, ["w"] * 15_000) == 15_000


def test_precision_recall_area_over_ranges(spark):
    """Few ranges and many, ties and a single class, against one pass over the sorted scores."""
    rng = np.random.default_rng(2)
    rows = [(int(rng.random() < 0.3), float(np.round(rng.random(), 2))) for _ in range(500)] + [(1, None), (None, 0.5)]
    df = spark.createDataFrame(rows, "y int, s double")
    area, tp, seen, r0, p0 = 0.0, 0, 0, 0.0, 1.0
    some = [(y, s) for y, s in rows if y is not None and s is not None]
    total = sum(y for y, _ in some)
    for s in sorted({s for _, s in some}, reverse=True):
        tp += sum(y for y, x in some if x == s)
        seen += sum(x == s for _, x in some)
        area += (tp / total - r0) * (tp / seen + p0) / 2
        r0, p0 = tp / total, tp / seen
    for ranges in (2, 7, 1000):
        assert abs(W2.auprc(df, "y", "s", ranges).first().auprc - area) < 1e-9


def test_likeness_of_names(spark):
    """Blocking by pairs of characters loses no name that is as alike as 0.8."""
    from difflib import SequenceMatcher

    rng = np.random.default_rng(6)
    names = sorted({"".join(rng.choice(list("abc "), int(rng.integers(1, 9)))) for _ in range(250)})
    keys, own = names[::2], names[1::2]
    got = C2.alike(spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame([(n,) for n in own], "name string"))
    assert sorted((r.key, r.name) for r in got.collect()) == sorted((a, b) for a in keys for b in own if SequenceMatcher(None, a, b).ratio() >= 0.8)


def test_concepts_by_type_and_likeness(spark):
    d = C2.dictionary(spark)
    rows = [("Hypertension", "DISEASE"), ("  HTN. ", "DISEASE"), ("hypertensoin", "DISEASE"), ("aspirin", "DISEASE"), ("aspirin", "MEDICATION"), ("zzzz", "DISEASE"), (None, None), ("", None), ("mri", "UNSEEN")]
    got = {(r.m, r.k): (r.term, r.match_type) for r in C2.normalise(spark.createDataFrame(rows, "m string, k string"), d, "m", "k").collect()}
    assert got == {("Hypertension", "DISEASE"): ("Hypertension", "exact"), ("  HTN. ", "DISEASE"): ("Hypertension", "alias"), ("hypertensoin", "DISEASE"): ("Hypertension", "fuzzy"), ("aspirin", "DISEASE"): (None, "none"), ("aspirin", "MEDICATION"): ("Aspirin", "exact"), ("zzzz", "DISEASE"): (None, "none"), (None, None): (None, "none"), ("", None): (None, "none"), ("mri", "UNSEEN"): ("Magnetic Resonance Imaging", "alias")}


@pytest.mark.parametrize(("text", "kind"), [
    ("OPERATIVE NOTE\nPre-operative diagnosis: hernia\nPost-operative diagnosis: hernia\nProcedure performed: repair\nAnesthesia: general\nEstimated blood loss: 10 ml\nFindings: sterile incision, closure, hemostasis", "operative_note"),
    ("DISCHARGE SUMMARY\nAdmission date: today\nHospital course: good\nDischarge diagnosis: well\nFollow-up instructions: home medications, disposition, admitted, discharged", "discharge_summary"),
    ("The quick brown fox", None), ("", None), (None, "unknown"),
])
def test_document_types(spark, text, kind):
    got = D2.classify(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert kind is None or got.doc_type == kind


def test_note_quality(spark):
    texts = ["", None, "short", "word " * 60, "Copied paragraph that is long enough.\n\nCopied paragraph that is long enough.\n\nPatient denies chest pain. Reports chest pain."]
    got = Q2.report(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    assert [r.readability for r in got[:2]] == [0.0, 0.0] and got[0].recommendations[:2] == ["very short: 0 words", "no sentences"]
    assert got[3].structure < 100 and "no headers" in got[3].recommendations
    assert got[4].consistency == 75.0 and "contradictions" in got[4].recommendations


@pytest.mark.parametrize(("text", "want"), [
    ("Pt c/o SOB. PMH: HTN", [("Pt", "patient", "default"), ("c/o", "complains of", "unambiguous"), ("SOB", "shortness of breath", "unambiguous"), ("PMH", "past medical history", "unambiguous"), ("HTN", "hypertension", "unambiguous")]),
    ("LABS: pt 12", [("pt", "prothrombin time", "section")]),
    ("pe with clot and heparin", [("pe", "pulmonary embolism", "context")]),
    ("n/v/d today", [("n/v/d", "nausea, vomiting, and diarrhea", "unambiguous")]),
    ("", []), (None, []), ("ptx htnx", []),
])
def test_abbreviations(spark, text, want):
    got = B.expand(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    assert [(r.abbreviation, r.expansion, r.resolution) for r in got] == want


def test_abbreviations_written_out(spark):
    docs = spark.createDataFrame([(1, "HTN and n/v"), (2, None)], "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in B.rewrite(docs).collect()} == {1: "HTN (hypertension) and n/v (nausea and vomiting)", 2: None}


@pytest.mark.parametrize(("text", "status", "by_section"), [
    ("FAMILY HISTORY: stroke", "family", True), ("PERTINENT NEGATIVES: stroke", "absent", True), ("PLAN: stroke workup", "hypothetical", True), ("FAMILY HISTORY: none\nHPI:\nstroke", "present", False),
    ("FAMILY HISTORY: denies stroke", "absent", False), ("stroke", "present", False), ("HPI: stroke", "present", False),
])
def test_assertions_by_section(spark, text, status, by_section):
    got = A.in_sections(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), "(?i)stroke").first()
    assert (got.status, got.by_section) == (status, by_section)


@pytest.mark.parametrize(("text", "sentiment", "confidence", "inside"), [
    ("SOCIAL HISTORY: homeless", "adverse", 0.97, True), ("denies being homeless", "protective", 0.782, False), ("SOCIAL HISTORY: x\nPLAN: homeless", "adverse", 0.92, False), ("no stable housing", "adverse", 0.7225, False), ("not retired", "neutral", 0.82, False),
])
def test_social_context(spark, text, sentiment, confidence, inside):
    got = O.in_context(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert (got.sentiment, round(got.confidence, 4), got.in_section) == (sentiment, confidence, inside)


def test_partial_matches(spark):
    gold = spark.createDataFrame([(1, "A", 0, 10), (1, "B", 20, 30)], "doc_id int, type string, start int, end int")
    guess = spark.createDataFrame([(1, "A", 0, 5), (1, "A", 20, 30), (2, "A", 0, 3)], "doc_id int, type string, start int, end int")
    assert {r.doc_id: (r.credit, r.n_gold, r.n_guess) for r in Y.partial_matches(gold, guess).collect()} == {1: (1.0, 2, 2), 2: (0.0, 0, 1)}


# rules as data ----------------------------------------------------------------------------------------------------
def _all_phrases(text, rules):
    """By looking for each phrase at each place."""
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text or "")
    wordy = lambda c: c == "_" or c.isalnum()
    out = set()
    for name, phrase, entry in rules:
        p = (phrase or "").lower()
        for a in range(len(low) - len(p) + 1) if p else ():
            b = a + len(p)
            if low[a:b] == p and not (wordy(p[0]) and a and wordy(low[a - 1])) and not (wordy(p[-1]) and b < len(low) and wordy(low[b])):
                out.add((name, entry, a, b, text[a:b]))
    return sorted(out, key=lambda x: (x[2], x[3], x[0], x[1] or ""))


RULES = [("d", "a", "1"), ("d", "ab", "2"), ("d", "a b", "3"), ("e", "b", "4"), ("e", "n/v", "5"), ("e", "n/v/d", "6"), ("d", "é", "7"), ("e", "-b", "8"), ("e", "A", "1"), ("d", "a", "1"), ("d", "", "9"), ("d", None, "9"), ("f", "b a", None)]


@pytest.mark.parametrize("part_chars", [4, 1_000_000])
def test_phrases_against_every_place(spark, part_chars):
    from notemill.functions import phrases as P

    rng = np.random.default_rng(5)
    texts = [None, "", "İA b", "x" * 5000 + " a b"] + ["".join(rng.choice(list("ab ABn/vd-é_1İ"), int(rng.integers(1, 30)))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(1, "a b"), (None, "a b")], "doc_id int, text string").withColumn("rules", F.lit("x"))
    rules = spark.createDataFrame(RULES, "rules string, phrase string, entry string")
    got = P.with_phrases(docs, rules, part_chars=part_chars).collect()
    assert len(got) == len(texts) + 2 and all([tuple(s) for s in r.phrases] == _all_phrases(r.text, RULES) for r in got)
    assert all(r.phrases == [] for r in P.with_phrases(docs, rules.limit(0)).collect())
    assert P.with_phrases(docs.limit(0), rules).count() == 0


def test_leftmost_phrases(spark):
    from notemill.functions import phrases as P

    docs = spark.createDataFrame([(1, "a b a bb n/v/d"), (2, None)], "doc_id int, text string")
    rules = spark.createDataFrame([("d", "a", "1"), ("d", "a b", "2"), ("d", "b a", "3"), ("e", "b", "4"), ("e", "n/v", "5"), ("e", "n/v/d", "6"), ("e", "n/v/d", "7")], "rules string, phrase string, entry string")
    got = {r.doc_id: [(s.rules, s.entry, s.start, s.end) for s in r.p] for r in P.with_phrases(docs, rules).select("doc_id", P.leftmost(F.col("phrases")).alias("p")).collect()}
    assert got == {1: [("d", "2", 0, 3), ("e", "4", 2, 3), ("d", "1", 4, 5), ("e", "6", 9, 14), ("e", "7", 9, 14)], 2: []}


# the stored index -------------------------------------------------------------------------------------------------
def test_index_equals_a_rebuild(spark, tmp_path):
    from notemill.operators import search
    from notemill.operators.inverted_index import Index

    shape = "doc_id bigint, text string"
    batches = [[(1, "red fox runs"), (2, "blue fox fox"), (3, None), (None, "red"), (5, "the"), (5, "green tree")], [(2, "red red whale"), (6, "fox")], [(3, "fox tree"), (7, "")]]
    index, live = Index(spark, str(tmp_path / "index")), {}
    assert index.bm25("fox").collect() == [] and index.cosine("fox").collect() == []

    def same(index):
        docs = spark.createDataFrame(sorted(live.items()), shape)
        for query in ("fox", "red fox fox tree", "zebra", "the"):
            want = {r.doc_id: round(r.bm25, 9) for r in search.bm25(docs, query).where("bm25 > 0").collect()}
            assert {r.doc_id: round(r.bm25, 9) for r in index.bm25(query).collect()} == want
            if search._query_tokens(query):
                want = {r.doc_id: round(r.cosine, 9) for r in search.cosine(docs, query).collect()}
                assert {r.doc_id: round(r.cosine, 9) for r in index.cosine(query).collect()} == want

    for n, rows in enumerate(batches):
        index.add(spark.createDataFrame(rows, shape))
        live.update({k: t for k, t in sorted(rows, key=lambda r: (r[0] or 0, r[1] or "")) if k is not None})
        if n == 1:
            index.delete(spark.createDataFrame([(1,), (1,), (99,), (None,)], "doc_id bigint"))
            del live[1]
        same(index)
    # a deleted document comes back; a batch that never got its totals doesn't count
    index.add(spark.createDataFrame([(1, "fox whale")], shape))
    live[1] = "fox whale"
    spark.createDataFrame([(50, 1, {"fox": 1}, 3)], "doc_id bigint, dl bigint, terms map<string,bigint>, block int").write.partitionBy("block").parquet(f"{index.folder}/forward/batch={index.last() + 1}")
    same(index)
    same(index.compact(str(tmp_path / "compact")))
    assert index.totals().first().docs == len(live)


def test_index_reads_the_blocks_of_its_words(spark, tmp_path):
    from notemill.operators.inverted_index import Index

    index = Index(spark, str(tmp_path / "index"))
    index.add(spark.createDataFrame([(i, f"word{i} common") for i in range(300)], "doc_id bigint, text string"))
    rows = index._of(index.table("postings"), ["word7"])
    assert len(rows.inputFiles()) > 10 and rows.count() == 1
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "block" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0] and "EqualTo(tok,word7)" in plan


def test_feature_space(spark):
    from notemill.operators import feature_space as S

    docs = spark.createDataFrame([(1, "red fox red"), (2, "blue fox"), (3, "red whale fox"), (4, None)], "doc_id bigint, text string")
    space = S.fit(docs, min_df=2, max_df=0.6)
    assert [(r.tok, r.df, r.column) for r in space.orderBy("column").collect()] == [("red", 2, 0)]
    assert [r.tok for r in S.fit(docs, min_df=1, max_df=1.0, max_features=2).orderBy("column").collect()] == ["fox", "red"]
    new = spark.createDataFrame([(9, "red red unseen"), (8, "unseen"), (7, None)], "doc_id bigint, text string")
    vectors = S.transform(new, S.fit(docs, min_df=1, max_df=1.0))
    assert {r.doc_id: r.vector for r in vectors.collect()} == {9: {2: 1.0}, 8: {}, 7: {}}
    weights = spark.createDataFrame([(2, -2.0), (0, 1.0)], "column bigint, weight double")
    told = {r.doc_id: (r.score, [tuple(x) for x in r.for_it], [tuple(x) for x in r.against_it]) for r in S.contributions(vectors, weights).collect()}
    assert told == {9: (-2.0, [], [(2, -2.0)]), 8: (0.0, [], []), 7: (0.0, [], [])}
    assert S.fit(docs.limit(0)).count() == S.transform(docs.limit(0), space).count() == 0


def test_no_last_turns(spark):
    from notemill.operators import sessions

    turns = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "s int, t int")
    assert sessions.last_turns(turns, "s", "t", 0).count() == 0 and sessions.last_turns(turns, "s", "t", 1).count() == 2


def test_nested_strings(spark):
    from notemill.functions import nested

    shape = "id int, `a.b` string, s struct<x:string,y:array<map<string,struct<z:string,n:int>>>>"
    rows = [(1, "a\x00b", ("c\x01", [{"k\x02": ("d\x03", 1), "l": None}, None])), (2, None, None), (3, "", (None, []))]
    df = spark.createDataFrame(rows, shape)
    done = nested.sanitized(df)
    assert done.columns == df.columns and [f.dataType.simpleString() for f in done.schema] == [f.dataType.simpleString() for f in df.schema]
    got = {r.id: r.asDict(recursive=True) for r in done.collect()}
    assert got[1] == {"id": 1, "a.b": "ab", "s": {"x": "c", "y": [{"k\x02": {"z": "d", "n": 1}, "l": None}, None]}}
    assert got[2]["s"] is None and got[3]["s"] == {"x": None, "y": []}
