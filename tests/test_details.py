"""Codes in two levels, order in time, own triggers, whole-line sections, key findings, readings in context, ROUGE in one reading."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

WORDS = {"E11.9": "sugar insulin", "E03.9": "thyroid tired", "I10": "pressure vessel", "I50.9": "heart swelling", "J18.9": "lung fever", "J44.1": "lung smoker"}


def _labelled(n: int, seed: int):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        code = rng.choice(list(WORDS))
        words = [rng.choice(WORDS[code].split()) for _ in range(4)] + [rng.choice(["person", "visit", "today", "stable"]) for _ in range(6)]
        rng.shuffle(words)
        rows.append((i, " ".join(words), code))
    return rows


def _bayes(train, text, parent=None):
    """Plain naive Bayes over the codes of a chapter (None: over chapters): log shares by class."""
    kept = [(t.split(), c if parent else c[0]) for _, t, c in train if not parent or c[0] == parent]
    vocabulary = {w for _, t, _ in train for w in t.split()}
    words, docs = defaultdict(Counter), Counter(c for _, c in kept)
    for t, c in kept:
        words[c].update(t)
    score = {c: math.log((docs[c] + 1) / (len(kept) + len(docs))) + sum(math.log((words[c][w] + 1) / (words[c].total() + len(vocabulary))) for w in text.split() if w in vocabulary) for c in docs}
    top = max(score.values())
    whole = top + math.log(sum(math.exp(s - top) for s in score.values()))
    return {c: s - whole for c, s in score.items()}


def test_codes_in_two_levels(spark):
    from notemill.operators import code_classifier as K

    train, held = _labelled(240, 1), _labelled(60, 2)
    model = K.fit(spark.createDataFrame([*train, (None, None, None), (7, "nothing", "")], "doc_id bigint, text string, code string"))
    asked = spark.createDataFrame([r[:2] for r in held] + [(1000, None), (1001, "unseen words"), (None, "lung fever lung")], "doc_id bigint, text string")
    got = defaultdict(list)
    for r in K.predict(asked, model, top_k=4).orderBy("rank").collect():
        got[r.doc_id].append((r.code, r.chapter, r.confidence))
    assert len(got) == 63
    for key, text in [*[(i, t) for i, t, _ in held], (1000, ""), (1001, "unseen words"), (None, "lung fever lung")]:
        chapters = sorted(_bayes(train, text).items(), key=lambda x: (-round(x[1], 6), x[0]))[:3]
        every = [(c, p, s + cs) for p, cs in chapters for c, s in sorted(_bayes(train, text, p).items(), key=lambda x: (-round(x[1], 6), x[0]))[:2]]
        want = sorted(every, key=lambda x: (-round(x[2], 6), x[0]))[:4]
        assert [x[:2] for x in got[key]] == [x[:2] for x in want]
        assert [x[2] for x in got[key]] == pytest.approx([math.exp(x[2]) for x in want], abs=2e-6)
    # held-out rows: as good as a model without chapters
    right = lambda rows: sum(rows[i] == c for i, _, c in held) / len(held)
    flat = K.fit(spark.createDataFrame(train, "doc_id bigint, text string, code string"), chapter=lambda c: F.lit("all"))
    flat_best = {r.doc_id: r.code for r in K.predict(asked, flat, chapters=1).where("rank = 1").collect()}
    assert right({k: v[0][0] for k, v in got.items()}) >= max(0.9, right(flat_best) - 0.02)
    # the code's confidence alone: shares within a chapter
    alone = K.predict(asked, model, top_k=4, chapters=1, joint=False).groupBy("doc_id").agg(F.sum("confidence").alias("s")).collect()
    assert len(alone) == 63 and all(abs(r.s - 1) < 1e-5 for r in alone)
    assert K.predict(asked.limit(0), model).count() == 0
    assert K.predict(asked, K.fit(spark.createDataFrame([], "text string, code string"))).count() == 0


def test_order_in_time(spark):
    from notemill.operators import temporal

    long = "a" * 100
    rows = [(1, "Pain after surgery. Before noon! She slept during the scan before discharge"), (1, "Pain after surgery"), (None, f"{long} while {long}"), (2, None), (3, ""), (4, "Following. after ...")]
    got = sorted((r.doc_id or 0, r.sentence, r.start, r.relation, r.source, r.target, r.evidence) for r in temporal.links(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [
        (0, 0, 101, "simultaneous", "a" * 80, "a" * 80, "while"),
        (1, 0, 5, "after", "Pain", "surgery", "after"), (1, 0, 5, "after", "Pain", "surgery", "after"),
        (1, 2, 10, "simultaneous", "She slept", "the scan before discharge", "during"), (1, 2, 26, "before", "She slept during the scan", "discharge", "before"),
    ]


def test_own_triggers(spark):
    from notemill.operators import assertions as A

    rows = [("Patient reports ", "fever", " today"), ("no ", "fever", ""), ("", "fever", " in 3 weeks"), ("possible ", "fever", ""), ("reports it, PO then ", "fever", ""), ("reports no ", "fever", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, pre string, match string, post string")
    own = [(r"\breports\s+", "pre", "reported", 6, 60), (r"\bpossible\s+", "pseudo"), (r"\bin\s+\d+\s+weeks", "post", "planned", 7, 300), (r"\bPO\b", "end")]
    told = lambda own: [r.status for r in A.detect(df, own).orderBy("id").collect()]
    assert told(own) == ["reported", "absent", "planned", "present", "present", "reported"]
    assert told(()) == ["present", "absent", "present", "possible", "present", "absent"]
    with pytest.raises(ValueError):
        A.detect(df, [("x", "before", "absent", 1, 1)])


def test_sections_by_whole_lines(spark):
    from notemill.operators import sections

    text = "intro\n Plan :\nrest and fluids\nHPI: inline\nmeds\nshort\nASSESSMENT\nx"
    rows = [(1, text), (1, text), (None, "Plan\n" + "y" * 20), (2, None), (3, "no header at all")]
    got = sorted((r.doc_id or 0, r.start, r.end, r.name, r.content) for r in sections.simple(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    one = [(1, 6, 42, "plan", "Plan :\nrest and fluids\nHPI: inline"), (1, 42, 53, "medications", "meds\nshort"), (1, 53, 65, "assessment", "ASSESSMENT\nx")]
    assert got == sorted([(0, 0, 25, "plan", "Plan\n" + "y" * 20), *one, *one])


def test_key_findings(spark):
    from notemill.operators import summaries

    text = "The weather was rather fine. Acute treatment plan with elevated dose. Nothing of note was said here. Diagnosis of acute biopsy allergy. Surgery was significant today."
    got = [(r["rank"], r.score, r.sentence) for r in summaries.key_findings(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string"), 2).collect()]
    assert got == [(1, 4, "Acute treatment plan with elevated dose."), (2, 4, "Diagnosis of acute biopsy allergy.")]


def test_readings_in_context(spark):
    from notemill.operators import vitals

    rows = [
        (1, "VITAL SIGNS:\nBP: 120/80 mmHg is improving. Height: 5'10\"\nSOCIAL HISTORY:\nHR: 70 bpm"), (2, "Ht: 5 ft 10 in, HR: 88 bpm unchanged"), (3, "Height: 9' 11\""), (4, None), (None, "stature 5 feet 6 inches"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.type, r.value, r.confidence, r.trend, r.in_section) for r in vitals.in_context(df).collect())
    assert got == [
        (0, "height", 167.6, 0.85, "unknown", False), (1, "blood_pressure", 120.0, 0.95, "improving", True), (1, "heart_rate", 70.0, 0.88, "improving", False), (1, "height", 177.8, 0.9, "improving", True),
        (2, "heart_rate", 88.0, 0.88, "stable", False), (2, "height", 177.8, 0.85, "stable", False),
    ]
    assert {r.value for r in vitals.extract(df).where("type = 'height'").collect()} == {177.8, 167.6}


def test_rouge_in_one_reading(spark):
    from notemill.operators import metrics, summaries

    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 12))), " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 12)))) for i in range(40)]
    pairs = spark.createDataFrame(rows, "pair_id bigint, ref string, hyp string")
    got = {r.pair_id: r for r in summaries.rouge(pairs).collect()}
    for n, name in ((1, "rouge1"), (2, "rouge2")):
        want = {r.pair_id: (r.precision, r.recall, r.f1) for r in metrics.rouge_n(pairs, n).collect()}
        assert {k: tuple(v[name]) for k, v in got.items()} == {k: want.get(k, (0.0, 0.0, 0.0)) for k in got}
    assert {k: tuple(v.rougeL) for k, v in got.items()} == {r.pair_id: (r.precision, r.recall, r.f1) for r in summaries.rouge_l(pairs).collect()}
    odd = summaries.rouge(spark.createDataFrame([(1, None, "a b"), (1, "", ""), (None, "a b", "a")], "pair_id bigint, ref string, hyp string")).collect()
    assert sorted((r.reference_length, r.hypothesis_length, r.length_ratio, r.rouge1.f1) for r in odd) == [(0, 0, 0.0, 0.0), (0, 2, 0.0, 0.0), (2, 1, 0.5, pytest.approx(2 / 3))]
