"""Metrics, drift, votes, sessions and windows over labels, lineitem, events, conversations and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.operators import metrics as M
from notemill.operators import monitoring as W
from notemill.operators import sessions as S
from notemill.sources.scan import spread


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _r(df: DataFrame, *keep: str) -> DataFrame:
    """Doubles to 6 places."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _predictions(spark, sf):
    """Probability and truth of line items: ten times the discount, and whether the status is open."""
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_partkey", F.round(F.col("l_discount") * 10, 3).alias("prob"), (F.col("l_linestatus") == "O").cast("int").alias("y"), (F.col("l_discount") >= 0.05).cast("int").alias("p"), F.col("l_returnflag").alias("label"), F.when(F.col("l_tax") > 0.04, "R").otherwise("N").alias("guess"))


def confusion_counts(spark, sf):
    return M.confusion(_t(spark, sf, "labels"), "quality", "toxic")


def class_metrics(spark, sf):
    return _r(M.per_class(_predictions(spark, sf), "label", "guess"))


def classification_metrics(spark, sf):
    return _r(M.classification(_predictions(spark, sf), "label", "guess"))


def kappa(spark, sf):
    return _r(M.kappa(_t(spark, sf, "labels"), "quality", "toxic"))


def mcc(spark, sf):
    return _r(M.mcc(_predictions(spark, sf), "y", "p"))


def confusion_metrics(spark, sf):
    return _r(M.confusion_metrics(_predictions(spark, sf), "y", "p"))


def calibration(spark, sf):
    return _r(M.calibration(_predictions(spark, sf), "y", "prob"))


def calibration_error(spark, sf):
    return _r(M.calibration_error(_predictions(spark, sf), "y", "prob"))


def auprc(spark, sf):
    return _r(M.auprc(_predictions(spark, sf), "y", "prob"))


def precision_at_k(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return _r(M.precision_at_k(o, "y", "o_totalprice", "o_orderkey", 100))


VOTE_PATTERNS = {"m0": r"[0-9]+", "m1": r"[0-9]{2,}", "m2": r"[0-9.]+"}


def _span_votes(spark, sf):
    """Number spans of three scans of differing strictness over the pages' text-free part of documents."""
    from notemill.functions.spans import scan

    d = _t(spark, sf, "documents")
    parts = [scan(d, p, "doc_id", "text").select("doc_id", F.lit("NUM").alias("type"), "start", "end", F.lit(m).alias("model")) for m, p in VOTE_PATTERNS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def vote_union(spark, sf):
    return M.votes(_span_votes(spark, sf), "union", 3)


def vote_intersect(spark, sf):
    return M.votes(_span_votes(spark, sf), "intersection", 3)


def vote_majority(spark, sf):
    return M.votes(_span_votes(spark, sf), "majority", 3)


def ner_prf(spark, sf):
    v = _span_votes(spark, sf)
    return _r(M.span_scores(v.where("model = 'm0'"), v.where("model = 'm1'")))


def hier_icd(spark, sf):
    codes = _t(spark, sf, "lineitem").select(F.expr("concat(substring('EIJKN', cast(l_partkey % 5 as int) + 1, 1), lpad(cast(l_partkey % 90 + 10 as string), 2, '0'), '.', cast(l_suppkey % 10 as string))").alias("g"), F.expr("concat(substring('EIJKN', cast(l_suppkey % 5 as int) + 1, 1), lpad(cast(l_partkey % 90 + 10 as string), 2, '0'), '.', cast(l_linenumber % 10 as string))").alias("p"))
    return _r(M.hierarchical(codes, "g", "p"))


def _pairs(spark, sf):
    """Spread, as pairs are scored where they are."""
    t = _t(spark, sf, "documents").select("doc_id", "text")
    d = spread(t, "doc_id")
    n = t.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("hyp"))
    return d.join(n, "doc_id").select(F.col("doc_id").alias("pair_id"), F.col("text").alias("ref"), "hyp")


def rouge_1(spark, sf):
    return _r(M.rouge_n(_pairs(spark, sf), 1))


def rouge_2(spark, sf):
    return _r(M.rouge_n(_pairs(spark, sf), 2))


def _sides(spark, sf, column):
    return W.first_and_last(_t(spark, sf, "documents").select("doc_id", column), "doc_id", 200, 100)


def psi_numeric(spark, sf):
    return _r(W.psi_numeric(_sides(spark, sf, "n_chars"), "n_chars"))


def psi_categorical(spark, sf):
    return _r(W.psi_categorical(_sides(spark, sf, "lang"), "lang")).withColumn("severity", W.severity(F.col("psi")))


def confidence_drift(spark, sf):
    e = _t(spark, sf, "events").select("event_id", "value")
    return _r(W.psi_numeric(W.first_and_last(e, "event_id", 500, 100), "value")).withColumn("severity", W.severity(F.col("psi")))


def drift_report(spark, sf):
    """psi and severity of each text statistic between the first 200 and the last 100 documents."""
    d = _t(spark, sf, "documents")
    sides = W.text_record(W.first_and_last(d.select("doc_id", "text"), "doc_id", 200, 100).select(F.struct("doc_id", "side").alias("k"), "text"), "k").withColumn("side", F.col("k.side"))
    parts = [_r(W.psi_numeric(sides, c)).withColumns({"feature": F.lit(c), "severity": W.severity(F.col("psi"))}) for c in ("doc_length", "word_count", "vocab_diversity")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def text_record(spark, sf):
    return W.text_record(_t(spark, sf, "documents"))


def drift_summary(spark, sf):
    return W.summary(W.text_record(_t(spark, sf, "documents")), ["doc_length", "word_count", "vocab_diversity"])


def latency_histogram(spark, sf):
    e = _t(spark, sf, "events").select("event_type", (F.col("value") / 100).alias("v"))
    return W.histogram(e, "event_type", "v")


def latency_percentiles(spark, sf):
    return _r(W.percentiles(_t(spark, sf, "events"), "event_type", "value"))


def rate_limit(spark, sf):
    return W.rate_limited(_t(spark, sf, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 3, 86_400).select("event_id", "seen", "allowed", "remaining")


def session_lastn(spark, sf):
    return S.last_turns(_t(spark, sf, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", 2)


def session_context(spark, sf):
    return S.context(_t(spark, sf, "conversations"), "conv_id", "turn", "text", 3)


def session_stats(spark, sf):
    return S.stats(_t(spark, sf, "conversations"), "conv_id")


def win_tumbling(spark, sf):
    e = _t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.unix_timestamp("w.start").alias("start_s"), "event_type", "n", "total")


def win_sliding(spark, sf):
    e = _t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.unix_timestamp("w.start").alias("start_s"), "n")


def win_session(spark, sf):
    s = S.gap_sessions(_t(spark, sf, "events"), "user_id", "ts", 30)
    return s.select("user_id", F.unix_timestamp(F.col("started").cast("timestamp")).alias("start_s"), F.unix_timestamp(F.col("ended").cast("timestamp")).alias("end_s"), "n")


PRED = """pr as (select round(l_discount * 10, 3) as prob, (l_linestatus = 'O')::int as y, (l_discount >= 0.05e0)::int as p, l_returnflag as label, case when l_tax > 0.04e0 then 'R' else 'N' end as guess from lineitem)"""
CLASS = f"""with {PRED}, l as (select distinct label as c from pr union select distinct guess from pr),
k as (select c as label, (select count(*) from pr where label = c and guess = c) as tp, (select count(*) from pr where label <> c and guess = c) as fp, (select count(*) from pr where label = c and guess <> c) as fn from l),
m as (select *, tp + fn as support, case when tp + fp > 0 then tp::double / (tp + fp) else 0 end as pc, case when tp + fn > 0 then tp::double / (tp + fn) else 0 end as rc from k),
f as (select *, case when pc + rc > 0 then 2 * pc * rc / (pc + rc) else 0 end as f1 from m)"""
BIN = f"with {PRED}, b as (select count(*) filter (y = 1 and p = 1) as tp, count(*) filter (y = 0 and p = 1) as fp, count(*) filter (y = 1 and p = 0) as fn, count(*) filter (y = 0 and p = 0) as tn from pr)"
CAL = f"with {PRED}, c as (select range as bin from range(10)), g as (select least(greatest(floor(prob * 10), 0), 9)::int as bin, count(*) as n, avg(prob) as mp, avg(y) as mt from pr group by 1)"


def _spans_sql(pattern: str) -> str:
    return f"""select doc_id, 'NUM' as type, s.a as start, s.b as "end" from (select doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: struct_pack(
 a := (list_sum(list_transform(list_slice(p, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(m, 1, i - 1), lambda x: length(x))), 0))::bigint,
 b := (list_sum(list_transform(list_slice(p, 1, i), lambda x: length(x))) + list_sum(list_transform(list_slice(m, 1, i), lambda x: length(x))))::bigint))) as s
 from (select doc_id, regexp_extract_all(text, '{pattern}') as m, regexp_split_to_array(text, '{pattern}') as p from documents))"""


VOTES = "with v as (" + " union all ".join(f"select *, '{m}' as model from ({_spans_sql(p)})" for m, p in VOTE_PATTERNS.items()) + ")"


def _votes_sql(least: int) -> str:
    return VOTES + f' select doc_id, type, start, "end", count(distinct model) as n_models from v group by all having count(distinct model) >= {least}'


def _psi_sql(table: str, x: str, key: str, ref: int, cur: int, extra: str = "") -> str:
    return f"""select round(greatest(sum((c - r) * ln(c / r)), 0), 6) as psi{extra} from (select b, (count(x) filter (side = 'r'))::double / {ref} + 1e-6::double as r, (count(x) filter (side = 'c'))::double / {cur} + 1e-6::double as c from
 (select range as b from range(10)) left join (select side, x, least(floor((x - lo) / ((hi - lo) / 10)), 9)::int as k from (select * from (select 'r' as side, {x}::double as x from {table} order by {key} limit {ref}) union all select * from (select 'c' as side, {x}::double as x from {table} order by {key} desc limit {cur})),
 (select min(x) as lo, max(x) as hi from (select x from (select {x}::double as x from {table} order by {key} limit {ref}) union all select x from (select {x}::double as x from {table} order by {key} desc limit {cur})))) on b = k group by b)"""


SEV = ", case when round(greatest(sum((c - r) * ln(c / r)), 0), 6) < 0.1 then 'stable' when round(greatest(sum((c - r) * ln(c / r)), 0), 6) < 0.2 then 'warning' else 'critical' end as severity"
from notemill.plans.text_queries import _words  # noqa: E402

REC = f"(select doc_id, length(text)::double as doc_length, len({_words('text')})::double as word_count, case when len({_words('text')}) > 0 then round(len(list_distinct(list_transform({_words('text')}, lambda w: lower(w))))::double / len({_words('text')}), 6) else 0 end as vocab_diversity from documents)"


def _rouge_sql(n: int) -> str:
    g = f"list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(list_slice(w, i, i + {n - 1}), ' '))"
    return f"""with d as (select doc_id, {_words('lower(text)')} as w from documents),
a as (select doc_id as k, unnest({g}) as g from d), b as (select doc_id + 1 as k, unnest({g}) as g from d where doc_id + 1 in (select doc_id from d)),
ca as (select k, g, count(*) as a from a where k - 1 in (select doc_id from d) group by all), cb as (select k, g, count(*) as b from b group by all),
j as (select k, g, coalesce(a, 0) as a, coalesce(b, 0) as b from ca full join cb using (k, g)),
s as (select k, sum(least(a, b)) as m, sum(a) as na, sum(b) as nb from j group by k),
q as (select k, case when nb > 0 then m::double / nb else 0 end as p, case when na > 0 then m::double / na else 0 end as r from s)
select k as pair_id, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1 from q"""


ORACLES = {
    "confusion_counts": "select quality as y, toxic as p, count(*) as n from labels group by all",
    "class_metrics": CLASS + " select label, tp, fp, fn, support, round(pc, 6) as precision, round(rc, 6) as recall, round(f1, 6) as f1 from f",
    "classification_metrics": CLASS + " select round(sum(tp)::double / sum(support), 6) as accuracy, round(avg(pc), 6) as macro_precision, round(avg(rc), 6) as macro_recall, round(avg(f1), 6) as macro_f1, round(sum(pc * support) / sum(support), 6) as weighted_precision, round(sum(rc * support) / sum(support), 6) as weighted_recall, round(sum(f1 * support) / sum(support), 6) as weighted_f1, round(sum(tp)::double / (sum(tp) + sum(fp)), 6) as micro_f1 from f",
    "kappa": "with n as (select count(*)::double as n, (count(*) filter (quality = toxic))::double as s from labels), e as (select sum(a * b)::double as e from (select quality as c, count(*) as a from labels group by 1) join (select toxic as c, count(*) as b from labels group by 1) using (c)) select round(s / n, 6) as observed, round(e / n / n, 6) as expected, round((s / n - e / n / n) / (1 - e / n / n), 6) as kappa, n::bigint as n from n, e",
    "mcc": BIN + " select tp, fp, fn, tn, round((tp::double * tn - fp::double * fn) / sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn)), 6) as mcc from b",
    "confusion_metrics": BIN + ", c as (select *, tp::double / (tp + fp) as pc, tp::double / (tp + fn) as rc from b) select round(pc, 6) as precision, round(rc, 6) as recall, round(2 * pc * rc / (pc + rc), 6) as f1, round(tn::double / (tn + fp), 6) as specificity, round((tp + tn)::double / (tp + fp + fn + tn), 6) as accuracy from c",
    "calibration": CAL + " select c.bin::int as bin, coalesce(n, 0) as n, round(coalesce(mp, 0), 6) as mean_prob, round(coalesce(mt, 0), 6) as mean_true from c left join g using (bin)",
    "calibration_error": CAL + ", h as (select avg((prob - y) * (prob - y)) as brier, count(*) as n from pr) select round(sum(abs(mp - mt) * g.n) / sum(g.n), 6) as ece, round(max(abs(mp - mt)), 6) as mce, round(any_value(h.brier), 6) as brier, any_value(h.n) as n from g, h",
    "auprc": f"with {PRED}, g as (select prob as s, sum(y)::double as pos, count(*) as n from pr group by 1), c as (select s, sum(pos) over w / (select sum(y) from pr) as r, sum(pos) over w / sum(n) over w as p from g window w as (order by s desc rows unbounded preceding)), d as (select r, p, lag(r, 1, 0) over (order by s desc) as r0, lag(p, 1, 1) over (order by s desc) as p0 from c) select round(sum((r - r0) * (p + p0) / 2), 6) as auprc, count(*) as points from d",
    "precision_at_k": "select round(avg(y), 6) as precision_at_k from (select (o_orderstatus = 'F')::int as y from orders order by o_totalprice desc, o_orderkey limit 100)",
    "vote_union": _votes_sql(1), "vote_intersect": _votes_sql(3), "vote_majority": _votes_sql(2),
    "ner_prf": VOTES + """, g as (select * from v where model = 'm0'), p as (select * from v where model = 'm1'), t as (select count(*) as tp from (select doc_id, type, start, "end" from g intersect select doc_id, type, start, "end" from p)),
 n as (select (select count(*) from g) as n_gold, (select count(*) from p) as n_guess, tp from t)
 select 'NUM' as type, n_gold, n_guess, tp, round(tp::double / n_guess, 6) as precision, round(tp::double / n_gold, 6) as recall, round(2 * (tp::double / n_guess) * (tp::double / n_gold) / (tp::double / n_guess + tp::double / n_gold), 6) as f1 from n""",
    "hier_icd": "with c as (select substring('EIJKN', (l_partkey % 5)::int + 1, 1) || lpad((l_partkey % 90 + 10)::varchar, 2, '0') || '.' || (l_suppkey % 10)::varchar as g, substring('EIJKN', (l_suppkey % 5)::int + 1, 1) || lpad((l_partkey % 90 + 10)::varchar, 2, '0') || '.' || (l_linenumber % 10)::varchar as p from lineitem) select round(avg((g = p)::int), 6) as full_code, round(avg((left(g, 3) = left(p, 3))::int), 6) as category, round(avg((left(g, 1) = left(p, 1))::int), 6) as chapter, count(*) as n from c",
    "rouge_1": _rouge_sql(1), "rouge_2": _rouge_sql(2),
    "psi_numeric": _psi_sql("documents", "n_chars", "doc_id", 200, 100),
    "psi_categorical": "with s as (select * from (select 'r' as side, lang from documents order by doc_id limit 200) union all select * from (select 'c' as side, lang from documents order by doc_id desc limit 100)), g as (select lang, count(*) filter (side = 'r') / (200 + 1e-6::double) + 1e-6::double as r, count(*) filter (side = 'c') / (100 + 1e-6::double) + 1e-6::double as c from s group by lang), p as (select round(greatest(sum((c - r) * ln(c / r)), 0), 6) as psi from g) select psi, case when psi < 0.1 then 'stable' when psi < 0.2 then 'warning' else 'critical' end as severity from p",
    "confidence_drift": _psi_sql("events", "value", "event_id", 500, 100, SEV),
    "drift_report": " union all ".join(f"select *, '{c}' as feature from (" + _psi_sql(REC, c, "doc_id", 200, 100, SEV) + ")" for c in ("doc_length", "word_count", "vocab_diversity")),
    "text_record": f"select * from {REC}",
    "drift_summary": " union all ".join(f"select '{c}' as feature, round(avg({c}), 4) as mean, round(stddev_pop({c}), 4) as std, round(min({c}), 4) as min, round(max({c}), 4) as max, count(*) as n from {REC}" for c in ("doc_length", "word_count", "vocab_diversity")),
    "latency_histogram": "with e as (select event_type, value / 100 as v from events), b as (select event_type, case " + " ".join(f"when v <= {x}e0 then '{x}'" for x in W.BUCKETS) + " end as le from e) select event_type, le, count(*) as n from b where le is not null group by all union all select event_type, '+Inf', count(*) from b group by all",
    "latency_percentiles": "select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99, count(*) as n from events group by 1",
    "rate_limit": "select event_id, seen, seen <= 3 as allowed, greatest(3 - seen, 0) as remaining from (select event_id, count(*) over (partition by user_id order by floor(epoch(ts)) range between 86399 preceding and current row) as seen from events)",
    "session_lastn": "select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as k from conversations) where k <= 2",
    "session_context": "select conv_id, count(*) as turns, max(turn) as last_turn, array_to_string(list_sort(list(distinct role)), ',') as speakers, sum(length(text))::bigint as chars from (select *, row_number() over (partition by conv_id order by turn desc) as k from conversations) where k <= 3 group by conv_id",
    "session_stats": "select count(distinct conv_id) as sessions, count(*) as turns from conversations",
    "win_tumbling": "select (floor(epoch(ts) / 3600) * 3600)::bigint as start_s, event_type, count(*) as n, round(sum(value), 4) as total from events group by all",
    "win_sliding": "select start_s, count(*) as n from (select unnest([(floor(epoch(ts) / 3600) * 3600)::bigint, (floor(epoch(ts) / 3600) * 3600)::bigint - 3600]) as start_s from events) group by 1",
    "win_session": "with a as (select user_id, ts, case when lag(ts) over (partition by user_id order by ts) is null or ts >= lag(ts) over (partition by user_id order by ts) + interval 30 minutes then 1 else 0 end as s from events), b as (select *, sum(s) over (partition by user_id order by ts rows unbounded preceding) as k from a) select user_id, floor(epoch(min(ts)))::bigint as start_s, floor(epoch(max(ts)))::bigint as end_s, count(*) as n from b group by user_id, k",
}
QUERIES = {name: globals()[name] for name in ORACLES}
