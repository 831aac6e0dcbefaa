"""Sessions that expire, drift of predictions, sketches by window and overlapping spans over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from notemill.operators import ensemble, prediction_drift, sessions, sketches
from notemill.plans.monitor_queries import ORACLES as MONITOR_SQL
from notemill.plans.monitor_queries import VOTES, _span_votes, drift_report
from notemill.streaming import predictions, windows
from notemill.streaming import sessions as store

TTL, KEEP, OPEN = 21_600, 3, 50
SPAN = 21_600
#: How sure each of the span scans is.
SURE = {"m0": 0.6, "m1": 0.8, "m2": 0.7}


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _actions(events):
    """A user's events as turns of a session; a sign-up clears it."""
    action = F.when(F.col("event_type") == "signup", "clear").otherwise("turn")
    return events.select(F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), action.alias("action"), F.length("props").alias("chars"))


def session_replay(spark, sf):
    return sessions.replay(_actions(_table(spark, sf, "events")), TTL, KEEP)


def stream_session_store(spark, sf):
    """The same answers from state that expires."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, store.ROCKS)
    try:
        return windows.drained(store.session_store(_actions(windows.read(spark, f"{sf}/events.parquet")), TTL, KEEP))
    finally:
        spark.conf.set(name, before)


def sessions_open(spark, sf):
    """Sessions open at the time of the last event."""
    actions = _actions(_table(spark, sf, "events"))
    now = actions.agg(F.max(F.unix_seconds("at"))).first()[0]
    return sessions.still_open(actions, now or 0, TTL, OPEN)


def _predictions(events):
    """A model for each event type: values as confidence, quarters of users as labels."""
    return events.select(F.col("event_type").alias("model"), F.col("event_id").alias("at"), F.col("value").alias("confidence"), (F.col("user_id") % 4).cast("string").alias("label"))


def prediction_report(spark, sf):
    return prediction_drift.report(prediction_drift.ends(_predictions(_table(spark, sf, "events"))))


def stream_prediction_report(spark, sf):
    told = windows.drained(predictions.tracked(_predictions(windows.read(spark, f"{sf}/events.parquet"))), "update")
    return prediction_drift.report(predictions.merged(told))


def drift_status(spark, sf):
    return prediction_drift.status(drift_report(spark, sf), prediction_report(spark, sf))


def _sketched(spark, sf):
    e = _table(spark, sf, "events")
    return sketches.sketched(e, ["event_type"], "ts", "value", F.col("value") > 100)


def metric_rates(spark, sf):
    """Counts, error share and rate by six hours, from five-minute windows."""
    r = lambda c: F.round(c, 6).alias(c)
    return sketches.over(_sketched(spark, sf), ["event_type"], SPAN).select("event_type", "start_s", "n", "failures", r("error_share"), r("a_minute"), r("mean"))


def sketch_quantiles(spark, sf):
    """Per event type, from all windows: n, and for each quantile whether the share of values up to it is as near as the sketch promises."""
    told = sketches.over(_sketched(spark, sf), ["event_type"])
    e = _table(spark, sf, "events").select("event_type", "value").join(told.withColumnRenamed("n", "all"), "event_type")
    near = [(F.abs(F.avg((F.col("value") <= F.col(f"p{round(q * 100)}")).cast("double")) - q) <= sketches.ERROR + 1 / F.count("*")).alias(f"p{round(q * 100)}_near") for q in sketches.QUANTILES]
    return e.groupBy("event_type").agg(F.max("all").alias("n"), *near)


def _sure_spans(spark, sf):
    return _span_votes(spark, sf).withColumn("confidence", F.coalesce(*[F.when(F.col("model") == m, F.lit(c)) for m, c in SURE.items()]))


def ensemble_union(spark, sf):
    return ensemble.overlapping(_sure_spans(spark, sf))


def ensemble_majority(spark, sf):
    return ensemble.overlapping(_sure_spans(spark, sf), "majority", len(SURE))


_ACTIONS = "a as (select user_id as session, floor(epoch(ts))::bigint as at_s, event_id as seq, case when event_type = 'signup' then 'clear' else 'turn' end as action, length(props) as chars from events)"
REPLAY = f"""with {_ACTIONS}, b as (select *, coalesce(lag(action) over w = 'turn' and at_s - lag(at_s) over w <= {TTL}, false) as alive from a window w as (partition by session order by at_s, seq)),
c as (select *, sum(case when action = 'turn' and not alive then 1 else 0 end) over (partition by session order by at_s, seq rows unbounded preceding) as run from b)
select session, seq, case when action = 'turn' then first_value(at_s) over r end as started, case when action = 'turn' then row_number() over r else 0 end as turn,
 case when action = 'turn' then count(*) over k else 0 end as held, (case when action = 'turn' then sum(chars) over k else 0 end)::bigint as chars, action = 'clear' and alive as cleared
from c window r as (partition by session, run order by at_s, seq), k as (partition by session, run order by at_s, seq rows {KEEP - 1} preceding)"""
STILL_OPEN = f"""with {_ACTIONS}, l as (select *, row_number() over (partition by session order by at_s desc, seq desc) as k, max(at_s) over () as now from a)
select session, at_s as last_access from l where k = 1 and action = 'turn' and now - at_s <= {TTL} order by at_s desc, seq desc limit {OPEN}"""
_R, _C = "(r / (nr + 1e-6::double) + 1e-6::double)", "(c / (nc + 1e-6::double) + 1e-6::double)"
_PSI = f"greatest(sum(({_C} - {_R}) * ln({_C} / {_R})), 0)"
_SIDES = "(count(*) filter (side = 'r'))::double as r, (count(*) filter (side = 'c'))::double as c, any_value(nr)::double as nr, any_value(nc)::double as nc"
_SEVERITY = "case when {0} < 0.1 then 'stable' when {0} < 0.2 then 'warning' else 'critical' end as {1}"
REPORT = f"""with p as (select event_type as model, event_id as k, value as confidence, (user_id % 4)::varchar as label from events),
s as (select 'r' as side, * from p qualify row_number() over (partition by model order by k) <= 500 union all select 'c' as side, * from p qualify row_number() over (partition by model order by k desc) <= 100),
x as (select *, min(confidence) over w as lo, max(confidence) over w as hi, count(*) filter (side = 'r') over w as nr, count(*) filter (side = 'c') over w as nc from s window w as (partition by model)),
cc as (select model, least(floor((confidence - lo) / ((hi - lo) / 10)), 9) as bin, {_SIDES} from x where hi > lo and nr > 1 and nc > 1 group by model, bin),
lc as (select model, label, {_SIDES} from x group by model, label),
cp as (select model, round({_PSI}, 6) as confidence_psi from cc group by model), lp as (select model, round({_PSI}, 6) as label_psi from lc group by model),
st as (select model, count(*) filter (side = 'r') as n_reference, count(*) filter (side = 'c') as n_current, round(avg(confidence) filter (side = 'r'), 4) as reference_mean, round(stddev_pop(confidence) filter (side = 'r'), 4) as reference_std,
 round(avg(confidence) filter (side = 'c'), 4) as current_mean, round(stddev_pop(confidence) filter (side = 'c'), 4) as current_std from s group by model),
report as (select st.*, coalesce(confidence_psi, 0) as confidence_psi, label_psi, {_SEVERITY.format('coalesce(confidence_psi, 0)', 'confidence_severity')}, {_SEVERITY.format('label_psi', 'label_severity')}, coalesce(confidence_psi, 0) >= 0.1 as drifted from st left join cp using (model) left join lp using (model))"""
STATUS = f"""{REPORT}, t as (select round(avg(psi), 6) as text_score from ({MONITOR_SQL['drift_report']})), m as (select count(*) filter (drifted) as models_drifted from report)
select text_score, models_drifted, case when text_score >= 0.1 and models_drifted > 0 then 'drifted' when text_score >= 0.1 or models_drifted > 0 then 'warning' else 'stable' end as overall from t, m"""
RATES = f"""select event_type, (floor(epoch(ts) / {SPAN}) * {SPAN})::bigint as start_s, count(*) as n, count(*) filter (value > 100) as failures, round((count(*) filter (value > 100)) / count(*)::double, 6) as error_share,
 round(count(*) * 60 / {SPAN}::double, 6) as a_minute, round(sum(value) / count(value), 6) as mean from events group by all"""
GROUPS = (
    VOTES
    + ", s as (select *, case model "
    + " ".join(f"when '{m}' then {c}::double" for m, c in SURE.items())
    + """ end as confidence from v where start < "end"), r as (select *, max("end") over (partition by doc_id, type order by start, "end", model rows between unbounded preceding and 1 preceding) as reach from s),
g as (select *, sum(case when reach is null or start >= reach then 1 else 0 end) over (partition by doc_id, type order by start, "end", model rows unbounded preceding) as g from r),
b as (select *, row_number() over (partition by doc_id, type, g order by confidence desc, "end" - start desc, start, model) as k from g)
select doc_id, type, min(start) as start, max("end") as "end", count(distinct model) as n_models, count(*) as n_spans, max(start) filter (k = 1) as best_start, max("end") filter (k = 1) as best_end, max(model) filter (k = 1) as best_model, max(confidence) filter (k = 1) as confidence
from b group by doc_id, type, g"""
)
ORACLES = {
    "session_replay": REPLAY,
    "stream_session_store": REPLAY,
    "sessions_open": STILL_OPEN,
    "prediction_report": REPORT + " select * from report",
    "stream_prediction_report": REPORT + " select * from report",
    "drift_status": STATUS,
    "metric_rates": RATES,
    "sketch_quantiles": "select event_type, count(*) as n, true as p50_near, true as p95_near, true as p99_near from events group by event_type",
    "ensemble_union": GROUPS,
    "ensemble_majority": GROUPS + " having count(distinct model) >= 2",
}
QUERIES = {name: globals()[name] for name in ORACLES}
