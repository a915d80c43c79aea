"""Queries over predictions: metrics of classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics
from ..sources import bridge
from ..sources.shared import place
from . import duck
from .registry import query


def _pred(spark, sf):
    return bridge.predictions(spark, sf).withColumn("p", F.array("p0", "p1", "p2"))


_SCORED = duck.PRED + """, s as (select *, case when p0 >= p1 and p0 >= p2 then 0 when p1 >= p2 then 1 else 2 end as pred, greatest(p0, p1, p2) as p_max, case y when 0 then p0 when 1 then p1 else p2 end as p_true from pred),
c as (select *, cast(pred = y as int) as correct, cast(p0 > p_true or (p0 = p_true and 0 > y) as int) + cast(p1 > p_true or (p1 = p_true and 1 > y) as int) + cast(p2 > p_true or (p2 = p_true and 2 > y) as int) + 1 as true_rank from s)
"""


@query("srt_argmax", _SCORED + "select event_id, pred, correct, true_rank from c")
def srt_argmax(spark, sf):
    return metrics.scored(_pred(spark, sf)).select("event_id", "pred", "correct", "true_rank")


@query("fn_entropy", _SCORED + "select event_id, round(-(p0 * ln(p0) + p1 * ln(p1) + p2 * ln(p2)), 6) as entropy, round(abs(p_max - (p0 + p1 + p2 - p_max - least(p0, p1, p2))), 6) as margin, p_max from c")
def fn_entropy(spark, sf):
    return metrics.scored(_pred(spark, sf)).select("event_id", F.round("entropy", 6).alias("entropy"), F.round("margin", 6).alias("margin"), "p_max")


@query("agg_accuracy", _SCORED + "select count(*) as n, avg(correct) as accuracy, avg(cast(true_rank <= 2 as int)) as top2_accuracy from c")
def agg_accuracy(spark, sf):
    return metrics.summary(_pred(spark, sf)).select("n", "accuracy", "top2_accuracy")


@query("agg_log_loss", _SCORED + "select round(avg(-ln(greatest(1e-15, least(1 - 1e-15, p_true)))), 6) as log_loss from c")
def agg_log_loss(spark, sf):
    return metrics.summary(_pred(spark, sf)).select(F.round("log_loss", 6).alias("log_loss"))


@query("agg_brier", duck.PRED + "select count(*) as n, round(avg((villain_p - villain_y) ** 2), 6) as brier from pred where villain_y >= 0")
def agg_brier(spark, sf):
    return metrics.brier(_pred(spark, sf), "villain_p", "villain_y").select("n", F.round("brier", 6).alias("brier"))


@query("agg_bluff_ev", duck.PRED + ", m as (select avg(bet) as m from pred where bet <> 0), e as (select villain_p * pot - (1 - villain_p) * case when bet = 0 then coalesce(m, 3.0) else bet end as ev from pred, m) select round(avg(ev), 6) as bluff_ev_mean, avg(cast(ev > 0 as int)) as bluff_positive_frac from e")
def agg_bluff_ev(spark, sf):
    return metrics.bluff_summary(_pred(spark, sf), "villain_p", "pot", "bet").select(F.round("bluff_ev_mean", 6).alias("bluff_ev_mean"), "bluff_positive_frac")


@query("agg_bet_impute", duck.PRED + ", m as (select avg(bet) as m from pred where bet <> 0) select event_id, round(case when bet = 0 then m else bet end, 6) as bet from pred, m")
def agg_bet_impute(spark, sf):
    return metrics.imputed_bet(_pred(spark, sf), "bet").select("event_id", F.round("bet", 6).alias("bet"))


@query("agg_confusion", _SCORED + "select y, pred, count(*) as n, count(*) / sum(count(*)) over (partition by y)::double as share from c group by 1, 2")
def agg_confusion(spark, sf):
    return metrics.confusion(metrics.scored(_pred(spark, sf)))


_PRF = _SCORED + """, k as (select unnest([0, 1, 2]) as c), t as (select k.c, count(*) filter (where y = k.c and pred = k.c) as tp, count(*) filter (where pred = k.c) as pp, count(*) filter (where y = k.c) as support from c, k group by 1),
r as (select c, support, case when pp = 0 then 0 else tp / pp::double end as precision, case when support = 0 then 0 else tp / support::double end as recall from t), f as (select *, case when precision + recall = 0 then 0 else 2 * precision * recall / (precision + recall) end as f1 from r)
"""


@query("agg_prf", _PRF + "select c, precision, recall, support, f1 from f")
def agg_prf(spark, sf):
    return metrics.per_class(metrics.scored(_pred(spark, sf)))


@query("agg_prf_averages", _PRF + "select round(avg(precision), 9) as macro_precision, round(avg(recall), 9) as macro_recall, round(avg(f1), 9) as macro_f1, round(sum(precision * support) / sum(support), 9) as weighted_precision, round(sum(recall * support) / sum(support), 9) as weighted_recall, round(sum(f1 * support) / sum(support), 9) as weighted_f1 from f")
def agg_prf_averages(spark, sf):
    a = metrics.averages(metrics.per_class(metrics.scored(_pred(spark, sf))))
    return a.select(*[F.round(c, 9).alias(c) for c in a.columns])


@query("agg_roc_auc", duck.PRED + ", r as (select villain_y as y, rank() over (order by villain_p) + (count(*) over (partition by villain_p) - 1) / 2.0 as r from pred where villain_y >= 0) select round((sum(r) filter (where y = 1) - count(*) filter (where y = 1) * (count(*) filter (where y = 1) + 1) / 2.0) / (count(*) filter (where y = 1) * count(*) filter (where y = 0))::double, 9) as roc_auc from r")
def agg_roc_auc(spark, sf):
    return metrics.roc_auc(_pred(spark, sf).where("villain_y >= 0"), "villain_p", "villain_y").select(F.round("roc_auc", 9).alias("roc_auc"))


@query("agg_pr_auc", duck.PRED + ", g as (select villain_p as s, sum(villain_y) as pos, count(*) as n from pred where villain_y >= 0 group by 1), c as (select pos, sum(pos) over (order by s desc) / sum(n) over (order by s desc)::double as precision from g) select round(cast(sum(precision * pos) / sum(pos) as double), 9) as average_precision from c")
def agg_pr_auc(spark, sf):
    return metrics.average_precision(_pred(spark, sf).where("villain_y >= 0"), "villain_p", "villain_y").select(F.round("average_precision", 9).alias("average_precision"))


_RANKED = _SCORED + ", o as (select row_number() over (order by p_max desc, event_id) as k, sum(correct) over (order by p_max desc, event_id rows unbounded preceding) as hits, count(*) over () as n, p_max as s from c)\n"


@query("win_selective_curve", _RANKED + ", w as (select i / 20.0e0 as coverage, greatest(1, cast(round_even(i / 20.0e0 * (select count(*) from c), 0) as bigint)) as k from range(1, 21) t(i)) select coverage, k, hits / k::double as accuracy, s as threshold from w join o using (k)")
def win_selective_curve(spark, sf):
    return metrics.selective_curve(metrics.scored(_pred(spark, sf)), "p_max", "correct", "event_id")


_TARGETS = [0.3, 0.33, 0.36, 0.5, 0.9]


@query("win_trust_policy", _RANKED + f", t as (select unnest({_TARGETS}::double[]) as target), b as (select target, max(k) filter (where hits >= target * k) as k from t, o group by 1) select target, k, k / n::double as coverage, s as threshold, hits / k::double as accuracy from b left join o using (k)")
def win_trust_policy(spark, sf):
    return metrics.trust_policy(metrics.scored(_pred(spark, sf)), "p_max", "correct", "event_id", _TARGETS)


@query("join_nearest", _RANKED + ", w as (select i / 20.0e0 as coverage, greatest(1, cast(round_even(i / 20.0e0 * (select count(*) from c), 0) as bigint)) as k from range(1, 21) t(i)), v as (select coverage, hits / k::double as accuracy, s as threshold from w join o using (k)), t as (select unnest([0.12, 0.5, 0.83]::double[]) as target), z as (select *, row_number() over (partition by target order by abs(coverage - target), coverage) as r from t, v) select target, coverage, accuracy, threshold from z where r = 1")
def join_nearest(spark, sf):
    curve = metrics.selective_curve(metrics.scored(_pred(spark, sf)), "p_max", "correct", "event_id").select("coverage", "accuracy", "threshold")
    return metrics.nearest(curve, spark.createDataFrame([(0.12,), (0.5,), (0.83,)], "target double"))


@query("agg_calibration", duck.PRED + ", e as (select list_distinct(quantile_cont(villain_p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) as q from pred where villain_y >= 0), b as (select villain_p as p, villain_y as y, cast(len(list_filter(q, lambda x: villain_p > x)) as int) as bin from pred, e where villain_y >= 0) select bin, count(*) as n, round(avg(p), 9) as mean_p, avg(y) as mean_y from b group by 1")
def agg_calibration(spark, sf):
    return metrics.calibration(_pred(spark, sf).where("villain_y >= 0"), "villain_p", "villain_y").select("bin", "n", F.round("mean_p", 9).alias("mean_p"), "mean_y")


@query("fil_trust_gate", _SCORED + "select event_id, case when p_max < 0.4 then 'defer' else cast(pred as varchar) end as decision from c")
def fil_trust_gate(spark, sf):
    return metrics.scored(_pred(spark, sf)).select("event_id", F.when(F.col("p_max") < 0.4, "defer").otherwise(F.col("pred").cast("string")).alias("decision"))


@query("fil_villain_known", duck.PRED + "select event_id, villain_y from pred where villain_y >= 0")
def fil_villain_known(spark, sf):
    return _pred(spark, sf).where("villain_y >= 0").select("event_id", "villain_y")


@query("agg_model_compare", duck.PRED + "select 'mixed' as model, avg(cast(case when p0 >= p1 and p0 >= p2 then 0 when p1 >= p2 then 1 else 2 end = y as int)) as accuracy from pred union all select 'zero', avg(cast(y = 0 as int)) from pred order by 2 desc, 1")
def agg_model_compare(spark, sf):
    s = metrics.scored(_pred(spark, sf))
    parts = s.agg(F.avg("correct").alias("a"), F.avg((F.col("y") == 0).cast("int")).alias("b"))
    return parts.select(F.explode(F.array(F.struct(F.lit("mixed").alias("model"), F.col("a").alias("accuracy")), F.struct(F.lit("zero").alias("model"), F.col("b").alias("accuracy")))).alias("x")).select("x.*").orderBy(F.desc("accuracy"), "model")


@query("join_meta_features", _SCORED + "select event_id, p0, p1, p2, p_max, round(abs(p_max - (p0 + p1 + p2 - p_max - least(p0, p1, p2))), 6) as margin, pot, bet from c")
def join_meta_features(spark, sf):
    return metrics.scored(_pred(spark, sf)).select("event_id", "p0", "p1", "p2", "p_max", F.round("margin", 6).alias("margin"), "pot", "bet")


@query("snk_llm_metrics", _SCORED + "select count(*) as n, avg(correct) as accuracy, sum(pred) as predicted from c")
def snk_llm_metrics(spark, sf):
    """Metrics and predictions written as JSON lines side by side; the metrics file and the sum over the predictions' file."""
    folder = place(spark, "llm-metrics")
    s = metrics.scored(_pred(spark, sf))
    s.select("event_id", "y", "pred", "p_max").write.json(f"{folder}/predictions")
    metrics.summary(s.select("p", "y")).write.json(f"{folder}/metrics")
    figures = spark.read.schema("n long, accuracy double").json(f"{folder}/metrics")
    return figures.crossJoin(spark.read.schema("event_id long, pred int").json(f"{folder}/predictions").agg(F.sum("pred").alias("predicted")))
