"""Queries over score tables, gates, sweeps and pseudo-labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtable.catalog.cleaning import docs
from voxtable.catalog.profiles import rounded
from voxtable.catalog.registry import query, table
from voxtable.catalog.tables import SCORES_SQL, scores
from voxtable.operators import categories as cat
from voxtable.operators import ensembles as en
from voxtable.operators import gating as gt
from voxtable.operators import pseudo as ps
from voxtable.operators import scores as sc
from voxtable.operators import splits as sp

_S = SCORES_SQL
_WEIGHTS = {"m0": 0.5, "m1": 1.0, "m2": 0.25}
_W = "(select * from (values ('m0', 0.5::double), ('m1', 1.0::double), ('m2', 0.25::double)) t(model, weight))"
_ORDER = [3, 1, 0, 4]
_MODELS = [f"m{i}" for i in range(8)]


@query("b1_align_classes", f"select model, row_id, label, cast(case label when 3 then 0 when 1 then 1 when 0 then 2 else 3 end as integer) as label_pos, round(score, 9) as score from {_S} where label in (0, 1, 3, 4)")
def align_classes(spark, d):
    return rounded(sc.align_classes(scores(spark, d), _ORDER).drop("y"), "score", digits=9)


@query("b1_missing_classes", f"select m.model, w.label from (select distinct model from {_S}) m, (select unnest([0, 1, 17])::bigint as label) w where not exists (select 1 from {_S} s where s.model = m.model and s.label = w.label)")
def missing_classes(spark, d):
    return sc.missing_classes(scores(spark, d), [0, 1, 17])


# Models without a weight of their own weigh 1.
_SUM = f"(select row_id, label, min(label_pos) as label_pos, sum(coalesce(weight, 1.0) * score) as score, sum(coalesce(weight, 1.0)) as total from {_S} s left join {_W} w using (model) group by 1, 2)"


@query("b2_weighted_sum", f"select row_id, label, label_pos, round(score, 9) as score from {_SUM}")
def weighted_sum(spark, d):
    return rounded(sc.weighted_sum(scores(spark, d), sc.model_weights(spark, _WEIGHTS)), "score", digits=9)


@query("b2_fold_weights", f"select model, round(w / count(*) over (partition by run), 9)::double as weight from (select distinct model, case when model = 'm2' then 'b' else 'a' end as run, case when model = 'm2' then 0.5 else 1.0 end as w from {_S})")
def fold_weights(spark, d):
    models = scores(spark, d).select("model").distinct().withColumn("run", F.when(F.col("model") == "m2", "b").otherwise("a"))
    return rounded(sc.fold_weights(models, sc.model_weights(spark, {"a": 1.0, "b": 0.5})), "weight", digits=9)


@query("b3_weighted_mean", f"select row_id, label, label_pos, round(score / total, 9) as score from {_SUM}")
def weighted_mean(spark, d):
    return rounded(sc.weighted_mean(scores(spark, d), sc.model_weights(spark, _WEIGHTS)), "score", digits=9)


@query("b4_auto_weights", f"select model, coalesce(case when model <> 'm1' then round(avg(score), 6) end, 1.0)::double as weight from {_S} group by model")
def auto_weights(spark, d):
    table_ = scores(spark, d)
    known = table_.filter("model <> 'm1'").groupBy("model").agg(F.round(F.avg("score"), 6).alias("score"))
    return sc.auto_weights(table_.select("model").distinct(), known)


_SOFT = f"(select *, exp(score - max(score) over w) / sum(exp(score - mx)) over w as p from (select *, max(score) over (partition by model, row_id) as mx from {_S}) window w as (partition by model, row_id))"


@query("b5_softmax", f"select model, row_id, label, round(p, 9) as score from {_SOFT}")
def softmax(spark, d):
    return rounded(sc.softmax(scores(spark, d)).select("model", "row_id", "label", "score"), "score", digits=9)


def _pair(spark, d):
    table_ = scores(spark, d)
    return table_.filter("model = 'm0'"), table_.filter("model = 'm1'")


@query("b6_blend_softmax", f"select row_id, label, min(label_pos) as label_pos, round(sum(p * case when model = 'm0' then 1.0 else 0.4 end) / 1.4, 9)::double as score from {_SOFT} where model in ('m0', 'm1') group by 1, 2")
def blend_softmax(spark, d):
    return rounded(sc.blend(*_pair(spark, d), 1.0, 0.4), "score", digits=9)


@query("b6_blend_logits", f"select row_id, label, min(label_pos) as label_pos, round(sum(score * case when model = 'm0' then 1.0 else 0.4 end), 9)::double as score from {_S} where model in ('m0', 'm1') group by 1, 2")
def blend_logits(spark, d):
    return rounded(sc.blend(*_pair(spark, d), 1.0, 0.4, "logit_sum"), "score", digits=9)


@query("b7_argmax", f"select row_id, label, confidence from (select row_id, label, round(score) as confidence, row_number() over (partition by row_id order by round(score) desc, label_pos) as r from {_S} where model = 'm0') where r = 1")
def argmax(spark, d):
    # Scores rounded to whole numbers, so that ties are common.
    return sc.argmax(rounded(scores(spark, d).filter("model = 'm0'"), "score", digits=0))


# Events with a class tied to the time of month and a prediction that is often wrong.
_EVENTS = "(select event_id, ts, cast(event_id % 5 + 1 as integer) as fold, case when day(ts) <= 10 then event_id % 3 else 3 + event_id % 3 end as y, (event_id * 7 + user_id) % 6 as pred, case when event_id % 13 = 0 then null else ts end as t from events)"


def events(spark, d):
    return table(spark, d, "events").select(
        "event_id", "ts", F.expr("cast(event_id % 5 + 1 as int)").alias("fold"),
        F.expr("case when day(ts) <= 10 then event_id % 3 else 3 + event_id % 3 end").alias("y"), F.expr("(event_id * 7 + user_id) % 6").alias("pred"),
        F.expr("case when event_id % 13 = 0 then null else ts end").alias("t"),
    )


@query("b8_time_windows", f"select y as label, strftime(min(t), '%Y-%m-%d %H:%M:%S.%f') as t_min, strftime(max(t), '%Y-%m-%d %H:%M:%S.%f') as t_max from {_EVENTS} group by y")
def time_windows(spark, d):
    out = gt.time_windows(events(spark, d), "y", "t")
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("t_min", "t_max")})


_GATES, _FALLBACK, _OVERRIDES = [0, 3, 4, 5], 2, {5: 1, 0: 4}


def _gate_sql(source: str, windows: str, fold: str = "") -> str:
    """The gate as nested CASE steps, one per class in order."""
    sql = f"(select *, pred as g, 0::bigint as ch from {source})"
    for c in _GATES:
        fb = _OVERRIDES.get(c, _FALLBACK)
        hit = f"(a.g = {c} and (a.t < w.t_min or a.t > w.t_max))"
        on = f"w.label = {c}" + (" and w.fold = a.fold" if fold else "")
        sql = f"(select a.* replace (case when {hit} then {fb} else a.g end as g, a.ch + case when {hit} then 1 else 0 end as ch) from {sql} a left join {windows} w on {on})"
    return sql


_WIN = f"(select y as label, min(t) as t_min, max(t) as t_max from {_EVENTS} where t is not null group by y)"
_GATED = _gate_sql(_EVENTS, _WIN)


@query("b9_gate_by_time", f"select event_id, pred, cast(g as bigint) as pred_gated, ch as gate_changes from {_GATED}")
def gate_by_time(spark, d):
    df = events(spark, d)
    gated = gt.gate_by_time(df, gt.time_windows(df, "y", "t"), "pred", "t", _GATES, _FALLBACK, _OVERRIDES)
    return gated.select("event_id", "pred", "pred_gated", "gate_changes")


def _macro(source: str, pred: str) -> str:
    return f"""(select avg(coalesce(2 * tp / nullif(pr + su, 0), 0)) from (select l, count(*) filter (where y = l and {pred} = l) as tp, count(*) filter (where {pred} = l) as pr, count(*) filter (where y = l) as su
        from {source}, (select unnest([0, 1, 2, 3, 4, 5]) as l) group by l))"""


def _compare(source: str) -> str:
    return (
        f"select 'raw' as variant, round({_macro(source, 'pred')}, 9)::double as macro_f1, 0::bigint as changed"
        f" union all select 'gated', round({_macro(source, 'g')}, 9)::double, (select cast(sum(ch) as bigint) from {source})"
    )


_FOLD_WIN = f"(select f.fold, e.y as label, min(e.t) as t_min, max(e.t) as t_max from {_EVENTS} e join (select distinct fold from {_EVENTS}) f on e.fold <> f.fold where e.t is not null group by 1, 2)"


@query("b10_gated_evaluation", _compare(_gate_sql(_EVENTS, _FOLD_WIN, "fold")))
def gated_evaluation(spark, d):
    df = events(spark, d)
    gated = gt.gate_by_time(df, gt.fold_windows(df, "y", "t"), "pred", "t", _GATES, _FALLBACK, _OVERRIDES)
    return rounded(gt.compare_gating(gated, "y", "pred", range(6)), "macro_f1", digits=9)


@query("b10_gated_evaluation_all_rows", _compare(_GATED))
def gated_evaluation_all_rows(spark, d):
    df = events(spark, d)
    gated = gt.gate_by_time(df, gt.time_windows(df, "y", "t"), "pred", "t", _GATES, _FALLBACK, _OVERRIDES)
    return rounded(gt.compare_gating(gated, "y", "pred", range(6)), "macro_f1", digits=9)


_GRID = [("left", 1.0, 0.0), ("right", 0.0, 1.0), *[(f"mix{w:g}", 1.0, w) for w in (0.2, 0.5, 0.8, 1.0, 1.5)]]
_GRID_SQL = "(select * from (values " + ", ".join(f"('{n}', {a}::double, {b}::double)" for n, a, b in _GRID) + ") t(name, a, b))"
_SWEEP = f"""with p as (select row_id, y, label, label_pos, max(case when model = 'm0' then p end) as p0, max(case when model = 'm1' then p end) as p1 from {_SOFT} group by all),
    s as (select name, row_id, y, label, label_pos, (a * p0 + b * p1) / (a + b) as v from p, {_GRID_SQL}),
    d as (select name, y, label as q from (select *, row_number() over (partition by name, row_id order by v desc, label_pos) as r from s) where r = 1),
    f as (select name, l as label, coalesce(2 * count(*) filter (where y = l and q = l) / nullif(count(*) filter (where y = l) + count(*) filter (where q = l), 0), 0) as f1 from d, (select unnest([0, 1, 2, 3, 4, 5, 6, 7]) as l) group by name, l)"""


def _sweep(spark, d):
    table_ = scores(spark, d)
    rows = en.score_rows(table_.filter("model in ('m0', 'm1')"), ["m0", "m1"])
    truth = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), (F.col("label") % 5).cast("long").alias("y"))
    return en.blend_sweep(rows, truth, _GRID, range(8))


@query("b11_blend_sweep", f"{_SWEEP} select name, round(avg(f1), 9)::double as macro_f1 from f group by name")
def blend_sweep(spark, d):
    return rounded(en.rank_sweep(_sweep(spark, d)), "macro_f1", digits=9)


@query("b11_sweep_per_class", f"{_SWEEP} select name, cast(label as bigint) as label, round(f1, 9)::double as f1 from f")
def sweep_per_class(spark, d):
    return rounded(_sweep(spark, d).select("name", "label", "f1"), "f1", digits=9)


@query("b12_greedy_ensemble")
def greedy_ensemble(spark, d):
    truth = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), (F.col("label") % 5).cast("long").alias("y"))
    found = en.greedy_ensemble(scores(spark, d).drop("y"), truth, _MODELS, range(8))
    # The weights found, next to the macro-F1 that scoring the whole table with them gives.
    rows = en.score_rows(scores(spark, d), list(found["weights"])).join(truth, "row_id")
    weights = F.array(*[F.lit(w) for w in found["weights"].values()])
    mixed = en.predict_cells(F.col("cells"), lambda c: F.aggregate(F.zip_with(c["s"], weights, lambda s, w: s * w), F.lit(0.0), lambda a, b: a + b))
    f1 = en.per_class_report(rows.select("y", mixed.alias("p")), "y", "p", range(8)).agg(F.avg("f1").alias("macro_f1"))
    listed = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(w).alias("weight")) for m, w in found["weights"].items()])
    return rounded(f1.select(F.explode(listed).alias("m"), "macro_f1").select("m.model", "m.weight", "macro_f1"), "weight", "macro_f1")


_PREDICTIONS = f"(select row_id as id, label, confidence from (select row_id, label, p as confidence, row_number() over (partition by row_id order by p desc, label_pos) as r from {_SOFT} where model = 'm0') where r = 1)"


def predictions(spark, d):
    return sc.argmax(sc.softmax(scores(spark, d).filter("model = 'm0'"))).withColumnRenamed("row_id", "id")


_PSEUDO = f"(select id, label, confidence from (select *, row_number() over (partition by label order by confidence desc, id) as r from {_PREDICTIONS} where confidence >= 0.4) where r <= 20)"


@query("b13_pseudo_labels", f"select id, label, round(confidence, 9) as confidence from {_PSEUDO}")
def pseudo_labels(spark, d):
    return rounded(ps.select_pseudo_labels(predictions(spark, d), "id", 0.4, 20), "confidence", digits=9)


@query("b13_pseudo_summary", f"select label, count(*) as rows, round(min(confidence), 9) as min_conf, round(avg(confidence), 9) as mean_conf, round(max(confidence), 9) as max_conf from {_PSEUDO} group by label")
def pseudo_summary(spark, d):
    chosen = ps.select_pseudo_labels(predictions(spark, d), "id", 0.4, 20)
    return rounded(ps.pseudo_summary(chosen), "min_conf", "mean_conf", "max_conf", digits=9)


@query(
    "b14_pseudo_union",
    f"""select id, label, fold, weight from (select vec_id as id, label::bigint as label, cast((row_number() over (partition by label order by md5(concat(vec_id, '-42')), vec_id) - 1) % 3 + 1 as integer) as fold, 1.0::double as weight
        from embeddings where label <> 4) union all select id, label, 0, 0.3::double from {_PSEUDO} where confidence >= 0.45 and label <> 4""",
)
def pseudo_union(spark, d):
    train = table(spark, d, "embeddings").filter("label <> 4").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"))
    folded = sp.assign_folds(train, "id", "label", 3)
    chosen = ps.select_pseudo_labels(predictions(spark, d), "id", 0.4, 20)
    return ps.with_pseudo_rows(folded, chosen, cat.LabelEncoder.fit(train, "label"), 0.45, 0.3).select("id", "label", "fold", "weight")


@query("b15_submission", f"select doc_id as id, label as class_int from documents left join {_PREDICTIONS} p on p.id = doc_id")
def submission(spark, d):
    template = docs(spark, d).select(F.col("doc_id").alias("id"))
    return ps.submission(template, predictions(spark, d).withColumnRenamed("label", "class_int"), "id", "class_int")


@query("b15_complete_submission", f"select vec_id as id, label as class_int from (select vec_id from embeddings) e join {_PREDICTIONS} p on p.id = e.vec_id")
def complete_submission(spark, d):
    template = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    return ps.complete_submission(template, predictions(spark, d).withColumnRenamed("label", "class_int"), "id", "class_int")
