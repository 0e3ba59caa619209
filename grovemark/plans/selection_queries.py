"""Queries on choosing a panel's way of voting, on its misses, and on grids of readers and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from grovemark.operators import selection as sl
from grovemark.operators import votes as vt
from grovemark.operators.quality import ratio
from grovemark.plans import fixtures as fx
from grovemark.plans.fixtures import div, sql
from grovemark.plans.registry import query

_UNITS = ("report", "window", "segment")
_J = 4
_D4 = "SELECT DISTINCT juror % 4 AS juror, report, segment, term FROM detections"
_FD = "SELECT report, report % 3 AS fold FROM range(500) x(report)"
_PK = {
    "report": "SELECT DISTINCT juror, report, 0 AS unit, term FROM d4",
    "segment": "SELECT juror, report, segment AS unit, term FROM d4",
    "window": "SELECT DISTINCT a.juror, a.report, c.segment AS unit, a.term FROM d4 a JOIN (SELECT DISTINCT report, segment FROM d4) c ON c.report = a.report AND abs(c.segment - a.segment) <= 1",
}
_CO = {"d4": _D4, "fd": _FD, "pk": " UNION ALL ".join(f"SELECT '{u}' AS u, * FROM ({s})" for u, s in _PK.items())}
_CO["mk"] = "SELECT u, report, unit, term, bit_or(CAST(1 AS BIGINT) << CAST(juror AS BIGINT)) AS mask FROM pk GROUP BY ALL"
_CO["tp_"] = "SELECT m.u, s.subset, m.report, m.term, max(bit_count(m.mask & s.subset)) AS top FROM mk m CROSS JOIN (SELECT CAST(range AS BIGINT) AS subset FROM range(1, 16)) s GROUP BY ALL"
_CO["ct"] = "SELECT g.u, g.subset, g.k, g.fold, coalesce(c.tp, 0) AS tp, coalesce(c.fp, 0) AS fp, g.n_gold - coalesce(c.tp, 0) AS fn FROM (SELECT u, subset, k, f.fold, f.n_gold FROM (SELECT unnest(['report', 'window', 'segment']) AS u) CROSS JOIN (SELECT CAST(range AS BIGINT) AS subset FROM range(1, 16)) CROSS JOIN range(1, 5) x(k) CROSS JOIN (SELECT fold, count(*) AS n_gold FROM gold_d JOIN fd ON fd.report = gold_d.report GROUP BY fold) f WHERE k <= bit_count(subset)) g LEFT JOIN (SELECT t.u, t.subset, k, fd.fold, count(y.term) AS tp, count(*) - count(y.term) AS fp FROM tp_ t JOIN range(1, 5) x(k) ON k <= t.top JOIN fd ON fd.report = t.report LEFT JOIN gold_d y ON y.report = t.report AND y.term = t.term GROUP BY ALL) c ON c.u = g.u AND c.subset = g.subset AND c.k = g.k AND c.fold = g.fold"
_CO["mn"] = f"SELECT u, subset, k, avg({div('2 * tp', '(2 * tp + fp + fn)')}) AS f1 FROM ct GROUP BY ALL"
_CO["be"] = "SELECT * FROM mn QUALIFY row_number() OVER (PARTITION BY subset ORDER BY round(f1, 12) DESC, list_position(['report', 'window', 'segment'], u), k) = 1"
_IN = ("detections", "gold_d")


def _four(spark, d):
    return fx.detections(spark, d).select((F.col("juror") % 4).alias("juror"), "report", "segment", "term").distinct()


def _folds(spark):
    return spark.range(500).select(F.col("id").alias("report"), (F.col("id") % 3).alias("fold"))


def _counts(spark, d):
    return sl.fold_counts(_four(spark, d), fx.gold_d(spark, d), _folds(spark), _UNITS, _J)


@query("vote_fold_counts", "unit:s subset:i k:i fold:i tp:i fp:i fn:i", sql("SELECT u AS unit, subset, k, fold, tp, fp, fn FROM ct", *_IN, **_CO))
def _(spark, d):
    return _counts(spark, d)


@query("select_config", "subset:i unit:s k:i inner_f1:d", sql("SELECT subset, u AS unit, k, f1 AS inner_f1 FROM be", *_IN, **_CO))
def _(spark, d):
    """Every jury's best unit and number of votes on the inner folds."""
    return sl.select_config(_counts(spark, d), _UNITS)


_DROP = "SELECT 0 AS step, CAST(15 AS BIGINT) AS subset UNION ALL SELECT p.step + 1, (SELECT arg_min(b.subset, (-round(b.f1, 12), p.subset - b.subset)) FROM be b WHERE bit_count(b.subset) = bit_count(p.subset) - 1 AND (b.subset & p.subset) = b.subset) FROM path p WHERE bit_count(p.subset) > 1"


@query("backward_elimination", "step:i subset:i unit:s k:i inner_f1:d chosen:s",
       sql("SELECT p.step, p.subset, b.u AS unit, b.k, b.f1 AS inner_f1, p.subset = (SELECT arg_min(q.subset, bit_count(q.subset)) FROM path q JOIN be x ON x.subset = q.subset WHERE x.f1 >= (SELECT max(z.f1) FROM path w JOIN be z ON z.subset = w.subset) - 0.01) AS chosen FROM path p JOIN be b ON b.subset = p.subset", *_IN, **_CO, path=_DROP))
def _(spark, d):
    from grovemark.plans.scratch import settled

    path, chosen = sl.backward_elimination(settled(sl.select_config(_counts(spark, d), _UNITS)), _J, 0.01)
    return path.join(F.broadcast(chosen.select("subset", F.lit(True).alias("chosen"))), "subset", "left").select("step", "subset", "unit", "k", "inner_f1", F.coalesce("chosen", F.lit(False)).alias("chosen"))


# Cells of a grid: a juror's model is juror % 4, its prompt juror div 4.
_GR = "SELECT juror % 4 AS model, juror // 4 AS prompt, segment % 2 AS normaliser, report, term FROM detections"
_GC = f"SELECT model, prompt, normaliser, fold, count(DISTINCT (c.report, c.term)) AS n, count(DISTINCT CASE WHEN y.term IS NOT NULL THEN (c.report, c.term) END) AS tp FROM cells c JOIN fd ON fd.report = c.report LEFT JOIN gold_d y ON y.report = c.report AND y.term = c.term GROUP BY ALL"
_NG = "SELECT fold, count(*) AS g FROM gold_d JOIN fd ON fd.report = gold_d.report GROUP BY fold"
_CL = {"fd": _FD, "cells": _GR, "gc": _GC, "ng": _NG}


def _cells(spark, d):
    """model, prompt, normaliser, fold, n, tp: distinct pairs of each cell and those that are gold."""
    y = fx.gold_d(spark, d).distinct().withColumn("y", F.lit(1))
    c = fx.detections(spark, d).select((F.col("juror") % 4).alias("model"), F.floor(F.col("juror") / 4).alias("prompt"), (F.col("segment") % 2).alias("normaliser"), "report", "term").distinct()
    met = c.join(_folds(spark), "report").join(y, ["report", "term"], "left")
    return met.groupBy("model", "prompt", "normaliser", "fold").agg(F.count(F.lit(1)).alias("n"), F.count("y").alias("tp"))


def _gold_sizes(spark, d):
    return fx.gold_d(spark, d).distinct().join(_folds(spark), "report").groupBy("fold").agg(F.count(F.lit(1)).alias("g"))


@query("stage_grid", "prompt:i normaliser:i f1:d", sql(f"SELECT prompt, normaliser, avg(f1) AS f1 FROM (SELECT model, prompt, normaliser, {div('2 * sum(tp)', '(sum(n) + sum(g))')} AS f1 FROM gc JOIN ng ON ng.fold = gc.fold GROUP BY ALL) GROUP BY ALL", *_IN, **_CL))
def _(spark, d):
    """The mean micro F1 over models of every prompt with every normaliser."""
    per = _cells(spark, d).join(F.broadcast(_gold_sizes(spark, d)), "fold").groupBy("model", "prompt", "normaliser").agg(ratio(2 * F.sum("tp"), F.sum("n") + F.sum("g")).alias("f1"))
    return per.groupBy("prompt", "normaliser").agg(F.avg("f1").alias("f1"))


@query("stage_interaction", "model:i prompt:i f1:d", sql(f"SELECT model, prompt, {div('2 * sum(tp)', '(sum(n) + sum(g))')} AS f1 FROM gc JOIN ng ON ng.fold = gc.fold WHERE normaliser = 0 GROUP BY ALL", *_IN, **_CL))
def _(spark, d):
    per = _cells(spark, d).where("normaliser = 0").join(F.broadcast(_gold_sizes(spark, d)), "fold")
    return per.groupBy("model", "prompt").agg(ratio(2 * F.sum("tp"), F.sum("n") + F.sum("g")).alias("f1"))


_PS = f"SELECT fold, prompt || '/' || normaliser AS pair, avg({div('2 * tp', '(n + g)')}) AS score FROM (SELECT gc.*, g FROM gc JOIN ng ON ng.fold = gc.fold) GROUP BY ALL"
_CP = "SELECT fold, arg_min(pair, (-round(score, 12), list_position(['1/0', '0/0', '0/1', '1/1'], pair))) AS pair, arg_min(score, (-round(score, 12), list_position(['1/0', '0/0', '0/1', '1/1'], pair))) AS score FROM ps GROUP BY fold"
_ORDER = ("1/0", "0/0", "0/1", "1/1")


def _pairs(spark, d):
    rows = _cells(spark, d).join(F.broadcast(_gold_sizes(spark, d)), "fold")
    pair = F.concat_ws("/", F.col("prompt").cast("string"), F.col("normaliser").cast("string"))
    return rows.withColumn("pair", pair).groupBy("fold", "pair").agg(F.avg(ratio(2 * F.col("tp"), F.col("n") + F.col("g"))).alias("score"))


@query("choose_pair", "fold:i pair:s score:d", sql("SELECT * FROM cp", *_IN, **_CL, ps=_PS, cp=_CP))
def _(spark, d):
    return sl.choose_pair(_pairs(spark, d), _ORDER)


@query("pair_frequency", "field:s value:s share:d", sql("SELECT 'pair' AS field, pair AS value, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM cp) AS share FROM cp GROUP BY pair", *_IN, **_CL, ps=_PS, cp=_CP))
def _(spark, d):
    return sl.pair_frequency(sl.choose_pair(_pairs(spark, d), _ORDER), ("pair",))


@query("modal_pair", "pair:s n:i", sql("SELECT arg_min(pair, (-n, f)) AS pair, arg_min(n, (-n, f)) AS n FROM (SELECT pair, count(*) AS n, min(fold) AS f FROM cp GROUP BY pair)", *_IN, **_CL, ps=_PS, cp=_CP))
def _(spark, d):
    return sl.modal(sl.choose_pair(_pairs(spark, d), _ORDER), "pair")


@query("rank_prompts", "place:i prompt:s f1:d promoted:s",
       sql("SELECT place, prompt, f1, place <= 2 AND prompt <> '1/1' AND f1 - (SELECT max(score) FROM ps WHERE pair = '1/1') >= 0.001 AS promoted FROM (SELECT pair AS prompt, max(score) AS f1, row_number() OVER (ORDER BY round(max(score), 12) DESC, pair) AS place FROM ps GROUP BY pair)", *_IN, **_CL, ps=_PS))
def _(spark, d):
    return sl.rank_prompts(_pairs(spark, d).select(F.col("pair").alias("prompt"), F.col("score").alias("f1")), "1/1", 0.001, 2)


@query("stage_ceilings", "slice:s n_named:i recall:d",
       sql("SELECT slice, count(*) AS n_named, CAST(count(y.term) AS DOUBLE) / (SELECT count(*) FROM gold_d) AS recall FROM (SELECT DISTINCT 'model ' || model AS slice, report, term FROM cells UNION SELECT DISTINCT 'prompt ' || prompt, report, term FROM cells UNION SELECT DISTINCT 'all', report, term FROM cells) s LEFT JOIN gold_d y ON y.report = s.report AND y.term = s.term GROUP BY slice", *_IN, cells=_GR))
def _(spark, d):
    """The recall that any reader, any prompt, and all together could reach if one vote were enough."""
    juror = F.col("juror")
    slices = F.array(F.concat(F.lit("model "), (juror % 4).cast("string")), F.concat(F.lit("prompt "), F.floor(juror / 4).cast("string")), F.lit("all"))
    named = fx.detections(spark, d).select(F.explode(slices).alias("slice"), "report", "term").distinct().join(fx.gold_d(spark, d).distinct().withColumn("y", F.lit(1)), ["report", "term"], "left")
    total = fx.gold_d(spark, d).distinct().agg(F.count(F.lit(1)).alias("t"))
    return named.groupBy("slice").agg(F.count(F.lit(1)).alias("n_named"), F.count("y").alias("k")).crossJoin(F.broadcast(total)).select("slice", "n_named", ratio(F.col("k"), F.col("t")).alias("recall"))


@query("stage_lomo", "left_out:i k:i f1:d",
       sql(f"SELECT left_out, arg_min(k, (-round(f1, 12), k)) AS k, arg_min(f1, (-round(f1, 12), k)) AS f1 FROM (SELECT 3 - x.j AS left_out, k, {div('2 * sum(tp)', '(2 * sum(tp) + sum(fp) + sum(fn))')} AS f1 FROM ct JOIN (SELECT j, 15 - (1 << (3 - j)) AS s FROM range(4) r(j)) x ON x.s = ct.subset WHERE u = 'report' GROUP BY ALL) GROUP BY left_out", *_IN, **_CO))
def _(spark, d):
    """Leave one reader out and choose the votes anew."""
    c = _counts(spark, d).where("unit = 'report'").withColumn("out", 15 - F.col("subset")).where(F.bit_count("out") == 1)
    f1 = c.groupBy(F.log2("out").cast("int").alias("left_out"), "k").agg(ratio(2 * F.sum("tp"), 2 * F.sum("tp") + F.sum("fp") + F.sum("fn")).alias("f1"))
    return f1.groupBy("left_out").agg(F.min(F.struct((-F.round("f1", 12)).alias("o"), "k", "f1")).alias("x")).select("left_out", "x.k", "x.f1")


@query("stage_curves", "unit:s k:i precision:d recall:d verbosity:d",
       sql(f"SELECT u AS unit, k, {div('sum(tp)', 'sum(tp + fp)')} AS precision, {div('sum(tp)', 'sum(tp + fn)')} AS recall, sum(tp + fp) / 500.0 AS verbosity FROM ct WHERE subset = 15 GROUP BY ALL", *_IN, **_CO))
def _(spark, d):
    """Precision, recall and predictions a report for every unit and number of votes."""
    t = _counts(spark, d).where("subset = 15").groupBy("unit", "k").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return t.select("unit", "k", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), ((F.col("tp") + F.col("fp")) / 500).alias("verbosity"))


_FT = "SELECT g.report, g.term, coalesce(v.votes, 0) AS votes, coalesce(v.mask, 0) AS mask, CASE WHEN v.votes >= 3 THEN 'accepted' WHEN v.votes > 0 THEN 'outvoted' ELSE 'unnamed' END AS fate FROM gold_d g LEFT JOIN (SELECT report, term, count(DISTINCT juror) AS votes, bit_or(CAST(1 AS BIGINT) << CAST(juror AS BIGINT)) AS mask FROM detections GROUP BY ALL) v ON v.report = g.report AND v.term = g.term"


@query("jury_decomposition", "fate:s votes:i n:i", sql("SELECT fate, votes, count(*) AS n FROM ft GROUP BY ALL", *_IN, ft=_FT))
def _(spark, d):
    """What became of every gold pair: accepted, named but outvoted, or never named."""
    return sl.missed_votes(fx.detections(spark, d), fx.gold_d(spark, d), 3).groupBy("fate", "votes").agg(F.count(F.lit(1)).alias("n"))


@query("juror_blame", "juror:i found_but_outvoted:i", sql("SELECT j AS juror, count(*) AS found_but_outvoted FROM ft JOIN range(8) x(j) ON (mask >> j) & 1 = 1 WHERE fate = 'outvoted' GROUP BY 1", *_IN, ft=_FT))
def _(spark, d):
    return sl.blame(sl.missed_votes(fx.detections(spark, d), fx.gold_d(spark, d), 3), 8)


@query("ensemble_confidences", "confidence:d n:i", sql("SELECT votes / 8.0 AS confidence, count(*) AS n FROM (SELECT report, term, count(DISTINCT juror) AS votes FROM detections GROUP BY ALL) GROUP BY 1", "detections"))
def _(spark, d):
    v = vt.max_counts(vt.packed(fx.detections(spark, d), "report"))
    return v.groupBy((F.col("votes") / 8).alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


@query("call_budget", "report:i segments:i calls:i", sql("SELECT report, count(DISTINCT segment) AS segments, count(DISTINCT segment) * (SELECT count(DISTINCT juror) FROM detections) AS calls FROM detections GROUP BY report", "detections"))
def _(spark, d):
    """Segments of a report and the calls that the whole panel makes on them."""
    det = fx.detections(spark, d)
    n = det.agg(F.count_distinct("juror").alias("j"))
    return det.groupBy("report").agg(F.count_distinct("segment").alias("segments")).crossJoin(F.broadcast(n)).select("report", "segments", (F.col("segments") * F.col("j")).alias("calls"))


@query("audit_cells", "model:i normaliser:i n_reports:i n_segments:i ragged:s",
       sql("SELECT model, normaliser, n_reports, n_segments, n_reports < max(n_reports) OVER () AS ragged FROM (SELECT juror % 4 AS model, segment % 2 AS normaliser, count(DISTINCT report) AS n_reports, count(DISTINCT (report, segment)) AS n_segments FROM detections GROUP BY ALL)", "detections"))
def _(spark, d):
    """Cells of the grid and whether one has fewer reports than the fullest."""
    c = fx.detections(spark, d).select((F.col("juror") % 4).alias("model"), (F.col("segment") % 2).alias("normaliser"), "report", "segment").distinct()
    per = c.groupBy("model", "normaliser").agg(F.count_distinct("report").alias("n_reports"), F.count(F.lit(1)).alias("n_segments"))
    return per.crossJoin(F.broadcast(per.agg(F.max("n_reports").alias("m")))).select("model", "normaliser", "n_reports", "n_segments", (F.col("n_reports") < F.col("m")).alias("ragged"))


@query("productivity", "juror:i segments:i wrote:i linked:i pct_wrote:d pct_linked:d",
       sql("SELECT juror, count(*) AS segments, count_if(w) AS wrote, count_if(w AND l) AS linked, round(100.0 * count_if(w) / count(*), 2) AS pct_wrote, round(100.0 * count_if(w AND l) / count(*), 2) AS pct_linked FROM (SELECT juror, report, segment, bool_and(report % 7 <> juror % 7) AS w, bool_or(term < 30) AS l FROM detections GROUP BY juror, report, segment) GROUP BY juror", "detections"))
def _(spark, d):
    """Per juror: segments, those it wrote on, those whose writing was linked to a term, and both as percentages."""
    per = fx.detections(spark, d).groupBy("juror", "report", "segment").agg(F.bool_or(F.col("term") < 30).alias("l")).withColumn("w", F.col("report") % 7 != F.col("juror") % 7)
    n = F.count(F.lit(1))
    wrote, linked = F.count_if("w"), F.count_if(F.col("w") & F.col("l"))
    return per.groupBy("juror").agg(n.alias("segments"), wrote.alias("wrote"), linked.alias("linked"), F.round(100 * wrote / n, 2).alias("pct_wrote"), F.round(100 * linked / n, 2).alias("pct_linked"))
