"""Registered queries: mini-batch training, sweeps, a hidden layer, resuming, saved pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledeframe.operators import cooccur as C
from ledeframe.operators import metrics as M
from ledeframe.operators import train as T
from ledeframe.plans import fixtures as X
from ledeframe.plans.catalog import ORACLE, i64, r6, register, sql_bits
from ledeframe.plans.q_metrics import sql_per_class
from ledeframe.plans.q_train import _T1_SQL, FEAT_SQL, REG, T1_CHECK, _t1_log_out, headline_features
from ledeframe.plans.q_vectors import DIM
from ledeframe.session import scratch_path

_P = "1.0 / (1.0 + exp(-{z}))"
_CUT = "least(greatest(p, 1e-7), 1.0 - 1e-7)"
_BCE = f"(-(y * ln({_CUT} + 1e-7) + (1.0 - y) * ln(1.0 - {_CUT} + 1e-7)))"
_DOT = _P.format(z="list_dot_product(xb, w)")
_ZEROS = f"list_transform(range({DIM + 1}), lambda j: 0.0::DOUBLE)"
# Rows with the bias as first feature.
_ROWS_SQL = f"{FEAT_SQL}, _b AS (SELECT doc_id, split, y, list_concat([1.0::DOUBLE], x) AS xb FROM feat)"


def _sql_factor(step: str, total: str, share: float) -> str:
    """W6 at ``step`` of ``total``."""
    warm = f"trunc({share} * {total})"
    return f"(CASE WHEN {step} < {warm} THEN {step} / greatest(1, {warm}) ELSE greatest(0.0, ({total} - {step}) / greatest(1, {total} - {warm})) END)"


def _sql_metrics(source: str, keys: str) -> str:
    """Validation metrics per ``keys`` of rows (keys, y, p)."""
    return f"""SELECT {keys}, avg({_BCE}) AS val_loss, avg(CASE WHEN (y = 1) = (p > 0.5) THEN 1.0 ELSE 0.0 END) AS val_accuracy,
       coalesce(2.0 * count(*) FILTER (WHERE y = 1 AND p > 0.5) / nullif(2 * count(*) FILTER (WHERE y = 1 AND p > 0.5)
         + count(*) FILTER (WHERE y = 0 AND p > 0.5) + count(*) FILTER (WHERE y = 1 AND NOT p > 0.5), 0), 0.0) AS val_f1 FROM {source} GROUP BY {keys}"""


_SQUARES = "list_sum(list_transform({v}, lambda v: v * v))"

# --- T1 / W7: mini-batches of a shuffled loader --------------------------------------

BATCHES = T.BatchConfig(max_epochs=2, lr=0.5, patience=10, l2=0.01, clip=1.0, warmup_share=0.1, run_id="batches", batch_size=32, accumulate=2)


def _minibatch_sql(cfg: T.BatchConfig) -> str:
    b, k, epochs = cfg.batch_size, cfg.accumulate, cfg.max_epochs
    return f"""WITH RECURSIVE {_ROWS_SQL},
_od AS (SELECT e, y, xb, row_number() OVER (PARTITION BY e ORDER BY {sql_bits(cfg.seed, 'e', 'doc_id')}, doc_id) - 1 AS pos
        FROM _b, (SELECT unnest(range(1, {epochs + 1})) AS e) WHERE split = 'train'),
_bt AS (SELECT e, y, xb, pos // {b} AS batch, pos // {b * k} AS step, 1.0 / count(*) OVER (PARTITION BY e, pos // {b}) AS wt FROM _od),
_nb AS (SELECT max(batch) + 1 AS nb, max(step) + 1 AS s FROM _bt),
_gs AS MATERIALIZED (SELECT y, xb, wt, (e - 1) * s + step AS t, least({k}, nb - step * {k}) AS taken, {_sql_factor('((e - 1) * s + step)', f'(s * {epochs})', cfg.warmup_share)} AS f FROM _bt, _nb),
_run AS (SELECT 0::BIGINT AS t, {_ZEROS} AS w, 0.0::DOUBLE AS loss, 0.0::DOUBLE AS rate
  UNION ALL
  SELECT t + 1, list_transform(list_zip(w, h), lambda z: z[1] - rate * least(1.0, {cfg.clip} / (sqrt({_SQUARES.format(v='h')}) + 1e-6)) * z[2]), loss, rate FROM (
    SELECT t, w, loss, rate, list_transform(list_zip(w, g), lambda z, i: z[2] + CASE WHEN i = 1 THEN 0.0 ELSE {cfg.l2} * z[1] END) AS h FROM (
      SELECT t, w, list(g ORDER BY j) FILTER (WHERE j > 0) AS g, max(g * taken) FILTER (WHERE j = 0) AS loss, {cfg.lr} * f AS rate FROM (
        SELECT t, w, f, taken, j, sum(v) / taken AS g FROM (
          SELECT t, w, f, taken, unnest(range({DIM + 2})) AS j, unnest(list_concat([wt * {_BCE}], list_transform(xb, lambda v: wt * (p - y) * v))) AS v FROM (
            SELECT r.t, r.w, g.y, g.xb, g.wt, g.taken, g.f, {_DOT} AS p FROM _run r JOIN _gs g ON r.t = g.t))
        GROUP BY t, w, f, taken, j) GROUP BY t, w, f))),
_val AS (SELECT r.t // s AS epoch, y, {_DOT} AS p FROM _run r, _b, _nb WHERE split = 'val' AND r.t > 0 AND r.t % s = 0),
_m AS ({_sql_metrics('_val', 'epoch')}),
_l AS (SELECT (t - 1) // s + 1 AS epoch, sum(loss) / max(nb) AS train_loss, arg_max(rate, t) AS lr, arg_max(w, t) AS w FROM _run, _nb WHERE t > 0 GROUP BY 1)
SELECT '{cfg.run_id}' AS run_id, epoch::BIGINT AS epoch, round(train_loss, 6) AS train_loss, round(val_loss, 6) AS val_loss, round(val_f1, 6) AS val_f1, round(val_accuracy, 6) AS val_accuracy,
       round(lr, 9) AS lr, round(0.5 * {cfg.l2} * {_SQUARES.format(v='w[2:]')}, 6) AS l2_penalty FROM _l JOIN _m USING (epoch)"""


@register("train_minibatches", _minibatch_sql(BATCHES))
def q_train_minibatches(spark, sf_dir):
    """T1 as a loader runs it: a new order each epoch, two batches of 32 to a step."""
    res = T.train_minibatches(headline_features(spark, sf_dir), "doc_id", DIM, BATCHES)
    return _t1_log_out(T.log_frame(spark, res))


# --- T10: a sweep that trains ------------------------------------------------------

SWEEP = [
    T.TrainConfig(max_epochs=6, lr=lr, patience=2, l2=l2, clip=1.0, warmup_share=0.2, run_id=f"lr={lr} l2={l2}")
    for lr in (0.1, 0.5, 2.0, 8.0, 32.0)
    for l2 in (0.0, 0.1)
]


def _sweep_sql(runs: list[T.TrainConfig]) -> str:
    cfg = runs[0]
    rates = T.lr_factors(cfg.max_epochs, cfg.warmup_share)
    values = ", ".join(f"('{c.run_id}', {c.lr}::DOUBLE, {c.l2}::DOUBLE)" for c in runs)
    return f"""WITH RECURSIVE {_ROWS_SQL}, _bm AS MATERIALIZED (SELECT * FROM _b),
_runs AS (SELECT * FROM (VALUES {values}) v(run_id, base, l2)),
_st AS (SELECT run_id, base, l2, 0::BIGINT AS e, {_ZEROS} AS w, 0.0::DOUBLE AS train_loss FROM _runs
  UNION ALL
  SELECT run_id, base, l2, e + 1, list_transform(list_zip(w, h), lambda z: z[1] - base * {rates}[e + 1] * least(1.0, {cfg.clip} / (sqrt({_SQUARES.format(v='h')}) + 1e-6)) * z[2]), loss FROM (
    SELECT run_id, base, l2, e, w, loss, list_transform(list_zip(w, g), lambda z, i: z[2] + CASE WHEN i = 1 THEN 0.0 ELSE l2 * z[1] END) AS h FROM (
      SELECT run_id, base, l2, e, w, list(g ORDER BY j) FILTER (WHERE j > 0) AS g, max(g) FILTER (WHERE j = 0) AS loss FROM (
        SELECT run_id, base, l2, e, w, j, avg(v) AS g FROM (
          SELECT run_id, base, l2, e, w, unnest(range({DIM + 2})) AS j, unnest(list_concat([{_BCE}], list_transform(xb, lambda v: (p - y) * v))) AS v FROM (
            SELECT s.run_id, s.base, s.l2, s.e, s.w, y, xb, {_DOT} AS p FROM _st s, _bm WHERE split = 'train' AND s.e < {cfg.max_epochs}))
        GROUP BY run_id, base, l2, e, w, j) GROUP BY run_id, base, l2, e, w))),
_val AS (SELECT run_id, e, y, {_DOT} AS p FROM _st, _bm WHERE split = 'val' AND e > 0),
_m AS ({_sql_metrics('_val', 'run_id, e')}),
_log AS (SELECT s.*, val_loss, val_f1, val_accuracy, min(val_loss) OVER (PARTITION BY run_id ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM _st s JOIN _m USING (run_id, e)),
_imp AS (SELECT *, max(CASE WHEN before IS NULL OR val_loss < before THEN e END) OVER (PARTITION BY run_id ORDER BY e) AS last FROM _log),
_end AS (SELECT *, min(CASE WHEN e - last >= {cfg.patience} THEN e END) OVER (PARTITION BY run_id) AS stop FROM _imp)
SELECT run_id, e AS epoch, round(train_loss, 6) AS train_loss, round(val_loss, 6) AS val_loss, round(val_f1, 6) AS val_f1, round(val_accuracy, 6) AS val_accuracy,
       round(base * {rates}[e], 9) AS lr, round(0.5 * l2 * {_SQUARES.format(v='w[2:]')}, 6) AS l2_penalty FROM _end WHERE e <= coalesce(stop, e)"""


@register("run_sweep", _sweep_sql(SWEEP))
def q_run_sweep(spark, sf_dir):
    """Ten configurations trained side by side, one scan per epoch for all; the log of every run."""
    log = [row for res in T.train_sweep(headline_features(spark, sf_dir), DIM, SWEEP) for row in res.log]
    return _t1_log_out(T.log_frame(spark, T.TrainResult(log=log)))


# --- T2: the hidden layer ----------------------------------------------------------

HIDDEN = 16
NETWORK = T.TrainConfig(max_epochs=2, lr=2.0, patience=5, l2=0.01, clip=1.0, warmup_share=0.0, run_id="network")


def _network_chain(cfg: T.TrainConfig, h: int, d: int) -> str:
    """CTEs ``_net_n{e}`` (all rows with p at the parameters after e epochs) and ``_net_q{e}`` (parameters)."""
    start = ", ".join(repr(float(v)) for v in T.start_weights(d, h))
    rates = [cfg.lr * f for f in T.lr_factors(cfg.max_epochs, cfg.warmup_share)]
    w1, b1, w2, b2 = (1, d * h), (d * h + 1, d * h + h), (d * h + h + 1, d * h + 2 * h), (d * h + 2 * h + 1, d * h + 2 * h + 1)
    parts = [FEAT_SQL, "_fm AS MATERIALIZED (SELECT * FROM feat)", f"_net_q0 AS MATERIALIZED (SELECT [{start}]::DOUBLE[] AS q)"]
    for e in range(cfg.max_epochs + 1):
        parts.append(f"""
_net_c{e} AS MATERIALIZED (SELECT list_transform(range({h}), lambda k: list_transform(range({d}), lambda j: q[j * {h} + k + 1])) AS cols, q[{b1[0]}:{b1[1]}] AS b1, q[{w2[0]}:{w2[1]}] AS w2, q[{b2[0]}] AS b2 FROM _net_q{e}),
_net_u{e} AS (SELECT doc_id, split, y, x, w2, b2, list_transform(range({h}), lambda k: list_dot_product(x, cols[k + 1]) + b1[k + 1]) AS u FROM _fm, _net_c{e}),
_net_n{e} AS MATERIALIZED (SELECT doc_id, split, y, x, w2, u, {_P.format(z="(list_dot_product(list_transform(u, lambda v: greatest(v, 0.0)), w2) + b2)")} AS p FROM _net_u{e})""")
        if e == cfg.max_epochs:
            break
        norms = ", ".join(f"sqrt({_SQUARES.format(v=f'h[{a}:{z}]')}) AS n{i}" for i, (a, z) in enumerate((w1, b1, w2, b2)))
        which = f"CASE WHEN i <= {w1[1]} THEN n0 WHEN i <= {b1[1]} THEN n1 WHEN i <= {w2[1]} THEN n2 ELSE n3 END"
        parts.append(f"""
_net_r{e} AS (SELECT (p - y) AS s, x, u, list_transform(range({h}), lambda k: CASE WHEN u[k + 1] > 0 THEN (p - y) * w2[k + 1] ELSE 0.0 END) AS back FROM _net_n{e} WHERE split = 'train'),
_net_g{e} AS (SELECT list(g ORDER BY i) AS g FROM (SELECT i, avg(v) AS g FROM (
  SELECT unnest(range(1, {b2[0] + 1})) AS i,
         unnest(list_concat(list_concat(flatten(list_transform(x, lambda xj: list_transform(back, lambda bk: xj * bk))), back), list_concat(list_transform(u, lambda v: s * greatest(v, 0.0)), [s]))) AS v FROM _net_r{e}) GROUP BY i)),
_net_h{e} AS (SELECT q, list_transform(list_zip(q, g), lambda z, i: z[2] + CASE WHEN i <= {w1[1]} OR (i >= {w2[0]} AND i <= {w2[1]}) THEN {cfg.l2} * z[1] ELSE 0.0 END) AS h FROM _net_q{e}, _net_g{e}),
_net_k{e} AS (SELECT q, h, {norms} FROM _net_h{e}),
_net_q{e + 1} AS MATERIALIZED (SELECT list_transform(list_zip(q, h), lambda z, i: z[1] - {rates[e]} * least(1.0, {cfg.clip} / ({which} + 1e-6)) * z[2]) AS q FROM _net_k{e})""")
    return ",".join(parts)


def _network_sql(cfg: T.TrainConfig, h: int, d: int) -> str:
    rates = [cfg.lr * f for f in T.lr_factors(cfg.max_epochs, cfg.warmup_share)]
    w1, w2 = f"q[1:{d * h}]", f"q[{d * h + h + 1}:{d * h + 2 * h}]"
    rows = [
        f"""SELECT '{cfg.run_id}' AS run_id, {e}::BIGINT AS epoch, round(train_loss, 6) AS train_loss, round(val_loss, 6) AS val_loss, round(val_f1, 6) AS val_f1, round(val_accuracy, 6) AS val_accuracy,
       round({rates[e - 1]}::DOUBLE, 9) AS lr, round(0.5 * {cfg.l2} * ({_SQUARES.format(v=w1)} + {_SQUARES.format(v=w2)}), 6) AS l2_penalty
  FROM (SELECT avg({_BCE}) AS train_loss FROM _net_n{e - 1} WHERE split = 'train'), ({_sql_metrics(f"(SELECT y, p, split FROM _net_n{e} WHERE split = 'val')", 'split')}), _net_q{e}"""
        for e in range(1, cfg.max_epochs + 1)
    ]
    return f"WITH {_network_chain(cfg, h, d)}\n" + "\nUNION ALL\n".join(rows)


@register("fit_hidden_layer", _network_sql(NETWORK, HIDDEN, DIM))
def q_fit_hidden_layer(spark, sf_dir):
    """T2 with the hidden layer of 16 units: the epoch log from fixed start weights."""
    res = T.train_network(headline_features(spark, sf_dir), DIM, HIDDEN, NETWORK)
    return _t1_log_out(T.log_frame(spark, T.TrainResult(log=res.log)))


_REPORT_SQL = f"""
_t AS (SELECT sum(recall * support) / sum(support)::DOUBLE AS acc, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
              sum(precision * support) / sum(support)::DOUBLE AS wp, sum(recall * support) / sum(support)::DOUBLE AS wr,
              sum(f1 * support) / sum(support)::DOUBLE AS wf, sum(support) AS n FROM _pcm),
_rep AS (
  SELECT CAST(label AS VARCHAR) AS "row", precision, recall, f1, support FROM _pcm
  UNION ALL SELECT 'accuracy', NULL, NULL, acc, n FROM _t
  UNION ALL SELECT 'macro avg', mp, mr, mf, n FROM _t
  UNION ALL SELECT 'weighted avg', wp, wr, wf, n FROM _t)"""
_REPORT_COLS = '"row", round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, CAST(support AS BIGINT) AS support'


@register(
    "hidden_layer_report",
    f"""WITH {_network_chain(NETWORK, HIDDEN, DIM)},
_vp AS (SELECT CAST(y AS INTEGER) AS y, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS pred FROM _net_n{NETWORK.max_epochs} WHERE split = 'val'),
{sql_per_class('SELECT y, pred FROM _vp')}, {_REPORT_SQL}
SELECT {_REPORT_COLS} FROM _rep""",
)
def q_hidden_layer_report(spark, sf_dir):
    """Report on the validation rows at the last epoch's parameters."""
    feats = headline_features(spark, sf_dir)
    res = T.train_network(feats, DIM, HIDDEN, NETWORK)
    scored = T.network_score(feats.filter(F.col("split") == "val"), DIM, HIDDEN, res.params[-1])
    rep = M.classification_report(scored.select(F.col("y").cast("int").alias("y"), "pred"))
    return rep.select("row", "precision", "recall", "f1", "support")


_STEPS = 1500  # gradient steps of the SQL below; they end within 1e-6 of the optimum


@register(
    "classifier_report",
    f"""WITH RECURSIVE {_ROWS_SQL}, _tr AS MATERIALIZED (SELECT y, xb FROM _b WHERE split = 'train'),
_opt AS (SELECT 0 AS t, {_ZEROS} AS w
  UNION ALL
  SELECT t + 1, list_transform(list_zip(w, g), lambda z, i: z[1] - 1.5 * (z[2] + CASE WHEN i = 1 THEN 0.0 ELSE {REG} * z[1] END)) FROM (
    SELECT t, w, list(g ORDER BY j) AS g FROM (
      SELECT t, w, j, avg(v) AS g FROM (
        SELECT t, w, unnest(range({DIM + 1})) AS j, unnest(list_transform(xb, lambda v: (p - y) * v)) AS v FROM (
          SELECT t, w, y, xb, {_DOT} AS p FROM _opt, _tr WHERE t < {_STEPS})) GROUP BY t, w, j) GROUP BY t, w)),
_vp AS (SELECT CAST(y AS INTEGER) AS y, CASE WHEN {_DOT} > 0.5 THEN 1 ELSE 0 END AS pred FROM _b, _opt WHERE split = 'val' AND t = {_STEPS}),
{sql_per_class('SELECT y, pred FROM _vp')}, {_REPORT_SQL}
SELECT {_REPORT_COLS} FROM _rep""",
)
def q_classifier_report(spark, sf_dir):
    """Spark ML's logistic regression at its optimum, reported on the validation rows."""
    feats = headline_features(spark, sf_dir)
    model = T.fit_classifier(feats.filter(F.col("split") == "train"), DIM, "x", "y", reg=REG, max_iter=500)
    pred = model.transform(feats.filter(F.col("split") == "val"))
    rep = M.classification_report(pred.select(F.col("y").cast("int").alias("y"), F.col("prediction").cast("int").alias("pred")))
    return rep.select("row", "precision", "recall", "f1", "support")


# --- K3: resuming, saved pipelines ---------------------------------------------------


@register("resume_training", _T1_SQL)
def q_resume_training(spark, sf_dir):
    """K3: a run cut off after its fourth epoch, taken up again from its checkpoint, has the log of an unbroken one."""
    from ledeframe.sources.sinks import Checkpoints

    feats = headline_features(spark, sf_dir)
    path = scratch_path(spark, "checkpoints")

    class Cut(Exception):
        pass

    def power_cut(epoch, w, b, metrics):
        if epoch == 4:
            raise Cut

    try:
        T.train_epochs(feats, DIM, T1_CHECK, on_epoch_end=power_cut, checkpoints=Checkpoints(spark, path))
    except Cut:
        pass
    res = T.train_epochs(feats, DIM, T1_CHECK, checkpoints=Checkpoints(spark, path))
    return _t1_log_out(T.log_frame(spark, res))


@register(
    "pipeline_sink",
    f"""WITH {FEAT_SQL} SELECT 'mlp' AS run_id, CAST(y AS BIGINT) AS y, count(*) AS support, 0::BIGINT AS mismatches FROM feat WHERE split = 'val' GROUP BY y""",
)
def q_pipeline_sink(spark, sf_dir):
    """K3: a fitted pipeline with a hidden layer, saved with its manifest row, loaded from the path in it and scored again."""
    from pyspark.ml import PipelineModel

    from ledeframe.sources.sinks import model_sink

    feats = headline_features(spark, sf_dir)
    model = T.fit_classifier(feats.filter(F.col("split") == "train"), DIM, kind="mlp", hidden=HIDDEN, max_iter=10)
    row = model_sink(model, scratch_path(spark, "pipeline"), spark, {"run_id": "mlp"}).first()
    again = PipelineModel.load(row["path"])
    val = feats.filter(F.col("split") == "val")
    both = model.transform(val).select("doc_id", "y", F.col("prediction").alias("p0")).join(again.transform(val).select("doc_id", F.col("prediction").alias("p1")), "doc_id")
    return both.groupBy(i64("y").alias("y")).agg(F.count(F.lit(1)).alias("support"), F.count_if(F.col("p0") != F.col("p1")).alias("mismatches")).select(
        F.lit(row["run_id"]).alias("run_id"), "y", "support", "mismatches"
    )


# --- T8: a model in a file ------------------------------------------------------------


def _load_weights(path: str):
    import json

    import numpy as np

    with open(path) as file:
        found = json.load(file)
    return np.array(found["w"]), found["b"]


def _predict(model, x):
    import numpy as np

    return 1.0 / (1.0 + np.exp(-(x @ model[0] + model[1])))


@register("foreign_model_score", ORACLE["batch_score"])
def q_foreign_model_score(spark, sf_dir):
    """The weights of T1 as a file that Spark knows nothing about, loaded by the Python workers."""
    feats = headline_features(spark, sf_dir)
    w, b = T.train_epochs(feats, DIM, T1_CHECK).weights[-1]
    path = scratch_path(spark, "weights")
    spark.createDataFrame([(w, b)], "w array<double>, b double").select(F.to_json(F.struct("w", "b")).alias("value")).coalesce(1).write.text(path)
    file = spark.read.text(path).inputFiles()[0]
    scored = T.score_model_file(feats, file, _load_weights, _predict)
    return scored.select("doc_id", r6("p").alias("p"), i64(F.col("p") > 0.5).alias("pred"))


# --- T7: co-occurrence ------------------------------------------------------------------

_WINDOW, _LEAST = 2, 5


def _tokens(spark, sf_dir):
    from ledeframe.functions.text import split_words

    return X.texts(spark, sf_dir).select(split_words(F.lower("text")).alias("tokens"))


@register(
    "cooccurrences",
    f"""WITH _t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') AS ws FROM documents),
_p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM _t),
_w AS (SELECT ws[i] AS word FROM _p GROUP BY 1 HAVING count(*) >= {_LEAST}),
_a AS (SELECT ws[i] AS word, ws[i + d] AS context, count(*) AS n FROM _p, (SELECT unnest(range(1, {_WINDOW + 1})) AS d) WHERE i + d <= len(ws) GROUP BY 1, 2),
_b AS (SELECT * FROM _a WHERE word IN (SELECT word FROM _w) AND context IN (SELECT word FROM _w)),
_c AS (SELECT word, context, sum(n) AS n FROM (SELECT * FROM _b UNION ALL SELECT context, word, n FROM _b) GROUP BY 1, 2),
_s AS (SELECT word, sum(n) AS s FROM _c GROUP BY word)
SELECT _c.word, _c.context, _c.n::BIGINT AS n, round(greatest(ln(_c.n::DOUBLE * (SELECT sum(s) FROM _s)::DOUBLE / (a.s::DOUBLE * b.s::DOUBLE)), 0.0), 6) AS ppmi
FROM _c JOIN _s a ON a.word = _c.word JOIN _s b ON b.word = _c.context""",
)
def q_cooccurrences(spark, sf_dir):
    """Counts of frequent words at most two places apart, with their positive PMI."""
    counts = C.cooccurrences(_tokens(spark, sf_dir), "tokens", _WINDOW, _LEAST)
    return C.positive_pmi(counts, keep=True).select("word", "context", i64("n").alias("n"), r6("value").alias("ppmi"))


@register(
    "cooccurrence_vectors",
    f"""SELECT word, 16::BIGINT AS dim FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS word FROM documents)
    GROUP BY word HAVING count(*) >= {_LEAST}""",
)
def q_cooccurrence_vectors(spark, sf_dir):
    """A vector for every frequent word; the numbers themselves are tested against a dense factorisation."""
    vecs = C.cooccurrence_vectors(_tokens(spark, sf_dir), "tokens", 16, _WINDOW, _LEAST)
    return vecs.select("word", i64(F.size("vec")).alias("dim"))
