"""Queries over labelled samples: functions, scaling, scoring, gradients, training."""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallygrad.functions import activations as act
from tallygrad.functions.metrics import error, relative_error, squared_error
from tallygrad.functions.random import lehmer, row_key
from tallygrad.functions.surfaces import SURFACES, rastrigin, rosenbrock, sphere, xor
from tallygrad.functions.vectors import masked, matvec, to_long, to_wide, vector, with_bias, without_first
from tallygrad.network import NetworkConfig, initial_weights, weights_from_table, weights_table
from tallygrad.operators.forward import hidden_means, layer_outputs, loss, score
from tallygrad.operators.gradcheck import gradient_check, gradient_check_summary, row_gradients
from tallygrad.operators.gradient import gradient_table, partial_sums, run_pass, update_table
from tallygrad.operators.logs import best_iteration, plateau_runs, step_times
from tallygrad.operators.samples import assemble, dropout_mask, mark_validation, mask_features, split_vector
from tallygrad.operators.scaling import column_stats, label_stats, sample_stats, scale, scale_columns, vector_stats
from tallygrad.plans.training import LOG_SCHEMA, Model, train
from tallygrad.session import shared_path
from tallygrad.sources.results import (
    append_log,
    append_predictions,
    load_weights,
    prediction_report,
    read_runs,
    save_weights,
)
from tallygrad.sources.synthetic import random_samples

from .fixtures import EMBEDDED, EMBEDDED_LONG, LINES, embedded, formula_weights, lines, table
from .network_sql import (
    deltas,
    differences_sql,
    forward,
    gradient_columns,
    gradient_sql,
    lehmer_sql,
    log_sql,
    loss_sql,
    mask_columns,

    training_ctes,
    unpivot,
    update_sql,
    weight_row,
)
from .registry import register, rounded

LINE_KEYS = ["l_orderkey", "l_linenumber"]
EPOCHS = 5
#: Rows that a task gets at most, or hardly more, when a query deals a table out anew. Beyond 200 tasks Spark's
#: shuffle writer sorts and spills the rows a second time, which smaller shares come to sooner.
ROWS_PER_TASK = 2_000_000

# Networks over line items (6 inputs) and embeddings (64 inputs).
SMALL = NetworkConfig(size=(6, 5, 1), learning_rate=0.5, momentum=0.0)
HEAVY = NetworkConfig(size=(6, 5, 1), learning_rate=0.5, momentum=0.5, rate_decay=0.9, l2=0.01)
DEEP = NetworkConfig(size=(6, 4, 3, 1), hidden="tanh_opt", output="linear", learning_rate=0.1, momentum=0.0)
WIDE = NetworkConfig(size=(64, 5, 1))
NARROW = NetworkConfig(size=(64, 2, 1))


def lines_with(sql: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([LINES, *ctes]) + "\n" + sql


def embedded_with(sql: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([EMBEDDED, *ctes]) + "\n" + sql


def long_with(sql: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([EMBEDDED_LONG, *ctes]) + "\n" + sql


def dealt_anew(rows: DataFrame, least: int) -> DataFrame:
    """The same rows in partitions of their own, ``least`` or more: what one task reads does not grow with the table."""
    return rows.repartition(max(least, math.ceil(rows.count() / ROWS_PER_TASK)))


# --- samples ----------------------------------------------------------------------


@register(
    "src5_assemble_samples",
    "SELECT l_orderkey, l_linenumber, l_discount AS label, l_quantity AS x0, l_extendedprice AS x1, l_tax AS x2 FROM lineitem",
)
def assembled(spark, sf_dir):
    samples = assemble(
        table(spark, sf_dir, "lineitem"),
        F.col("l_discount"),
        ["l_quantity", "l_extendedprice", "l_tax"],
        keep=LINE_KEYS,
    )
    return samples.select(*LINE_KEYS, "label", *[F.get("features", F.lit(i)).alias(f"x{i}") for i in range(3)])


@register(
    "src6_synthetic_samples",
    "SELECT o_orderkey, s AS surface, true AS in_range, true AS label_fits FROM orders, "
    "(VALUES ('rosenbrock'), ('rastrigin'), ('sphere'), ('xor')) t(s)",
)
def synthetic(spark, sf_dir):
    """A random sample per order and surface; values are seeded draws, so SQL checks their properties."""
    keys = table(spark, sf_dir, "orders").select("o_orderkey")
    parts = []
    for name, surface in SURFACES.items():
        drawn = random_samples(keys, F.col("o_orderkey"), 4, -10.0, 10.0, name, seed=7)
        if name == "xor":
            inside = F.forall("features", lambda v: (v == 0) | (v == 1))
        else:
            inside = F.forall("features", lambda v: (v >= -10) & (v < 10))
        fits = F.abs(F.col("label") - surface(F.col("features"))) <= 1e-9 * (1 + F.abs(F.col("label")))
        parts.append(
            drawn.select("o_orderkey", F.lit(name).alias("surface"), inside.alias("in_range"), fits.alias("label_fits"))
        )
    return reduce(DataFrame.unionByName, parts)


@register(
    "prj1_split_vector",
    long_with(
        "SELECT l.vec_id, f.value AS label, l.pos - 1 AS pos, l.value FROM long l JOIN long f "
        "ON l.vec_id = f.vec_id AND f.pos = 0 WHERE l.pos > 0"
    ),
)
def split(spark, sf_dir):
    samples = split_vector(embedded(spark, sf_dir).drop("label"), "features", keep=["vec_id"])
    return to_long(samples, ["vec_id", "label"], "features")


@register("prj2_strip_bias", long_with("SELECT vec_id, pos, value FROM long"))
def stripped(spark, sf_dir):
    biased = embedded(spark, sf_dir).withColumn("features", with_bias(F.col("features")))
    return to_long(biased.withColumn("features", without_first(F.col("features"))), ["vec_id"], "features")


@register(
    "prj3_label_prediction",
    lines_with(
        "SELECT l_orderkey, l_linenumber, y AS label, round(o, 6) AS prediction FROM ("
        + forward("lines", "w0", SMALL, "l_orderkey, l_linenumber, y") + ")",
        weight_row("w0", SMALL),
    ),
)
def pairs(spark, sf_dir):
    scored = score(lines(spark, sf_dir), formula_weights(SMALL), SMALL)
    return scored.select(*LINE_KEYS, "label", rounded("predict_label").alias("prediction"))


@register(
    "set2_train_valid_split",
    "SELECT count(*) AS n, true AS share_fits, true AS repeatable, true AS seed_matters FROM lineitem",
)
def validation_split(spark, sf_dir):
    """A fifth of the lines is held out, the same ones under any partitioning."""
    rows = table(spark, sf_dir, "lineitem")
    first = mark_validation(rows, 0.2, seed=3).select(row_key(rows).alias("k"), "is_valid")
    again = mark_validation(dealt_anew(rows, 5), 0.2, seed=3)
    other = mark_validation(rows, 0.2, seed=4)
    mark = F.sum(F.when(F.col("is_valid"), F.lit(1)).otherwise(F.lit(0)))
    # Sums of keys of held-out rows tell equal choices from different ones.
    trace = F.sum(F.when(F.col("is_valid"), F.pmod("k", F.lit(1000003))).otherwise(F.lit(0)))

    def traced(df):
        return df.select(row_key(rows).alias("k"), "is_valid").agg(trace.alias("t")).scalar()

    return first.agg(F.count(F.lit(1)).alias("n"), mark.alias("held"), trace.alias("t")).select(
        "n",
        (F.abs(F.col("held") / F.col("n") - 0.2) < 0.02).alias("share_fits"),
        (F.col("t") == traced(again)).alias("repeatable"),
        (F.col("t") != traced(other)).alias("seed_matters"),
    )


#: Draws of the integer generator over (line number, copy), spelled out.
COPY_DRAWS = """
SELECT l_linenumber AS k, count(*) AS n, CAST(sum(CASE WHEN u < 0.2 THEN 1 ELSE 0 END) AS BIGINT) AS held FROM (
  SELECT l_linenumber, ((((((((l_linenumber * 48271 + copy + 1) % 2147483647) * 48271 + 1) % 2147483647) * 48271 + 4)
                          % 2147483647) * 48271 + 2) % 2147483647) / 2147483647.0::DOUBLE AS u
  FROM (SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, row_number() OVER (PARTITION BY l_linenumber) - 1 AS copy
        FROM lineitem)) GROUP BY l_linenumber
"""


@register("set2_split_of_copies", COPY_DRAWS)
def split_copies(spark, sf_dir):
    """Rows that are copies of each other are drawn apart; line numbers alone are a table of few distinct rows."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("long").alias("k"))
    marked = mark_validation(dealt_anew(rows, 6), 0.2, seed=3, key=["k"], split_copies=True, draw=lehmer)
    return marked.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_valid").alias("held"))


# --- scalar and array functions ---------------------------------------------------


@register(
    "sc1_to_sc5_activations",
    "SELECT l_orderkey, l_linenumber, l_quantity, round(1 / (1 + exp(-x)), 6) AS sigm, "
    "round(1.7159::DOUBLE * tanh(x * 2 / 3), 6) + 0 AS tanh_opt, "
    "round(1 / (1 + exp(-x)) * (1 - 1 / (1 + exp(-x))), 6) AS sigm_slope, "
    "round(1.7159::DOUBLE * 2 / 3 * (1 - tanh(x * 2 / 3) * tanh(x * 2 / 3)), 6) + 0 AS tanh_opt_slope, "
    "x AS linear, 1.0::DOUBLE AS linear_slope "
    "FROM (SELECT *, (l_quantity - 25) / 10 AS x FROM lineitem)",
)
def activation_functions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("x", (F.col("l_quantity") - 25) / 10)
    x = F.col("x")
    return rows.select(
        *LINE_KEYS,
        "l_quantity",
        rounded(act.sigm(x)).alias("sigm"),
        rounded(act.tanh_opt(x)).alias("tanh_opt"),
        rounded(act.sigm_slope(act.sigm(x))).alias("sigm_slope"),
        rounded(act.tanh_opt_slope(act.tanh_opt(x))).alias("tanh_opt_slope"),
        act.linear(x).alias("linear"),
        act.linear_slope(act.linear(x)).alias("linear_slope"),
    )


@register(
    "sc6_with_bias",
    long_with(
        "SELECT vec_id, pos + 1 AS pos, value FROM long "
        "UNION ALL SELECT vec_id, 0 AS pos, 1.0::DOUBLE AS value FROM embeddings"
    ),
)
def biased(spark, sf_dir):
    return to_long(
        embedded(spark, sf_dir).withColumn("features", with_bias(F.col("features"))), ["vec_id"], "features"
    )


@register(
    "sc7_matrix_times_vector",
    long_with(
        "SELECT vec_id, CAST(r AS INTEGER) AS unit, round(sum(cos(r + 2 * pos) * value), 6) + 0 AS value FROM long, range(5) t(r) "
        "GROUP BY vec_id, r"
    ),
)
def matrix_vector(spark, sf_dir):
    rows = F.array(*[F.array(*[F.lit(math.cos(r + 2 * c)) for c in range(64)]) for r in range(5)])
    product = embedded(spark, sf_dir).select("vec_id", matvec(rows, F.col("features")).alias("z"))
    return to_long(product, ["vec_id"], "z", pos="unit").withColumn("value", rounded("value"))


@register(
    "sc8_outer_products",
    embedded_with(
        " UNION ALL ".join(
            f"SELECT vec_id, {l} AS layer, {r} AS r, {c} AS c, round({e}, 6) + 0 AS g FROM d"
            for (l, r, c), e in gradient_columns(NARROW).items()
        ),
        weight_row("w0", NARROW),
        f"d AS MATERIALIZED ({deltas('embedded', 'w0', NARROW, 'vec_id, y')})",
    ),
)
def outer_products(spark, sf_dir):
    grads = row_gradients(embedded(spark, sf_dir), formula_weights(NARROW), NARROW, ["vec_id"])
    return grads.select("vec_id", "layer", "r", "c", rounded("g").alias("g"))


@register(
    "sc9_masked_vector",
    long_with("SELECT vec_id, pos, CASE WHEN value > 0 THEN value ELSE 0 END AS value FROM long"),
)
def masked_vectors(spark, sf_dir):
    mask = F.transform("features", lambda v: F.when(v > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    rows = embedded(spark, sf_dir).select("vec_id", masked(F.col("features"), mask).alias("features"))
    return to_long(rows, ["vec_id"], "features").withColumn("value", F.col("value") + F.lit(0.0))


@register(
    "sc10_to_sc12_surfaces",
    long_with(
        "SELECT a.vec_id, round(sum(CASE WHEN b.value IS NOT NULL THEN 100 * (b.value - a.value * a.value) * "
        "(b.value - a.value * a.value) + (a.value - 1) * (a.value - 1) ELSE 0 END), 6) AS rosenbrock, "
        "round(sum(a.value * a.value - 10 * cos(2 * pi() * a.value) + 10), 6) AS rastrigin, "
        "round(sum(a.value * a.value), 6) AS sphere "
        "FROM long a LEFT JOIN long b ON a.vec_id = b.vec_id AND b.pos = a.pos + 1 GROUP BY a.vec_id"
    ),
)
def surfaces(spark, sf_dir):
    x = F.col("features")
    return embedded(spark, sf_dir).select(
        "vec_id",
        rounded(rosenbrock(x)).alias("rosenbrock"),
        rounded(rastrigin(x)).alias("rastrigin"),
        rounded(sphere(x)).alias("sphere"),
    )


@register(
    "sc13_xor",
    "SELECT l_orderkey, l_linenumber, CASE WHEN (l_returnflag = 'R') = (l_linestatus = 'O') THEN 0.0::DOUBLE "
    "ELSE 1.0::DOUBLE END AS label FROM lineitem",
)
def exclusive_or(spark, sf_dir):
    def bit(test):
        return F.when(test, F.lit(1.0)).otherwise(F.lit(0.0))

    bits = vector(bit(F.col("l_returnflag") == "R"), bit(F.col("l_linestatus") == "O"), F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select(*LINE_KEYS, xor(bits).alias("label"))


@register(
    "sc16_relative_error",
    lines_with(
        "SELECT l_orderkey, l_linenumber, round(abs(y - o) / nullif(y, 0), 6) AS rel_error FROM ("
        + forward("lines", "w0", SMALL, "l_orderkey, l_linenumber, y") + ")",
        weight_row("w0", SMALL),
    ),
)
def relative_errors(spark, sf_dir):
    scored = score(lines(spark, sf_dir), formula_weights(SMALL), SMALL)
    return scored.select(*LINE_KEYS, rounded(relative_error(F.col("label"), F.col("predict_label"))).alias("rel_error"))


@register(
    "sc17_errors",
    lines_with(
        "SELECT l_orderkey, l_linenumber, round(y - o, 6) + 0 AS error, round((y - o) * (y - o), 6) AS squared FROM ("
        + forward("lines", "w0", SMALL, "l_orderkey, l_linenumber, y") + ")",
        weight_row("w0", SMALL),
    ),
)
def errors(spark, sf_dir):
    scored = score(lines(spark, sf_dir).drop("is_valid"), formula_weights(SMALL), SMALL, method="arrow")
    label, predicted = F.col("label"), F.col("predict_label")
    return scored.select(
        *LINE_KEYS, rounded(error(label, predicted)).alias("error"), rounded(squared_error(label, predicted)).alias("squared")
    )


@register(
    "sc19_long_and_wide",
    "SELECT vec_id, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS x{i}" for i in range(64)) + " FROM embeddings",
)
def reshaped(spark, sf_dir):
    wide = to_wide(to_long(embedded(spark, sf_dir), ["vec_id"], "features"), ["vec_id"], 64)
    return wide.select("vec_id", *[F.get("features", F.lit(i)).alias(f"x{i}") for i in range(64)])


@register(
    "sc19_wide_vectors",
    long_with(
        "SELECT vec_id, CAST(k * 64 + pos AS INTEGER) AS pos, round(value * (k + 1), 6) + 0 AS value "
        "FROM long CROSS JOIN (SELECT unnest(range(3)) AS k) WHERE (k * 64 + pos) % 5 <> 0"
    ),
)
def wide_vectors(spark, sf_dir):
    """Vectors of three slices, every fifth element missing, through long rows and back."""
    def times(k):
        return F.transform("features", lambda v: v * k)

    tripled = embedded(spark, sf_dir).select("vec_id", F.concat(times(1), times(2), times(3)).alias("features"))
    long = to_long(tripled, ["vec_id"], "features").where("pos % 5 <> 0")
    back = to_long(to_wide(long, ["vec_id"], 192), ["vec_id"], "features")
    return back.where("value is not null").select("vec_id", "pos", rounded("value").alias("value"))


# --- statistics and scaling -------------------------------------------------------


@register(
    "agg2_agg3_feature_statistics",
    long_with("SELECT pos, round(avg(value), 6) + 0 AS mean, round(var_pop(value) / 2, 6) AS spread FROM long GROUP BY pos"),
)
def feature_statistics(spark, sf_dir):
    stats = vector_stats(embedded(spark, sf_dir))
    return stats.select("pos", rounded("mean").alias("mean"), rounded("spread").alias("spread"))


@register("agg4_label_range", "SELECT min(l_discount) AS label_min, max(l_discount) AS label_max FROM lineitem")
def label_range(spark, sf_dir):
    return label_stats(table(spark, sf_dir, "lineitem"), "l_discount")


@register("agg8_row_count", "SELECT count(*) AS n FROM lineitem")
def row_count(spark, sf_dir):
    """The count that a pass over the rows reports, without its gradient."""
    sums = partial_sums(lines(spark, sf_dir), formula_weights(SMALL), SMALL, gradient=False)
    rows = F.element_at("sums", SMALL.parameters + 1) + F.element_at("sums", SMALL.parameters + 3)
    return sums.agg(F.coalesce(F.sum(rows), F.lit(0.0)).cast("long").alias("n"))


SCALED = (
    "SELECT l_orderkey, l_linenumber, round((l_discount - a) / nullif(b - a, 0), 6) AS l_discount, "
    "round((l_quantity - mq) / nullif(vq, 0), 6) + 0 AS l_quantity, "
    "round((l_extendedprice - mp) / nullif(vp, 0) * 100000, 6) + 0 AS l_extendedprice FROM lineitem, ("
    "SELECT min(l_discount) AS a, max(l_discount) AS b, avg(l_quantity) AS mq, var_pop(l_quantity) / 2 AS vq, "
    "avg(l_extendedprice) AS mp, var_pop(l_extendedprice) / 2 AS vp FROM lineitem)"
)


@register("jn2_statistics_for_each_row", SCALED)
def scaled_columns(spark, sf_dir):
    features = ["l_quantity", "l_extendedprice"]
    rows = table(spark, sf_dir, "lineitem").select(*LINE_KEYS, "l_discount", *features)
    scaled = scale_columns(rows, column_stats(rows, features, "l_discount"), features, "l_discount")
    return scaled.select(
        *LINE_KEYS,
        rounded("l_discount").alias("l_discount"),
        rounded("l_quantity").alias("l_quantity"),
        rounded(F.col("l_extendedprice") * 100000).alias("l_extendedprice"),
    )


@register(
    "sc14_sc15_scaled_vectors",
    long_with(
        "SELECT l.vec_id, round((label / 10.0::DOUBLE - a) / nullif(b - a, 0), 6) AS label, l.pos, "
        "round((value - m) / nullif(s, 0), 6) + 0 AS value FROM long l "
        "JOIN (SELECT pos, avg(value) AS m, var_pop(value) / 2 AS s FROM long GROUP BY pos) p ON l.pos = p.pos, "
        "(SELECT min(label) / 10.0::DOUBLE AS a, max(label) / 10.0::DOUBLE AS b FROM embeddings)"
    ),
)
def scaled_vectors(spark, sf_dir):
    samples = embedded(spark, sf_dir)
    scaled = scale(samples, sample_stats(samples))
    return to_long(scaled.withColumn("label", rounded("label")), ["vec_id", "label"], "features").withColumn(
        "value", rounded("value")
    )


# --- scoring ----------------------------------------------------------------------


@register(
    "jn1_weights_for_each_row",
    embedded_with(
        "SELECT vec_id, round(o, 6) AS predict_label FROM (" + forward("embedded", "w0", WIDE, "vec_id") + ")",
        weight_row("w0", WIDE),
    ),
)
def scored_embeddings(spark, sf_dir):
    scored = score(embedded(spark, sf_dir).drop("label"), formula_weights(WIDE), WIDE)
    return scored.select("vec_id", rounded("predict_label").alias("predict_label"))


def unit_rows(config: NetworkConfig, key: str) -> str:
    parts = []
    for layer in range(config.layer):
        if layer < config.layer - 1:
            parts.append(f"SELECT {key}, {layer} AS layer, 0 AS unit, 1.0::DOUBLE AS value FROM f")
        for u in range(config.size[layer]):
            name = f"x{u + 1}" if layer == 0 else ("o" if layer == config.layer - 1 else f"a{layer}_{u}")
            unit = u if layer == config.layer - 1 else u + 1
            parts.append(f"SELECT {key}, {layer} AS layer, {unit} AS unit, round({name}, 6) + 0 AS value FROM f")
    return " UNION ALL ".join(parts)


@register(
    "ml4_snk6_layer_outputs",
    embedded_with(
        unit_rows(WIDE, "vec_id"),
        weight_row("w0", WIDE),
        f"f AS MATERIALIZED ({forward('embedded', 'w0', WIDE, 'vec_id')})",
    ),
)
def outputs(spark, sf_dir):
    rows = layer_outputs(embedded(spark, sf_dir), formula_weights(WIDE), WIDE, ["vec_id"])
    return rows.withColumn("value", rounded("value"))


@register(
    "ml4_forward_two_hidden_layers",
    lines_with(
        "SELECT l_orderkey, l_linenumber, round(o, 6) + 0 AS predict_label, round(y - o, 6) + 0 AS error FROM ("
        + forward("lines", "w0", DEEP, "l_orderkey, l_linenumber, y") + ")",
        weight_row("w0", DEEP),
    ),
)
def deep_scores(spark, sf_dir):
    scored = score(lines(spark, sf_dir), formula_weights(DEEP), DEEP)
    return scored.select(*LINE_KEYS, rounded("predict_label").alias("predict_label"), rounded("error").alias("error"))


@register(
    "agg7_ml7_loss",
    lines_with(
        "SELECT round(lt, 9) AS train_loss, round(lv, 9) AS valid_loss FROM l0",
        weight_row("w0", SMALL),
        loss_sql("lines", "w0", SMALL, "l0"),
    ),
)
def losses(spark, sf_dir):
    result = run_pass(lines(spark, sf_dir), formula_weights(SMALL), SMALL, gradient=False)
    return spark.createDataFrame(
        [(round(result.train_loss, 9), round(result.valid_loss, 9))], "train_loss double, valid_loss double"
    )


START = initial_weights(SMALL, 21)


@register(
    "ml2_loss_of_initial_weights",
    lines_with(
        "SELECT round(lt, 9) AS train_loss, round(lv, 9) AS valid_loss FROM l0",
        weight_row("w0", SMALL, START),
        loss_sql("lines", "w0", SMALL, "l0"),
    ),
)
def initial_losses(spark, sf_dir):
    """What a run starts from: the losses of small random weights, written into the SQL as numbers."""
    result = run_pass(lines(spark, sf_dir), START, SMALL, gradient=False)
    return spark.createDataFrame(
        [(round(result.train_loss, 9), round(result.valid_loss, 9))], "train_loss double, valid_loss double"
    )


@register(
    "ml12_predict_and_loss",
    embedded_with(
        "SELECT round(0.5 * avg((y - o) * (y - o)), 9) AS loss FROM (" + forward("embedded", "w0", WIDE, "y") + ")",
        weight_row("w0", WIDE),
    ),
)
def predict_and_loss(spark, sf_dir):
    predicted = Model(WIDE, formula_weights(WIDE)).predict(embedded(spark, sf_dir))
    return loss(predicted).select(rounded("loss", 9).alias("loss"))


@register(
    "agg9_hidden_means",
    embedded_with(
        " UNION ALL ".join(
            f"SELECT 1 AS layer, {u + 1} AS unit, round(avg(a1_{u}) * 0.01 + 0.99 * 0.01 * avg(a1_{u}), 9) AS mean FROM f"
            for u in range(5)
        ),
        weight_row("w0", WIDE),
        f"f AS MATERIALIZED ({forward('embedded', 'w0', WIDE, 'vec_id')})",
    ),
)
def sparsity(spark, sf_dir):
    samples, weights = embedded(spark, sf_dir), formula_weights(WIDE)
    means = hidden_means(samples, weights, WIDE, previous=hidden_means(samples, weights, WIDE))
    return means.select("layer", "unit", rounded("mean", 9).alias("mean"))


@register(
    "snk4_prediction_table",
    lines_with(
        "SELECT l_orderkey, l_linenumber, y AS label, round(o, 6) AS prediction, round(abs(y - o) / nullif(y, 0), 6) AS rel_error "
        "FROM (" + forward("lines", "w0", SMALL, "l_orderkey, l_linenumber, y") + ")",
        weight_row("w0", SMALL),
    ),
)
def prediction_table(spark, sf_dir):
    path = shared_path(spark, "predictions")
    scored = score(lines(spark, sf_dir), formula_weights(SMALL), SMALL)
    for _ in range(2):  # the second write takes the place of the first
        append_predictions(scored, path, LINE_KEYS, run="a")
    stored = spark.read.parquet(path).where("run = 'a'")
    return stored.select(
        *LINE_KEYS, "label", rounded("prediction").alias("prediction"), rounded("rel_error").alias("rel_error")
    )


# --- gradient and update ----------------------------------------------------------


def gradient_rows(config: NetworkConfig) -> str:
    return lines_with(
        unpivot("g0", config, {"g": "round(g_{p}, 9) + 0", "n": "n"}),
        weight_row("w0", config),
        gradient_sql("lines", "w0", config, "g0"),
    )


@register("agg6_ml5_average_gradient", gradient_rows(SMALL))
def average_gradient(spark, sf_dir):
    grads = gradient_table(lines(spark, sf_dir), formula_weights(SMALL), SMALL)
    return grads.select("layer", "r", "c", rounded("g", 9).alias("g"), "n")


@register("ml5_gradient_two_hidden_layers", gradient_rows(DEEP))
def deep_gradient(spark, sf_dir):
    grads = gradient_table(lines(spark, sf_dir), formula_weights(DEEP), DEEP)
    return grads.select("layer", "r", "c", rounded("g", 9).alias("g"), "n")


@register(
    "agg5_snk7_gradient_sums",
    lines_with(
        unpivot("g0", SMALL, {"g_sum": "round(g_{p}, 4) + 0", "n": "n"}),
        weight_row("w0", SMALL),
        gradient_sql("lines", "w0", SMALL, "g0", total="sum"),
    ),
)
def gradient_totals(spark, sf_dir):
    path = shared_path(spark, "gradients")
    gradient_table(lines(spark, sf_dir), formula_weights(SMALL), SMALL).write.parquet(path)
    return spark.read.parquet(path).select("layer", "r", "c", rounded("g_sum", 4).alias("g_sum"), "n")


STEPS = [
    weight_row("w0", HEAVY),
    gradient_sql("lines", "w0", HEAVY, "g0"),
    update_sql("w0", "g0", None, HEAVY, 0.5, "w1"),
    gradient_sql("lines", "w1", HEAVY, "g1"),
    update_sql("w1", "g1", "w1", HEAVY, 0.5, "w2"),
]


@register(
    "ml6_weight_update",
    lines_with(unpivot("w2", HEAVY, {"w": "round(w_{p}, 9) + 0", "v": "round(s_{p}, 9) + 0"}), *STEPS),
)
def weight_update(spark, sf_dir):
    """Two steps on tables, the second with the velocity of the first."""
    samples = lines(spark, sf_dir)
    start = formula_weights(HEAVY)
    first = update_table(weights_table(spark, start), gradient_table(samples, start, HEAVY), None, HEAVY, 0.5)
    path = shared_path(spark, "weights")
    first.write.parquet(path)
    first = spark.read.parquet(path)
    moved = weights_from_table(first, HEAVY)
    second = update_table(first, gradient_table(samples, moved, HEAVY), first, HEAVY, 0.5)
    return second.select("layer", "r", "c", rounded("w", 9).alias("w"), rounded("v", 9).alias("v"))


CHECK_PARTS = [
    weight_row("w0", SMALL),
    gradient_sql("valued", "w0", SMALL, "g0"),
    "valued AS (SELECT * REPLACE (false AS v) FROM lines)",
    differences_sql("valued", SMALL, "e0"),
]


@register(
    "ml13_snk8_gradient_check",
    lines_with(
        unpivot(
            "(SELECT * FROM e0, g0)",
            SMALL,
            {
                "n": "n",
                "estimate": "round(e_{p}, 6) + 0",
                "actual": "round(g_{p}, 6) + 0",
                "ratio": "round(e_{p} / nullif(g_{p}, 0), 3)",
                "close": "true",
            },
        ),
        CHECK_PARTS[2],
        CHECK_PARTS[0],
        CHECK_PARTS[1],
        CHECK_PARTS[3],
    ),
)
def checked_gradient(spark, sf_dir):
    summary = gradient_check_summary(lines(spark, sf_dir), formula_weights(SMALL), SMALL)
    return summary.select(
        "layer",
        "r",
        "c",
        "n",
        rounded("estimate").alias("estimate"),
        rounded("actual").alias("actual"),
        rounded("ratio", 3).alias("ratio"),
        (F.col("worst") < 1e-6).alias("close"),
    )


@register(
    "ml13_gradient_check_by_row",
    embedded_with(
        " UNION ALL ".join(
            f"SELECT vec_id, {l} AS layer, {r} AS r, {c} AS c, round({e}, 6) + 0 AS actual, true AS close FROM d"
            for (l, r, c), e in gradient_columns(NARROW).items()
        ),
        weight_row("w0", NARROW),
        f"d AS MATERIALIZED ({deltas('embedded', 'w0', NARROW, 'vec_id, y')})",
    ),
)
def checked_rows(spark, sf_dir):
    rows = gradient_check(embedded(spark, sf_dir), formula_weights(NARROW), NARROW, ["vec_id"])
    close = F.abs(F.col("estimate") - F.col("actual")) < 1e-6
    return rows.select("vec_id", "layer", "r", "c", rounded("actual").alias("actual"), close.alias("close"))


DROPPED = NetworkConfig(size=(64, 3, 2, 1), hidden="tanh_opt", output="linear", dropout=0.5)


@register(
    "ml13_gradient_check_dropout",
    " UNION ALL ".join(
        f"SELECT {given} AS given, {l} AS layer, {r} AS r, {c} AS c, count(*) AS n, true AS close FROM embeddings"
        for given in ("false", "true")
        for l, (rows, cols) in enumerate(DROPPED.shapes)
        for r in range(rows)
        for c in range(cols)
    ),
)
def checked_dropout(spark, sf_dir):
    """Numeric and analytic gradient of a network with dropout, scaled as it scores and under given masks."""
    plain = embedded(spark, sf_dir)
    mask = dropout_mask(F.col("vec_id"), DROPPED.hidden_units, DROPPED.dropout, epoch=1)
    weights = [w * 20 for w in formula_weights(DROPPED)]
    parts = []
    for given, rows in ((False, plain), (True, plain.withColumn("keep", mask))):
        summary = gradient_check_summary(rows, weights, DROPPED)
        close = (F.col("worst") < 1e-6).alias("close")
        parts.append(summary.select(F.lit(given).alias("given"), "layer", "r", "c", "n", close))
    return parts[0].unionByName(parts[1])


@register(
    "ml13_gradient_check_under_masks",
    embedded_with(
        unpivot("g0", DROPPED, {"n": "n", "actual": "round(g_{p}, 6) + 0", "close": "true"}),
        "given AS (SELECT *, false AS v, "
        + ", ".join(
            f"CASE WHEN {lehmer_sql('vec_id', 1, k, 1)} > {DROPPED.dropout}::DOUBLE THEN 1 ELSE 0 END AS {m}"
            for k, m in enumerate(mask_columns(DROPPED))
        )
        + " FROM embedded)",
        weight_row("w0", DROPPED, [w * 20 for w in formula_weights(DROPPED)]),
        gradient_sql("given", "w0", DROPPED, "g0", masks=True),
    ),
)
def checked_masks(spark, sf_dir):
    """Numeric and analytic gradient under dropout masks that SQL draws as well."""
    mask = dropout_mask(F.col("vec_id"), DROPPED.hidden_units, DROPPED.dropout, epoch=1, draw=lehmer)
    rows = embedded(spark, sf_dir).withColumn("keep", mask)
    summary = gradient_check_summary(rows, [w * 20 for w in formula_weights(DROPPED)], DROPPED)
    close = (F.col("worst") < 1e-6).alias("close")
    return summary.select("layer", "r", "c", "n", rounded("actual").alias("actual"), close)


@register(
    "ml12_scores_both_ways",
    lines_with(
        "SELECT l_orderkey, l_linenumber, round(o, 6) AS by_columns, round(o, 6) AS by_arrow FROM ("
        + forward("lines", "w0", SMALL, "l_orderkey, l_linenumber, y") + ")",
        weight_row("w0", SMALL),
    ),
)
def both_ways(spark, sf_dir):
    """Generated code and Arrow batches give the same columns and values."""
    rows, weights = lines(spark, sf_dir), formula_weights(SMALL)
    first = score(rows.withColumn("error", F.lit("stale")), weights, SMALL, "columns")
    both = score(first.withColumnRenamed("predict_label", "p").withColumnRenamed("error", "e"), weights, SMALL, "arrow")
    unlike = (F.abs(F.col("p") - F.col("predict_label")) > 1e-12) | (F.abs(F.col("e") - F.col("error")) > 1e-12)
    by_arrow = F.when(unlike, F.raise_error(F.lit("both ways give other scores"))).otherwise(rounded("predict_label"))
    return both.select(*LINE_KEYS, rounded("p").alias("by_columns"), by_arrow.cast("double").alias("by_arrow"))


# --- training ---------------------------------------------------------------------


def trained(spark: SparkSession, sf_dir: str, config: NetworkConfig, epochs: int = EPOCHS, **settings):
    return train(
        lines(spark, sf_dir), config, epochs, init_weights=formula_weights(config), key=LINE_KEYS, **settings
    )


def log_rows(run, spark) -> DataFrame:
    return run.log_table(spark).select(
        "iteration", rounded("train_loss", 9).alias("train_loss"), rounded("valid_loss", 9).alias("valid_loss")
    )


def rounded_log(inner: str) -> str:
    return f"SELECT iteration, round(train_loss, 9) AS train_loss, round(valid_loss, 9) AS valid_loss FROM ({inner})"


RUN = training_ctes("lines", HEAVY, EPOCHS)


@register("ml8_ml9_snk5_training_log", lines_with(rounded_log(log_sql(EPOCHS)), RUN))
def training_log(spark, sf_dir):
    """Full batch training with momentum, penalty and a falling rate; the log is stored and read back."""
    path = shared_path(spark, "log")
    append_log(trained(spark, sf_dir, HEAVY).log_table(spark), path)
    log = spark.read.parquet(path)
    return log.select(
        "iteration", rounded("train_loss", 9).alias("train_loss"), rounded("valid_loss", 9).alias("valid_loss")
    )


@register(
    "ml8_resumed_training",
    lines_with(rounded_log(log_sql(EPOCHS)), RUN),
)
def resumed_training(spark, sf_dir):
    """A run that is cut after two epochs and resumed gives the log of an unbroken one."""
    run_id = f"resumed-{uuid.uuid4().hex}"
    trained(spark, sf_dir, HEAVY, 2, run_id=run_id)
    return log_rows(trained(spark, sf_dir, HEAVY, run_id=run_id, resume=True), spark)


@register(
    "snk5_log_of_runs",
    lines_with(
        " UNION ALL ".join(
            f"SELECT '{run}' AS run, iteration, round(train_loss, 9) AS train_loss FROM ({log_sql(EPOCHS)}) WHERE iteration <= {n}"
            for run, n in (("a", EPOCHS), ("b", 2))
        ),
        RUN,
    ),
)
def log_of_runs(spark, sf_dir):
    """Logs of two runs in one table; writing one again replaces it and leaves the other."""
    path = shared_path(spark, "log")
    log = trained(spark, sf_dir, HEAVY).log_table(spark)
    for run, rows in (("a", log), ("b", log), ("a", log), ("b", log.where("iteration <= 2"))):
        append_log(rows, path, run)
    return read_runs(spark, path, LOG_SCHEMA).select("run", "iteration", rounded("train_loss", 9).alias("train_loss"))


@register(
    "snk7_trained_weights",
    lines_with(unpivot(f"w{EPOCHS}", HEAVY, {"w": "round(w_{p}, 9) + 0"}), RUN),
)
def trained_weights(spark, sf_dir):
    path = shared_path(spark, "weights")
    save_weights(spark, trained(spark, sf_dir, HEAVY).model.weights, path)
    stored = load_weights(spark, path, HEAVY)
    return weights_table(spark, stored).withColumn("w", rounded("w", 9))


@register(
    "ml8_train_deep_network",
    lines_with(rounded_log(log_sql(3)), training_ctes("lines", DEEP, 3)),
)
def deep_training(spark, sf_dir):
    return log_rows(trained(spark, sf_dir, DEEP, 3, storage="table"), spark)


RESTART = NetworkConfig(size=(6, 5, 1), learning_rate=0.5, momentum=0.5, rate_decay=0.9)


@register(
    "ml10_restart_on_plateau",
    lines_with(
        rounded_log(log_sql(6)),
        training_ctes("lines", RESTART, 6, {2: initial_weights(RESTART, 11), 4: initial_weights(RESTART, 12)}),
    ),
)
def restarts(spark, sf_dir):
    """Every step counts as flat, so new seeded weights come in after each second epoch."""
    run = trained(spark, sf_dir, RESTART, 6, seed=10, plateau_step=1e9, plateau_length=1)
    return log_rows(run, spark)


EARLY = 0.040755


@register(
    "ml11_early_stop",
    lines_with(
        rounded_log(
            f"SELECT * FROM log WHERE iteration <= (SELECT coalesce(min(iteration), {EPOCHS}) FROM log WHERE valid_loss < {EARLY})"
        ),
        RUN,
        f"log AS ({log_sql(EPOCHS)})",
    ),
)
def early_stop(spark, sf_dir):
    return log_rows(trained(spark, sf_dir, HEAVY, target_loss=EARLY), spark)


@register(
    "agg10_srt2_best_iteration",
    lines_with(
        "SELECT iteration, round(valid_loss, 9) AS valid_loss FROM log ORDER BY valid_loss, iteration LIMIT 1",
        RUN,
        f"log AS ({log_sql(EPOCHS)})",
    ),
)
def best(spark, sf_dir):
    log = trained(spark, sf_dir, HEAVY).log_table(spark)
    return best_iteration(log).select("iteration", rounded("valid_loss", 9).alias("valid_loss"))


FLAT = 0.000005


@register(
    "win4_plateau_runs",
    lines_with(
        "SELECT iteration, CAST(row_number() OVER (PARTITION BY island ORDER BY iteration) - 1 AS INTEGER) AS flat_epochs FROM ("
        "SELECT *, sum(moved) OVER (ORDER BY iteration) AS island FROM ("
        f"SELECT *, CASE WHEN abs(lag(valid_loss) OVER (ORDER BY iteration) - valid_loss) <= {FLAT} THEN 0 ELSE 1 END "
        "AS moved FROM log))",
        RUN,
        f"log AS ({log_sql(EPOCHS)})",
    ),
)
def plateaus(spark, sf_dir):
    log = trained(spark, sf_dir, HEAVY).log_table(spark)
    return plateau_runs(log, step=FLAT).select("iteration", "flat_epochs")


@register(
    "win5_step_times",
    lines_with(f"SELECT iteration, true AS adds_up, true AS never_negative FROM ({log_sql(EPOCHS)})", RUN),
)
def epoch_times(spark, sf_dir):
    """Times differ from run to run; that they add up to the cumulative ones does not."""
    steps = step_times(trained(spark, sf_dir, HEAVY).log_table(spark))
    so_far = F.sum("step_ms").over(Window.orderBy("iteration"))  # a log has one row per epoch
    return steps.select(
        "iteration", (so_far == F.col("elapsed_ms")).alias("adds_up"), (F.col("step_ms") >= 0).alias("never_negative")
    )


# Logs made of orders: the run is the customer, an epoch an order, and no run has a validation loss.
ORDER_LOGS = """logs AS (
  SELECT o_custkey AS run, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS iteration,
         CAST(sum(o_orderkey % 1000) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS elapsed_ms,
         CAST(o_orderkey % 1000 AS BIGINT) AS step_ms, floor(o_totalprice / 100000) AS train_loss
  FROM orders)"""


def order_logs(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    by_customer = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return orders.select(
        F.col("o_custkey").alias("run"),
        F.row_number().over(by_customer).alias("iteration"),
        F.sum(F.col("o_orderkey") % 1000).over(by_customer).cast("long").alias("elapsed_ms"),
        F.floor(F.col("o_totalprice") / 100000).cast("double").alias("train_loss"),
        F.lit(None).cast("double").alias("valid_loss"),
    )


@register(
    "agg10_best_iteration_without_validation",
    f"WITH {ORDER_LOGS} SELECT run, iteration, train_loss AS loss FROM (SELECT *, row_number() OVER "
    "(PARTITION BY run ORDER BY train_loss, iteration) AS place FROM logs) WHERE place = 1",
)
def best_of_logs(spark, sf_dir):
    return best_iteration(order_logs(spark, sf_dir), ["run"]).select("run", "iteration", "loss")


@register(
    "win4_plateau_runs_without_validation",
    f"WITH {ORDER_LOGS} SELECT run, iteration, CAST(row_number() OVER (PARTITION BY run, island ORDER BY iteration) - 1 AS INTEGER) "
    "AS flat_epochs FROM (SELECT *, sum(moved) OVER (PARTITION BY run ORDER BY iteration) AS island FROM ("
    "SELECT *, CASE WHEN abs(lag(train_loss) OVER (PARTITION BY run ORDER BY iteration) - train_loss) <= 0 THEN 0 ELSE 1 END "
    "AS moved FROM logs))",
)
def plateaus_of_logs(spark, sf_dir):
    return plateau_runs(order_logs(spark, sf_dir), ["run"], step=0.0).select("run", "iteration", "flat_epochs")


@register("win5_step_times_of_logs", f"WITH {ORDER_LOGS} SELECT run, iteration, step_ms FROM logs")
def times_of_logs(spark, sf_dir):
    return step_times(order_logs(spark, sf_dir), ["run"]).select("run", "iteration", "step_ms")


# --- masks and dropout ------------------------------------------------------------


@register(
    "ml14_input_mask",
    long_with("SELECT vec_id, pos, true AS kept_or_zero FROM long"),
)
def noisy_inputs(spark, sf_dir):
    """Each value survives or becomes 0; the draws are seeded, so SQL checks the property only."""
    samples = embedded(spark, sf_dir)
    noisy = mask_features(samples, 0.3, F.col("vec_id"), epoch=1, seed=5)
    both = samples.select("vec_id", F.col("features").alias("clean")).join(
        noisy.select("vec_id", "features"), "vec_id"
    )
    ok = F.zip_with("clean", "features", lambda a, b: (b == 0) | (a == b))
    return both.select("vec_id", F.posexplode(ok).alias("pos", "kept_or_zero"))


LINE_NUMBER = "l_orderkey * 8 + l_linenumber"
MASKED_RUN = NetworkConfig(size=(6, 5, 1), learning_rate=0.5, input_mask=0.2)
DROPPED_RUN = NetworkConfig(size=(6, 5, 1), learning_rate=0.5, dropout=0.2)


def noisy_log(config: NetworkConfig) -> str:
    return lines_with(
        f"SELECT iteration, round(train_loss, 9) AS train_loss, round(valid_loss, 9) AS valid_loss FROM ({log_sql(3)})",
        training_ctes("lines", config, 3, noise_key=LINE_NUMBER),
    )


def noisily_trained(spark, sf_dir, config: NetworkConfig):
    """Trained with draws that SQL repeats."""
    samples = lines(spark, sf_dir).withColumn("k", F.expr(LINE_NUMBER))
    return train(samples, config, 3, init_weights=formula_weights(config), key=["k"], draw=lehmer)


@register("ml14_train_with_input_mask", noisy_log(MASKED_RUN))
def masked_training(spark, sf_dir):
    return log_rows(noisily_trained(spark, sf_dir, MASKED_RUN), spark)


@register(
    "ml15_dropout_share",
    "SELECT count(*) * 5 AS units, true AS share_fits FROM lineitem",
)
def dropped_units(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    keep = rows.select(dropout_mask(row_key(rows), 5, 0.4, epoch=1, seed=5).alias("keep"))
    units = keep.select(F.explode("keep").alias("k"))
    totals = units.agg(F.count(F.lit(1)).alias("units"), F.avg("k").alias("share"))
    return totals.select("units", (F.abs(F.col("share") - 0.6) < 0.01).alias("share_fits"))


@register("ml15_train_with_dropout", noisy_log(DROPPED_RUN))
def dropout_training(spark, sf_dir):
    return log_rows(noisily_trained(spark, sf_dir, DROPPED_RUN), spark)


MASKED = NetworkConfig(size=(6, 4, 3, 1), input_mask=0.3, dropout=0.3)
# Masks both engines can build: a feature survives by the size of the next one, a unit by a feature of its own.
GIVEN = (
    "given AS (SELECT y, v, "
    + ", ".join(f"CASE WHEN x{(i + 1) % 6 + 1} >= 0.3 THEN x{i + 1} ELSE 0 END AS x{i + 1}" for i in range(6))
    + ", "
    + ", ".join(f"CASE WHEN x{k % 6 + 1} > 0.25 THEN 1 ELSE 0 END AS {m}" for k, m in enumerate(mask_columns(MASKED)))
    + " FROM lines)"
)


@register(
    "ml14_ml15_gradient_under_masks",
    lines_with(
        unpivot("g0", MASKED, {"g": "round(g_{p}, 9) + 0", "n": "n"}),
        GIVEN,
        weight_row("w0", MASKED),
        gradient_sql("given", "w0", MASKED, "g0", masks=True),
    ),
)
def gradient_under_masks(spark, sf_dir):
    """What a noisy epoch computes, with masks from the data instead of draws."""

    def kept(test):
        return F.when(test, F.lit(1.0)).otherwise(F.lit(0.0))

    def x(i):
        return F.get("features", F.lit(i))

    features = F.array(*[kept(x((i + 1) % 6) >= 0.3) for i in range(6)])
    units = F.array(*[kept(x(k % 6) > 0.25) for k in range(MASKED.hidden_units)])
    samples = lines(spark, sf_dir).withColumns({"noisy": masked(F.col("features"), features), "keep": units})
    grads = gradient_table(samples, formula_weights(MASKED), MASKED)
    return grads.select("layer", "r", "c", rounded("g", 9).alias("g"), "n")


HALVED = NetworkConfig(size=(6, 5, 1), dropout=0.25)


@register(
    "ml15_scores_with_dropout",
    lines_with(
        "SELECT l_orderkey, l_linenumber, round(o, 6) AS prediction FROM ("
        + forward("lines", "w0", HALVED, "l_orderkey, l_linenumber, y") + ")",
        weight_row("w0", HALVED),
    ),
)
def dropout_scores(spark, sf_dir):
    scored = score(lines(spark, sf_dir), formula_weights(HALVED), HALVED)
    return prediction_report(scored, LINE_KEYS).select(*LINE_KEYS, rounded("prediction").alias("prediction"))
