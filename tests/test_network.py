"""Scoring, gradients and training against an independent numpy replay."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from tallygrad.network import (
    NetworkConfig,
    check_weights,
    flatten,
    initial_weights,
    unflatten,
    weights_from_table,
    weights_table,
)
from tallygrad.functions.random import lehmer, lehmer_block, uniform, uniform_block
from tallygrad.operators import blocks, gradcheck, kernel
from tallygrad.operators.forward import activations, hidden_means, layer_outputs, loss, score
from tallygrad.operators.gradcheck import gradient_check, gradient_check_summary, row_gradients
from tallygrad.operators.gradient import (
    Noise,
    gradient_table,
    partial_sums,
    run_pass,
    sliced_sums,
    summed,
    update,
    update_table,
)
from tallygrad.operators.logs import best_iteration, plateau_runs, step_times
from tallygrad.operators.samples import dropout_mask, mark_validation, mask_features, numbered_copies, split_vector
from tallygrad.operators.scaling import sample_stats, scale
from tallygrad.plans import training
from tallygrad.plans.training import LOG_SCHEMA, Model, prepare, train, with_noise
from tallygrad.session import shared_dir
from tallygrad.streaming.scoring import score_stream

SCHEMA = "k long, label double, features array<double>, is_valid boolean"
SHAPES = [
    NetworkConfig(size=(3, 4, 1), hidden=h, output=o, learning_rate=0.3, momentum=0.4, rate_decay=0.9, l2=0.01)
    for h in ("sigm", "tanh_opt")
    for o in ("sigm", "linear")
] + [NetworkConfig(size=(3, 4, 2, 1), hidden="tanh_opt", output="linear", learning_rate=0.05, momentum=0.2)]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    y = 1 / (1 + np.exp(-x.sum(axis=1)))
    valid = rng.random(300) < 0.25
    rows = [(k, float(y[k]), [float(v) for v in x[k]], bool(valid[k])) for k in range(300)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache(), x, y, valid


# --- an independent replay, one row at a time ---------------------------------------


def act(z, name):
    if name == "sigm":
        return 1 / (1 + math.exp(-z))
    return 1.7159 * math.tanh(2 / 3 * z) if name == "tanh_opt" else z


def slope(a, name):
    if name == "sigm":
        return a * (1 - a)
    return 1.7159 * 2 / 3 * (1 - a * a / 1.7159**2) if name == "tanh_opt" else 1.0


def run(x, weights, config, keep=None, share=0.0):
    acts, used = [list(x)], 0
    for l, w in enumerate(weights):
        last = l == len(weights) - 1
        z = [w[r, 0] + sum(w[r, c + 1] * v for c, v in enumerate(acts[-1])) for r in range(w.shape[0])]
        a = [act(v, config.output if last else config.hidden) for v in z]
        if not last and keep is not None:
            a = [v * m for v, m in zip(a, keep[used : used + len(a)])]
            used += len(a)
        elif not last:
            a = [v * (1 - share) for v in a]
        acts.append(a)
    return acts


def backward(x, y, weights, config, keep=None):
    acts = run(x, weights, config, keep)
    delta = [-(y - acts[-1][0]) * slope(acts[-1][0], config.output)]
    grads, end = [], config.hidden_units
    for l in range(len(weights) - 1, -1, -1):
        grads.insert(0, np.outer(delta, [1.0] + acts[l]))
        if l == 0:
            break
        units = acts[l]
        mask = [1.0] * len(units) if keep is None else keep[end - len(units) : end]
        end -= len(units)
        delta = [
            sum(weights[l][k, j + 1] * d for k, d in enumerate(delta)) * slope(units[j], config.hidden) * mask[j]
            for j in range(len(units))
        ]
    return grads


def mean_loss(x, y, weights, config):
    return 0.5 * np.mean([(b - run(a, weights, config, share=config.dropout)[-1][0]) ** 2 for a, b in zip(x, y)])


def mean_gradient(x, y, weights, config, keeps=None):
    keeps = [None] * len(x) if keeps is None else keeps
    total = [np.zeros(s) for s in config.shapes]
    for a, b, k in zip(x, y, keeps):
        total = [t + g for t, g in zip(total, backward(a, b, weights, config, k))]
    return [t / len(x) for t in total]


# --- configuration and weights ------------------------------------------------------


@pytest.mark.parametrize(
    "wrong",
    [
        {"size": (3, 1)},
        {"size": (3, 2, 2)},
        {"hidden": "relu"},
        {"output": "softmax"},
        {"dropout": 1.0},
        {"input_mask": -0.1},
        {"sparsity_penalty": 0.1},
    ],
)
def test_wrong_settings_are_refused(wrong):
    with pytest.raises(ValueError):
        NetworkConfig(**wrong)


def test_default_settings():
    c = NetworkConfig()
    assert (c.size, c.layer, c.hidden, c.output, c.learning_rate, c.momentum) == ((10, 5, 1), 3, "sigm", "sigm", 2.0, 0.5)
    assert (c.rate_decay, c.l2, c.sparsity_target, c.input_mask, c.dropout) == (1.0, 0.0, 0.05, 0.0, 0.0)


def test_initial_weights():
    c = NetworkConfig(size=(50, 40, 1))
    w = initial_weights(c, 1)
    assert [a.shape for a in w] == [(40, 51), (1, 41)]
    flat = flatten(w)
    assert flat.min() >= -0.05 and flat.max() < 0.05 and abs(flat.mean()) < 0.005
    assert (flatten(initial_weights(c, 1)) == flat).all() and not (flatten(initial_weights(c, 2)) == flat).all()
    assert all((a == b).all() for a, b in zip(unflatten(flat, c), w))
    with pytest.raises(ValueError):
        check_weights(w, NetworkConfig(size=(49, 40, 1)))


# --- scoring ------------------------------------------------------------------------


@pytest.mark.parametrize("config", SHAPES)
@pytest.mark.parametrize("method", ["columns", "arrow"])
def test_scores(data, config, method):
    df, x, y, _ = data
    w = initial_weights(config, 2)
    for r in score(df, w, config, method).collect():
        want = run(x[r.k], w, config)[-1][0]
        assert r.predict_label == pytest.approx(want, abs=1e-12)
        assert r.error == pytest.approx(y[r.k] - want, abs=1e-12)
        assert r.features == list(x[r.k])


def test_scores_with_dropout_shrink_hidden_outputs(data):
    df, x, _, _ = data
    config = NetworkConfig(size=(3, 4, 1), dropout=0.25)
    w = initial_weights(config, 2)
    for method in ("columns", "arrow"):
        for r in score(df, w, config, method).collect():
            assert r.predict_label == pytest.approx(run(x[r.k], w, config, share=0.25)[-1][0], abs=1e-12)


def test_hand_worked_network(spark):
    config = NetworkConfig(size=(1, 1, 1), learning_rate=2.0, momentum=0.5, l2=0.1)
    w = [np.array([[0.0, 1.0]]), np.array([[0.0, 1.0]])]
    df = spark.createDataFrame([(1.0, [0.0])], "label double, features array<double>")
    scored = score(df, w, config)
    assert scored.first().predict_label == pytest.approx(0.6224593312018546, abs=1e-15)
    assert loss(scored).first().loss == pytest.approx(0.07126847829827546, abs=1e-15)
    result = run_pass(df, w, config)
    assert result.gradient[1][0] == pytest.approx([-0.08872345867463687, -0.04436172933731843], abs=1e-15)
    assert result.gradient[0][0] == pytest.approx([-0.022180864668659216, 0.0], abs=1e-15)
    new, step = update(w, None, result.gradient, config, 2.0)
    assert new[1][0] == pytest.approx([0.17744691734927373, 0.8887234586746369], abs=1e-15)
    assert new[0][0] == pytest.approx([0.04436172933731843, 0.8], abs=1e-15)
    assert step[1][0] == pytest.approx(w[1][0] - new[1][0], abs=1e-15)


def test_loss_of_no_rows_is_null(data):
    df, *_ = data
    config = SHAPES[0]
    assert loss(score(df.filter("k < 0"), initial_weights(config), config)).first().loss is None


def test_layer_outputs(data):
    df, x, _, _ = data
    config = SHAPES[-1]
    w = initial_weights(config, 2)
    rows = layer_outputs(df, w, config, ["k"]).filter("k = 7").collect()
    got = {(r.layer, r.unit): r.value for r in rows}
    acts = run(x[7], w, config)
    want = {(l, 0): 1.0 for l in range(3)}
    want |= {(l, u + 1): v for l in range(3) for u, v in enumerate(acts[l])}
    want[3, 0] = acts[3][0]
    assert got == pytest.approx(want)
    assert [len(a) for a in activations(df, w, config).first().activations] == [4, 5, 3, 1]


def test_hidden_means(data):
    df, x, _, _ = data
    config = SHAPES[-1]
    w = initial_weights(config, 2)
    acts = [run(a, w, config) for a in x]
    want = {(l, u + 1): np.mean([a[l][u] for a in acts]) for l in (1, 2) for u in range(config.size[l])}
    first = hidden_means(df, w, config)
    assert {(r.layer, r.unit): r["mean"] for r in first.collect()} == pytest.approx({k: 0.01 * v for k, v in want.items()})
    second = hidden_means(df, w, config, previous=first)
    assert {(r.layer, r.unit): r["mean"] for r in second.collect()} == pytest.approx(
        {k: 0.01 * v + 0.99 * 0.01 * v for k, v in want.items()}
    )


def test_bad_rows_are_errors_not_silent_losses(spark):
    config = NetworkConfig(size=(2, 2, 1))
    w = initial_weights(config)
    schema = "label double, features array<double>"
    for row in [(1.0, [1.0]), (1.0, None), (1.0, [1.0, None]), (None, [1.0, 2.0])]:
        bad = spark.createDataFrame([(1.0, [1.0, 2.0]), row], schema).coalesce(1)
        with pytest.raises(Exception):
            run_pass(bad, w, config)
    # Widths that only add up are no escape.
    mixed = spark.createDataFrame([(1.0, [1.0]), (1.0, [1.0, 2.0, 3.0])], schema).coalesce(1)
    for method in ("columns", "arrow", "auto"):
        with pytest.raises(Exception):
            score(mixed, w, config, method).collect()
        for row in [(1.0, [1.0]), (1.0, None), (1.0, [1.0, None]), (1.0, [1.0, 2.0, 3.0])]:
            with pytest.raises(Exception):
                score(spark.createDataFrame([row], schema), w, config, method).collect()
        stale = spark.createDataFrame([(1.0, 7, [1.0, 2.0], "x")], "error double, predict_label int, features array<double>, k string")
        assert score(stale, w, config, method).columns == ["features", "k", "predict_label"]
        labelled = stale.withColumn("label", F.lit(1.0))
        assert score(labelled, w, config, method).columns == ["features", "k", "label", "predict_label", "error"]


def test_streams_are_scored_without_state(spark, data, tmp_path):
    df, x, _, _ = data
    config = SHAPES[0]
    model = Model(config, initial_weights(config, 2))
    source = str(tmp_path / "in")
    df.drop("is_valid").write.parquet(source)
    for method in ("columns", "arrow"):
        stream = spark.readStream.schema("k long, label double, features array<double>").parquet(source)
        query = score_stream(stream, model, method=method).writeStream.format("memory").queryName(f"s_{method}").start()
        query.processAllAvailable()
        query.stop()
        got = {r.k: r.predict_label for r in spark.table(f"s_{method}").collect()}
        assert got == pytest.approx({k: run(x[k], model.weights, config)[-1][0] for k in range(300)})
    with pytest.raises(ValueError):
        score_stream(df, model)


def test_streams_are_scaled_with_fitted_statistics(spark, data, tmp_path):
    df, *_ = data
    model = Model(SHAPES[0], initial_weights(SHAPES[0], 2))
    stats = sample_stats(df).first()
    source = str(tmp_path / "in")
    df.drop("is_valid").write.parquet(source)
    stream = spark.readStream.schema("k long, label double, features array<double>").parquet(source)
    query = score_stream(stream, model, stats).writeStream.format("memory").queryName("scaled").start()
    query.processAllAvailable()
    query.stop()
    got = {r.k: r.predict_label for r in spark.table("scaled").collect()}
    want = {r.k: r.predict_label for r in model.predict(scale(df, stats)).collect()}
    assert got == pytest.approx(want)


# --- gradients ----------------------------------------------------------------------


@pytest.mark.parametrize("config", SHAPES)
def test_gradient_and_losses_of_one_pass(data, config):
    df, x, y, valid = data
    w = initial_weights(config, 2)
    result = run_pass(df, w, config)
    assert (result.train_rows, result.valid_rows) == ((~valid).sum(), valid.sum())
    assert result.train_loss == pytest.approx(mean_loss(x[~valid], y[~valid], w, config))
    assert result.valid_loss == pytest.approx(mean_loss(x[valid], y[valid], w, config))
    want = mean_gradient(x[~valid], y[~valid], w, config)
    assert all(np.allclose(a, b, atol=1e-12) for a, b in zip(result.gradient, want))
    table = {(r.layer, r.r, r.c): r for r in gradient_table(df, w, config).collect()}
    assert len(table) == config.parameters
    for l, g in enumerate(want):
        for r, c in np.ndindex(g.shape):
            assert table[l, r, c].g == pytest.approx(g[r, c], abs=1e-12)
            assert table[l, r, c].n == (~valid).sum()


def test_combine_stage_changes_nothing(data):
    df, *_ = data
    config = SHAPES[-1]
    w = initial_weights(config, 2)
    a, b = run_pass(df, w, config, combine_tasks=1), run_pass(df, w, config)
    assert all(np.allclose(u, v, atol=1e-13) for u, v in zip(a.gradient, b.gradient))
    assert (a.train_rows, a.valid_rows) == (b.train_rows, b.valid_rows)


def test_one_vector_per_partition_is_shuffled(data):
    df, *_ = data
    config = SHAPES[0]
    partials = partial_sums(df, initial_weights(config), config)
    assert partials.count() == df.rdd.getNumPartitions()
    plan = plan_of(summed(partials))
    assert plan.count("Exchange RoundRobinPartitioning(8)") == 1 and plan.count("Exchange SinglePartition") == 1
    (row,) = summed(partials).collect()
    assert len(row.sums) == SHAPES[0].parameters + 4


@pytest.mark.parametrize("config", SHAPES)
def test_numeric_gradient_check(data, config):
    df, x, y, _ = data
    w = [a * 10 for a in initial_weights(config, 2)]
    summary = gradient_check_summary(df, w, config).collect()
    assert len(summary) == config.parameters
    assert max(r.worst for r in summary) < 1e-6
    assert {r.n for r in summary} == {300}
    by_row = gradient_check(df.filter("k < 20"), w, config, ["k"])
    assert by_row.count() == 20 * config.parameters
    assert by_row.filter("abs(estimate - actual) > 1e-6").count() == 0
    for r in row_gradients(df.filter("k = 5"), w, config, ["k"]).collect():
        assert r.g == pytest.approx(backward(x[5], y[5], w, config)[r.layer][r.r, r.c], abs=1e-12)


def whole_passes(x, y, weights, config, step, keep):
    """Differences by two forward passes of the whole network for each weight."""
    flat, out = flatten(weights), []
    for p in range(len(flat)):
        halves = []
        for sign in (1.0, -1.0):
            moved = flat.copy()
            moved[p] += sign * step
            halves.append(0.5 * (kernel.forward(x, unflatten(moved, config), config, keep)[-1][:, 0] - y) ** 2)
        out.append((halves[0] - halves[1]) / (2.0 * step))
    return np.array(out).T


@pytest.mark.parametrize("config", [*SHAPES, NetworkConfig(size=(3, 4, 3, 2, 1), dropout=0.3)])
@pytest.mark.parametrize("masked", [False, True])
def test_differences_carry_a_moved_weight_through(data, config, masked):
    _, x, y, _ = data
    w = [a * 10 for a in initial_weights(config, 2)]
    keep = None
    if masked:
        drawn = (np.random.default_rng(5).random((len(y), config.hidden_units)) > 0.3).astype(float)
        keep = kernel.layer_masks(drawn, config)
    want = whole_passes(x, y, w, config, 1e-4, keep)
    got = gradcheck._differences(x, y, w, config, 1e-4, keep)
    # Rounding of the losses alone makes 1e-16 / 2e-4.
    assert np.abs(got - want).max() < 4e-12


def test_gradient_table_moves_finished_slices(data, monkeypatch):
    df, *_ = data
    config = SHAPES[-1]
    w = initial_weights(config, 2)
    want = {(r.layer, r.r, r.c): (r.g_sum, r.n) for r in gradient_table(df, w, config).collect()}
    sums = sliced_sums(partial_sums(df.repartition(40), w, config), config.parameters, 2, size=7)
    rows = sums.collect()
    assert [r.slice for r in sorted(rows)] == list(range(-(-config.parameters // 7)))
    flat = np.concatenate([r.sums for r in sorted(rows)])
    assert np.allclose(flat, [want[p][0] for p in sorted(want)], atol=1e-12)
    assert {int(r.rows) for r in rows} == {n for _, n in want.values()}
    # Forty vectors are shuffled as slices, then two of each; no element travels alone.
    plan = plan_of(gradient_table(df, w, config))
    assert plan.count("Exchange hashpartitioning(slice") == 2 and "HashAggregate" not in plan


def test_update_on_tables(spark, data):
    df, *_ = data
    config = SHAPES[0]
    w = initial_weights(config, 2)
    gradient = run_pass(df, w, config).gradient
    w1, v1 = update(w, None, gradient, config, 0.3)
    w2, v2 = update(w1, v1, gradient, config, 0.2)
    grads = gradient_table(df, w, config)
    t1 = update_table(weights_table(spark, w), grads, None, config, 0.3)
    t2 = update_table(t1, grads, t1, config, 0.2)
    assert np.allclose(flatten(weights_from_table(t2, config)), flatten(w2))
    velocity = weights_from_table(t2.select("layer", "r", "c", F.col("v").alias("w")), config)
    assert np.allclose(flatten(velocity), flatten(v2))


# --- training -----------------------------------------------------------------------


def replay(x, y, valid, config, weights, epochs, keeps=None, noisy=None):
    """Losses after each epoch, and the weights."""
    rate, velocity, log = config.learning_rate, [np.zeros(s) for s in config.shapes], []
    for e in range(epochs):
        inputs = x if noisy is None else noisy[e]
        masks = None if keeps is None else [k for k, v in zip(keeps[e], valid) if not v]
        grads = mean_gradient(inputs[~valid], y[~valid], weights, config, masks)
        new = []
        for i, (w, g) in enumerate(zip(weights, grads)):
            l2 = config.l2 * w
            l2[:, 0] = 0
            step = rate * (g + l2) + config.momentum * velocity[i]
            if config.momentum > 0:
                velocity[i] = step
            new.append(w - step)
        weights = new
        rate *= config.rate_decay
        log.append((mean_loss(x[~valid], y[~valid], weights, config), mean_loss(x[valid], y[valid], weights, config)))
    return log, weights


@pytest.mark.parametrize("config", SHAPES)
def test_training_replay(data, config):
    df, x, y, valid = data
    w = initial_weights(config, 2)
    run_ = train(df, config, 4, init_weights=w)
    log, weights = replay(x, y, valid, config, w, 4)
    assert np.allclose([r[2:] for r in run_.log], log, atol=1e-12)
    assert [r[0] for r in run_.log] == [1, 2, 3, 4]
    best = min(range(4), key=lambda i: log[i][1])
    assert run_.best_iteration == best + 1
    _, at_best = replay(x, y, valid, config, w, best + 1)
    assert np.allclose(flatten(run_.model.weights), flatten(at_best))
    assert run_.model.loss(df.filter("is_valid")).first().loss == pytest.approx(log[best][1])


def test_stored_training_table_gives_the_same_run(data):
    df, *_ = data
    config = SHAPES[0]
    w = initial_weights(config, 2)
    a = train(df, config, 3, init_weights=w)
    spark = df.sparkSession
    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    b = train(df, config, 3, init_weights=w, storage="table", partitions=3)
    left = set(os.listdir(shared_dir(spark).removeprefix("file:"))) - before
    assert not [f for f in left if f.startswith("training")]
    assert np.allclose([r[2:] for r in a.log], [r[2:] for r in b.log], atol=1e-12)


def test_random_split_is_repeatable(data):
    df, *_ = data
    plain = df.drop("is_valid")
    a = train(plain, SHAPES[0], 2, validation=0.3, seed=5, key=["k"])
    b = train(plain.repartition(2), SHAPES[0], 2, validation=0.3, seed=5, key=["k"])
    assert np.allclose([r[2:] for r in a.log], [r[2:] for r in b.log], atol=1e-12)
    marked = mark_validation(plain, 0.3, seed=5, key=["k"])
    assert abs(marked.filter("is_valid").count() - 90) < 25


def test_copies_are_split_apart(spark):
    """A row of a hundred thousand copies is divided like any other, whatever the partitions."""
    rows = spark.range(100_000).select(F.lit(1).alias("a"), F.lit(None).cast("string").alias("_copy"))
    rows = rows.unionByName(spark.range(50).select((F.col("id") + 10).cast("int").alias("a"), F.lit("x").alias("_copy")))
    counts = []
    for parts in (1, 7, 30):
        marked = mark_validation(rows.repartition(parts), 0.2, seed=3, split_copies=True)
        assert marked.columns == ["a", "_copy", "is_valid"]
        counts.append({(r.a, r.is_valid): r["count"] for r in marked.groupBy("a", "is_valid").count().collect()})
    assert counts[0] == counts[1] == counts[2]
    assert abs(counts[0][1, True] / 100_000 - 0.2) < 0.01
    numbers = numbered_copies(rows.repartition(6)).where("a = 1").select("copy")
    assert numbers.distinct().count() == 100_000 and numbers.agg(F.max("copy")).first()[0] == 99_999
    assert numbered_copies(rows.where("a = 0")).count() == 0
    together = mark_validation(rows, 0.2, seed=3).where("a = 1").select("is_valid").distinct().count()
    assert together == 1


def test_without_validation_the_training_loss_decides(data):
    df, *_ = data
    config = NetworkConfig(size=(3, 4, 1), learning_rate=0.5)
    run_ = train(df.drop("is_valid"), config, 3)
    assert [r[3] for r in run_.log] == [None] * 3 and len(run_.log) == 3
    assert run_.best_iteration == 3


def test_early_stop(data):
    df, *_ = data
    config = NetworkConfig(size=(3, 4, 1), learning_rate=0.5)
    full = train(df, config, 6)
    target = full.log[3][3] * 1.0000001
    run_ = train(df, config, 6, target_loss=target)
    assert run_.converged and len(run_.log) == 4 and run_.best_iteration == 4


def test_plateau_restarts_after_more_than_the_allowed_epochs(data):
    df, x, y, valid = data
    still = NetworkConfig(size=(3, 4, 1), learning_rate=0.0, momentum=0.0)
    ten = train(df, still, 11, seed=1)
    assert ten.restarts == 0
    assert train(df, still, 12, seed=1).restarts == 1
    # Flat epochs 1 and 2, new weights before 3, whose loss differs, flat 4 and 5, new weights before 6.
    short = train(df, still, 6, seed=1, plateau_length=1)
    want = [mean_loss(x[valid], y[valid], initial_weights(still, s), still) for s in (1, 1, 2, 2, 2, 3)]
    assert [r[3] for r in short.log] == pytest.approx(want)
    assert short.restarts == 2
    assert short.best_iteration == 1 + int(np.argmin(want))


def test_empty_sides_are_errors(data):
    df, *_ = data
    with pytest.raises(ValueError):
        train(df.filter("is_valid"), SHAPES[0], 1)
    with pytest.raises(ValueError):
        train(df.filter("not is_valid"), SHAPES[0], 1)


def test_one_query_per_epoch(spark, data):
    """k epochs are k + 1 passes; adaptive execution submits the three stages of a pass as jobs of their own."""
    df, *_ = data
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("epochs", "count jobs")
    train(df, SHAPES[0], 4, init_weights=initial_weights(SHAPES[0]))
    spark.sparkContext.setJobGroup("", "")
    assert len(tracker.getJobIdsForGroup("epochs")) <= 3 * 5 + 1  # and one fills the stored table


# --- masks and dropout --------------------------------------------------------------


def test_mask_features(data):
    df, x, *_ = data
    a = mask_features(df, 0.3, F.col("k"), epoch=1, seed=9)
    b = mask_features(df.repartition(3), 0.3, F.col("k"), epoch=1, seed=9)
    got = {r.k: r.features for r in a.collect()}
    assert got == {r.k: r.features for r in b.collect()}
    kept = sum(v != 0 for f in got.values() for v in f) / 900
    assert abs(kept - 0.7) < 0.05
    assert all(v in (0, x[k][i]) for k, f in got.items() for i, v in enumerate(f))
    spelled_out = mask_features(df, 0.3, F.col("k"), epoch=1, seed=9, width=3)
    assert got == {r.k: r.features for r in spelled_out.collect()}
    other = mask_features(df, 0.3, F.col("k"), epoch=2, seed=9)
    assert got != {r.k: r.features for r in other.collect()}
    assert {r.k: r.features for r in mask_features(df, 0.0, F.col("k")).collect()} == {k: list(v) for k, v in enumerate(x)}


def test_training_with_noise_replays_from_the_masks(data):
    df, x, y, valid = data
    config = NetworkConfig(size=(3, 4, 2, 1), learning_rate=0.5, momentum=0.3, input_mask=0.2, dropout=0.3)
    w = initial_weights(config, 2)
    run_ = train(df, config, 3, init_weights=w, key=["k"], seed=4)
    keeps, noisy = [], []
    keyed = df.withColumn("row_key", F.xxhash64("k"))
    for e in range(3):
        rows = {r.k: r for r in with_noise(keyed, config, e, 4).collect()}
        keeps.append([rows[k].keep for k in range(300)])
        noisy.append(np.array([rows[k].noisy for k in range(300)]))
    log, _ = replay(x, y, valid, config, w, 3, keeps, noisy)
    assert np.allclose([r[2:] for r in run_.log], log, atol=1e-12)


def test_a_draw_that_is_only_a_column_trains_on_rows(data):
    df, *_ = data
    config = NetworkConfig(size=(3, 4, 2, 1), learning_rate=0.5, input_mask=0.2, dropout=0.3)
    a = train(df, config, 3, key=["k"], draw=lehmer)
    b = train(df, config, 3, key=["k"], draw=lambda key, epoch, i, seed: lehmer(key, epoch, i, seed))
    assert np.allclose([r[2:] for r in a.log], [r[2:] for r in b.log], atol=1e-13)


@pytest.mark.parametrize("column, block", [(uniform, uniform_block), (lehmer, lehmer_block)])
@pytest.mark.parametrize("epoch, seed", [(0, 0), (7, 1), (2**31 - 1, -5), (3, 2**40)])
def test_draws_in_blocks_are_those_of_columns(spark, column, block, epoch, seed):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 123456789012345, *range(-20, 20)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")

    def draw(i):
        if column is uniform:
            return uniform(F.col("k"), F.lit(epoch), F.lit(i), seed=seed)
        return lehmer(F.col("k"), F.lit(epoch), F.lit(i), seed)

    want = {r[0]: list(r[1:]) for r in df.select("k", *[draw(i) for i in range(5)]).collect()}
    got = block(np.array(keys), epoch, np.arange(5), seed)
    assert all(got[i].tolist() == want[k] for i, k in enumerate(keys))


def test_noise_in_blocks_is_that_of_the_columns(data):
    df, *_ = data
    config = NetworkConfig(size=(3, 5, 4, 2, 1), input_mask=0.3, dropout=0.4)
    w = initial_weights(config, 2)
    keyed = df.withColumn("row_key", F.col("k"))
    rows = run_pass(with_noise(keyed, config, 6, 9), w, config)
    packed = run_pass(blocks.to_blocks(keyed, 3), w, config, noise=Noise(6, 9))
    assert all(np.allclose(u, v, atol=1e-14) for u, v in zip(rows.gradient, packed.gradient))
    assert rows.train_loss == pytest.approx(packed.train_loss)
    with pytest.raises(ValueError, match="columns"):
        run_pass(keyed, w, config, noise=Noise(6, 9))
    with pytest.raises(Exception, match="no row keys"):
        run_pass(blocks.to_blocks(df, 3), w, config, noise=Noise(6, 9))


def plain(log):
    return [(r[0], *r[2:]) for r in log]


@pytest.mark.parametrize("settings", [{}, {"input_mask": 0.2, "dropout": 0.2}])
def test_a_run_that_was_cut_goes_on(data, settings, monkeypatch):
    df, *_ = data
    config = NetworkConfig(size=(3, 4, 1), learning_rate=0.5, momentum=0.3, rate_decay=0.9, **settings)
    options = {"key": ["k"], "seed": 3, "plateau_step": 1e-3, "plateau_length": 2, "combine_tasks": 1, "partitions": 1}
    whole = train(df, config, 8, **options)
    assert whole.restarts

    real, calls = training.run_pass, []

    def failing(*args):
        calls.append(1)
        if len(calls) == 7:
            raise KeyboardInterrupt
        return real(*args)

    name = f"cut-{len(settings)}-{os.getpid()}"
    monkeypatch.setattr(training, "run_pass", failing)
    with pytest.raises(KeyboardInterrupt):
        train(df, config, 8, run_id=name, save_every=2, **options)
    monkeypatch.undo()
    states = training.LoopStates(df.sparkSession, name, "")
    assert states.epochs() == [2, 4]
    again = train(df, config, 8, run_id=name, save_every=2, resume=True, **options)
    assert plain(again.log) == plain(whole.log) and again.before[2:] == whole.before[2:]
    assert (again.restarts, again.restarted, again.best_iteration) == (whole.restarts, whole.restarted, whole.best_iteration)
    assert all(np.array_equal(a, b) for a, b in zip(again.model.weights, whole.model.weights))
    assert [r[1] for r in again.log] == sorted(r[1] for r in again.log)
    # A finished run comes back as it is, and more epochs follow its last one.
    monkeypatch.setattr(training, "run_pass", None)
    assert plain(train(df, config, 8, run_id=name, resume=True, **options).log) == plain(whole.log)
    monkeypatch.undo()
    longer = train(df, config, 9, run_id=name, resume=True, **options)
    assert plain(longer.log[:8]) == plain(whole.log) and len(longer.log) == 9
    with pytest.raises(ValueError, match="other settings"):
        train(df, config, 8, run_id=name, resume=True, **options | {"seed": 4})
    states.remove()
    assert states.epochs() == []


def test_a_run_without_a_state_begins(data):
    df, *_ = data
    name = f"fresh-{os.getpid()}"
    log = train(df, SHAPES[0], 2, run_id=name, resume=True).log
    assert np.allclose([r[2:] for r in log], [r[2:] for r in train(df, SHAPES[0], 2).log], atol=1e-13)
    assert training.LoopStates(df.sparkSession, name, "").epochs() == [1, 2]
    training.LoopStates(df.sparkSession, name, "").remove()
    for wrong in ({"resume": True}, {"run_id": "a/b"}, {"run_id": "a", "save_every": 0}):
        with pytest.raises(ValueError):
            train(df, SHAPES[0], 2, **wrong)


def test_dropout_mask_share(spark):
    keep = spark.range(5000).select(F.explode(dropout_mask(F.col("id"), 4, 0.25, epoch=1)).alias("k"))
    assert abs(keep.agg(F.avg("k")).first()[0] - 0.75) < 0.01


def test_blocks_hold_all_rows_and_give_the_same_pass(data, monkeypatch):
    df, x, y, valid = data
    config = SHAPES[-1]
    w = initial_weights(config, 2)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 700)
    packed = blocks.to_blocks(df, 3)
    assert packed.agg(F.sum("rows")).first()[0] == 300
    assert packed.agg(F.max("rows")).first()[0] <= blocks.block_rows(3) < 30
    a, b = run_pass(df, w, config), run_pass(packed, w, config)
    assert all(np.allclose(u, v, atol=1e-13) for u, v in zip(a.gradient, b.gradient))
    assert (a.train_rows, a.valid_rows) == (b.train_rows, b.valid_rows)
    assert (a.train_loss, a.valid_loss) == pytest.approx((b.train_loss, b.valid_loss))
    plain = run_pass(blocks.to_blocks(df.drop("is_valid"), 3), w, config)
    assert (plain.train_rows, plain.valid_rows, plain.valid_loss) == (300, 0, None)


def test_prepared_table(data):
    df, *_ = data
    packed = prepare(df, SHAPES[0])
    dropped = NetworkConfig(size=(3, 4, 1), dropout=0.1)
    noisy = prepare(df, dropped, key=["k"])
    rows = prepare(df, dropped, key=["k"], draw=lambda key, epoch, i, seed: lehmer(key, epoch, i, seed))
    try:
        assert packed.columns == noisy.columns == ["rows", "label", "features", "is_valid", "row_key"]
        assert packed.agg(F.max(F.length("row_key"))).first()[0] == 0
        assert noisy.select(F.sum(F.length("row_key"))).first()[0] == 8 * 300
        assert rows.columns == ["label", "features", "is_valid", "row_key"]
    finally:
        for table in (packed, noisy, rows):
            table.unpersist()


def test_split_vector(spark):
    df = spark.createDataFrame([(1, [5.0, 1.0, 2.0])], "k int, x array<double>")
    r = split_vector(df, "x", ["k"]).first()
    assert (r.label, r.features) == (5.0, [1.0, 2.0])


# --- logs ---------------------------------------------------------------------------


def log_of(spark, losses):
    return spark.createDataFrame([(i + 1, 10 * (i + 1) ** 2, 0.0, v) for i, v in enumerate(losses)], LOG_SCHEMA)


@pytest.mark.parametrize("hidden", ["sigm", "tanh_opt"])
@pytest.mark.parametrize("given", [False, True])
def test_numeric_gradient_check_with_dropout(data, hidden, given):
    df, _, _, _ = data
    config = NetworkConfig(size=(3, 4, 3, 1), hidden=hidden, output="linear", dropout=0.5)
    w = [a * 10 for a in initial_weights(config, 2)]
    rows = df.filter("k < 60").withColumn("features", F.slice("features", 1, 3))
    if given:
        rows = rows.withColumn("keep", dropout_mask(F.col("k"), config.hidden_units, 0.5, 1))
    assert max(r.worst for r in gradient_check_summary(rows, w, config).collect()) < 1e-6
    by_row = gradient_check(rows, w, config, ["k"])
    assert by_row.filter("abs(estimate - actual) > 1e-6").count() == 0


def test_logs_without_validation(spark):
    log = log_of(spark, [0.5, 0.3, 0.3, 0.3]).withColumns({"train_loss": F.col("valid_loss"), "valid_loss": F.lit(None).cast("double")})
    assert best_iteration(log).first().iteration == 2
    assert [r.flat_epochs for r in plateau_runs(log).orderBy("iteration").collect()] == [0, 0, 1, 2]


def test_the_full_log_reproduces_the_count_of_training(spark, data):
    """The loss before training counts, and a restart begins a new count."""
    df, _, _, _ = data
    config = NetworkConfig(size=(3, 2, 1), learning_rate=1e-30)
    rows = df.withColumn("features", F.slice("features", 1, 3))
    run_ = train(rows, config, 9, plateau_length=2, key=["k"])
    assert run_.restarts and run_.restarted[0] == 4
    counts = {r.iteration: r.flat_epochs for r in plateau_runs(run_.full_log_table(spark)).collect()}
    assert [counts[i] for i in range(4)] == [0, 1, 2, 3]
    assert all(counts[e] <= 1 for e in run_.restarted)
    assert run_.before[1] > 0 and run_.log[0][1] >= run_.before[1]


def test_best_iteration(spark):
    log = log_of(spark, [0.5, 0.3, 0.4, 0.3])
    assert tuple(best_iteration(log).first()) == (2, 0.3, 0.3)
    assert best_iteration(log, below=0.1).count() == 0
    two = log.withColumn("run", F.lit("a")).unionByName(log_of(spark, [0.2]).withColumn("run", F.lit("b")))
    assert {tuple(r) for r in best_iteration(two, ["run"]).collect()} == {("a", 2, 0.3, 0.3), ("b", 1, 0.2, 0.2)}


def test_plateau_runs_and_step_times(spark):
    log = log_of(spark, [0.5, 0.5, 0.5, 0.4, 0.4])
    assert [r.flat_epochs for r in plateau_runs(log).orderBy("iteration").collect()] == [0, 1, 2, 0, 1]
    assert [r.step_ms for r in step_times(log).orderBy("iteration").collect()] == [10, 30, 50, 70, 90]
