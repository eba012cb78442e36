"""Full-batch training: one Spark job per epoch over a prepared table.

The job for weights W gives the losses at W and the gradient at W from the same
forward pass. Losses after an update thus come with the next gradient, and a
run of k epochs takes k + 1 jobs, plus one per restart. The driver holds
weights, velocity and the log, never rows.
"""

from __future__ import annotations

import math
import re
import time
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.random import row_key, uniform
from ..functions.vectors import masked
from ..network import (
    NetworkConfig,
    Weights,
    check_weights,
    flatten,
    initial_weights,
    unflatten,
    weights_table,
    zero_weights,
)
from ..operators.blocks import to_blocks
from ..operators.forward import loss as scored_loss, score
from ..operators.gradient import COMBINE_TASKS, Noise, run_pass, update
from ..operators.samples import dropout_mask, input_mask, mark_validation
from ..session import remove_path, shared_dir, shared_path

LOG_SCHEMA = "iteration int, elapsed_ms long, train_loss double, valid_loss double"
FULL_LOG_SCHEMA = f"{LOG_SCHEMA}, restarted boolean"

# Fixed values of the stopping rules.
TARGET_LOSS = 0.0012
PLATEAU_STEP = 1e-9
PLATEAU_LENGTH = 10


@dataclass
class Model:
    """Trained weights with the settings they belong to."""

    config: NetworkConfig
    weights: Weights

    def predict(self, df: DataFrame, method: str = "auto") -> DataFrame:
        return score(df, self.weights, self.config, method)

    def loss(self, df: DataFrame) -> DataFrame:
        """One row ``loss`` over labelled samples."""
        return scored_loss(self.predict(df.select("label", "features")))

    def table(self, spark: SparkSession) -> DataFrame:
        return weights_table(spark, self.weights)


@dataclass
class TrainingRun:
    model: Model
    log: list[tuple[int, int, float, float | None]] = field(default_factory=list)
    best_iteration: int | None = None
    restarts: int = 0
    converged: bool = False
    #: The log's row before the first epoch, and the epochs that began with new weights.
    before: tuple[int, int, float, float | None] | None = None
    restarted: list[int] = field(default_factory=list)

    def full_log_table(self, spark: SparkSession) -> DataFrame:
        """The log with the losses before training as iteration 0, and ``restarted``."""
        rows = ([self.before] if self.before else []) + self.log
        return spark.createDataFrame([(*r, r[0] in self.restarted) for r in rows], FULL_LOG_SCHEMA)

    def log_table(self, spark: SparkSession) -> DataFrame:
        """The log as rows (iteration, elapsed_ms, train_loss, valid_loss)."""
        return spark.createDataFrame(self.log, LOG_SCHEMA)


def is_noisy(config: NetworkConfig) -> bool:
    return config.input_mask > 0 or config.dropout > 0


def block_draw(config: NetworkConfig, draw=None):
    """How masks are drawn inside blocks; None where ``draw`` can only be a column of single rows."""
    return uniform.in_blocks if draw is None or not is_noisy(config) else getattr(draw, "in_blocks", None)


def prepare(
    samples: DataFrame,
    config: NetworkConfig,
    validation: float = 0.0,
    seed: int = 0,
    key: Sequence[str] = (),
    partitions: int | None = None,
    storage: str = "cache",
    path: str | None = None,
    draw=None,
) -> DataFrame:
    """The table all epochs read: blocks of label, features and ``is_valid``.

    With masked inputs or dropout it also holds a ``row_key`` per row, on which the
    masks depend: a hash of the key columns, or with a ``draw`` of the caller's the
    one key column itself. Only a draw that is a column and nothing else needs
    single rows instead of blocks. An ``is_valid`` column of the samples is used as
    it is. ``storage="cache"`` persists in memory and on disk; ``"table"`` writes
    Parquet to ``path`` (by default below the shared folder) and reads it back,
    so that a lost executor costs no recomputation of the steps before.
    """
    columns = [F.col("label").cast("double").alias("label"), F.col("features")]
    if "is_valid" not in samples.columns and validation > 0:
        samples = mark_validation(samples, validation, seed, key)
    if "is_valid" in samples.columns:
        columns.append(F.col("is_valid"))
    if is_noisy(config):
        named = [F.col(c) for c in key]
        if draw is not None and len(named) != 1:
            raise ValueError("a draw of your own needs one integer key column")
        hashed = F.xxhash64(*named) if named else row_key(samples)
        columns.append((hashed if draw is None else named[0]).alias("row_key"))
    table = samples.select(*columns)
    if partitions:
        table = table.repartition(partitions)
    if block_draw(config, draw) is not None:
        table = to_blocks(table, config.size[0])
    if storage == "cache":
        return table.persist(StorageLevel.MEMORY_AND_DISK)
    if storage == "table":
        path = path or shared_path(samples.sparkSession, "training")
        table.write.parquet(path)
        return samples.sparkSession.read.parquet(path)
    raise ValueError("storage must be 'cache' or 'table'")


def with_noise(table: DataFrame, config: NetworkConfig, epoch: int, seed: int, draw=None) -> DataFrame:
    """Add this epoch's masked features and dropout mask to single rows, where the settings ask for them."""
    if config.input_mask > 0:
        mask = input_mask(F.col("row_key"), config.size[0], config.input_mask, epoch, seed, draw)
        table = table.withColumn("noisy", masked(F.col("features"), mask))
    if config.dropout > 0:
        table = table.withColumn(
            "keep", dropout_mask(F.col("row_key"), config.hidden_units, config.dropout, epoch, seed, draw)
        )
    return table


def train(
    samples: DataFrame,
    config: NetworkConfig,
    epochs: int,
    validation: float = 0.0,
    seed: int = 0,
    key: Sequence[str] = (),
    init_weights: Weights | None = None,
    target_loss: float = TARGET_LOSS,
    plateau_step: float = PLATEAU_STEP,
    plateau_length: int = PLATEAU_LENGTH,
    partitions: int | None = None,
    storage: str = "cache",
    combine_tasks: int = COMBINE_TASKS,
    draw=None,
    run_id: str | None = None,
    save_every: int = 1,
    resume: bool = False,
) -> TrainingRun:
    """Train on (label, features) samples and keep the weights of the best epoch.

    ``validation`` is the share of rows held out, or the samples bring their own
    ``is_valid`` column; without either, the training loss picks and stops. A
    run stops early when a new best loss lies below ``target_loss``. When more
    than ``plateau_length`` epochs in a row change the loss by at most
    ``plateau_step``, new random weights are drawn and the learning rate starts
    anew. Everything random follows from ``seed`` and row keys. The vectors of the
    tasks are added up in ``combine_tasks`` tasks first where there are more tasks than that. A table written for the
    run (``storage="table"``) is removed at its end. ``draw`` replaces the hash
    behind masks and dropout, see :func:`..functions.random.lehmer`.

    With a ``run_id`` the state of the loop is written to the shared folder after
    every ``save_every`` epochs. ``resume=True`` goes on behind the newest state of
    that run, or begins where there is none, and gives the log and weights an
    unbroken run gives; other settings than those of the saved run are an error.
    """
    if resume and run_id is None:
        raise ValueError("resume needs the run_id of the run to go on with")
    held_out = validation > 0 or "is_valid" in samples.columns
    saved = None
    if run_id is not None:
        settings = f"{config} {validation} {seed} {list(key)} {target_loss} {plateau_step} {plateau_length}"
        saved = LoopStates(samples.sparkSession, run_id, settings, save_every)
    path = shared_path(samples.sparkSession, "training") if storage == "table" else None
    table = prepare(samples, config, validation, seed, key, partitions, storage, path, draw)
    try:
        noise = block_draw(config, draw) if is_noisy(config) else None
        # With no more tasks than that the vectors are added up in one step: the same sums but for rounding.
        if table.rdd.getNumPartitions() <= combine_tasks:
            combine_tasks = 1

        def at(weights: Weights, epoch: int, gradient: bool = True):
            drawn = Noise(epoch, seed, noise) if gradient and noise is not None else None
            source = with_noise(table, config, epoch, seed, draw) if gradient and noise is None else table
            return run_pass(source, weights, config, gradient, combine_tasks, drawn)

        state = saved.newest(config) if resume else None
        if state is None:
            first = initial_weights(config, seed) if init_weights is None else check_weights(init_weights, config)
            state = _begun(at, config, first, epochs, held_out)
        return _epochs(at, config, state, epochs, held_out, seed, target_loss, plateau_step, plateau_length, saved)
    finally:
        if storage == "cache":
            table.unpersist()
        elif path:
            remove_path(samples.sparkSession, path)


@dataclass
class LoopState:
    """Everything the loop carries from one epoch to the next."""

    epoch: int
    weights: Weights
    velocity: Weights
    #: Gradient at the weights.
    gradient: Weights
    rate: float
    run: TrainingRun
    last: float
    best: float = math.inf
    flat: int = 0
    restart: bool = False
    elapsed_ms: int = 0


def _judged(result, held_out: bool) -> float:
    return result.valid_loss if held_out else result.train_loss


def _begun(at, config: NetworkConfig, weights: Weights, epochs: int, held_out: bool) -> LoopState:
    """The state before the first epoch."""
    started = time.monotonic()
    first = at(weights, 0, epochs > 0)
    if first.train_rows == 0:
        raise ValueError("no training rows")
    if held_out and first.valid_rows == 0:
        raise ValueError("no validation rows; raise the share or train without validation")
    elapsed = int((time.monotonic() - started) * 1000)
    run = TrainingRun(Model(config, weights))
    run.before = (0, elapsed, first.train_loss, first.valid_loss)
    return LoopState(
        0, weights, zero_weights(config), first.gradient, config.learning_rate, run, _judged(first, held_out), elapsed_ms=elapsed
    )


def _epochs(at, config, s: LoopState, epochs, held_out, seed, target_loss, plateau_step, plateau_length, saved=None):
    started, run = time.monotonic() - s.elapsed_ms / 1000, s.run
    while s.epoch < epochs and not run.converged:
        epoch = s.epoch
        if s.restart:
            run.restarts += 1
            run.restarted.append(epoch + 1)
            s.weights = initial_weights(config, seed + run.restarts)
            s.velocity, s.rate, s.flat, s.restart = zero_weights(config), config.learning_rate, 0, False
            s.gradient = at(s.weights, epoch).gradient
        s.weights, s.velocity = update(s.weights, s.velocity, s.gradient, config, s.rate)
        s.rate *= config.rate_decay
        # A run that is saved may go on later, so its last epoch needs the gradient as well.
        found = at(s.weights, epoch + 1, epoch + 1 < epochs or saved is not None)
        now, s.gradient, s.epoch = _judged(found, held_out), found.gradient, epoch + 1
        s.elapsed_ms = int((time.monotonic() - started) * 1000)
        run.log.append((s.epoch, s.elapsed_ms, found.train_loss, found.valid_loss))
        if now < s.best:
            s.best, run.best_iteration, run.model = now, s.epoch, Model(config, s.weights)
            run.converged = now < target_loss
        s.flat = s.flat + 1 if abs(s.last - now) <= plateau_step else 0
        s.restart = s.flat > plateau_length
        s.last = now
        if saved is not None and (s.epoch % saved.every == 0 or s.epoch == epochs or run.converged):
            saved.write(s)
    return run


class LoopStates:
    """States of one run in the shared folder, a small table per saved epoch; the last two are kept.

    A state counts once Spark has committed its folder, so a driver that is lost
    while writing leaves the one before.
    """

    SCHEMA = (
        "settings string, epoch int, rate double, last double, best double, flat int, restart boolean, elapsed_ms long, "
        "best_iteration int, restarts int, restarted array<int>, converged boolean, "
        f"`before` struct<{LOG_SCHEMA}>, log array<struct<{LOG_SCHEMA}>>, "
        "weights array<double>, velocity array<double>, gradient array<double>, best_weights array<double>"
    )

    def __init__(self, spark: SparkSession, run_id: str, settings: str, every: int = 1):
        if not re.fullmatch(r"[A-Za-z0-9._-]+", run_id):
            raise ValueError("run_id may hold letters, digits, dots, dashes and underscores")
        if every < 1:
            raise ValueError("save_every must be at least 1")
        self.spark, self.settings, self.every = spark, settings, every
        self.path = f"{shared_dir(spark).rstrip('/')}/training-run-{run_id}"

    def epochs(self) -> list[int]:
        """Epochs with a committed state, ascending."""
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/epoch-*/_SUCCESS")
        found = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
        return sorted(int(f.getPath().getParent().getName().removeprefix("epoch-")) for f in found or [])

    def write(self, s: LoopState) -> None:
        run = s.run
        row = (
            self.settings, s.epoch, s.rate, s.last, s.best, s.flat, s.restart, s.elapsed_ms, run.best_iteration, run.restarts,
            run.restarted, run.converged, run.before, run.log, *(flatten(w).tolist() for w in (s.weights, s.velocity, s.gradient, run.model.weights)),
        )
        table = self.spark.createDataFrame([row], self.SCHEMA).coalesce(1)
        table.write.mode("overwrite").parquet(f"{self.path}/epoch-{s.epoch}")
        for old in self.epochs()[:-2]:
            remove_path(self.spark, f"{self.path}/epoch-{old}")

    def newest(self, config: NetworkConfig) -> LoopState | None:
        if not (found := self.epochs()):
            return None
        r = self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/epoch-{found[-1]}").first()
        if r.settings != self.settings:
            raise ValueError(f"the saved run has other settings: {r.settings}; these are {self.settings}")
        weights, velocity, gradient, best = (
            unflatten(np.array(v), config) for v in (r.weights, r.velocity, r.gradient, r.best_weights)
        )
        run = TrainingRun(
            Model(config, best), [tuple(x) for x in r.log], r.best_iteration, r.restarts, r.converged, tuple(r.before), list(r.restarted)
        )
        return LoopState(r.epoch, weights, velocity, gradient, r.rate, run, r.last, r.best, r.flat, r.restart, r.elapsed_ms)

    def remove(self) -> None:
        """Remove all states of the run."""
        remove_path(self.spark, self.path)
