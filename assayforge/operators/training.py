"""A linear classifier of several labels at once, trained on the masked, class-weighted focal loss.

The loss is that of ``losses.masked_focal_loss`` with the class weights of the whole table. A step is one
aggregation: each task sums loss and gradient over its Arrow batches, Spark adds the tasks' sums up, and the
driver, which holds the weights and the optimiser's state only, moves the weights.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayforge.operators.losses import EPSILON, GAMMA, class_weights
from assayforge.schemas import LABEL_MISSING
from assayforge.session import pinned


@dataclass(frozen=True)
class Objective:
    """The loss of one table: class weights of each label, and how rows are averaged.

    ``macro``: each row's weighted mean over its known labels, then the mean over the rows that have one, with
    class weights per label; otherwise one weighted mean over all known labels, with pooled class weights.
    ``penalty`` times half the squared weights, without the intercepts, is added.
    """

    labels: tuple[str, ...]
    alpha: np.ndarray  # a row a label: weight of class 0, weight of class 1
    macro: bool = True
    gamma: float = GAMMA
    epsilon: float = EPSILON
    missing: int = LABEL_MISSING
    penalty: float = 0.0

    def sums(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float, np.ndarray]:
        """Loss and gradient summed over rows, and what they have to be divided by.

        ``y`` holds 0, 1 and anything else for a missing label; ``weights`` a row a label, its last the intercept.
        """
        z = x @ weights[:, :-1].T + weights[:, -1]
        known = (y == 0) | (y == 1)
        sign = np.where(y == 1, 1.0, -1.0)
        true = 1.0 / (1.0 + np.exp(-np.clip(sign * z, -700, 700)))
        kept = np.clip(true, self.epsilon, 1 - self.epsilon)
        alpha = np.where(known, np.where(y == 1, self.alpha[:, 1], self.alpha[:, 0]), 0.0)
        total = alpha.sum(1)
        share = alpha / np.where(total > 0, total, 1.0)[:, None] if self.macro else alpha
        term = -((1 - kept) ** self.gamma) * np.log(kept)
        slope = self.gamma * (1 - kept) ** (self.gamma - 1) * np.log(kept) - (1 - kept) ** self.gamma / kept
        pull = share * sign * slope * true * (1 - true) * (kept == true)
        norm = float((total > 0).sum()) if self.macro else float(total.sum())
        return float((share * term).sum()), norm, np.column_stack([pull.T @ x, pull.sum(0)])

    def mean(self, loss: float, norm: float, gradient: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray]:
        plain = np.column_stack([weights[:, :-1], np.zeros(len(weights))])
        norm = norm or 1.0  # no known label: loss and gradient are 0
        return float(loss / norm + self.penalty * (plain**2).sum() / 2), gradient / norm + self.penalty * plain


def objective(df: DataFrame, labels: Sequence[str], *, macro: bool = True, **options) -> Objective:
    """The objective of ``df``, whose class weights cover all of its rows."""
    rows = {r["label"]: r for r in class_weights(df, labels).collect()}  # a row a label
    alpha = np.array([[rows[c]["alpha0"], rows[c]["alpha1"]] for c in labels], float)
    if not macro:
        n = [float(sum(rows[c][k] for c in labels)) for k in ("n0", "n1")]
        raw = [1 / math.sqrt(k) if k else 0.0 for k in n]
        weighted = sum(r * k for r, k in zip(raw, n, strict=True))
        alpha = np.tile([r * sum(n) / weighted if weighted else 0.0 for r in raw], (len(labels), 1))
    return Objective(tuple(labels), alpha, macro, **options)


def training_rows(df: DataFrame, features: str, labels: Sequence[str]) -> DataFrame:
    """(features array<double>, y array<int>) of ``df``; ``features`` is a vector or an array, labels may be null."""
    column = F.col(features)
    array = vector_to_array(column) if isinstance(df.schema[features].dataType, VectorUDT) else column.cast("array<double>")
    return df.select(array.alias("features"), F.array(*[F.coalesce(F.col(c).cast("int"), F.lit(-1)) for c in labels]).alias("y"))


def loss_and_gradient(rows: DataFrame, goal: Objective, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Loss and gradient over all ``training_rows`` at ``weights``: one aggregation, a row a weight on the driver."""
    size = weights.shape[1] - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, norm, gradient = 0.0, 0.0, np.zeros(weights.shape)
        for batch in batches:
            x, y = batch.column(0), batch.column(1)
            flat = x.flatten().to_numpy(zero_copy_only=False)
            if x.null_count or len(flat) != size * len(x) or not np.isfinite(flat.astype(float)).all():
                raise ValueError(f"features must be {size} finite numbers in every row")
            parts = goal.sums(flat.reshape(len(x), size), y.flatten().to_numpy().reshape(len(x), len(goal.labels)), weights)
            loss, norm, gradient = loss + parts[0], norm + parts[1], gradient + parts[2]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(weights.size + 2)), pa.array(np.concatenate([[loss, norm], gradient.ravel()]))],
            ["place", "value"])

    sums = np.zeros(weights.size + 2)
    for row in rows.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("v")).collect():
        sums[row["place"]] = row["v"]
    return goal.mean(sums[0], sums[1], sums[2:].reshape(weights.shape), weights)


# --- optimisers: functions of the weights and a state that can be stored -----------------------------------

Gradient = Callable[[np.ndarray], tuple[float, np.ndarray]]


@dataclass
class State:
    """Where a fit stands: step, weights, and the optimiser's own arrays by name."""

    step: int
    weights: np.ndarray
    kept: dict[str, np.ndarray] = field(default_factory=dict)
    done: bool = False

    def to_json(self) -> str:
        return json.dumps({"step": self.step, "done": self.done, "weights": self.weights.tolist(),
                           "kept": {k: v.tolist() for k, v in self.kept.items()}})

    @staticmethod
    def from_json(text: str) -> State:
        held = json.loads(text)
        return State(held["step"], np.array(held["weights"]), {k: np.array(v) for k, v in held["kept"].items()}, held["done"])


def adam_step(state: State, gradient: Gradient, *, rate: float = 0.05, decay: float = 0.9, decay2: float = 0.999,
              epsilon: float = 1e-7) -> State:
    """One step of Adam (Kingma and Ba) over the whole table."""
    _, g = gradient(state.weights)
    t = state.step + 1
    first = decay * state.kept.get("first", 0.0) + (1 - decay) * g
    second = decay2 * state.kept.get("second", 0.0) + (1 - decay2) * g**2
    moved = rate * (first / (1 - decay**t)) / (np.sqrt(second / (1 - decay2**t)) + epsilon)
    return State(t, state.weights - moved, {"first": first, "second": second})


def lbfgs_step(state: State, gradient: Gradient, *, memory: int = 8, tolerance: float = 1e-9, halvings: int = 40) -> State:
    """One step of limited-memory BFGS with backtracking; done where the gradient or the step vanishes."""
    kept = state.kept
    loss, g = (float(kept["loss"]), kept["gradient"]) if "loss" in kept else gradient(state.weights)
    moves, turns = list(kept.get("moves", [])), list(kept.get("turns", []))
    if np.abs(g).max() <= tolerance:
        return State(state.step, state.weights, kept, True)
    direction, scales = g.copy(), []
    for s, y in zip(reversed(moves), reversed(turns), strict=True):
        scales.append((s * direction).sum() / (s * y).sum())
        direction -= scales[-1] * y
    if moves:
        direction *= (moves[-1] * turns[-1]).sum() / (turns[-1] ** 2).sum()
    for s, y, scale in zip(moves, turns, reversed(scales), strict=True):
        direction += (scale - (y * direction).sum() / (s * y).sum()) * s
    length = 1.0 if moves else min(1.0, 1.0 / np.abs(g).sum())
    fall = (g * direction).sum()
    for _ in range(halvings):
        weights = state.weights - length * direction
        new_loss, new_g = gradient(weights)
        if new_loss <= loss - 1e-4 * length * fall:
            break
        length /= 2
    else:
        return State(state.step, state.weights, kept, True)
    move, turn = weights - state.weights, new_g - g
    if (move * turn).sum() > 1e-14 * (turn**2).sum():  # keeps the implied curvature positive
        moves, turns = [*moves, move][-memory:], [*turns, turn][-memory:]
    held = {"loss": np.array(new_loss), "gradient": new_g}
    if moves:
        held |= {"moves": np.array(moves), "turns": np.array(turns)}
    return State(state.step + 1, weights, held)


STEPS = {"adam": adam_step, "lbfgs": lbfgs_step}


def minimise(gradient: Gradient, start: State, *, optimiser: str = "lbfgs", steps: int = 100,
             after: Callable[[State], None] = lambda state: None, **options) -> State:
    """The state after ``steps`` steps, or earlier where the optimiser is done; ``after`` sees every step."""
    state = start
    while state.step < steps and not state.done:
        state = STEPS[optimiser](state, gradient, **options)
        after(state)
    return state


# --- the classifier ------------------------------------------------------------------------------------

@dataclass(frozen=True)
class LinearLabels:
    """A weight a feature and an intercept for every label."""

    labels: tuple[str, ...]
    weights: np.ndarray

    def columns(self, features: Column) -> list[Column]:
        """The probability of every label from an array of features, as ``<label>_pred``."""
        out = []
        for label, row in zip(self.labels, self.weights.tolist(), strict=True):
            products = F.zip_with(features, F.array(*map(F.lit, row[:-1])), lambda x, w: x * w)
            z = F.aggregate(products, F.lit(row[-1]), lambda total, x: total + x)
            out.append((F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).alias(f"{label}_pred"))
        return out


def last_state(spark: SparkSession, progress: str) -> State | None:
    """The newest state stored below ``progress``, None if there is none."""
    try:
        held = spark.read.schema("state string, step int").parquet(progress)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    newest = held.orderBy(F.desc("step")).limit(1).collect()
    return State.from_json(newest[0]["state"]) if newest else None


def train_focal_labels(df: DataFrame, labels: Sequence[str], *, features: str = "features", macro: bool = True, steps: int = 100,
                       optimiser: str = "lbfgs", penalty: float = 0.0, gamma: float = GAMMA, epsilon: float = EPSILON,
                       missing: int = LABEL_MISSING, progress: str | None = None, store_every: int = 1, **options) -> LinearLabels:
    """A linear classifier of all ``labels`` together, fitted on the masked focal loss of ``df``.

    Labels are 0 or 1; null, ``missing`` and any other code take no part, and a row without a known label has
    no effect. Features must be finite and equally many in every row, or the fit raises. Weights start at 0.
    With ``progress``, a folder that all executors can reach, the state is stored there every ``store_every``
    steps, and a fit that finds one goes on from it: a restart gives what an unbroken fit gives.
    """
    spark = df.sparkSession
    rows = pinned(training_rows(df, features, labels))
    goal = objective(df, labels, macro=macro, gamma=gamma, epsilon=epsilon, missing=missing, penalty=penalty)
    sizes = rows.agg(F.max(F.size("features"))).scalar()
    size = spark.range(1).select(sizes.alias("n")).first()["n"] or 0
    state = (last_state(spark, progress) if progress else None) or State(0, np.zeros((len(labels), size + 1)))

    def store(state: State) -> None:
        if progress and (state.step % store_every == 0 or state.done or state.step == steps):
            spark.createDataFrame([(state.to_json(),)], "state string").write.mode("overwrite").parquet(f"{progress}/step={state.step}")

    final = minimise(lambda weights: loss_and_gradient(rows, goal, weights), state, optimiser=optimiser, steps=steps, after=store,
                     **options)
    return LinearLabels(tuple(labels), final.weights)


def score_focal_labels(df: DataFrame, model: LinearLabels, *, features: str = "features", keep: Sequence[str]) -> DataFrame:
    """``keep`` columns and one ``<label>_pred`` each, by column expressions."""
    column = F.col(features)
    array = vector_to_array(column) if isinstance(df.schema[features].dataType, VectorUDT) else column.cast("array<double>")
    return df.select(*keep, *model.columns(array))
