"""A signal per split: logistic regression by distributed Newton steps, and its forecasts of test rows.

Each step is one pass over the training rows: batches become a gradient, a matrix of second derivatives and a loss for each
split they hold rows of; those are added up and solved by split. Only the models are on the driver: a row of
features + 1 numbers for each split.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.operators.windows import by_ticker

MODEL = "split_id int, n_train long, n_steps int, loss double, intercept double, weights array<double>"
SUMS = "split_id int, n long, loss double, gradient array<double>, curvature array<double>"


def next_sign(own: Column, bench: Column, key: str = "Ticker") -> Column:
    """1 if the next row's return is above the benchmark's, else 0; NULL where either is missing."""
    ahead = F.lead(own - bench).over(by_ticker(key))
    return F.when(ahead.isNotNull(), (ahead > 0).cast("int"))


def _sums(models: dict[int, np.ndarray], k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each split: what the batches add to its sums at its model. Columns: split_id, label, features."""
    total: dict[int, list] = {}
    for b in batches:
        split = b.column(0).to_numpy()
        y = b.column(1).to_numpy()
        x = np.stack([np.ones(len(y)), *(c.to_numpy() for c in b.columns[2:])], 1)
        for s in np.unique(split).tolist():
            if s not in models:
                continue
            at = split == s
            xs, ys = x[at], y[at]
            z = xs @ models[s]
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            was = total.setdefault(s, [0, 0.0, np.zeros(k), np.zeros((k, k))])
            was[0] += len(ys)
            was[1] += float(np.logaddexp(0, np.where(ys > 0, -z, z)).sum())
            was[2] += xs.T @ (p - ys)
            was[3] += (xs * (p * (1 - p))[:, None]).T @ xs
    keys = list(total)
    yield pa.record_batch([pa.array(keys, pa.int32()), pa.array([total[s][0] for s in keys], pa.int64()), pa.array([total[s][1] for s in keys], pa.float64()), pa.array([total[s][2].tolist() for s in keys], pa.list_(pa.float64())), pa.array([total[s][3].ravel().tolist() for s in keys], pa.list_(pa.float64()))], ["split_id", "n", "loss", "gradient", "curvature"])


def _together(part: pa.Table) -> pa.Table:
    """One split's sums of all tasks, added up one by one."""
    add = lambda c: np.sum([np.asarray(x.values) for x in part[c].combine_chunks()], axis=0)
    return pa.table({"split_id": part["split_id"][:1], "n": [int(np.sum(part["n"].to_numpy()))], "loss": [float(np.sum(part["loss"].to_numpy()))], "gradient": pa.array([add("gradient")], pa.list_(pa.float64())), "curvature": pa.array([add("curvature")], pa.list_(pa.float64()))})


def fit(assigned: DataFrame, features: Sequence[str], label: str = "label", ridge: float = 1.0, steps: int = 50, tolerance: float = 1e-12) -> DataFrame:
    """(split_id, n_train, n_steps, loss, intercept, weights) of each split that has training rows.

    ``assigned`` has split_id and part; training rows with a NULL label or feature teach nothing. The loss is the sum of
    negative log likelihoods plus ``ridge`` / 2 times the sum of squared weights, without the intercept. A step that
    makes the loss larger is halved. A split is done when a step promises less than ``tolerance`` of the loss, or after ``steps`` passes.
    """
    k = len(features) + 1
    needed = [F.col("split_id").cast("int").alias("split_id"), F.col(label).cast("double").alias("y"), *(F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(features))]
    rows = assigned.where("part = 'train'").select(*needed).dropna().persist()
    penalty = ridge * np.diag([0.0] + [1.0] * (k - 1))
    ids = sorted(r[0] for r in rows.select("split_id").distinct().collect())  # a row per split
    now = {s: np.zeros(k) for s in ids}  # where the next pass looks
    best: dict[int, tuple[float, np.ndarray, int]] = {}  # loss, model and rows of the last step that was taken
    way: dict[int, np.ndarray] = {}
    taken, open_ = dict.fromkeys(ids, 0), set(ids)
    for _ in range(steps):
        if not open_:
            break
        models = {s: now[s] for s in open_}
        sums = rows.mapInArrow(lambda b, m=models: _sums(m, k, b), SUMS).groupBy("split_id").applyInArrow(_together, SUMS)
        for r in sums.collect():  # a row per split
            s, w = r["split_id"], now[r["split_id"]]
            loss = r["loss"] + 0.5 * float(w @ penalty @ w)
            taken[s] += 1
            if s in best and loss > best[s][0] * (1 + 1e-12):
                way[s] = way[s] / 2
                now[s] = best[s][1] + way[s]
                if np.abs(way[s]).max() < 1e-14:
                    open_.discard(s)
                continue
            best[s] = (loss, w, r["n"])
            gradient = np.array(r["gradient"]) + penalty @ w
            curvature = np.array(r["curvature"]).reshape(k, k) + penalty
            way[s] = -np.linalg.lstsq(curvature, gradient, rcond=None)[0]
            now[s] = w + way[s]
            if -float(gradient @ way[s]) <= tolerance * max(loss, 1e-300):
                best[s] = (loss, now[s], r["n"])  # so small a step is taken without another pass
                open_.discard(s)
    rows.unpersist()
    out = [(s, best[s][2], taken[s], best[s][0], float(best[s][1][0]), best[s][1][1:].tolist()) for s in ids]
    return assigned.sparkSession.createDataFrame(out, MODEL)


def forecasts(assigned: DataFrame, models: DataFrame, features: Sequence[str]) -> DataFrame:
    """Test rows with ``p``, the probability that the label is 1; NULL where a feature is. Splits without a model give no rows."""
    known = models.select("split_id", F.col("intercept").alias("_b"), F.col("weights").alias("_w"))
    z = F.col("_b")
    for i, c in enumerate(features):
        z = z + F.col("_w")[i] * F.col(f"`{c}`").cast("double")
    test = assigned.where("part = 'test'").join(F.broadcast(known), "split_id")  # a row per split
    return test.withColumn("p", 1 / (1 + F.exp(-z))).select(*assigned.columns, "p")
