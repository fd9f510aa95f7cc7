"""One-dimensional mixtures and depth filters (inventory ids G1, G2, G5, G8)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mixture(x: np.ndarray, w: np.ndarray, k: int, least_sd: float = 0.1, same: list[list[int]] | None = None, seed: int = 12345, most: int = 500, patience: int = 50) -> tuple[np.ndarray, float]:
    """Hard labels and log likelihood of a weighted mixture of k normals.

    Weights are brought to mean 1. Labels start as equal slices of the falling order. A
    deviation is at least least_sd times the mean. Values of one list in ``same`` share a
    label. An empty cluster takes the value that costs least. It ends at a relative change
    of 0.001, after ``most`` rounds, or ``patience`` rounds without a better likelihood.
    """
    n = len(x)
    w = w * n / w.sum()
    label = np.empty(n, dtype=int)
    label[np.argsort(-x, kind="stable")] = np.arange(n) * k // n
    tied = [np.array(s) for s in (same or []) if len(s) > 1]
    best, best_label, last, idle = -np.inf, label, None, 0
    for _ in range(most):
        for group in tied:
            label[group] = np.bincount(label[group], weights=w[group], minlength=k).argmax()
        weight = np.bincount(label, weights=w, minlength=k)
        full = weight > 0
        mean = np.where(full, np.bincount(label, weights=w * x, minlength=k) / np.where(full, weight, 1), 0)
        var = np.bincount(label, weights=w * (x - mean[label]) ** 2, minlength=k) / np.where(full, weight, 1)
        sd = np.maximum(np.sqrt(var), np.maximum(least_sd * np.abs(mean), 1e-9))
        density = -((x[:, None] - mean) ** 2) / (2 * sd**2) - np.log(sd * np.sqrt(2 * np.pi)) + np.log(np.maximum(weight, 1e-300))
        density[:, ~full] = -np.inf
        gain = density * w[:, None]
        loglike = float(gain[np.arange(n), label].sum() - w.sum() * np.log(w.sum()))
        if loglike > best + 1e-12:
            best, best_label, idle = loglike, label.copy(), 0
        else:
            idle += 1
        if idle >= patience or (last is not None and abs(loglike - last) <= 0.001 * abs(last)):
            break
        last = loglike
        new = gain.argmax(axis=1)
        for c in np.flatnonzero(np.bincount(new, minlength=k) == 0):
            size = np.bincount(new, minlength=k)
            free = np.flatnonzero(size[new] > 1)
            if len(free):
                cost = gain[free, new[free]]
                new[free[cost.argmin()]] = c
        label = new
    return best_label, best


def cluster_bic(x: np.ndarray, w: np.ndarray, least: int = 1, most: int = 5, least_sd: float = 0.1, same: list[list[int]] | None = None) -> np.ndarray:
    """Labels of the mixture of least BIC, 2k parameters each; clusters are numbered by falling mean."""
    n = len(x)
    found = []
    for k in range(least, min(most, n) + 1):
        label, loglike = mixture(x, w, k, least_sd, same)
        found.append((2 * k * np.log(n) - 2 * loglike, k, label))
    label = min(found, key=lambda f: f[:2])[2]
    means = {c: np.average(x[label == c], weights=w[label == c]) for c in np.unique(label)}
    order = {c: i for i, c in enumerate(sorted(means, key=lambda c: -means[c]))}
    return np.array([order[c] for c in label])


def cluster_groups(rows: DataFrame, keys: list[str], id_col: str, value: str, weight: str, least: int = 1, most: int = 5, least_sd: float = 0.1) -> DataFrame:
    """(keys, id, label): cluster_bic within each key (G1).

    A key is one task's work in numpy: keys are meant to be components or samples.
    """
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, id_col]) + ", label int"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([value, id_col], ascending=[False, True], kind="stable")
        out = part[[*keys, id_col]].copy()
        out["label"] = cluster_bic(part[value].to_numpy(float), part[weight].to_numpy(float), least, most, least_sd)
        return out

    return rows.where(F.col(value).isNotNull() & (F.col(weight) > 0)).select(*keys, id_col, value, weight).groupBy(*keys).applyInPandas(run, schema)


def filter_by_depth(vertices: DataFrame, key: str, factor: float = 5.0, least_sd: float = 0.1) -> DataFrame:
    """(v, kept): vertices of each key's target whose depth goes with the rest.

    vertices: (key, v, len, cov, weight), weight being the target's. The standard is the
    depth of the heaviest vertex; what is below standard/factor goes; of the clusters of the
    rest those stay that hold a weighted vertex, or whose mean is within two deviations of one.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("v").reset_index(drop=True)
        kept = np.zeros(len(part), dtype=bool)
        standard = part["cov"][part["weight"].fillna(0).idxmax()]
        alive = np.flatnonzero(part["cov"].to_numpy() * factor >= standard)
        if len(alive):
            x, w = part["cov"].to_numpy(float)[alive], part["len"].to_numpy(float)[alive]
            label = cluster_bic(x, w, 1, min(5, len(alive)), least_sd)
            tagged = set(label[part["weight"].fillna(0).to_numpy()[alive] > 0])
            stat = {}
            for c in np.unique(label):
                m = np.average(x[label == c], weights=w[label == c])
                stat[c] = m, np.sqrt(np.average((x[label == c] - m) ** 2, weights=w[label == c]))
            near = {c for c in stat if any(abs(stat[c][0] - stat[t][0]) <= 2 * stat[t][1] for t in tagged)}
            kept[alive] = [c in tagged or c in near for c in label]
        return pd.DataFrame({"v": part["v"], "kept": kept})

    return vertices.groupBy(key).applyInPandas(run, "v string, kept boolean")


def clean_loci(hits: DataFrame, components: DataFrame, drop: float = 20.0) -> DataFrame:
    """hits (v, db, locus, weight, cov, len) with keep: not in a component far lighter than the locus's heaviest, nor in a minor depth cluster."""
    t = hits.join(components, "v")
    sums = t.groupBy("db", "locus", "component").agg(F.sum("weight").alias("__w"))
    top = sums.groupBy("db", "locus").agg(F.max("__w").alias("__m"))
    strong = t.join(sums.join(top, ["db", "locus"]).where(F.col("__w") * drop >= F.col("__m")).select("db", "locus", "component"), ["db", "locus", "component"], "left_semi")
    labels = cluster_groups(strong, ["db", "locus"], "v", "cov", "len")
    mass = strong.join(labels, ["db", "locus", "v"]).groupBy("db", "locus", "label").agg(F.sum("weight").alias("mass"))
    main = mass.groupBy("db", "locus").agg(F.max_by("label", F.struct("mass", -F.col("label"))).alias("label"))
    good = labels.join(main, ["db", "locus", "label"], "left_semi").select("db", "locus", "v").withColumn("keep", F.lit(True))
    return hits.join(good, ["db", "locus", "v"], "left").withColumn("keep", F.coalesce("keep", F.lit(False)))
