"""Layouts: (vid, x, y)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import uniform
from ..net import Net, per_graph
from .paths import Adjacency

XY = "vid long, x double, y double"


def layout_circle(net: Net) -> DataFrame:
    """Vertices in order around the unit circle, from (1, 0)."""
    place = F.row_number().over(Window.partitionBy("gid").orderBy("vid")) - 1
    got = net.with_n(net.vertices.select("gid", "vid")).withColumn("turn", F.lit(2 * math.pi) * place / F.col("n"))
    return net.out(got.select("gid", "vid", F.cos("turn").alias("x"), F.sin("turn").alias("y")))


def layout_random(net: Net, seed: int = 0) -> DataFrame:
    """Independent places in [-1, 1] x [-1, 1]."""
    x, y = (2 * uniform(seed, F.lit(axis), F.col("gid"), F.col("vid")) - 1 for axis in "xy")
    return net.out(net.vertices.select("gid", "vid", x.alias("x"), y.alias("y")))


def layout_fruchterman_reingold(net: Net, iterations: int = 100, seed: int = 0) -> DataFrame:
    """All vertices repel each other, ties attract; moves are limited by a temperature that falls."""

    def place(ids, m):
        n = len(ids)
        if n < 2:
            return {"vid": ids, "x": np.zeros(n), "y": np.zeros(n)}
        tied = ((m != 0) | (m.T != 0)).astype(float)
        ideal, pos, heat = math.sqrt(4 / n), np.random.default_rng(seed).uniform(-1, 1, (n, 2)), 0.5
        for _ in range(iterations):
            gap = pos[:, None] - pos[None]
            far = np.maximum(np.sqrt((gap**2).sum(axis=2)), 1e-9)
            force = ideal**2 / far**2 - tied * far / ideal
            np.fill_diagonal(force, 0.0)
            move = (gap * force[:, :, None]).sum(axis=1)
            size = np.maximum(np.sqrt((move**2).sum(axis=1)), 1e-9)
            pos += move / size[:, None] * np.minimum(size, heat)[:, None]
            heat *= 0.95
        return {"vid": ids, "x": pos[:, 0], "y": pos[:, 1]}

    return net.out(per_graph(net, place, XY))


def layout_kamada_kawai(net: Net, maxiter: int = 500, tol: float = 1e-6) -> DataFrame:
    """Places whose distances come near those in the graph, weighed by their inverse squares: stress majorization from
    classical scaling. Vertices of different components are one step farther apart than any in the same."""

    def place(ids, m):
        n = len(ids)
        if n < 2:
            return {"vid": ids, "x": np.zeros(n), "y": np.zeros(n)}
        i, j = np.nonzero((m != 0) | (m.T != 0))
        zero = np.zeros(n, np.int64)
        a = Adjacency(zero, np.arange(n), np.zeros(len(i), np.int64), i, j)
        d = np.stack([a.search(v, 0, n)[0] for v in range(n)]).astype(float)
        d[d < 0] = max(1.0, d.max() + 1) if d.max() > 0 else 1.0
        pos = classical_scaling(d)
        with np.errstate(divide="ignore"):
            w = np.where(np.eye(n, dtype=bool), 0.0, 1 / d**2)
        inverse = np.linalg.pinv(np.diag(w.sum(axis=1)) - w)
        old = stress(pos, d, w)
        for _ in range(maxiter):
            far = np.sqrt(((pos[:, None] - pos[None]) ** 2).sum(axis=2))
            b = -np.where(far > 0, w * d / np.where(far > 0, far, 1.0), 0.0)
            b -= np.diag(b.sum(axis=1))
            pos = inverse @ (b @ pos)
            new = stress(pos, d, w)
            if old - new <= tol * max(old, 2.3e-16):
                break
            old = new
        return {"vid": ids, "x": pos[:, 0], "y": pos[:, 1]}

    return net.out(per_graph(net, place, XY))


def stress(pos: np.ndarray, d: np.ndarray, w: np.ndarray) -> float:
    far = np.sqrt(((pos[:, None] - pos[None]) ** 2).sum(axis=2))
    return float((w * (far - d) ** 2).sum() / 2)


def classical_scaling(d: np.ndarray) -> np.ndarray:
    n = len(d)
    centre = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(-0.5 * centre @ (d**2) @ centre)
    top = np.argsort(-values)[:2]
    pos = np.zeros((n, 2))
    pos[:, : len(top)] = vectors[:, top] * np.sqrt(np.maximum(values[top], 0.0))
    return pos
