"""Drawings of small graphs for reports: spring layout and a self-contained page. For the entities with most edges."""

from __future__ import annotations

import html

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Nodes a drawing shows at most; a limit of the drawing, not of the graph.
NODES = 220


def layout(n: int, edges: list[tuple[int, int]], width: float = 1100, height: float = 680, rounds: int = 200, seed: int = 42) -> np.ndarray:
    """Places of n nodes: all push each other away, edges pull, steps shrink."""
    rng = np.random.default_rng(seed)
    p = rng.random((n, 2)) * [width, height]
    if n < 2:
        return p
    k = np.sqrt(width * height / n)
    a = np.array([e[0] for e in edges], int)
    b = np.array([e[1] for e in edges], int)
    for step in range(rounds):
        gap = p[:, None] - p[None, :]
        far = np.maximum(np.sqrt((gap**2).sum(-1)), 0.01)
        move = (gap * (k * k / far**2)[..., None]).sum(1)
        if len(a):
            d = p[a] - p[b]
            pull = d * (np.sqrt((d**2).sum(-1, keepdims=True)) / k)
            np.add.at(move, a, -pull)
            np.add.at(move, b, pull)
        size = np.maximum(np.sqrt((move**2).sum(-1, keepdims=True)), 0.01)
        p = np.clip(p + move / size * np.minimum(size, width / 10 * (1 - step / rounds)), 0, [width, height])
    return p


def page(edges: DataFrame, title: str, nodes: int = NODES) -> str:
    """A page with the entities of most edges and the edges among them; ties go by id."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").count()
    top = [r["id"] for r in ends.orderBy(F.desc("count"), "id").limit(nodes).collect()]
    place = {x: i for i, x in enumerate(top)}
    among = edges.filter(F.col("src").isin(top) & F.col("dst").isin(top)).select("src", "dst").distinct().collect() if top else []
    pairs = [(place[r["src"]], place[r["dst"]]) for r in among]
    p = layout(len(top), pairs)
    lines = "".join(f'<line x1="{p[a][0]:.0f}" y1="{p[a][1]:.0f}" x2="{p[b][0]:.0f}" y2="{p[b][1]:.0f}"/>' for a, b in pairs)
    dots = "".join(f'<circle cx="{x:.0f}" cy="{y:.0f}" r="5"><title>{html.escape(top[i])}</title></circle>' for i, (x, y) in enumerate(p))
    return f'<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><svg viewBox="0 0 1100 680" stroke="#888" fill="#246">{lines}{dots}</svg>'
