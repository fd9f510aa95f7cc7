"""Integer multiplicities of vertices (inventory id G4): branch and bound in each component."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def multiplicities(target: dict[str, float], balance: list[tuple[list[str], list[str]]], slack: int = 4, most_nodes: int = 200_000) -> dict[str, int] | None:
    """Least-squares integers x_v >= 1 near target, under sum(x in left) = sum(x in right) for each balance.

    x_v is at most slack * ceil(max/min of target). Values are tried nearest first and a
    branch ends when its cost reaches the best one found, or when a balance can't be met by
    what is still free. Divided by their common divisor. None if there is no solution;
    most_nodes bounds the search, after which the best so far stands.
    """
    names = sorted(target, key=lambda v: (-sum(v in a or v in b for a, b in balance), v))
    top = slack * max(1, math.ceil(max(target.values()) / max(min(target.values()), 1e-9)))
    where = {v: [i for i, (a, b) in enumerate(balance) if v in a or v in b] for v in names}
    coefficient = [{v: a.count(v) - b.count(v) for v in {*a, *b}} for a, b in balance]
    total = [0] * len(balance)
    low = [sum(min(c, c * top) for c in k.values()) for k in coefficient]
    high = [sum(max(c, c * top) for c in k.values()) for k in coefficient]
    best: list = [math.inf, None]
    seen = [0]
    chosen: dict[str, int] = {}

    def visit(i: int, cost: float) -> None:
        seen[0] += 1
        if cost >= best[0] or seen[0] > most_nodes:
            return
        if i == len(names):
            best[:] = cost, dict(chosen)
            return
        v = names[i]
        for x in sorted(range(1, top + 1), key=lambda x: (abs(x - target[v]), x)):
            more = cost + (x - target[v]) ** 2
            if more >= best[0]:
                break
            saved = [(j, total[j], low[j], high[j]) for j in where[v]]
            good = True
            for j in where[v]:
                c = coefficient[j][v]
                total[j] += c * x
                low[j] -= min(c, c * top)
                high[j] -= max(c, c * top)
                good &= total[j] + low[j] <= 0 <= total[j] + high[j]
            if good:
                chosen[v] = x
                visit(i + 1, more)
                chosen.pop(v)
            for j, t, lo, hi in saved:
                total[j], low[j], high[j] = t, lo, hi

    visit(0, 0.0)
    if best[1] is None:
        return None
    common = math.gcd(*best[1].values())
    return {v: x // common for v, x in best[1].items()}


def flow_balances(vertices: list[str], edges: list[tuple[str, bool, str, bool]]) -> list[tuple[list[str], list[str]]]:
    """Balances of a graph: where all ends that one end meets meet only that end, copies on both sides agree."""
    meets: dict[tuple[str, bool], set] = {}
    for v1, e1, v2, e2 in edges:
        meets.setdefault((v1, e1), set()).add((v2, e2))
        meets.setdefault((v2, e2), set()).add((v1, e1))
    out, done = [], set()
    for end in sorted(meets):
        others = meets[end]
        back = set().union(*(meets[o] for o in others))
        # a complete two-sided join: every end of one side meets every end of the other
        if end in done or any(meets[o] != back for o in others) or back & others:
            continue
        done |= back | others
        out.append((sorted(v for v, _ in back), sorted(v for v, _ in others)))
    return out


def solve_components(vertices: DataFrame, edges: DataFrame, components: DataFrame) -> DataFrame:
    """(v, copy): multiplicities of each component's vertices (v, float_copy); null where there is no solution."""
    links = edges.join(components.withColumnRenamed("v", "v1"), "v1").select(F.col("component").alias("of"), "v1", "e1", "v2", "e2")
    nodes = vertices.join(components, "v").select("component", "v", "float_copy")

    def run(key, nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        target = dict(zip(nodes["v"], nodes["float_copy"].astype(float)))
        known = multiplicities(target, flow_balances(list(target), list(links[["v1", "e1", "v2", "e2"]].itertuples(index=False, name=None)))) if target else {}
        return pd.DataFrame({"v": list(target), "copy": pd.array([(known or {}).get(v) for v in target], dtype="Int32")})

    return nodes.groupBy("component").cogroup(links.groupBy("of")).applyInPandas(run, "v string, copy int")
