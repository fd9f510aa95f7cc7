"""Paths through a component (inventory ids H9, H11, H15-H17), one component a task.

Enumeration is exponential at worst; the caller's bound on the number of paths ends it.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Step = tuple[str, bool]


def _next(edges: list[tuple[str, bool, str, bool]]) -> dict[Step, list[Step]]:
    """Oriented successors: leaving (v, True) by its tail, (v, False) by its head."""
    out: dict[Step, set] = defaultdict(set)
    for v1, e1, v2, e2 in edges:
        out[v1, e1].add((v2, not e2))
        out[v2, e2].add((v1, not e1))
    return {k: sorted(v) for k, v in out.items()}


def reverse_path(path: tuple[Step, ...]) -> tuple[Step, ...]:
    return tuple((v, not d) for v, d in reversed(path))


def canonical_circle(path: tuple[Step, ...]) -> tuple[Step, ...]:
    """The least rotation of a circle or of its reverse."""
    both = (path, reverse_path(path))
    return min(p[i:] + p[:i] for p in both for i in range(len(p)))


def canonical_line(path: tuple[Step, ...]) -> tuple[Step, ...]:
    return min(path, reverse_path(path))


def _reachable(after: dict[Step, list[Step]], here: Step, left: Counter) -> bool:
    """Whether all vertices with copies left can still be reached, in either direction."""
    need = {v for v, n in left.items() if n > 0}
    seen, queue = {here}, [here]
    found = {here[0]}
    while queue:
        for step in after.get(queue.pop(), ()):
            if step not in seen and left[step[0]] > 0:
                seen.add(step)
                found.add(step[0])
                queue.append(step)
    return need <= found


def circular_paths(copies: dict[str, int], edges: list[tuple[str, bool, str, bool]], most: int = 1000) -> list[tuple[Step, ...]]:
    """All circles that use each vertex so many times, each once whatever its start and direction."""
    if not copies:
        return []
    after = _next(edges)
    start = (min(copies, key=lambda v: (copies[v], v)), True)
    found: set[tuple[Step, ...]] = set()
    left = Counter(copies)
    left[start[0]] -= 1
    stack: list[tuple[Step, list[Step], int]] = [(start, after.get(start, []), 0)]
    path = [start]
    while stack and len(found) < most:
        here, options, i = stack.pop()
        if i == 0 and not any(left.values()):
            if start in options:
                found.add(canonical_circle(tuple(path)))
            options = []
        if i < len(options):
            stack.append((here, options, i + 1))
            step = options[i]
            if left[step[0]] > 0:
                left[step[0]] -= 1
                if _reachable(after, step, left):
                    path.append(step)
                    stack.append((step, after.get(step, []), 0))
                else:
                    left[step[0]] += 1
        elif len(path) > 1 or stack:
            gone = path.pop()
            left[gone[0]] += 1
    return sorted(found)


def all_paths(copies: dict[str, int], edges: list[tuple[str, bool, str, bool]], most: int = 1000) -> list[tuple[tuple[Step, ...], ...]]:
    """All ways to use each vertex so many times in as few parts as can be; a part is a line, or a circle if it closes.

    Parts and the order of parts are canonical, so each way is there once.
    """
    after = _next(edges)
    found: set = set()
    for parts in range(1, sum(copies.values()) + 1):
        seen: set = set()

        def walk(path: tuple[Step, ...], done: tuple, left: tuple, room: int) -> None:
            if len(found) >= most or (path, done, left) in seen:
                return
            seen.add((path, done, left))
            have = dict(left)
            if not any(have.values()):
                found.add(tuple(sorted((*done, canonical_line(path)))))
                return
            for v, d in after.get(path[-1], ()):
                if have[v] > 0:
                    walk((*path, (v, d)), done, tuple((k, n - (k == v)) for k, n in left), room)
            if room > 1:
                begin(tuple((*done, canonical_line(path))), left, room - 1)

        def begin(done: tuple, left: tuple, room: int) -> None:
            for v, n in left:
                if n > 0:
                    for d in (True, False):
                        walk(((v, d),), done, tuple((k, m - (k == v)) for k, m in left), room)

        begin((), tuple(sorted(copies.items())), parts)
        if found:
            break
    return sorted(found)


def is_sequential_repeat(v: str, edges: list[tuple[str, bool, str, bool]]) -> bool:
    """Whether v, with two ends on each side, closes an inner circle: one of its two ways out leads back in and nowhere else (H9)."""
    after = _next(edges)
    outs, ins = after.get((v, True), []), after.get((v, False), [])
    if len(outs) != 2 or len(ins) != 2:
        return False
    for first in outs:
        seen, queue = {first}, [first]
        closed = first != (v, True)
        while queue and closed:
            here = queue.pop()
            back = after.get((here[0], not here[1]), [])
            if here[0] == v:
                continue
            # nothing else may lead in or out
            if any((b[0], not b[1]) not in seen and b[0] != v for b in back):
                closed = False
            for step in after.get(here, []):
                if step[0] != v and step not in seen:
                    seen.add(step)
                    queue.append(step)
                if step == (v, False):
                    closed = False
        if closed and any(s == (v, True) for here in seen for s in after.get(here, [])):
            return True
    return False


def best_linear(tags: dict[str, float], edges: list[tuple[str, bool, str, bool]], lengths: dict[str, int], most_gap: int) -> tuple[Step, ...]:
    """The path of greatest tag weight, with untagged stretches of at most most_gap bases, no vertex twice."""
    after = _next(edges)
    best: tuple[float, tuple[Step, ...]] = (0.0, ())

    def walk(path: tuple[Step, ...], weight: float, gap: int) -> None:
        nonlocal best
        if gap == 0 and (weight, ) > (best[0], ):
            best = weight, canonical_line(path)
        used = {v for v, _ in path}
        for step in after.get(path[-1], ()):
            if step[0] not in used:
                tagged = tags.get(step[0], 0.0)
                wide = 0 if tagged > 0 else gap + lengths[step[0]]
                if wide <= most_gap:
                    walk((*path, step), weight + max(tagged, 0.0), wide)

    for v in sorted(tags):
        if tags[v] > 0:
            for d in (True, False):
                walk(((v, d),), tags[v], 0)
    return best[1]


def circular_paths_of(vertices: DataFrame, edges: DataFrame, components: DataFrame, most: int = 1000) -> DataFrame:
    """(component, path_id, nth, v, fwd) of all circles of each component; vertices: (v, copy)."""
    links = edges.join(components.withColumnRenamed("v", "v1"), "v1").select(F.col("component").alias("of"), "v1", "e1", "v2", "e2")
    nodes = vertices.join(components, "v").select("component", "v", "copy")
    kind = dict(components.dtypes)["component"]

    def run(key, nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        found = circular_paths(dict(zip(nodes["v"], nodes["copy"].astype(int))), list(links[["v1", "e1", "v2", "e2"]].itertuples(index=False, name=None)), most)
        rows = [(key[0], p, i, v, d) for p, path in enumerate(found) for i, (v, d) in enumerate(path)]
        return pd.DataFrame(rows, columns=["component", "path_id", "nth", "v", "fwd"])

    return nodes.groupBy("component").cogroup(links.groupBy("of")).applyInPandas(run, f"component {kind}, path_id int, nth int, v string, fwd boolean")


def rank_paths(paths: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, path_id, score, pattern): mean distance along a path between copies of a vertex, ranked from the greatest."""
    by = by or []
    at = paths.select(*by, "path_id", "v", "nth")
    other = at.withColumnRenamed("nth", "m")
    pairs = at.join(other, [*by, "path_id", "v"]).where("nth < m")
    score = pairs.groupBy(*by, "path_id").agg(F.round(F.avg(F.col("m") - F.col("nth")), 6).alias("score"))
    t = paths.select(*by, "path_id").distinct().join(score, [*by, "path_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return t.withColumn("pattern", F.dense_rank().over(Window.partitionBy(*by).orderBy(F.desc("score"))))
