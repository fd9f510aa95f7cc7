"""Graphs of two-ended vertices (inventory ids H2-H8, H10, H12, H18-H24, E13, G3).

vertices: (v, len, cov, seq); edges: (v1, e1, v2, e2, overlap), each undirected link
there in both directions, where an end is true for a tail and false for a head.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import strings
from .components import connected_components, ensure_checkpoint_dir


def symmetric(edges: DataFrame) -> DataFrame:
    """edges with every link in both directions, once."""
    back = edges.select(F.col("v2").alias("v1"), F.col("e2").alias("e1"), F.col("v1").alias("v2"), F.col("e1").alias("e2"), "overlap")
    return edges.select("v1", "e1", "v2", "e2", "overlap").union(back).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Each link once, the lesser end first."""
    a, b = F.struct(F.col("v1"), F.col("e1")), F.struct(F.col("v2"), F.col("e2"))
    return edges.where(a <= b).dropDuplicates(["v1", "e1", "v2", "e2"])


def remove_vertices(vertices: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without some vertices (column v) and their links (H2)."""
    left = edges.join(gone.select(F.col("v").alias("v1")), "v1", "left_anti").join(gone.select(F.col("v").alias("v2")), "v2", "left_anti")
    return vertices.join(gone.select("v"), "v", "left_anti"), left.select(*edges.columns)


def rename_vertices(vertices: DataFrame, edges: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with new names from (v, name); others keep theirs (H3)."""
    out = vertices.join(names, "v", "left").withColumn("v", F.coalesce("name", "v")).select(*vertices.columns)
    links = edges
    for end in ("v1", "v2"):
        links = links.join(names.select(F.col("v").alias(end), F.col("name").alias("__n")), end, "left").withColumn(end, F.coalesce("__n", end)).drop("__n")
    return out, links.select(*edges.columns)


def clusters(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, component) of all vertices, also of those without links (H1)."""
    found = connected_components(edges, "v1", "v2")
    return vertices.select("v").join(found.withColumnRenamed("node", "v"), "v", "left").select("v", F.coalesce("component", "v").alias("component"))


def is_connected(vertices: DataFrame, edges: DataFrame) -> bool:
    """Whether the graph is one component (H1)."""
    return clusters(vertices, edges).select("component").distinct().limit(2).count() <= 1


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, heads, tails, terminal, self_loop) (H8)."""
    by = edges.groupBy(F.col("v1").alias("v")).agg(F.count_if(~F.col("e1")).alias("heads"), F.count_if(F.col("e1")).alias("tails"), F.max((F.col("v1") == F.col("v2")) & (F.col("e1") != F.col("e2"))).alias("self_loop"))
    t = vertices.select("v").join(by, "v", "left")
    h, e = F.coalesce("heads", F.lit(0)), F.coalesce("tails", F.lit(0))
    return t.select("v", h.alias("heads"), e.alias("tails"), ((h == 0) | (e == 0)).alias("terminal"), F.coalesce("self_loop", F.lit(False)).alias("self_loop"))


def parallel_vertices(sides: DataFrame) -> DataFrame:
    """(group, v): vertices whose two ends have the same pair of neighbour sets, in either order (H5).

    sides: (v, end, neighbour), a neighbour being any comparable value.
    """
    per = sides.groupBy("v", "end").agg(F.array_sort(F.collect_set("neighbour")).alias("ns"))
    pair = per.groupBy("v").agg(F.array_sort(F.collect_list("ns")).alias("pair"))
    text = F.to_json("pair")  # a hash of nested arrays would not see where one ends
    keyed = pair.select("v", F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2"))
    groups = keyed.groupBy("k1", "k2").agg(F.min("v").alias("group"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(groups, ["k1", "k2"]).select("group", "v")


def bounded_reach(seeds: DataFrame, links: DataFrame, most_steps: int | None = None) -> DataFrame:
    """(node, quota): the most that is left at each node that a quota reaches (H6, H7).

    seeds: (node, quota); links: (a, b, cost), walked from a to b. A walk goes on while
    something is left. Only improvements are propagated; costs must be positive unless
    most_steps bounds the walk.
    """
    ensure_checkpoint_dir(seeds.sparkSession)
    links = links.groupBy("a", "b").agg(F.min("cost").alias("cost")).checkpoint()
    best = seeds.groupBy("node").agg(F.max("quota").alias("quota")).where("quota >= 0").checkpoint()
    delta, step = best, 0
    while most_steps is None or step < most_steps:
        step += 1
        offered = delta.join(links, delta["node"] == links["a"]).select(F.col("b").alias("node"), (F.col("quota") - F.col("cost")).alias("offer")).where("offer >= 0").groupBy("node").agg(F.max("offer").alias("offer"))
        delta = offered.join(best, "node", "left").where("quota IS NULL OR offer > quota").select("node", F.col("offer").alias("quota")).checkpoint()
        if delta.isEmpty():
            break
        best = best.join(delta.select("node"), "node", "left_anti").union(delta).checkpoint()
    return best


def reach_costs(vertices: DataFrame, edges: DataFrame, base_cov: float | None = None) -> DataFrame:
    """links for bounded_reach: going to a vertex costs its length less the overlap, dearer where its coverage is above base_cov (H6)."""
    factor = F.greatest(F.lit(1.0), F.col("cov") / base_cov) if base_cov else F.lit(1.0)
    cost = (F.col("len") - F.col("overlap")) * factor
    return edges.join(vertices.select(F.col("v").alias("v2"), "len", "cov"), "v2").select(F.col("v1").alias("a"), F.col("v2").alias("b"), cost.alias("cost"))


def reduce_to_reach(vertices: DataFrame, edges: DataFrame, baits: DataFrame, base_cov: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The part of the graph that baits (node, quota) reach (H6)."""
    near = bounded_reach(baits, reach_costs(vertices, edges, base_cov)).select(F.col("node").alias("v"))
    return remove_vertices(vertices, edges, vertices.select("v").join(near, "v", "left_anti"))


def tag_between(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, tagged): an untagged node with exactly two neighbours, both tagged, becomes tagged; again until nothing changes.

    nodes: (node, tagged); links: (a, b) in both directions.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    links = links.where("a <> b").select("a", "b").distinct().checkpoint()
    two = links.groupBy("a").agg(F.count("*").alias("n")).where("n = 2").select("a")
    links = links.join(two, "a").checkpoint()
    tagged = nodes.where("tagged").select("node").distinct().checkpoint()
    while True:
        open_ = links.join(tagged.select(F.col("node").alias("a")), "a", "left_anti")
        new = open_.join(tagged.select(F.col("node").alias("b")), "b", "left_semi").groupBy("a").agg(F.count("*").alias("n")).where("n = 2").select(F.col("a").alias("node")).join(nodes.select("node"), "node", "left_semi").checkpoint()
        if new.isEmpty():
            break
        tagged = tagged.union(new).checkpoint()
    return nodes.select("node").distinct().join(tagged.withColumn("t", F.lit(True)), "node", "left").select("node", F.coalesce("t", F.lit(False)).alias("tagged"))


def exclude_other(tags: DataFrame, target: str) -> DataFrame:
    """(v) of the vertices that are tagged for other targets only."""
    return tags.groupBy("v").agg(F.max(F.col("db") == target).alias("own")).where("NOT own").select("v")


def baseline(vertices: DataFrame, least_share: float = 0.9) -> tuple[float, DataFrame]:
    """Baseline depth and vertices with copy, by the fixpoint of copies and depth.

    depth = max(sum len*cov / sum len*copy, 0.9 of the least cov); copy = max(1, cov/depth
    rounded half to even); until a depth, to 5 places, has been seen before. Each step
    is one aggregate of two sums.
    """
    ensure_checkpoint_dir(vertices.sparkSession)
    v = vertices.checkpoint()
    row = v.agg(F.sum(F.col("len") * F.col("cov")).alias("mass"), F.sum("len").alias("n"), F.min("cov").alias("least")).first()
    if row["n"] is None:
        return 0.0, v.withColumn("copy", F.lit(None).cast("int"))
    floor = least_share * row["least"]
    copy = lambda m: F.greatest(F.lit(1), F.bround(F.col("cov") / F.lit(m)).cast("int"))
    depth, seen = max(row["mass"] / row["n"], floor), set()
    while round(depth, 5) not in seen:
        seen.add(round(depth, 5))
        weight = v.agg(F.sum(F.col("len") * copy(depth))).first()[0]
        depth = max(row["mass"] / weight, floor)
    return depth, v.withColumn("copy", copy(depth))


def peel(vertices: DataFrame, part: DataFrame) -> DataFrame:
    """vertices with the share of a sub-graph (v, copy), at its depth, taken off their coverage."""
    depth = baseline(vertices.join(part.select("v"), "v", "left_semi"))[0]
    return vertices.join(part.select("v", F.col("copy").alias("__c")), "v", "left").withColumn("cov", F.greatest(F.lit(0.0), F.col("cov") - F.coalesce("__c", F.lit(0)) * depth)).drop("__c")


# ---- k-mer graphs and contigs ---------------------------------------------


def kmer_graph(rows: DataFrame, s: Column, k: int, involution: str = "identity", circular: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes (kmer, cnt) and links (k1, k2, cnt) between k-mers that follow each other.

    With an involution both strands count.
    """
    line = rows.select(s.alias("s"), (circular if circular is not None else F.lit(False)).alias("c"))
    if involution != "identity":
        line = line.union(line.select(strings.involute(F.col("s"), involution), "c"))
    ks = F.when(F.col("c"), strings.circular_substrings(F.col("s"), k)).otherwise(strings.substrings(F.col("s"), k))
    chains = line.select(ks.alias("ks"), "c").where(F.size("ks") > 0)
    nodes = chains.select(F.explode("ks").alias("kmer")).groupBy("kmer").agg(F.count("*").alias("cnt"))
    n = F.size("ks")
    pairs = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct(F.get("ks", i).alias("a"), F.get("ks", i + 1).alias("b")))
    closing = F.array(F.struct(F.element_at("ks", -1).alias("a"), F.get("ks", F.lit(0)).alias("b")))
    none = F.array().cast("array<struct<a:string,b:string>>")
    linked = F.concat(F.when(n >= 2, pairs).otherwise(none), F.when(F.col("c"), closing).otherwise(none))
    links = chains.select(F.explode(linked).alias("x")).groupBy(F.col("x.a").alias("k1"), F.col("x.b").alias("k2")).agg(F.count("*").alias("cnt"))
    return nodes, links


def chains(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, chain, rank, circular): maximal unbranched runs of a directed graph, with each node's place.

    nodes: (node); links: (a, b). A link is kept if it is a's only one out and b's only
    one in; the kept ones are paths and circles. Places are found by pointer doubling, in
    as many rounds as the logarithm of the longest run; circles start at their least node.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    links = links.select("a", "b").distinct()
    out1 = links.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b")).where("n = 1").select("a", "b")
    in1 = links.groupBy("b").agg(F.count("*").alias("n")).where("n = 1").select("b")
    only = out1.join(in1, "b").where("a <> b").select("a", "b").checkpoint()
    components = nodes.select("node").join(connected_components(only, "a", "b"), "node", "left").select("node", F.coalesce("component", "node").alias("chain")).checkpoint()
    # circles: every node has a link in; cut the one into the least node
    size = components.groupBy("chain").agg(F.count("*").alias("size"))
    inner = only.join(components.withColumnRenamed("node", "b"), "b").groupBy("chain").agg(F.count("*").alias("k"))
    rings = size.join(inner, "chain").where("size = k").select("chain").withColumn("circular", F.lit(True)).checkpoint()
    open_ = only.join(rings.select(F.col("chain").alias("b")), "b", "left_anti").select(F.col("b").alias("node"), F.col("a").alias("back"))
    step = components.select("node").join(open_, "node", "left").select("node", "back", F.when(F.col("back").isNull(), 0).otherwise(1).cast("long").alias("rank")).checkpoint()
    while not step.where("back IS NOT NULL").isEmpty():
        far = step.select(F.col("node").alias("back"), F.col("back").alias("back2"), F.col("rank").alias("rank2"))
        step = step.join(far, "back", "left").select("node", F.col("back2").alias("back"), (F.col("rank") + F.coalesce("rank2", F.lit(0))).alias("rank")).checkpoint()
    return components.join(step.select("node", "rank"), "node").join(rings, "chain", "left").select("node", "chain", "rank", F.coalesce("circular", F.lit(False)).alias("circular"))


def contigs(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(contig, len, cov, circular): texts of the unbranched runs of a k-mer graph; cov is the mean count."""
    runs = chains(nodes.select(F.col("kmer").alias("node")), links.select(F.col("k1").alias("a"), F.col("k2").alias("b")))
    parts = runs.join(nodes.withColumnRenamed("kmer", "node"), "node")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "node")))
    by = parts.groupBy("chain", "circular").agg(ordered.alias("ns"), F.avg("cnt").alias("cov"), F.count("*").alias("n"))
    head = F.get("ns", F.lit(0))["node"]
    tails = F.array_join(F.transform(F.slice("ns", F.lit(2), F.size("ns")), lambda x: F.right(x["node"], F.lit(1))), "")
    ring = F.array_join(F.transform("ns", lambda x: F.left(x["node"], F.lit(1))), "")
    text = F.when(F.col("circular"), ring).otherwise(F.concat(head, tails))
    return by.select(text.alias("contig"), F.length(text).alias("len"), "cov", "circular")


def oriented(edges: DataFrame) -> DataFrame:
    """(a, b, overlap): links between oriented vertices such as x+ and x-, both strands."""
    name = lambda v, forward: F.concat(v, F.when(forward, "+").otherwise("-"))
    # leaving v1 by its tail reads it forwards; entering v2 by its head reads it forwards
    return edges.select(name(F.col("v1"), F.col("e1")).alias("a"), name(F.col("v2"), ~F.col("e2")).alias("b"), "overlap").distinct()


def merged_depth(l1: Column, c1: Column, l2: Column, c2: Column, overlap: Column) -> Column:
    """Coverage of two vertices joined at an overlap (H4)."""
    a, b = l1 - overlap + 1, l2 - overlap + 1
    return (a * c1 + b * c2) / (a + b)


def contract(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with unbranched runs of vertices joined (H4); vertices get path, the oriented names that they were made of.

    Lengths are the parts' less the overlaps; coverage is the mean weighted by each
    part's length less its overlap, plus one. Runs are walked on oriented vertices and each is there
    twice, once for each strand; the one with the lesser name is kept. A run that meets its
    own other strand is left as it is.
    """
    links = symmetric(edges)
    both = oriented(links)
    names = vertices.select(F.explode(F.array(F.concat("v", F.lit("+")), F.concat("v", F.lit("-")))).alias("node"))
    runs = chains(names, both.select("a", "b")).withColumn("v", F.expr("left(node, length(node) - 1)")).withColumn("fwd", F.col("node").endswith("+")).checkpoint()
    double = runs.groupBy("chain", "v").agg(F.count("*").alias("n")).where("n > 1").select("chain").distinct()
    runs = runs.join(double, "chain", "left_anti").union(runs.join(double, "chain", "left_semi").select("chain", "node", "rank", "circular", "v", "fwd").withColumn("chain", F.col("node")).withColumn("rank", F.lit(0).cast("long")).withColumn("circular", F.lit(False)).select(*runs.columns))
    sets = runs.groupBy("chain").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    kept = sets.groupBy("vs").agg(F.min("chain").alias("chain")).select("chain")
    own = runs.join(kept, "chain", "left_semi").join(vertices, "v")
    ahead = Window.partitionBy("chain").orderBy("rank")
    prev = own.withColumn("__p", F.lag("node").over(ahead))
    cut = prev.join(both.select(F.col("a").alias("__p"), F.col("b").alias("node"), F.col("overlap").alias("__o")), ["__p", "node"], "left").withColumn("__o", F.coalesce("__o", F.lit(0)))
    part = F.struct("rank", F.struct("v", "fwd").alias("at"), F.when(F.col("fwd"), F.col("seq")).otherwise(strings.revcomp(F.col("seq"))).alias("s"), F.col("__o").alias("o"), "cov", "len")
    by = cut.groupBy("chain", "circular").agg(F.array_sort(F.collect_list(part)).alias("ps"))
    text = F.array_join(F.transform("ps", lambda p: F.substring(p["s"], p["o"] + 1, F.length(p["s"]))), "")
    length = F.aggregate("ps", F.lit(0).cast("long"), lambda a, p: a + p["len"] - p["o"])
    # the first part has no overlap of its own: the next one's counts for it
    ahead_of = F.coalesce(F.get("ps", F.lit(1))["o"], F.lit(0))
    weight = lambda p: (p["len"] - F.when(p["rank"] == 0, ahead_of).otherwise(p["o"]) + 1).cast("double")
    cov = F.aggregate("ps", F.lit(0.0), lambda a, p: a + weight(p) * p["cov"]) / F.aggregate("ps", F.lit(0.0), lambda a, p: a + weight(p))
    name = F.array_join(F.transform("ps", lambda p: p["at"]["v"]), "_")
    merged = by.select("chain", "circular", name.alias("v"), length.alias("len"), F.when(F.size("ps") == 1, F.get("ps", F.lit(0))["cov"]).otherwise(cov).alias("cov"), text.alias("seq"), F.transform("ps", lambda p: p["at"]).alias("path")).checkpoint()
    # ends of the new vertices: the first part's entry and the last one's exit
    first, last = F.get("path", F.lit(0)), F.element_at("path", -1)
    ends = merged.select("v", F.explode(F.array(F.struct(first["v"].alias("old"), (~first["fwd"]).alias("end"), F.lit(False).alias("new_end")), F.struct(last["v"].alias("old"), last["fwd"].alias("end"), F.lit(True).alias("new_end")))).alias("x"))
    ends = ends.select(F.col("v").alias("name"), F.col("x.old").alias("old"), F.col("x.end").alias("end"), F.col("x.new_end").alias("new_end"))
    left = ends.select(F.col("old").alias("v1"), F.col("end").alias("e1"), F.col("name").alias("n1"), F.col("new_end").alias("m1"))
    right = ends.select(F.col("old").alias("v2"), F.col("end").alias("e2"), F.col("name").alias("n2"), F.col("new_end").alias("m2"))
    out = links.join(left, ["v1", "e1"]).join(right, ["v2", "e2"]).select(F.col("n1").alias("v1"), F.col("m1").alias("e1"), F.col("n2").alias("v2"), F.col("m2").alias("e2"), "overlap").distinct()
    return merged.select("v", "len", "cov", "seq", "path", "circular"), out


def path_text(paths: DataFrame, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(path_id, seq, circular): texts of paths (path_id, nth, v, fwd), overlaps trimmed.

    A path is circular if a link leads from its last vertex to its first; then the text
    loses that overlap too.
    """
    links = oriented(symmetric(edges))
    node = F.concat("v", F.when(F.col("fwd"), "+").otherwise("-"))
    t = paths.join(vertices.select("v", "seq"), "v").withColumn("node", node)
    by = Window.partitionBy("path_id").orderBy("nth")
    whole = Window.partitionBy("path_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("p", F.coalesce(F.lag("node").over(by), F.last("node").over(whole))).withColumn("is_first", F.row_number().over(by) == 1)
    t = t.join(links.select(F.col("a").alias("p"), F.col("b").alias("node"), "overlap"), ["p", "node"], "left")
    s = F.when(F.col("fwd"), F.col("seq")).otherwise(strings.revcomp(F.col("seq")))
    parts = t.withColumn("s", F.substring(s, F.coalesce("overlap", F.lit(0)) + 1, F.length("seq")))
    return parts.groupBy("path_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "s"))), lambda x: x["s"]), "").alias("seq"), F.max(F.col("is_first") & F.col("overlap").isNotNull()).alias("circular"))


# ---- slimming, purifying, bridging ----------------------------------------


def purify(vertices: DataFrame, hits: DataFrame, ratio: float = 0.12, share: float = 0.9, mask: bool = False) -> DataFrame:
    """vertices without thin copies of others.

    hits: (query, subject, qlo, qhi), 1-based. A query's bases covered by hits on vertices
    of more than 1/ratio its coverage count; from the given share of its length on it is
    dropped, below it, with mask, those bases become N.
    """
    from .intervals import merge, union_length

    cov = vertices.select(F.col("v").alias("query"), F.col("cov").alias("qc"), "len")
    other = vertices.select(F.col("v").alias("subject"), F.col("cov").alias("sc"))
    thin = hits.where("query <> subject").join(cov, "query").join(other, "subject").where(F.col("qc") / F.col("sc") < ratio).select("query", F.col("qlo").alias("lo"), F.col("qhi").alias("hi"), "len")
    gone = union_length(thin, ["query", "len"]).where(F.col("covered") >= F.col("len") * share).select(F.col("query").alias("v"))
    left = vertices.join(gone, "v", "left_anti")
    if not mask:
        return left
    spots = merge(thin, ["query"]).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("__m")).withColumnRenamed("query", "v")
    cover = lambda s, p: F.concat(F.left(s, p["lo"] - 1), F.repeat(F.lit("N"), (p["hi"] - p["lo"] + 1).cast("int")), F.substring(s, (p["hi"] + 1).cast("int"), F.length(s)))
    return left.join(spots, "v", "left").withColumn("seq", F.when(F.col("__m").isNull(), F.col("seq")).otherwise(F.aggregate("__m", F.col("seq"), cover))).select(*vertices.columns)


def bridges(ends: DataFrame, length: int, most: int, linked: DataFrame) -> DataFrame:
    """(v1, e1, v2, e2, gap, name): new links between ends that lie near each other on a circular reference.

    ends: (v, e, pos, opens), where opens is true if the vertex lies before pos and false
    if it lies after; linked: (a, b) pairs of vertices that reach each other already.
    """
    from .intervals import circular_pairs

    keyed = ends.withColumn("id", F.struct("v", "e"))
    near = circular_pairs(keyed.where("opens").select("id", "pos"), keyed.where("NOT opens").select("id", "pos"), "id", "id", "pos", length, most)
    t = near.select(F.col("a.v").alias("v1"), F.col("a.e").alias("e1"), F.col("b.v").alias("v2"), F.col("b.e").alias("e2"), "gap").where("v1 <> v2")
    t = t.join(linked.select(F.col("a").alias("v1"), F.col("b").alias("v2")).union(linked.select("b", "a")), ["v1", "v2"], "left_anti")
    return t.withColumn("name", F.concat_ws("_", F.lit("gap"), "v1", "v2"))


def gap_vertices(new: DataFrame, fill: str = "N") -> tuple[DataFrame, DataFrame]:
    """Vertices of fill characters and edges that put the bridges into a graph."""
    vertices = new.select(F.col("name").alias("v"), F.greatest(F.col("gap"), F.lit(1)).cast("long").alias("len"), F.lit(1.0).alias("cov"), F.repeat(F.lit(fill), F.greatest(F.col("gap"), F.lit(1)).cast("int")).alias("seq"))
    into = new.select("v1", "e1", F.col("name").alias("v2"), F.lit(False).alias("e2"), F.lit(0).alias("overlap"))
    out = new.select(F.col("name").alias("v1"), F.lit(True).alias("e1"), "v2", "e2", F.lit(0).alias("overlap"))
    return vertices, symmetric(into.union(out))


def scaffold_jumps(scaffolds: DataFrame) -> DataFrame:
    """(v1, e1, v2, e2, node) for every gap between neighbouring sub-paths of a scaffold.

    scaffolds: (node, sub_path, path) with path an array of (v, fwd).
    """
    by = Window.partitionBy("node").orderBy("sub_path")
    t = scaffolds.where(F.size("path") > 0).withColumn("a", F.element_at("path", -1)).withColumn("b", F.lead(F.get("path", F.lit(0))).over(by)).where("b IS NOT NULL")
    return t.select(F.col("a.v").alias("v1"), F.col("a.fwd").alias("e1"), F.col("b.v").alias("v2"), (~F.col("b.fwd")).alias("e2"), "node")


def bridge_with_scaffolds(vertices: DataFrame, edges: DataFrame, scaffolds: DataFrame, gap: int = 10, fill: str = "N") -> tuple[DataFrame, DataFrame]:
    """The graph with gap vertices where a scaffold jumps between two open ends of known vertices.

    A jump that several scaffolds tell, on either strand, is made once.
    """
    links = symmetric(edges)
    jumps = scaffold_jumps(scaffolds)
    a, b = F.struct("v1", "e1"), F.struct("v2", "e2")
    one = jumps.select(F.least(a, b.cast("struct<v1:string,e1:boolean>")).alias("a"), F.greatest(a, b.cast("struct<v1:string,e1:boolean>")).alias("b")).distinct()
    known = vertices.select("v")
    new = one.select(F.col("a.v1").alias("v1"), F.col("a.e1").alias("e1"), F.col("b.v1").alias("v2"), F.col("b.e1").alias("e2"))
    new = new.join(known.withColumnRenamed("v", "v1"), "v1", "left_semi").join(known.withColumnRenamed("v", "v2"), "v2", "left_semi").where("v1 <> v2")
    new = new.join(links.select("v1", "e1").distinct(), ["v1", "e1"], "left_anti").join(links.select(F.col("v1").alias("v2"), F.col("e1").alias("e2")).distinct(), ["v2", "e2"], "left_anti")
    new = new.select("v1", "e1", "v2", "e2", F.lit(gap).alias("gap"), F.concat_ws("_", F.lit("gap"), "v1", "v2").alias("name"))
    more, joins = gap_vertices(new, fill)
    return vertices.select("v", "len", "cov", "seq").union(more.select("v", "len", "cov", "seq")), links.union(joins.select(*links.columns))


def one_strand(names: DataFrame, name: str) -> DataFrame:
    """Rows without the reverse strand's twin, marked by a closing apostrophe."""
    return names.where(~F.col(name).endswith("'"))


def consensus_groups(groups: DataFrame, vertices: DataFrame, ratio: float, degenerate: float) -> DataFrame:
    """(group, v, action) for parallel vertices: drop thin ones, make a consensus of alike ones of one length, else keep the deepest."""
    t = groups.join(vertices, "v")
    w = Window.partitionBy("group")
    top, low = F.max("cov").over(w), F.min("cov").over(w)
    same = F.min("len").over(w) == F.max("len").over(w)
    rank = F.row_number().over(w.orderBy(F.desc("cov"), "v"))
    action = F.when(F.col("cov") * ratio < top, "drop").when(same & (low * degenerate >= top), "consensus").when(rank == 1, "keep").otherwise("drop")
    return t.select("group", "v", action.alias("action"))


def slim(vertices: DataFrame, edges: DataFrame, scores: DataFrame, baits_quota: float, significant: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """The part of a graph around vertices that score for inclusion, without those that score for exclusion (B6, F13, G6; section 3.3)."""
    from .report import arbitrate

    decided = arbitrate(scores, "v", "include", "exclude", significant)
    vertices, edges = remove_vertices(vertices, edges, decided.where("decision = 'exclude'"))
    baits = decided.where("decision = 'include'").select(F.col("v").alias("node"), F.lit(float(baits_quota)).alias("quota"))
    return reduce_to_reach(vertices, edges, baits)
