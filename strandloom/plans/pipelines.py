"""Compositions: from reads to accepted rows, and from a graph to paths (sections 3.1-3.3; H14)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import strings
from ..operators import cluster, graph, paths, profile, recruit, report, solve, words


@dataclass(frozen=True)
class Options:
    """Defaults that are part of the semantics; presets change some of them."""

    word: int = 21
    probe_step: int = 3
    build_step: int = 2
    max_supersteps: int | None = 15
    max_words: int | None = 400_000_000
    rows_per_file: int = 15_000_000
    low_quality: str = '!"'
    depth_factor: float = 5.0
    type_factor: float = 3.0
    max_paths: int = 1000

    def fast(self) -> Options:
        return Options(**{**self.__dict__, "probe_step": 5, "build_step": 7, "max_supersteps": 10, "max_words": 30_000_000})


def index_rows(reads: DataFrame, options: Options) -> DataFrame:
    """(id, parts): one row for each distinct read, cut at low quality, of at least a word.

    reads: (file_id, read_id, seq, qual). A read and its reverse complement are one; the
    least (file, place) stands for both. id is a hash of the text's lesser strand.
    """
    capped = profile.first_n(reads, ["file_id"], ["read_id"], options.rows_per_file)
    parts = profile.quality_parts(F.col("seq"), F.col("qual"), options.low_quality, options.word - 1)
    key = F.xxhash64(strings.canonical(F.col("seq")))
    kept = capped.select(key.alias("id"), F.struct("file_id", "read_id").alias("at"), parts.alias("parts")).where(F.size("parts") > 0)
    return kept.groupBy("id").agg(F.min_by("parts", "at").alias("parts"), F.count("*").alias("n"))


def _canonical_words(parts: str, word: int, step: int):
    one = lambda s: F.transform(strings.substrings(s, word, step), lambda w: strings.canonical(w))
    return F.array_distinct(F.flatten(F.transform(parts, one)))


def _canonical_probes(parts: str, word: int, jump: int):
    one = lambda s: F.transform(strings.probe_positions(F.length(s), word, jump), lambda i: strings.canonical(F.substring(s, i + 1, F.lit(word))))
    return F.array_distinct(F.flatten(F.transform(parts, one)))


def from_rows(reads: DataFrame, seeds: DataFrame, options: Options = Options(), exclude: DataFrame | None = None, group: bool = False) -> DataFrame:
    """Reads (all columns) accepted by recruiting from seed texts (column seq) over both strands.

    exclude: texts (column seq) of which no accepted read may share a word.
    """
    rows = index_rows(reads, options).checkpoint()
    probes = words.word_table(rows, "id", _canonical_probes("parts", options.word, options.probe_step))
    built = words.word_table(rows, "id", _canonical_words("parts", options.word, options.build_step))
    all_words = lambda t: t.select(F.array("seq").alias("__s")).select(F.explode(_canonical_words("__s", options.word, 1)).alias("word")).distinct()
    seed_words, gone = all_words(seeds), None
    if exclude is not None:
        bad = all_words(exclude)
        gone = words.word_table(rows, "id", _canonical_words("parts", options.word, 1)).join(bad, "word", "left_semi").select("id").distinct()
    groups = recruit.pregroup(built.join(rows.where("n > 1").select("id"), "id", "left_semi")) if group else None
    accepted = recruit.recruit(probes, built, seed_words, gone, groups, options.max_supersteps, options.max_words)
    return reads.withColumn("__id", F.xxhash64(strings.canonical(F.col("seq")))).join(accepted.select(F.col("id").alias("__id")), "__id", "left_semi").select(*reads.columns)


@dataclass
class Target:
    """What is extracted for one target: its graph, multiplicities and paths."""

    vertices: DataFrame
    edges: DataFrame
    copies: DataFrame
    paths: DataFrame
    depth: float


def extract_target(vertices: DataFrame, edges: DataFrame, tags: DataFrame, target: str, options: Options = Options()) -> Target:
    """The heaviest component of a target, its multiplicities and its circles.

    vertices: (v, len, cov, seq); tags: (v, db, locus, weight). Vertices of other targets go,
    then those whose depth doesn't go with the target's, then tips without a tag, until
    nothing changes; runs are joined; copies are solved for each component.
    """
    kept = report.labels_kept(tags, options.type_factor).where("kept")
    weight = kept.where(F.col("db") == target).select("v", "weight")
    vertices, edges = graph.remove_vertices(vertices, graph.symmetric(edges), graph.exclude_other(kept, target))
    marked = vertices.join(weight, "v", "left").withColumn("key", F.lit("all"))
    good = cluster.filter_by_depth(marked.select("key", "v", "len", "cov", "weight"), "key", options.depth_factor)
    vertices, edges = graph.remove_vertices(vertices, edges, good.where("NOT kept"))
    while True:
        vertices, edges = vertices.checkpoint(), edges.checkpoint()
        tips = graph.degrees(vertices, edges).where("terminal").join(weight, "v", "left_anti").select("v")
        # a component's only vertices stay until components are chosen
        tips = tips.join(edges.select(F.col("v1").alias("v")), "v", "left_semi").checkpoint()
        if tips.isEmpty():
            break
        vertices, edges = graph.remove_vertices(vertices, edges, tips)
    of = graph.clusters(vertices, edges).checkpoint()
    best = of.join(weight, "v").groupBy("component").agg(F.sum("weight").alias("w")).orderBy(F.desc("w"), "component").limit(1)
    own = of.join(best.select("component"), "component", "left_semi").select("v")
    vertices, edges = graph.remove_vertices(vertices, edges, vertices.select("v").join(own, "v", "left_anti"))
    merged, links = graph.contract(vertices, edges)
    depth, counted = graph.baseline(merged.select("v", "len", "cov"))
    single = merged.select("v", (F.col("cov") / F.lit(depth or 1.0)).alias("float_copy"))
    parts = graph.clusters(merged, links)
    copies = solve.solve_components(single, links, parts).join(counted.select("v", F.col("copy").alias("guess")), "v").select("v", F.coalesce("copy", "guess").alias("copy"))
    return Target(merged, links, copies, paths.circular_paths_of(copies, links, parts, options.max_paths), depth)


def path_report(target: Target) -> DataFrame:
    """(path_id, seq, circular, score, pattern) of a target's circles."""
    return graph.path_text(target.paths, target.vertices, target.edges).join(paths.rank_paths(target.paths), "path_id")
