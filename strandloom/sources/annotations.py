"""Annotated records, logs and registries (inventory ids A16-A19, A28-A30, C18, F10, E18)."""

from __future__ import annotations

import fnmatch
import itertools
import re

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sequences import _files, _opened, _place

#: Records that are parsed at once.
_RECORDS = 500
FEATURES = "record STRING, feature STRING, name STRING, start LONG, `end` LONG, strand INT, part INT, quals MAP<STRING,STRING>"


def parse_location(text: str, strand: int = 1) -> list[tuple[int, int, int]]:
    """(start, end, strand) of each part of a location, 0-based and half open, in reading order.

    join, order and complement nest; a complement turns the order of its parts round.
    """
    text = re.sub(r"\s", "", text)
    call = re.match(r"^(join|order|complement)\((.*)\)$", text)
    if call:
        parts, depth, last = [], 0, 0
        body = call[2]
        for i, c in enumerate(body + ","):
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 0:
                parts.append(body[last:i])
                last = i + 1
        inner = strand if call[1] != "complement" else -strand
        found = [p for x in parts for p in parse_location(x, inner)]
        return found[::-1] if call[1] == "complement" else found
    numbers = [int(n) for n in re.findall(r"\d+", text.split(":")[-1])]
    return [(numbers[0] - 1, numbers[-1], strand)] if numbers else []


def parse_genbank(text: str) -> tuple[list[tuple], list[tuple[str, str]]]:
    """Feature rows and (record, sequence) of a GenBank text."""
    rows, seqs = [], []
    for block in re.split(r"^//\s*$", text, flags=re.M):
        head = re.search(r"^LOCUS\s+(\S+)", block, flags=re.M)
        if not head:
            continue
        record = head[1]
        table = re.search(r"^FEATURES.*?\n(.*?)(?=^\S|\Z)", block, flags=re.M | re.S)
        for kind, body in re.findall(r"^ {5}(\S+)\s+(.*?)(?=^ {5}\S|\Z)", table[1] if table else "", flags=re.M | re.S):
            location = re.split(r"\n\s+/", body, maxsplit=1)[0]
            quals = {k: re.sub(r"\s*\n\s+", " ", v or "").strip('"') for k, v in re.findall(r'^\s+/(\w+)(?:=("(?:[^"]|"")*"|[^\n]*))?', body[len(location) :], flags=re.M)}
            name = quals.get("gene") or quals.get("product") or quals.get("label") or ""
            rows += [(record, kind, name, a, b, s, i, quals) for i, (a, b, s) in enumerate(parse_location(location))]
        origin = re.search(r"^ORIGIN(.*)", block, flags=re.M | re.S)
        seqs.append((record, re.sub(r"[^A-Za-z?]", "", origin[1].split("\n", 1)[-1]).upper() if origin else ""))
    return rows, seqs


def read_genbank(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """features, one part a row, and sequences (record, seq).

    A record is one row of a splittable text read whose lines end before a line of //, so that
    a task holds some records at a time, however long the file.
    """
    records = spark.read.option("lineSep", "\n//").text(path)

    def some(batches):
        for b in batches:
            for k in range(0, len(b), _RECORDS):
                yield [parse_genbank(x) for x in b["value"].iloc[k : k + _RECORDS]]

    def features(batches):
        for found in some(batches):
            yield pd.DataFrame([r for rows, _ in found for r in rows], columns=["record", "feature", "name", "start", "end", "strand", "part", "quals"])

    def sequences(batches):
        for found in some(batches):
            yield pd.DataFrame([r for _, seqs in found for r in seqs], columns=["record", "seq"])

    return records.mapInPandas(features, FEATURES), records.mapInPandas(sequences, "record STRING, seq STRING")


def regions(features: DataFrame, sequences: DataFrame, kinds: tuple[str, ...] = ("CDS", "tRNA", "rRNA")) -> DataFrame:
    """(record, name, nth, len, n_missing, seq): texts of annotated regions, parts joined, over the origin where start >= end."""
    from ..functions.strings import gene_name, missing_bases, revcomp
    from ..operators.intervals import number_within

    f = features.where(F.col("feature").isin(*kinds))
    whole = f.groupBy("record", "feature", "name", F.col("quals").cast("string").alias("q")).agg(F.array_sort(F.collect_list(F.struct("part", "start", F.col("end"), "strand"))).alias("ps"), F.min("start").alias("at"))
    t = whole.join(sequences, "record")
    piece = lambda p: F.when(p["start"] < p["end"], F.substring(F.col("seq"), (p["start"] + 1).cast("int"), (p["end"] - p["start"]).cast("int"))).otherwise(F.concat(F.substring(F.col("seq"), (p["start"] + 1).cast("int"), F.length("seq")), F.left(F.col("seq"), p["end"].cast("int"))))
    text = F.array_join(F.transform("ps", lambda p: F.when(p["strand"] < 0, revcomp(piece(p))).otherwise(piece(p))), "")
    out = t.select("record", gene_name(F.col("name")).alias("name"), "at", text.alias("seq"))
    out = number_within(out, ["record", "name"], ["at", "seq"])
    return out.select("record", "name", "nth", F.length("seq").alias("len"), missing_bases(F.col("seq")).alias("n_missing"), "seq")


def compare(queries: DataFrame, references: DataFrame, ends: int = 10, least_length: float = 0.9, least_similarity: float = 0.9) -> DataFrame:
    """(name, status, length_ratio, similarity, same_start, same_end, problems) of annotated regions against references.

    Both tables: (name, seq). status is matched, only in query or only in reference; the
    best reference of a name counts. Similarity is 1 - edits / the greater length; ends
    agree if the first or last bases do. passes tells whether all limits are kept.
    """
    from ..functions.strings import codon_problems

    q, r = queries.select("name", F.upper("seq").alias("a")), references.select("name", F.upper("seq").alias("b"))
    t = q.join(r, "name", "full_outer")
    longest = F.greatest(F.length("a"), F.length("b"), F.lit(1))
    ratio = F.least(F.length("a"), F.length("b")) / longest
    alike = 1 - F.levenshtein("a", "b") / longest
    score = F.struct(alike.alias("similarity"), ratio.alias("length_ratio"), (F.left("a", F.lit(ends)) == F.left("b", F.lit(ends))).alias("same_start"), (F.right("a", F.lit(ends)) == F.right("b", F.lit(ends))).alias("same_end"))
    status = F.when(F.col("a").isNull(), "only in reference").when(F.col("b").isNull(), "only in query").otherwise("matched")
    best = t.withColumn("status", status).groupBy("name", "status", "a").agg(F.max(score).alias("m"))
    out = best.select("name", "status", "m.length_ratio", "m.similarity", "m.same_start", "m.same_end", codon_problems(F.col("a")).alias("problems"))
    return out.withColumn("passes", F.coalesce((F.col("length_ratio") >= least_length) & (F.col("similarity") >= least_similarity) & F.col("same_start") & F.col("same_end"), F.lit(False)))


def region_statistics(found: DataFrame, names: list[str]) -> DataFrame:
    """Lengths of regions, records by names, - where there is none."""
    t = found.groupBy("record").pivot("name", names).agg(F.max("len"))
    return t.select("record", *[F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("-")).alias(n) for n in names])


def tbl_lines(features: DataFrame, kinds: tuple[str, ...] = ("gene", "CDS", "tRNA", "rRNA"), quals: tuple[str, ...] = ("gene", "product", "note")) -> DataFrame:
    """(record, value): feature tables as text, a record's features in order of place."""
    f = features.where(F.col("feature").isin(*kinds))
    span = F.when(F.col("strand") < 0, F.concat_ws("\t", "end", F.col("start") + 1)).otherwise(F.concat_ws("\t", F.col("start") + 1, "end"))
    by = f.groupBy("record", "feature", F.to_json("quals").alias("j")).agg(F.array_sort(F.collect_list(F.struct("part", span.alias("s")))).alias("ps"), F.min("start").alias("at"), F.first("quals").alias("quals"))
    lines = F.concat_ws("\n", F.concat_ws("\t", F.get("ps", F.lit(0))["s"], "feature"), F.array_join(F.transform(F.slice("ps", 2, 100_000), lambda p: p["s"]), "\n"))
    more = F.array_join(F.array_compact(F.array(*[F.when(F.col("quals").getItem(q).isNotNull(), F.concat(F.lit(f"\t\t\t{q}\t"), F.col("quals").getItem(q))) for q in quals])), "\n")
    text = by.select("record", "at", "feature", F.regexp_replace(F.concat_ws("\n", lines, more), "\n+", "\n").alias("t"))
    whole = text.groupBy("record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "feature", "t"))), lambda x: x["t"]), "\n").alias("b"))
    return whole.select("record", F.concat(F.lit(">Feature "), "record", F.lit("\n"), "b").alias("value"))


_SAYS = r" - (?:INFO|WARNING):\s+"
#: Fields of a run's summary: how several values become one, and the pattern of the value in a log line.
#: last: the latest; all: in order, joined by " & "; sum; yes: whether there is a line; bytes: the latest of a number and its unit.
LOG_FIELDS: dict[str, tuple[str, str]] = {
    "accepted_lines": ("last", _SAYS + r"Round \d+: \S+ \S+ (\d+)"),
    "accepted_words": ("last", _SAYS + r"Round \d+: \S+ \S+ \d+ \S+ (\d+)"),
    "circular": ("yes", _SAYS + "(Result status.*circular genome)"),
    "closest_seed": ("all", _SAYS + "Closest .*seed sequence: (.+)$"),
    "degenerate_base_used": ("yes", r"(Ambiguous base\(s\) used)"),
    "dup_used": ("last", _SAYS + r".*?(\d+)(?: \S+)? used/duplicated$"),
    "estimated_base_coverage": ("all", _SAYS + r"Estimated .*base-coverage = (\S+)$"),
    "fastq_format": ("last", _SAYS + "Identified quality encoding format = (.+)$"),
    "k": ("last", r"(?:Setting '| )-k ([0-9,]+)"),
    "library_deviation": ("last", _SAYS + r"Insert size = [^,]+, [^=]+ = ([0-9.]+)"),
    "library_left": ("last", _SAYS + r"Insert size = [^,]+, [^,]+, [^=]+ = ([0-9.]+)"),
    "library_right": ("last", _SAYS + r"Insert size = [^,]+, [^,]+, [^,]+, [^=]+ = ([0-9.]+)"),
    "library_size": ("last", _SAYS + r"Insert size = ([0-9.]+)"),
    "max_extending_len": ("last", r"Setting '--max-extending-len ([^']+)'"),
    "max_read_len": ("last", _SAYS + r"Mean = .* = (\S+) bp"),
    "mean_error_rate": ("last", _SAYS + r"Mean error rate = (\S+)$"),
    "mean_read_len": ("last", _SAYS + r"Mean = (\S+) bp"),
    "mem_dup": ("bytes", r"Mem ([0-9.]+ [KMG]).*candidates in all"),
    "mem_extending": ("bytes", _SAYS + r"Round \d+: .* Mem ([0-9.]+)$"),
    "mem_group": ("bytes", r"Mem ([0-9.]+ [KMG]).*groups made"),
    "mem_used": ("bytes", r"Mem ([0-9.]+ [KMG]).*used/duplicated$"),
    "n_reads": ("last", _SAYS + r"(?:Mem [^,]*, )?\d+ \S+ \S+ \S+ (\d+) .*$"),
    "n_unique_reads": ("last", _SAYS + r"(?:Mem [^,]*, )?(\d+) candidates in all"),
    "num_reads_1": ("last", _SAYS + r"Reads used = (\S+)$"),
    "num_reads_2": ("last", _SAYS + r"Reads reduced to = (\S+)$"),
    "phred_offset": ("last", _SAYS + r"Phred offset = (\d+)"),
    "pre_w": ("last", r"Setting '--pre-w ([^']+)'"),
    "res_base_cov": ("all", _SAYS + r"Average .*base-coverage.* = (\S+)$"),
    "res_kmer": ("all", _SAYS + r"Writing PATH1 .*\.K(\d+)\."),
    "res_kmer_cov": ("all", _SAYS + r"Average .*kmer-coverage.* = (\S+)$"),
    "res_path_count": ("all", _SAYS + r"Writing PATH(\d+) "),
    "rounds": ("last", _SAYS + r"Round (\d+):"),
    "seed_read_filesize": ("all", _SAYS + r"Seed reads made: .*\((\S+)"),
    "time": ("sum", r"Total cost ([0-9.]+)"),
    "trim_chars": ("last", _SAYS + r"Trimming bases with qualities [^:]*:\s*.*?  (.+)$"),
    "trim_int": ("last", _SAYS + r"Trimming bases with qualities [^:]*:\s*(.*?)  "),
    "trim_percent": ("last", _SAYS + r"Trimming bases with qualities \(([^)]*)\)"),
    "type": ("last", r" -F (\S+)"),
    "unmapped_lengths": ("all", _SAYS + r"Unmapped percentage .*unmapped lengths (.*?) \.\."),
    "unmapped_percentage": ("all", _SAYS + r"Unmapped percentage (\S+)"),
    "w": ("last", r"(?:Setting '| )-w ([0-9.]+)"),
}


def write_logs(rows: DataFrame, path: str, name: str = "log.txt") -> None:
    """Write (sample, value) as one file in a folder for each sample, path/sample/name, its rows in order of their text.

    Tasks write their samples' files where they stay, so there is no file that the driver has to move;
    a task that runs again writes the same files again.
    """

    def write(part):
        for sample, texts in itertools.groupby(part, lambda r: r[0]):
            where, inner = _place(f"{path}/{sample}")
            where.create_dir(inner)
            with where.open_output_stream(f"{inner}/{name}") as f:
                f.write("".join(f"{r[1]}\n" for r in texts).encode())

    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.select("sample", "value").repartition(spread, "sample").sortWithinPartitions("sample", "value").foreachPartition(write)


def _log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(sample, at, value): lines of logs, at rising with their place in a folder's files.

    Of an address such as folder/*/*.txt only the first folder is listed by the driver; tasks list and
    read the others, many small files each.
    """
    base, _, pattern = path.partition("/*/")
    if not pattern or "*" in base or "/" in pattern:
        return spark.read.text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("sample"), F.monotonically_increasing_id().alias("at"), "value")
    where, inner = _place(base)
    samples = sorted(x.base_name for x in where.get_file_info(fs.FileSelector(inner)) if x.type == fs.FileType.Directory)
    spread = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), len(samples)))

    def read(batches):
        for batch in batches:
            for k in range(0, len(batch), _RECORDS):
                found = []
                for sample in batch["sample"].iloc[k : k + _RECORDS]:
                    lines = []
                    for file, _ in _files(f"{base}/{sample}"):
                        if fnmatch.fnmatch(file.rsplit("/", 1)[-1], pattern):
                            with _opened(file) as f:
                                text = re.split("\r\n|\n|\r", f.read().decode("utf-8", "replace"))
                            lines += text if text[-1] else text[:-1]
                    found += [(sample, i, x) for i, x in enumerate(lines)]
                yield pd.DataFrame(found, columns=["sample", "at", "value"])

    return spark.createDataFrame(pd.DataFrame({"sample": samples}), "sample STRING").repartition(spread).mapInPandas(read, "sample STRING, at LONG, value STRING")


def read_logs(spark: SparkSession, path: str, fields: dict[str, tuple[str, str]] | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """(sample, one column for each field) (A18, A19); the sample is the file's folder.

    Each line carries its place, so values keep the log's order. With the usual fields there
    are n_bases, mem_max and, from lengths (sample, res_len) of the paths written, res_len.
    """
    usual, fields = fields is None, fields or LOG_FIELDS
    lines = _log_lines(spark, path)
    text = lambda p: F.regexp_extract("value", p, 1)
    found = [F.when(text(p) != "", F.struct("at", text(p).alias("x"))).alias(k) for k, (_, p) in fields.items()]

    def one(k: str, rule: str):
        last = F.max(k)["x"]
        if rule == "all":
            return F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(k)), lambda s: s["x"]), " & "), F.lit(""))
        if rule == "sum":
            return F.sum(F.col(k)["x"].try_cast("double"))
        if rule == "yes":
            return F.when(F.count(k) > 0, "yes").otherwise("no")
        if rule == "bytes":
            unit = F.when(last.endswith("K"), 1 << 10).when(last.endswith("M"), 1 << 20).otherwise(1 << 30)
            return (F.substring_index(last, " ", 1).try_cast("double") * unit).cast("long")
        return last

    out = lines.select("sample", *found).groupBy("sample").agg(*[one(k, rule).alias(k) for k, (rule, _) in fields.items()])
    if not usual:
        return out
    out = out.withColumn("n_bases", (F.col("mean_read_len").try_cast("double") * F.col("n_reads").try_cast("long")).cast("long")).withColumn("mem_max", F.greatest("mem_dup", "mem_extending", "mem_group", "mem_used"))
    return out.join(lengths, "sample", "left") if lengths is not None else out


def write_summary(rows: DataFrame, path: str, columns: list[str], mode: str = "error") -> None:
    """Tab separated with a header; columns that aren't asked for are left out."""
    have = set(rows.columns)
    rows.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns]).write.mode(mode).csv(path, sep="\t", header=True, nullValue="-")


def rounds_of(spark: SparkSession, path: str) -> DataFrame:
    """(folder, round, file): files in order of the number in their name."""
    files = spark.read.format("binaryFile").load(path).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.element_at(F.split("path", "/"), -2).alias("folder"), F.regexp_extract(name, r"(\d+)", 1).try_cast("int").alias("round"), F.col("path").alias("file"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(type, version, sha256) of known databases."""
    return spark.read.csv(path, sep="\t", schema="type STRING, version STRING, sha256 STRING")
