"""Sequence files: FASTA, FASTQ and their sinks (inventory ids A1-A6, A21, A22, A26, A27)."""

from __future__ import annotations

import gzip
import io
import itertools
import os
import re
import tarfile
from collections.abc import Iterator
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, label, seq) of multi-line records, white space stripped; compressed files by their suffix (A1).

    A record is one row of a splittable text read whose lines end before a header;
    seq_id rises with the place in the file.
    """
    records = spark.read.option("lineSep", "\n>").text(path)
    body = F.regexp_replace("value", "^>", "")
    label = F.trim(F.regexp_replace(F.substring_index(body, "\n", 1), "\r", ""))
    seq = F.when(body.contains("\n"), F.regexp_replace(F.regexp_replace(body, r"^[^\n]*\n", ""), r"\s+", "")).otherwise("")
    return records.where("value <> ''").select(F.monotonically_increasing_id().alias("seq_id"), label.alias("label"), seq.alias("seq"))


def fasta_lengths(records: DataFrame, short_names: bool = False) -> DataFrame:
    """(label, len) of records; short names end at the first space (A2)."""
    name = F.substring_index("label", " ", 1) if short_names else F.col("label")
    return records.select(name.alias("label"), F.length("seq").cast("long").alias("len"))


def fasta_text(label: Column, seq: Column, width: int = 0) -> Column:
    """A record as text, wrapped at a width if one is given."""
    body = F.regexp_replace(seq, "(.{%d})(?=.)" % width, "$1\n") if width else seq
    return F.concat(F.lit(">"), label, F.lit("\n"), body)


def write_fasta(records: DataFrame, path: str, width: int = 0, mode: str = "error") -> None:
    """Write (label, seq) as text files; Spark's commit makes it all or nothing."""
    records.select(fasta_text(F.col("label"), F.col("seq"), width).alias("value")).write.mode(mode).text(path)


# ---- FASTQ ----------------------------------------------------------------


class _Ranges(InputPartition):
    """(file_id, path, begin, end) of ranges next to each other, for one task."""

    def __init__(self, ranges: list[tuple[int, str, int, int]]):
        self.ranges = ranges


#: Bytes of a task's ranges at least, so that small ranges and small files don't make a task each.
_TASK_BYTES = 16 << 20


_PACKED = (".gz", ".tar", ".tgz")


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address (file, hdfs, s3a, gs and what else Arrow knows) and the path in it."""
    if not re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", path):
        return fs.LocalFileSystem(), os.path.abspath(path)
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", re.sub("^s3[an]:", "s3:", path)))


def _files(path: str) -> list[tuple[str, int]]:
    """(address, bytes) of a file, or of those in a folder that don't begin with _ or a point."""
    where, inner = _place(path)
    info = where.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = [x for x in where.get_file_info(fs.FileSelector(inner, recursive=True)) if x.type == fs.FileType.File and x.base_name[0] not in "_."]
    return sorted((path.rstrip("/") + x.path[len(inner.rstrip("/")) :], x.size) for x in found)


class FastqReader(DataSourceReader):
    """Byte ranges of plain files, each taking the records that begin in it; a compressed file, or one of which only the first rows are asked for, is one range. A task has several if they are small."""

    def __init__(self, schema: StructType, options: dict):
        self.columns = schema.names
        self.paths = sorted(p for p in options["path"].split(",") if p)
        self.size = int(options.get("rangebytes", 64 << 20))
        self.most = int(options["rowsperfile"]) if "rowsperfile" in options else None

    def partitions(self) -> list[InputPartition]:
        out: list[list[tuple[int, str, int, int]]] = [[]]
        have = 0
        for i, (path, whole) in enumerate(x for p in self.paths for x in _files(p)):
            one = path.endswith(_PACKED) or self.most is not None
            step = max(whole, 1) if one else self.size
            for b in range(0, max(whole, 1), step):
                size = min(whole, b + step) - b
                if out[-1] and have + size > _TASK_BYTES:
                    out.append([])
                    have = 0
                out[-1].append((i, path, b, b + size))
                have += size
        return [_Ranges(x) for x in out]

    def read(self, part: InputPartition) -> Iterator[tuple]:
        place = {"file_id": 0, "read_id": 1, "name": 2, "mate": 3, "seq": 4, "qual": 5}
        pick = [place[c] for c in self.columns]
        for path, ranges in itertools.groupby(part.ranges, lambda x: x[1]):
            with _opened(path) as f:
                for file_id, _, begin, end in ranges:
                    for at, head, seq, qual in itertools.islice(records_in(f, begin, end, path.endswith(_PACKED)), self.most):
                        name, mate = split_head(head)
                        row = (file_id, at, name, mate, seq, qual)
                        yield tuple(row[i] for i in pick)


def _opened(path: str) -> BinaryIO:
    """A file's bytes, unpacked; of a tar the first file in it."""
    where, inner = _place(path)
    raw = io.BufferedReader(where.open_input_file(inner), 1 << 20)
    if path.endswith((".tar", ".tar.gz", ".tgz")):
        packed = tarfile.open(fileobj=raw, mode="r|*")
        return next((packed.extractfile(m) for m in packed if m.isfile()), io.BytesIO())
    return gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw


def records_of(path: str, begin: int, end: int) -> Iterator[tuple[int, str, str, str]]:
    """(place, head, seq, qual) of the records of a file that begin in [begin, end)."""
    with _opened(path) as f:
        yield from records_in(f, begin, end, path.endswith(_PACKED))


def records_in(f: BinaryIO, begin: int, end: int, packed: bool = False) -> Iterator[tuple[int, str, str, str]]:
    """(place, head, seq, qual) of the records that begin in [begin, end); place is the byte at which one begins.

    A range starts at a line whose shape is a record's: @ first, + two lines on, and equal
    lengths between; a quality line that begins with @ fails that test. A packed file is one range.
    """
    at = 0
    if begin and not packed:
        f.seek(begin - 1)
        at = begin - 1 + len(f.readline())
        window: list[tuple[int, bytes]] = []
        while len(window) < 8 and (line := f.readline()):
            window.append((at, line))
            at += len(line)
        for i in range(min(4, len(window))):
            four = [w[1].rstrip(b"\r\n") for w in window[i : i + 4]]
            if len(four) == 4 and four[0][:1] == b"@" and four[2][:1] == b"+" and len(four[1]) == len(four[3]):
                at = window[i][0]
                break
        else:
            return
        f.seek(at)
    elif not packed:
        f.seek(0)
    while packed or at < end:
        four = [f.readline() for _ in range(4)]
        if not four[3] and not four[1]:
            return
        text = [x.rstrip(b"\r\n").decode("ascii", "replace") for x in four]
        yield at, text[0][1:], text[1], text[3]
        at += sum(map(len, four))


def split_head(head: str) -> tuple[str, int]:
    """(name, mate) of a head: "name 1:N:0", "name#tag/1", "name/1" or "name"; mate 0 if it isn't told (A5)."""
    if " " in head:
        name, rest = head.split(" ", 1)
        if rest[:1] in "12" and (len(rest) == 1 or rest[1] == ":"):
            return name, int(rest[0])
        head = name
    if "#" in head:
        name, tag = head.split("#", 1)
        return name, int(tag[-1]) if tag[-2:] in ("/1", "/2") else 0
    if head[-2:] in ("/1", "/2"):
        return head[:-2], int(head[-1])
    return head, 0


def head_name(head: Column) -> Column:
    """The name part of a head, as an expression (A5)."""
    first = F.substring_index(head, " ", 1)
    return F.when(first.contains("#"), F.substring_index(first, "#", 1)).otherwise(F.regexp_replace(first, "/[12]$", ""))


def head_mate(head: Column) -> Column:
    """The mate of a head, 0 if it isn't told, as an expression (A5)."""
    found = F.coalesce(F.nullif(F.regexp_extract(head, r"^\S+ ([12])(?::|$)", 1), F.lit("")), F.nullif(F.regexp_extract(F.substring_index(head, " ", 1), "/([12])$", 1), F.lit("")), F.lit("0"))
    return found.cast("int")


class FastqSource(DataSource):
    """Format "fastq": (file_id, read_id, name, mate, seq, qual); a narrower schema reads fewer columns."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "file_id INT, read_id LONG, name STRING, mate INT, seq STRING, qual STRING"

    def reader(self, schema: StructType) -> DataSourceReader:
        return FastqReader(schema, {k.lower(): v for k, v in self.options.items()})


def read_fastq(spark: SparkSession, paths: list[str], range_bytes: int = 64 << 20, columns: list[str] | None = None, rows_per_file: int | None = None) -> DataFrame:
    """Records of FASTQ files or folders of them, on any storage that Arrow reads; read_id is a record's place in its file.

    With rows_per_file no more than the first so many are read of each file (A6, B2): the
    reading stops there, and nothing is sorted.
    """
    spark.dataSource.register(FastqSource)
    kinds = dict(c.split() for c in FastqSource({}).schema().split(", "))
    reader = spark.read.format("fastq").option("path", ",".join(paths)).option("rangeBytes", range_bytes)
    reader = reader if rows_per_file is None else reader.option("rowsPerFile", rows_per_file)
    return reader.schema(", ".join(f"{c} {kinds[c]}" for c in columns or kinds)).load()


def fastq_text(name: Column, seq: Column, qual: Column) -> Column:
    return F.concat(F.lit("@"), name, F.lit("\n"), seq, F.lit("\n+\n"), qual)


def write_accepted(reads: DataFrame, accepted: DataFrame, path: str, mode: str = "error") -> None:
    """Write the reads of accepted representatives, every member of their clusters.

    reads: (name, seq, qual, rep_id); accepted: (rep_id).
    """
    reads.join(accepted, "rep_id", "left_semi").select(fastq_text(F.col("name"), F.col("seq"), F.col("qual")).alias("value")).write.mode(mode).text(path)


def write_pairs(left: DataFrame, right: DataFrame, path: str, mode: str = "error") -> None:
    """Four folders: paired and unpaired reads of both mates, paired ones in one order."""
    key = "name"
    both = left.select(key).join(right.select(key), key).distinct()
    for side, rows in (("1", left), ("2", right)):
        text = fastq_text(F.col("name"), F.col("seq"), F.col("qual")).alias("value")
        rows.join(both, key, "left_semi").orderBy(key).select(text).write.mode(mode).text(f"{path}/paired_{side}")
        rows.join(both, key, "left_anti").select(text).write.mode(mode).text(f"{path}/unpaired_{side}")


def simulate_reads(records: DataFrame, length: int, stride: int = 1, insert: int | None = None, circular: bool = False, count: int | None = None, seed: int = 12345) -> DataFrame:
    """(name, mate, seq, qual) cut from (label, seq): windows at every stride, or count random ones from each.

    With an insert size each window has a mate on the other strand, that far on.
    """
    from ..functions.strings import pad_circular, revcomp

    span = insert or length
    n = F.length("seq")
    last = n if circular else n - span + 1
    starts = F.sequence(F.lit(0), last - 1, F.lit(stride))
    text = pad_circular(F.col("seq"), F.lit(span)) if circular else F.col("seq")
    base = records.where((n >= span) if not circular else (n > 0)).select("label", text.alias("t"), last.alias("last"), starts.alias("starts"))
    if count is not None:
        base = base.withColumn("starts", F.sequence(F.lit(0), F.lit(count - 1))).select("label", "t", "last", F.posexplode("starts").alias("k", "__s")).withColumn("start", F.floor(F.rand(seed) * F.col("last")).cast("int"))
    else:
        base = base.select("label", "t", F.posexplode("starts").alias("k", "start"))
    name = F.concat_ws("_", "label", F.col("k"))
    qual = F.repeat(F.lit("G"), F.lit(length))
    one = base.select(name.alias("name"), F.lit(1).alias("mate"), F.substring("t", F.col("start") + 1, F.lit(length)).alias("seq"), qual.alias("qual"))
    if not insert:
        return one
    return one.union(base.select(name, F.lit(2), revcomp(F.substring("t", F.col("start") + 1 + span - length, F.lit(length))), qual))
