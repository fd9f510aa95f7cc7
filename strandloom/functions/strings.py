"""String functions as column expressions; all of them stay inside code generation or SQL lambdas.

Positions are 0-based and ranges half open.  The letters in brackets name entries
of the operator inventory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_FROM, _TO = "ATGCRMYKHBDVatgcrmykhbdv", "TACGYKRMDVHBtacgykrmdvhb"
#: Sets of bases as bits A=1, C=2, G=4, T=8, by code letter.
BASE_BITS = {"A": 1, "C": 2, "M": 3, "G": 4, "R": 5, "S": 6, "V": 7, "T": 8, "W": 9, "Y": 10, "H": 11, "K": 12, "D": 13, "B": 14, "N": 15}
_AMINO = "Ala=A Arg=R Asn=N Asp=D Cys=C Gln=Q Glu=E Gly=G His=H Ile=I Leu=L Lys=K Met=M Phe=F Pro=P Ser=S Thr=T Trp=W Tyr=Y Val=V".split()


def revcomp(s: Column) -> Column:
    """Reverse complement over the ambiguity codes, case kept; other characters stand for themselves."""
    return F.reverse(F.translate(s, _FROM, _TO))


def involute(s: Column, involution: str) -> Column:
    """s under a named involution: identity, reverse or revcomp."""
    return {"identity": s, "reverse": F.reverse(s), "revcomp": revcomp(s)}[involution]


def canonical(s: Column, involution: str = "revcomp") -> Column:
    """The lesser of s and its involute, the same for both."""
    return s if involution == "identity" else F.least(s, involute(s, involution))


def substrings(s: Column, width: int, step: int = 1) -> Column:
    """All substrings of a width, at every step-th position; none if s is shorter."""
    n = F.length(s)
    return F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width, F.lit(step)), lambda i: F.substring(s, i + 1, F.lit(width)))).otherwise(F.array().cast("array<string>"))


def circular_substrings(s: Column, width: int) -> Column:
    """One substring of a width for each position of a circular string."""
    n = F.length(s)
    of = lambda padded: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(padded, i + 1, F.lit(width)))
    return F.when(n > 0, let(pad_circular(s, F.lit(width - 1)), of)).otherwise(F.array().cast("array<string>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, where body's lambdas would compute it again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(s: Column) -> Column:
    """Tokens between single spaces."""
    return F.split(s, " ")


def shingles(s: Column, width: int, step: int = 1) -> Column:
    """64-bit hashes of runs of tokens, at every step-th token; none if there are fewer tokens."""


    def of(t: Column) -> Column:
        n = F.size(t)
        return F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width, F.lit(step)), lambda i: shingle_at(t, i, width))).otherwise(F.array().cast("array<bigint>"))

    return let(_token_hashes(s), of)


def _token_hashes(s: Column) -> Column:
    return F.transform(tokens(s), lambda t: F.xxhash64(t))


def shingle_at(hashes: Column, i: Column, width: int) -> Column:
    """Hash of the run of so many tokens at i, from the tokens' hashes: each token is hashed once, not once a run."""
    return F.xxhash64(F.slice(hashes, i + 1, F.lit(width)))


def probed_shingles(s: Column, width: int, jump: int) -> Column:
    """Shingles at the probe positions of the row's tokens."""
    return let(_token_hashes(s), lambda t: F.transform(probe_positions(F.size(t), width, jump), lambda i: shingle_at(t, i, width)))


def probe_positions(n: Column, width: int, jump: int) -> Column:
    """Offsets that a row of n units is probed at: every jump-th from both ends inward, the middle included."""
    top = n - width
    half = F.when(top >= 0, F.transform(F.sequence(F.lit(0), F.floor(top / 2).cast("int"), F.lit(jump)), lambda i: F.array(i, top - i)))
    return F.coalesce(F.array_sort(F.array_distinct(F.flatten(half))), F.array().cast("array<int>"))


def codons(s: Column, frame: int = 0) -> Column:
    """Upper-case whole codons from a frame on."""
    n = F.length(s) - frame
    return F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.floor(n / 3).cast("int") - 1), lambda i: F.upper(F.substring(s, i * 3 + 1 + frame, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def orf_lengths(s: Column, frame: int, starts: tuple[str, ...], stops: tuple[str, ...], least: int) -> Column:
    """Lengths in bases, stop included, of the open frames of at least so many bases."""
    begin = F.struct(F.lit(0).alias("open"), F.array().cast("array<int>").alias("found"))

    def step(a: Column, c: Column) -> Column:
        running = F.when(a["open"] > 0, a["open"] + 3).when(c.isin(*starts), 3).otherwise(0)
        ends = (running > 0) & c.isin(*stops)
        return F.struct(F.when(ends, 0).otherwise(running).cast("int").alias("open"), F.when(ends, F.array_append(a["found"], running.cast("int"))).otherwise(a["found"]).alias("found"))

    return F.filter(F.aggregate(codons(s, frame), begin, step)["found"], lambda x: x >= least)


def codon_problems(s: Column, starts: tuple[str, ...] = ("ATG", "GTG", "ACG"), stops: tuple[str, ...] = ("TAA", "TAG", "TGA")) -> Column:
    """What is wrong with a coding sequence: frame, start, stop, internal."""
    c = codons(s)
    n = F.size(c)
    last = F.element_at(c, -1)
    inner = F.exists(F.slice(c, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda x: x.isin(*stops))
    found = F.array(
        F.when(F.length(s) % 3 != 0, "frame"), F.when((n == 0) | ~F.coalesce(F.get(c, F.lit(0)).isin(*starts), F.lit(False)), "start"),
        F.when((n == 0) | ~F.coalesce(F.when(n > 0, last).isin(*stops), F.lit(False)), "stop"), F.when(inner, "internal"),
    )
    return F.array_compact(found)


def gc_fraction(s: Column) -> Column:
    """Share of G and C among A, C, G, T; null if there is none (C17)."""
    acgt = F.regexp_count(s, F.lit("[ACGTacgt]"))
    return F.when(acgt > 0, F.regexp_count(s, F.lit("[GCgc]")) / acgt)


def missing_bases(s: Column) -> Column:
    """Number of N, n and ? (C20)."""
    return F.regexp_count(s, F.lit("[N?n]"))


def is_degenerate(s: Column) -> Column:
    """Whether an ambiguity code occurs."""
    return s.rlike("[NVHDBYRKMSW]")


def low_complexity(s: Column, least: int = 3) -> Column:
    """Fewer than so many distinct characters."""
    return F.size(F.array_distinct(characters(s))) < least


def characters(s: Column) -> Column:
    """The characters of a string, one element each."""
    return F.array_remove(F.split(s, ""), "")


def mask(s: Column, positions: Column, with_: str = "N") -> Column:
    """s with the listed 0-based positions replaced."""
    return F.when(F.length(s) > 0, F.array_join(F.transform(characters(s), lambda c, i: F.when(F.array_contains(positions, i), F.lit(with_)).otherwise(c)), "")).otherwise(s)


def overlaps(a: Column, b: Column, k: Column) -> Column:
    """Whether the last k characters of a are the first k of b."""
    return F.right(a, k) == F.left(b, k)


def pad_circular(s: Column, extra: Column) -> Column:
    """s followed by so many characters of itself, round and round."""
    n = F.length(s)
    return F.when(n > 0, F.concat(s, F.left(F.repeat(s, F.ceil(extra / n).cast("int")), extra))).otherwise(s)


def rotations(s: Column) -> Column:
    """All rotations of a circular string."""
    n = F.length(s)
    return F.when(n > 0, let(F.concat(s, s), lambda twice: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(twice, i + 1, n)))).otherwise(F.array(s))


def least_rotation(s: Column, involution: str = "revcomp") -> Column:
    """The least rotation over both strands, a name for the circular string."""
    both = rotations(s) if involution == "identity" else F.concat(rotations(s), rotations(involute(s, involution)))
    return F.array_min(both)


def gene_name(name: Column) -> Column:
    """One spelling for gene names: trnX-ANTICODON from three-letter forms, rrnN for ribosomal ones."""
    codes = F.create_map(*[F.lit(x) for pair in (a.lower().split("=") for a in _AMINO) for x in (pair[0], pair[1].upper())])
    amino = codes[F.lower(F.regexp_extract(name, r"(?i)^trna[-_ ]?([A-Za-z]{3})", 1))]
    anticodon = F.regexp_replace(F.upper(F.regexp_extract(name, r"(?i)^trna[-_ ]?[A-Za-z]{3}[-_ (]*([ACGTU]{3})?", 1)), "U", "T")
    ribosomal = F.regexp_extract(name, r"(?i)^([0-9.]+)s[-_ ]?(?:ribosomal|rrna)", 1)
    return (
        F.when(amino.isNotNull(), F.concat(F.lit("trn"), amino, F.when(anticodon != "", F.concat(F.lit("-"), anticodon)).otherwise("")))
        .when(ribosomal != "", F.concat(F.lit("rrn"), ribosomal))
        .otherwise(name)
    )


def natural_key(name: Column) -> Column:
    """A sort key in which numbers between underscores compare as numbers."""
    part = lambda p: F.when(p.rlike("^[0-9]{1,30}$"), F.lpad(p, 30, "0")).otherwise(F.concat(F.lit("~"), p))
    return F.array_join(F.transform(F.split(name, "_"), part), "_")


def file_stem(path: Column) -> Column:
    """A file's name without folder and known suffixes."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.(fasta|fas|fa|fastq|fq|gfa|fastg|gb|gbk|txt|tab|csv|sam)?(\.gz)?$", "")


def unique_names(name: Column, nth: Column) -> Column:
    """Labels made unique by their number within the label, spaces replaced."""
    plain = F.regexp_replace(name, " +", "_")
    return F.when(nth > 1, F.concat_ws("-", plain, nth - 1)).otherwise(plain)


def valid_k(k: Column, longest: Column) -> Column:
    """Whether k is odd, from 21 to 127 and no longer than the rows."""
    return (k % 2 == 1) & k.between(21, 127) & (k <= longest)


def compatible(a: Column, b: Column, factor: float) -> Column:
    """a/factor < b < a*factor."""
    return (a / factor < b) & (b < a * factor)


def out_of_fold(a: Column, b: Column, fold: float) -> Column:
    """Whether a and b differ by at least a factor."""
    return F.greatest(a / b, b / a) >= fold


def positive(x: Column) -> Column:
    """The size of x; an error for zero."""
    return F.when(x == 0, F.raise_error(F.lit("value is zero")).cast("double")).otherwise(F.abs(x))


def expected_rows(coverage: Column, length: Column, k: Column) -> Column:
    """Base coverage from k-mer coverage."""
    return coverage * length / (length - k + 1)


def normal_logpdf(x: Column, mean: Column, sd: Column) -> Column:
    """Log density of the normal distribution."""
    return -((x - mean) ** 2) / (2 * sd**2) - F.log(sd * F.sqrt(F.lit(2.0) * F.pi()))


def gcd_of(values: Column) -> Column:
    """Greatest common divisor of an array of integers, by Euclid's steps on each."""
    # 92 steps do for any two longs
    def two(a: Column, b: Column) -> Column:
        start = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))
        step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.pmod(s["a"], F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step)["a"]

    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: two(a, x.cast("long")))
