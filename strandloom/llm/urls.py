"""Operator 8: URL filters over classes of equivalent addresses.

An address is reduced to a canonical spelling (scheme, a leading www. or m., default
port, fragment, tracking parameters and a closing slash don't count).  Pages tie
their address to the targets that they name: canonical link, og:url, meta refresh;
a table of redirects adds more ties.  Connected components of these edges are the
classes.  A block rule that hits any address of a class holds for all its aliases;
an allow rule that hits an address itself comes before every block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components, ensure_checkpoint_dir
from ..operators.sizes import small_side

#: Rules: a host, with all its subdomains, and a path that addresses must begin with after it ("" or "/...").
BLOCK = tuple(f"{name}.example.{top}" for name in ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets") for top in ("com", "org", "net"))
ALLOW = ("ads-track.example.com/en/1", "cheap-pills.example.com/en/2", "free-bets.example.com/de")

SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"
TRACKING = r"(utm_[a-z]+|ref|fbclid|gclid|sessionid)=[^&]*"
CANONICAL = (
    r'(?i)<link[^>]*rel=["\']?canonical["\']?[^>]*href=["\']?([^"\'> ]+)',
    r'(?i)<link[^>]*href=["\']?([^"\'> ]+)["\']?[^>]*rel=["\']?canonical',
    r'(?i)<meta[^>]*property=["\']?og:url["\']?[^>]*content=["\']?([^"\'> ]+)',
    r'(?i)<meta[^>]*http-equiv=["\']?refresh["\']?[^>]*url=["\']?([^"\'> ]+)',
)


def host(url: Column) -> Column:
    """Lower-case host without port and user."""
    return F.lower(F.regexp_extract(F.regexp_replace(url, SCHEME, ""), r"^(?:[^/?#@]*@)?([^/?#:]*)", 1))


def normal(url: Column) -> Column:
    """Canonical spelling: host, path and the query parameters that aren't tracking; null for null and blank."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), SCHEME, ""), "#.*$", "")
    where = F.regexp_replace(host(F.trim(url)), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*(/[^?]*)", 1), "/+$", "")
    query = F.regexp_replace(F.regexp_extract(bare, r"\?(.*)$", 1), f"(^|&){TRACKING}", "")
    query = F.regexp_replace(query, "^&+", "")
    return F.when(F.trim(url) != "", F.concat(where, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def resolve(base: Column, target: Column) -> Column:
    """A link's address, seen from the page's."""
    root = F.regexp_extract(base, SCHEME + r"[^/?#]*", 0)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), SCHEME + r"[^/]*(/.*/|/)?", 0)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(target.rlike(SCHEME), target)
        .when(target.startswith("//"), F.concat(F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*:", 0), target))
        .when(target.startswith("/"), F.concat(root, target))
        .otherwise(F.concat(folder, target))
    )


def _hits(nodes: DataFrame, rules: tuple[str, ...] | DataFrame) -> DataFrame:
    """The distinct addresses (column node) that a rule hits: its host or a parent domain, and the path from there."""
    spark = nodes.sparkSession
    table = rules if isinstance(rules, DataFrame) else spark.createDataFrame([(r,) for r in rules], "rule STRING")
    table = table.select(F.lower(F.regexp_extract("rule", "^[^/]*", 0)).alias("h"), F.regexp_extract("rule", "/.*$", 0).alias("prefix")).where("h <> ''").distinct()
    at = F.regexp_extract("node", "^[^/?]*", 0)
    labels = F.split(at, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = nodes.select("node", F.regexp_extract("node", "^[^/?]*(.*)$", 1).alias("rest"), F.explode(domains).alias("h"))
    return asked.join(small_side(table), "h").where(F.col("rest").startswith(F.col("prefix"))).select("node").distinct()


def url_filter(
    pages: DataFrame, block: tuple[str, ...] | DataFrame = BLOCK, allow: tuple[str, ...] | DataFrame = ALLOW, redirects: DataFrame | None = None,
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """(page_id, node, class, decision) of every page; decision is allow, block or pass.

    node is the page's address in canonical spelling and class the least address of its
    equivalence class.  Rules are texts or a table with a column rule; redirects has
    columns source and target.  Rows with a null or blank url have null node and class and
    pass; null html names no target; edges with a missing end are left out; rows without
    an id or that are there twice keep their place; urls and html of any length are read whole; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).withColumn("node", normal(F.col("url")))
    named = F.array_compact(F.array(*[F.when(t != "", resolve(F.trim("url"), t)) for t in (F.regexp_extract("html", p, 1) for p in CANONICAL)]))
    ensure_checkpoint_dir(pages.sparkSession)
    edges = rows.where("node IS NOT NULL").select("node", F.explode(named).alias("target")).select("node", normal(F.col("target")).alias("other"))
    if redirects is not None:
        edges = edges.union(redirects.select(normal(F.col("source")), normal(F.col("target"))))
    # the components' rounds move keys of 96 bits instead of addresses
    key = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.xxhash64(c).alias("h"), F.hash(c).alias("g")))
    edges = edges.checkpoint()
    components = connected_components(edges.select(key("node").alias("u"), key("other").alias("v"))).withColumnRenamed("node", "key")
    nodes = rows.select("node").union(edges.select("node")).union(edges.select("other")).where("node IS NOT NULL").distinct().withColumn("key", key("node"))
    placed = nodes.join(components, "key", "left").select("node", F.coalesce("component", "key").alias("component")).checkpoint()
    least = placed.groupBy("component").agg(F.min("node").alias("class"))
    classes = placed.join(least, "component").select("node", "class").checkpoint()
    allowed = _hits(classes.select("node"), allow).withColumn("allowed", F.lit(True))
    blocked = _hits(classes.select("node"), block).join(allowed, "node", "left_anti").withColumn("hit", F.lit(True))
    judged = classes.join(allowed, "node", "left").join(blocked, "node", "left")
    bad = judged.groupBy("class").agg(F.max(F.col("hit").isNotNull()).alias("bad"))
    verdict = F.when(F.col("allowed"), "allow").when(F.col("bad"), "block").otherwise("pass")
    told = judged.join(bad, "class").select("node", "class", verdict.alias("decision"))
    return rows.select("page_id", "node").join(told, "node", "left").select("page_id", "node", "class", F.coalesce("decision", F.lit("pass")).alias("decision"))
