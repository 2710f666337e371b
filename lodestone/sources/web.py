"""Pages as fetched: their links, and a crawl over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.shared import shared_folder

PAGES, DEPTH = 50, 3


_HREF = """(?i)<a\\s[^>]*?href\\s*=\\s*("[^"]*"|'[^']*'|[^\\s"'>]+)"""


def links(pages: DataFrame) -> DataFrame:
    """(url, target) as written in the page's anchors, each once; quotes of either kind or none, the common entities decoded."""
    raw = F.explode(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1)))
    bare = pages.select("url", raw.alias("t")).select("url", F.regexp_replace("t", "^[\"']|[\"']$", "").alias("t"))
    plain = F.col("t")
    for entity, ch in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(ch))
    return bare.select("url", F.trim(plain).alias("target")).filter("target <> ''").distinct()


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "(?i)^[a-z][a-z0-9+.-]*://([^/?#]+)", 1))


def resolved(edges: DataFrame) -> DataFrame:
    """Targets against their page's address, without fragments, on the same host only."""
    root = F.regexp_extract("url", "(?i)^[a-z][a-z0-9+.-]*://[^/?#]+", 0)
    bare = F.regexp_replace("target", "#.*$", "")
    folder = F.when(F.regexp_extract("url", "(?i)^[a-z][a-z0-9+.-]*://[^/?#]+(/.*)?$", 1) == "", F.concat("url", F.lit("/"))).otherwise(F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "[^/]*$", ""))
    full = (
        F.when(bare == "", F.col("url"))
        .when(bare.rlike("(?i)^[a-z][a-z0-9+.-]*:"), bare)
        .when(bare.startswith("//"), F.concat(F.regexp_extract("url", "(?i)^[a-z][a-z0-9+.-]*:", 0), bare))
        .when(bare.startswith("/"), F.concat(root, bare))
        .otherwise(F.concat(folder, bare))
    )
    rows = edges.select("url", full.alias("target"))
    return rows.filter(host(F.col("target")) == host(F.col("url"))).distinct()


def crawl(pages: DataFrame, seeds: DataFrame, depth: int = DEPTH, most: int = PAGES) -> DataFrame:
    """(url, depth): pages reached from the seeds breadth first, ``most`` of them at most in the order of depth and url. Each level is one join of the frontier."""
    shared_folder(pages.sparkSession)
    edges = resolved(links(pages)).checkpoint()
    seen = seeds.select("url").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for d in range(1, depth + 1):
        found = frontier.select("url").join(edges, "url").select(F.col("target").alias("url")).distinct()
        frontier = found.join(seen, "url", "left_anti").withColumn("depth", F.lit(d)).checkpoint()
        seen = seen.unionByName(frontier)
    return seen.join(pages.select("url").distinct(), "url", "left_semi").orderBy("depth", "url").limit(most)
