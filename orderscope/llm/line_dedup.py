"""Line dedup by site-relative frequency (operator 7).

A line that a large share of a site's pages carry is boilerplate of that site, however rare
it is elsewhere. Pages are grouped by host; a line is dropped where the pages of the host
that contain it, divided by all pages of the host, exceed the boilerplate ratio.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderscope.llm.common import save, table, unused

RATIO = 0.2
BROADCAST_BYTES = 64 << 20  # of hosts and their boilerplate, sent to every executor at most
LEAST_PAGES = 2  # pages with the line: one page alone says nothing about its site
# Where a page's source breaks into lines: line ends and the tags that end a block.
BREAKS = r"(?i)\r?\n|<br\s*/?>|</?(?:p|div|li|ul|ol|h[1-6]|tr|table|td|th|nav|header|footer|article|section|title|script|style|body|head|html|blockquote|pre)(?:\s[^>]*)?>"
TAGS = r"<[^>]*>"


def host_of(url: Column) -> Column:
    """The lower-cased host of a URL, the empty string where there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.lower(found)


def lines_of(html: Column) -> Column:
    """The visible lines of a page: cut at block ends, tags removed, trimmed, none empty."""
    cut = F.split(F.coalesce(html, F.lit("")), BREAKS)
    clean = F.transform(cut, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, TAGS, " "), r"[\x20\x09-\x0D]+", " ")))
    return F.filter(clean, lambda x: x != "")


def _line_hash(line: Column) -> Column:
    """128 bits of a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def drop_boilerplate(
    pages: DataFrame,
    host: Column,
    lines: Column,
    ratio: float = RATIO,
    min_pages: int = LEAST_PAGES,
) -> DataFrame:
    """``pages`` with site (the host), site_pages, lines (all) and kept_lines.

    A line counts once for a page however often it is on it. It is dropped, everywhere on
    the host's pages, where pages with it / pages of the host > ratio and at least
    ``min_pages`` pages have it; a floor above two overrides the ratio on small hosts. Pages
    are cut into lines once and written; 128-bit hashes of the lines are counted, as partial
    sums by (host, hash), so neither a host nor a line that a third of all pages have meets
    in one task. A page is matched to its host's boilerplate by hash sets.

    Defined cases: null lines mean a page without lines; a null host is the host "";
    empty pages count for the host's total; repeated rows are pages of their own; an empty
    table gives no rows; columns of these names are replaced.
    """
    rows = pages.drop("site_pages", "kept_lines")
    rows = rows.withColumns({"site": F.coalesce(host, F.lit("")), "lines": F.coalesce(lines, F.array().cast("array<string>"))})
    rows = save(rows, "lines")
    totals = save(rows.groupBy("site").agg(F.count(F.lit(1)).alias("site_pages")), "sites")
    hashes = F.transform("lines", _line_hash)
    counted = rows.select("site", F.explode(F.array_distinct(hashes)).alias("h")).groupBy("site", "h").agg(F.count(F.lit(1)).alias("n"))
    boilerplate = unused(rows, "boilerplate")
    common = (
        counted.where(F.col("n") >= min_pages)
        .join(totals, "site")
        .where(F.col("n") > F.lit(ratio) * F.col("site_pages"))
        .groupBy("site")
        .agg(F.collect_list("h").alias(boilerplate))
    )
    # A host has few lines above the ratio: each page holds its own lines only, so there are
    # at most (mean lines of a page) / ratio of them.
    sites = save(totals.join(common, "site", "left"), "boilerplate")
    size = sites.agg(F.sum(64 + 16 * F.greatest(F.size(boilerplate), F.lit(0)))).first()[0] or 0
    if size <= BROADCAST_BYTES:  # else the pages are joined by shuffle
        sites = F.broadcast(sites)
    on_page = F.array_intersect(hashes, boilerplate)  # few, and by hash: long pages and lists stay linear
    return (
        rows.join(sites, "site")
        .withColumn(boilerplate, F.when(F.col(boilerplate).isNotNull(), on_page))
        .withColumn("kept_lines", F.when(F.coalesce(F.size(boilerplate) <= 0, F.lit(True)), F.col("lines")).otherwise(
            F.filter("lines", lambda x: ~F.array_contains(boilerplate, _line_hash(x)))
        ))
        .drop(boilerplate)
    )


def op7_site_lines(spark, sf_dir):
    """Query: every page with its lines counted before and after, and a digest of what stays."""
    pages = table(spark, sf_dir, "pages")
    pages = pages.select("page_id", host_of(F.col("url")).alias("site"), lines_of(F.col("html")).alias("lines"))
    found = drop_boilerplate(pages, F.col("site"), F.col("lines"))
    return found.select(
        "page_id",
        F.col("site").alias("host"),
        "site_pages",
        F.size("lines").cast("long").alias("n_lines"),
        F.size("kept_lines").cast("long").alias("n_kept"),
        F.md5(F.array_join("kept_lines", "\n")).alias("kept_md5"),
    )


def oracle() -> str:
    """DuckDB SQL of op7_site_lines."""
    return rf"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id,
    lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
    list_filter(list_transform(string_split_regex(coalesce(html, ''), '{BREAKS}'),
      lambda x: trim(regexp_replace(regexp_replace(x, '{TAGS}', ' ', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))), lambda x: x <> '') AS lines
  FROM pages),
t AS (SELECT host, count(*) AS site_pages FROM p GROUP BY host),
c AS (SELECT host, line, count(*) AS n FROM (SELECT host, r, unnest(list_distinct(lines)) AS line FROM p) GROUP BY host, line),
b AS (
  SELECT host, list(line) AS boilerplate FROM c JOIN t USING (host)
  WHERE n >= {LEAST_PAGES} AND n > {RATIO} * site_pages GROUP BY host),
k AS (
  SELECT page_id, host, site_pages, lines,
    CASE WHEN boilerplate IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(boilerplate, x)) END AS kept
  FROM p JOIN t USING (host) LEFT JOIN b USING (host))
SELECT page_id, host, site_pages, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(kept) AS BIGINT) AS n_kept,
  md5(array_to_string(kept, chr(10))) AS kept_md5
FROM k
"""
