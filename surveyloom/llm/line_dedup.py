"""Line deduplication by how many pages of a site carry a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import ascii_lower, whole_text
from surveyloom.sources.scratch import settle

# A line is boilerplate if it is on more than this share of its host's pages, and on so many pages at least.
RATIO, LEAST_PAGES = 0.3, 3

# What is no text of a page, what ends a line, any other markup, white space inside a line, the host of a URL.
NO_TEXT = "(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<head\\b.*?</head\\s*>|<!--.*?-->"
LINE_END = ("(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|header|hr|html"
            "|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\\b[^>]*>")
MARKUP = "<[^>]*>"
SPACE = "[\\x09\\x0B\\x0C\\x0D ]+"
HOST = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: Column) -> Column:
    """The host in lower case; null without one."""
    return F.nullif(ascii_lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def page_lines(html: Column) -> Column:
    """A page's text in lines, character references as written; no line is empty."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, NO_TEXT, "\n"), LINE_END, "\n"), MARKUP, "")
    return lines_of(text)


def lines_of(text: Column) -> Column:
    """Lines of plain text, white space in them as one space; no line is empty."""
    return F.array_remove(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, SPACE, " "))), "")


def boilerplate(lines: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, boiler): the boilerplate lines of every host that has some, from rows of host and lines.

    Pages are counted per host and line, combined before the shuffle, so neither
    a line nor a host that a third of the pages share lands in one task.  The
    shares of all lines of a host add up to its mean number of lines per page,
    so its list has at most that mean divided by ``ratio`` entries.
    """
    known = lines.where("host is not null")
    totals = settle(known.groupBy("host").agg(F.count(F.lit(1)).alias("total")))
    counted = known.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line").agg(
        F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pages)
    often = counted.join(totals, "host").where(F.col("n") > ratio * F.col("total"))
    return settle(often.groupBy("host").agg(F.collect_set("line").alias("boiler")))


def without_boilerplate(pages: DataFrame, lines: Column, id_column: str = "page_id", url_column: str = "url",
                        ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """One row per row of ``pages``: id, host, n_lines, n_dropped, text.

    ``lines`` is the array of a page's lines, such as ``page_lines(html)``.  A line
    is dropped wherever it stands if it is on more than ``ratio`` of its host's
    pages and on ``least_pages`` of them at least; a line that a page repeats
    counts once for that page.  Lines are compared as a whole.

    A page without host keeps all lines, a null or empty one has none; every row
    counts as a page, repeated ones and such with null or equal ids included; an
    empty table gives an empty one.
    """
    rows = pages.select(F.col(id_column).alias("id"), host_of(F.col(url_column)).alias("host"),
                        F.coalesce(lines, F.array().cast("array<string>")).alias("lines"))
    joined = rows.join(boilerplate(rows.select("host", "lines"), ratio, least_pages), "host", "left")
    kept = F.when(F.col("boiler").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x: ~F.array_contains("boiler", x)))
    return joined.withColumn("kept", kept).select(
        "id", "host", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


def html_column(column: str) -> Column:
    return page_lines(whole_text(column))
