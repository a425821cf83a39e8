"""Offline crawling: pages already fetched become texts, links, and a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.html import clean_text


def page_path(project: Column | str, url: Column | str, root: str = "pages", suffix: str = ".txt") -> Column:
    return F.concat(F.lit(root + "/"), F.col(project) if isinstance(project, str) else project, F.lit("/"), U.url_key(url), F.lit(suffix))


def cleaned_pages(pages: DataFrame, project: str) -> DataFrame:
    """(project, url, url_key, text) of pages that were fetched: url normalised, html not null."""
    ok = pages.where("html is not null").withColumn("url", U.normalize_url("url"))
    return ok.select(F.lit(project).alias("project"), "url", U.url_key("url").alias("url_key"), clean_text("html").alias("text"))


def discovered(pages: DataFrame) -> DataFrame:
    """(page_url, links): the documentation links of each page, in any form of reference."""
    hrefs = pages.select(F.col("url").alias("page_url"), F.explode(U.extract_hrefs("html")).alias("href"))
    links = hrefs.withColumn("link", U.normalize_url(F.coalesce(U.resolve_simple("page_url", "href"), U.resolve("page_url", "href"))))
    good = links.where(U.is_doc_link("link", U.netloc("page_url")))
    return good.groupBy("page_url").agg(F.array_sort(F.collect_set("link")).alias("links"))


def manifest(pages: DataFrame, seq: str = "page_id") -> DataFrame:
    """One row for each project: root_url (the first page), visited and saved_pages in order, each url once."""
    each = pages.groupBy("project", "url").agg(F.min(seq).alias("seq"))
    saved = F.struct("seq", "url", page_path("project", "url").alias("page_path"), page_path("project", "url", "trees", ".json").alias("tree_path"))
    rows = each.groupBy("project").agg(F.array_sort(F.collect_list(saved)).alias("s"))
    drop = F.transform("s", lambda x: F.struct(x["url"].alias("url"), x["page_path"].alias("page_path"), x["tree_path"].alias("tree_path")))
    return rows.select("project", F.col("s")[0]["url"].alias("root_url"), F.transform("s", lambda x: x["url"]).alias("visited"), drop.alias("saved_pages"))


def unvisited(requests: DataFrame, visited: DataFrame) -> DataFrame:
    """Requests (project, url) that no manifest row (project, url) has."""
    return requests.join(visited.select("project", "url"), ["project", "url"], "left_anti")


def lookup(texts: DataFrame, requests: DataFrame, missing: str = "Page not found") -> DataFrame:
    """(project, url_key, text) for each request, the literal where there is none."""
    found = requests.join(texts.select("project", "url_key", "text"), ["project", "url_key"], "left")
    return found.withColumn("text", F.coalesce("text", F.lit(missing)))


def transcripts(rows: DataFrame, least: int = 50) -> DataFrame:
    """(transcript, title, char_count, success): a fetch succeeded if its transcript has more than `least` characters."""
    n = F.coalesce(F.length("transcript"), F.lit(0))
    return rows.withColumn("char_count", n).withColumn("success", n > least)


def tree_text(items: DataFrame) -> DataFrame:
    """(url, tree): the text items of a page's snapshot, joined in order."""
    from .aggregate import ordered_concat

    return items.groupBy("url").agg(ordered_concat("text", "seq", "").alias("tree"))
