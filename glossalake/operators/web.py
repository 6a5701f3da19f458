"""Web pages and scanned lines: visible text and links of html, breadth-first crawls over stored pages, numbered manuscript lines."""

from __future__ import annotations

import html
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_extracted, normal_url, unnumbered

__all__ = ["HIDDEN", "clean_extracted", "crawl", "html_extract", "page_links", "unnumbered"]

#: Elements whose text isn't shown (fixed values).
HIDDEN = frozenset(("noscript", "script", "style"))


def _reader() -> Callable[[str], tuple[str, list[str], str | None]]:
    """A function made here goes to the workers by value: they need not have this package."""

    def read(page: str) -> tuple[str, list[str], str | None]:
        """Visible text (a line for each run of text), targets of anchors, and title (None without one; its text is in the body too)."""
        runs: list[tuple[str, bool]] = []
        targets: list[str] = []
        hidden, titled = 0, False
        reader = HTMLParser()

        def begin(tag: str, attrs: list[tuple[str, str | None]]) -> None:
            nonlocal hidden, titled
            hidden += tag in HIDDEN
            titled |= tag == "title"
            targets.extend(v.strip() for k, v in dict(attrs).items() if tag == "a" and k == "href" and v)

        def end(tag: str) -> None:
            nonlocal hidden, titled
            hidden = max(0, hidden - (tag in HIDDEN))
            titled &= tag != "title"

        def data(text: str) -> None:
            run = " ".join(html.unescape(text).split())  # references are resolved a second time, as clients expect
            if run and not hidden:
                runs.append((run, titled))

        reader.handle_starttag, reader.handle_endtag, reader.handle_data = begin, end, data
        reader.feed(page)
        return "\n".join(r for r, _ in runs), targets, " ".join(r for r, t in runs if t) or None

    return read


def html_extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row for each page: id, text, links, title. Null html gives an empty text and no links; other columns are not read."""
    rows = pages.select(F.col(id_col), F.col(html_col))
    kind = rows.schema[id_col].dataType.simpleString()

    read = _reader()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read(x or "") for x in batch.column(1).to_pylist()]
            columns = [batch.column(0), *(pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.list_(pa.string()), pa.string())))]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "text", "links", "title"])

    return rows.mapInArrow(run, f"{id_col} {kind}, text string, links array<string>, title string")


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, pos, dst): the links of each page, in their order, as full urls of http or https; others are left out. This is what crawl() reads."""
    read = _reader()

    @F.pandas_udf("array<string>")
    def targets(urls: pd.Series, pages: pd.Series) -> pd.Series:
        return pd.Series([[_joined(u, x) for x in read(p or "")[1]] for u, p in zip(urls, pages, strict=True)], dtype=object)

    def _joined(url: str, target: str) -> str | None:
        try:
            return urljoin(url, target)
        except ValueError:
            return None

    some = pages.filter(F.col(url_col).isNotNull()).select(F.col(url_col).alias("src"), F.posexplode(targets(url_col, html_col)).alias("pos", "to"))
    return some.select("src", "pos", normal_url(F.col("to")).alias("dst")).filter("dst IS NOT NULL")


def crawl(edges: DataFrame, pages: DataFrame, root, max_depth: int = 1, max_pages: int = 20) -> DataFrame:
    """Breadth-first visits from `root`: url, source_url, depth, status ('ok', or 'fetch_error' for urls that `pages` lacks).

    edges (src, pos, dst): links of a page in their order; pages (url, and a status, such as http_404 or access_restricted, if there is such a column). A url is visited once, from the first page in
    visiting order that names it; pages that can't be fetched count as visits but lead nowhere. `max_pages` and `max_depth` are
    the crawl's own limits, so each level's frontier is at most max_pages rows. Null targets are no links.
    """
    told = F.col("status") if "status" in pages.columns else F.lit("ok")
    known = pages.groupBy(F.col("url").alias("k")).agg(F.max(told).alias("status"))

    def visit(level: DataFrame) -> DataFrame:
        return level.join(known, F.col("url") == F.col("k"), "left").withColumn("status", F.coalesce("status", F.lit("fetch_error"))).drop("k")

    columns = ("url", "source_url", "depth", "place", "status")
    start = edges.sparkSession.range(1).select(F.lit(root).alias("url"))
    visited = level = visit(start.select("url", F.col("url").alias("source_url"), F.lit(0).alias("depth"), F.array(F.lit(0).cast("long")).alias("place"))).select(*columns)
    for depth in range(1, max_depth + 1):
        ahead = level.filter("status = 'ok'").select(F.col("url").alias("from"), "place")
        named = edges.join(ahead, F.col("src") == F.col("from")).filter("dst IS NOT NULL")
        # Places are paths of positions from the root: of one depth, they sort as a queue would serve them.
        first = named.groupBy("dst").agg(F.min_by(F.struct("src", "pos", "place"), F.struct("place", "pos")).alias("m"))
        new = first.join(visited.select(F.col("url").alias("seen")), F.col("dst") == F.col("seen"), "left_anti")
        new = new.select(F.col("dst").alias("url"), F.col("m.src").alias("source_url"), F.lit(depth).alias("depth"), F.concat("m.place", F.array(F.col("m.pos").cast("long"))).alias("place"))
        level = visit(new.orderBy("place").limit(max_pages)).select(*columns).cache()  # max_pages rows at most; the next level doesn't find them again
        visited = visited.union(level)
    return visited.orderBy("depth", "place").limit(max_pages).select("url", "source_url", "depth", "status")
