"""Html, crawls and manuscript lines against hand-made cases and plain Python."""

import random
from collections import deque

from pyspark.sql import functions as F

from glossalake.operators import web as W


def test_html(spark):
    page = "<title>A &amp;amp; B</title><style>x</style><p>one\n two</p><script>no<b></b></script><a href=' /u '>three</a><a>four</a><a href=''>"
    rows = spark.createDataFrame([(1, page, "x"), (2, None, "x"), (3, "", "x"), (None, "a<br>b", "x")], "page_id int, html string, text string")
    got = {r.page_id: (r.text, r.links, r.title) for r in W.html_extract(rows).collect()}
    assert got == {1: ("A & B\none two\nthree\nfour", ["/u"], "A & B"), 2: ("", [], None), 3: ("", [], None), None: ("a\nb", [], None)}
    assert W.html_extract(rows.limit(0)).count() == 0


def _queue(edges, known, root, max_depth, max_pages):
    """Visits with a plain queue."""
    seen, out, todo = set(), [], deque([(root, 0, root)])
    while todo and len(seen) < max_pages:
        url, depth, source = todo.popleft()
        if url in seen:
            continue
        seen.add(url)
        out.append((url, source, depth, "ok" if url in known else "fetch_error"))
        if url in known and depth < max_depth:
            todo.extend((d, depth + 1, url) for _, d in sorted(edges.get(url, []), key=lambda e: e[0]) if d is not None and d not in seen)
    return out


def test_crawl(spark):
    rng = random.Random(3)
    edges = {i: [(k, None if rng.random() < 0.1 else rng.randrange(60)) for k in range(4)] for i in range(60)}
    known = set(range(50))
    e = spark.createDataFrame([(i, k, d) for i, x in edges.items() for k, d in x], "src long, pos int, dst long")
    p = spark.createDataFrame([(i,) for i in known], "url long")
    for depth, pages in ((0, 20), (1, 20), (3, 25), (3, 500)):
        got = [tuple(r) for r in W.crawl(e, p, 7, depth, pages).collect()]
        assert got == _queue(edges, known, 7, depth, pages)


def test_manuscript(spark):
    numbered = "1 In the be-\n2 ginning was\n3 a line\n\n4 and then\n5 another of\n6 the last in 1999"
    trailing = "\n".join(f"line {w} {n}" for n, w in enumerate("abcdef", 1))
    few = "1 a\n2 b\n3 c\n4 d\n5 e"
    sparse = "\n".join(["1 a", "2 b", "3 c", "4 d"] + ["word"] * 20)
    cases = {numbered: "In the beginning was a line\n\nand then another of the last in 1999", trailing: "line a line b line c line d line e line f", few: few, sparse: sparse, "": "", "a\x00b\r\nc  d ": "a b\nc d", None: ""}
    rows = spark.createDataFrame([(t, w) for t, w in cases.items()], "t string, want string")
    for r in rows.select("t", "want", W.clean_extracted(F.col("t")).alias("got")).collect():
        assert r.got == r.want, r.t


def test_crawl_statuses(spark):
    pages = spark.createDataFrame([("a", "ok"), ("b", "http_404"), ("c", "ok"), ("d", "access_restricted")], "url string, status string")
    edges = spark.createDataFrame([("a", 0, "b"), ("a", 1, "c"), ("b", 0, "x"), ("c", 0, "d"), ("c", 1, "a"), ("c", 2, "y")], "src string, pos int, dst string")
    got = [(r.url, r.depth, r.status) for r in W.crawl(edges, pages, "a", 3, 10).collect()]
    assert got == [("a", 0, "ok"), ("b", 1, "http_404"), ("c", 1, "ok"), ("d", 2, "access_restricted"), ("y", 2, "fetch_error")]
