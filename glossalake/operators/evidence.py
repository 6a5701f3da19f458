"""Terms in their contexts, rule-based relevance and sense of evidence, and the reports made of them."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon as W
from ..functions.lexicon import Lexicon
from ..functions.text import clean_extracted, term_pattern
from .documents import paragraphs_of

RANK = ("high", "medium", "low")


def parse_terms(query: str | None) -> list[str]:
    """The terms of a query that commas, semicolons or line ends separate; white space squeezed, repeats in any case dropped."""
    found: dict[str, str] = {}
    for part in re.split(r"[,;\n]+", query or ""):
        term = " ".join(part.split())
        if term:
            found.setdefault(term.lower(), term)
    return list(found.values())


def matched_terms(text: Column, terms: Sequence[str]) -> Column:
    """The terms that a text holds, in the order given; null holds none."""
    hits = [F.when(F.coalesce(text, F.lit("")).rlike(term_pattern(t)), F.lit(t)) for t in terms]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def contains_any(low: Column, words: Sequence[str]) -> Column:
    """Whether a lower-cased text holds one of the words, as a part of it."""
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def near_domain(low: Column, terms: Sequence[str], domain: Sequence[str], window: int = 120) -> Column:
    """Whether a domain word lies wholly within `window` characters around some occurrence of a term, as a part of the lower-cased text."""
    def near(term: str) -> Column:
        n = len(term)
        parts = F.split(low, re.escape(term), -1)

        def step(s: Column, p: Column) -> Column:
            start = s["at"] + F.length(p)
            return F.struct((start + n).alias("at"), F.concat(s["starts"], F.array(start)).alias("starts"))

        starts = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), F.expr("named_struct('at', 0, 'starts', cast(array() as array<int>))"), step, lambda s: s["starts"])
        around = lambda i: F.substring(low, F.greatest(i - window, F.lit(0)) + 1, F.least(i, F.lit(window)) + n + window)
        return F.coalesce(F.exists(starts, lambda i: contains_any(around(i), domain)), F.lit(False))

    out = F.lit(False)
    for term in terms:
        out = out | near(term.lower())
    return out


def looks_like_wordlist(text: Column, kind: Column, locator: Column) -> Column:
    """Header words or row cues in the first 1,000 characters, or a csv locator. Nulls are empty."""
    empty = F.lit("")
    low = F.lower(F.concat_ws(" ", F.coalesce(kind, empty), F.coalesce(locator, empty), F.substring(F.coalesce(text, empty), 1, 1000)))
    heads = F.lit(True)
    for w in W.WORDLIST_HEADERS:
        heads = heads & low.contains(w)
    return heads | contains_any(low, W.WORDLIST_ROWS) | low.rlike(W.WORDLIST_CELL) | F.lower(F.coalesce(locator, empty)).endswith(".csv")


def looks_like_bibliography(text: Column, kind: Column, locator: Column) -> Column:
    """A heading word, or a text under 2,500 characters with three citations and two publishers' words. Nulls are empty."""
    empty = F.lit("")
    text = F.coalesce(text, empty)
    low = F.lower(F.concat_ws(" ", F.coalesce(kind, empty), F.coalesce(locator, empty), text))
    cited = (F.regexp_count(text, F.lit(W.CITATION)) >= 3) & (F.regexp_count(low, F.lit(W.PUBLISHER)) >= 2) & (F.length(text) < 2500)
    return contains_any(low, W.BIBLIOGRAPHY) | cited


def classified(rows: DataFrame, terms: Sequence[str], text: str, kind: str, locator: str, words: Lexicon = Lexicon()) -> DataFrame:  # noqa: B008
    """rows with domain_relevance_score (0 to 10), sense, research_relevance, relevance_reason and evidence_type.

    The cues are columns of a first projection, so each is found once. Null texts have no cue. Existing columns of these names are replaced.
    """
    t, k, loc = F.col(text), F.col(kind), F.col(locator)
    low = F.lower(F.coalesce(t, F.lit("")))
    cues = {
        "c_exact": F.size(matched_terms(t, terms)), "c_domain": sum((low.contains(w).cast("int") for w in words.domain), F.lit(0)),
        "c_near": near_domain(low, terms, words.domain), "c_tool": contains_any(low, words.tool), "c_production": contains_any(low, words.production),
        "c_wordlist": looks_like_wordlist(t, k, loc), "c_negative": contains_any(low, words.negative), "c_bibliography": looks_like_bibliography(t, k, loc),
        "c_paper": contains_any(low, words.paper), "c_ritual": contains_any(low, words.ritual), "c_lexical": contains_any(low, words.lexical),
    }
    c = lambda n: F.col(f"c_{n}")
    plus = lambda n, v: F.when(c(n), F.lit(v)).otherwise(0.0)
    raw = F.least(c("exact") * 1.5, F.lit(4.0)) + F.least(c("domain") * 0.45, F.lit(4.0)) + plus("near", 2.0) + plus("tool", 1.5) + plus("production", 1.8) + plus("wordlist", 1.5) + plus("negative", -2.5) + plus("bibliography", -1.5)
    score = F.round(F.greatest(F.lit(0.0), F.least(raw, F.lit(10.0))), 3)
    domain = c("domain") > 0
    # A cue's sense, and whether its relevance is high, else medium, else low; the first cue that holds decides.
    s, yes, no = F.col("domain_relevance_score"), F.lit(True), F.lit(False)
    rules = (
        ("lexical_wordlist", c("wordlist"), c("lexical") | (s >= 3), yes), ("bibliographic_lead", c("bibliography"), no, domain), ("bark_paper_or_related_technology", c("paper"), c("near") | (s >= 5), yes),
        ("tool_or_beater", c("tool") & (c("near") | domain), yes, yes), ("production_action", c("production") & (c("near") | domain), yes, yes),
        ("ritual_or_non_barkcloth_action", c("ritual"), no, domain), ("metaphor_or_general_usage", c("negative"), no, no), ("needs_review", yes, no, domain | (s >= 3)),
    )
    sense, relevance = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, holds, high, medium in reversed(rules):
        sense = F.when(holds, name).otherwise(sense)
        relevance = F.when(holds, F.when(high, "high").when(medium, "medium").otherwise("low")).otherwise(relevance)
    about = {"evidence_type": 0, "relevance_reason": 1}
    table = {k: F.create_map(*[F.lit(x) for n, v in W.SENSES.items() for x in (n, v[i])]) for k, i in about.items()}
    scored = rows.withColumns(cues).withColumn("domain_relevance_score", score).withColumns({"sense": sense, "research_relevance": relevance})
    return scored.withColumns({k: m[F.col("sense")] for k, m in table.items()}).drop(*cues)


def term_contexts(segments: DataFrame, terms: Sequence[str], window: int = 1, key: str = "id", text: str = "content_text") -> DataFrame:
    """One row for each paragraph that holds a term: id, paragraph_index (from 0), matched_terms, terms_in_context, all_terms_in_context,
    before, match, after, context_text. `window` paragraphs of the same text on either side belong to the context; arrays in a row, so no shuffle."""
    if not terms or not 0 <= window <= 3:
        raise ValueError("terms are needed, and a window of 0 to 3")
    any_term = "|".join(term_pattern(t) for t in terms)
    paras = segments.filter(F.col(text).rlike(any_term)).select(F.col(key).alias("id"), paragraphs_of(F.col(text)).alias("ps"))
    each = paras.select("id", "ps", F.posexplode("ps").alias("i", "match")).withColumn("matched_terms", matched_terms(F.col("match"), terms)).filter(F.size("matched_terms") > 0)
    before = F.slice("ps", F.greatest(F.col("i") - window + 1, F.lit(1)), F.least(F.col("i"), F.lit(window)))
    both = each.select("id", F.col("i").alias("paragraph_index"), "matched_terms", F.array_join(before, "\n\n").alias("before"), "match", F.array_join(F.slice("ps", F.col("i") + 2, window), "\n\n").alias("after"))
    parts = F.array("before", "match", "after")
    out = both.withColumn("context_text", F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")).withColumn("terms_in_context", matched_terms(F.col("context_text"), terms))
    return out.withColumn("all_terms_in_context", F.size("terms_in_context") == len(terms))


def context_report(segments: DataFrame, materials: DataFrame, query: str, window: int = 1, most: int = 200, material_id: str | None = None, words: Lexicon = Lexicon()) -> DataFrame:  # noqa: B008
    """The contexts of a query's terms with their material, classified, the most relevant first, `most` of them; wordlist_rows where a context is a table.

    segments: id, material_id, source_kind, source_locator, page_ref, page_index, content_text; materials: id, title, authors, year. A query
    without terms is an error. Segments of unknown materials are left out. The first `most` rows are found by a distributed top-k; word lists are read in these alone.
    """
    terms = parse_terms(query)
    some = segments if material_id is None else segments.filter(F.col("material_id") == material_id)
    found = term_contexts(some, terms, window).withColumnRenamed("id", "segment_id")
    of = some.select(F.col("id").alias("s_id"), "material_id", "source_kind", "source_locator", "page_ref", "page_index")
    m = materials.select(F.col("id").alias("m_id"), F.col("title").alias("material_title"), F.col("authors").alias("material_authors"), F.col("year").alias("material_year"))
    both = found.join(of, F.col("segment_id") == F.col("s_id")).join(m, F.col("material_id") == F.col("m_id")).drop("s_id", "m_id")
    rank = relevance_rank(F.col("research_relevance"))
    order = (rank, F.desc("domain_relevance_score"), F.lower(F.coalesce("material_title", F.lit(""))), F.coalesce("page_index", F.lit(999999)), "segment_id", "paragraph_index")
    top = classified(both, terms, "context_text", "source_kind", "source_locator", words).orderBy(*order).limit(most)
    return top.withColumn("wordlist_rows", wordlist_rows(terms)(F.col("context_text")))


def cooccurrences(report: DataFrame) -> DataFrame:
    """Of a report's rows, after its limit, how many have all terms in their context."""
    return report.agg(F.count(F.lit(1)).alias("total_matches"), F.count_if("all_terms_in_context").alias("cooccurrence_count"))


def relevance_rank(relevance: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, RANK)), relevance), F.lit(0)) + F.when(relevance.isin(*RANK), 0).otherwise(len(RANK) + 1)


# The fields of a word list in a text.
_ROW = "array<struct<language_name:string,concept:string,concept_group:string,form:string,source:string,latitude:string,longitude:string>>"
_FIELDS = ("language_name", "concept", "concept_group", "form", "source", "latitude", "longitude")


def _table_reader():
    """A function made here goes to the workers by value: they need not have this package."""

    def read(text: str | None, patterns: Sequence[re.Pattern], most: int) -> list[dict] | None:
        """Rows of a csv table that stands in a text: lines with a comma, of which the first names three or more of the first five fields. None without one."""
        lines = [x for x in (text or "").splitlines() if "," in x]
        if len(lines) < 2:
            return None
        plain = lambda h: re.sub(r"[^a-z0-9]+", "_", (h or "").strip().lower()).strip("_")
        out: list[dict] = []
        try:
            reader = csv.DictReader(lines)
            if len({plain(h) for h in reader.fieldnames or ()} & set(_FIELDS[:5])) < 3:
                return None
            for raw in reader:
                row = {plain(k): v for k, v in raw.items() if k is not None}
                cells = " ".join(row.get(k) or "" for k in ("concept", "concept_group", "form"))
                if not patterns or any(p.search(cells) for p in patterns):
                    out.append({k: row.get(k) for k in _FIELDS})
                    if len(out) == most:
                        break
        except csv.Error:
            return None
        return out or None

    return read


def wordlist_rows(terms: Sequence[str], most: int = 20):
    """A column function: the rows of a word list in a text that fit a term, `most` at most; null without one."""
    sources = [term_pattern(t).removeprefix("(?iU)") for t in terms]
    table_rows = _table_reader()

    @F.pandas_udf(_ROW)
    def read(texts: pd.Series) -> pd.Series:
        patterns = [re.compile(s, re.IGNORECASE) for s in sources]
        return pd.Series([table_rows(t, patterns, most) for t in texts], dtype=object)

    return read


def themes(items: DataFrame) -> DataFrame:
    """By material: counts by relevance, the three commonest senses, and passages, the most relevant first, as a report lists them.

    items: material_id, material_title, kind ('text' or 'image'), item_id, score, domain_relevance_score, research_relevance, sense. What is
    gathered in a row is one material's retrieved items, of which retrieval sets the number. Ordered by high, then medium counts, then best score, then title.
    """
    rank = relevance_rank(F.col("research_relevance"))
    key = F.struct(rank.alias("rank"), (-F.col("domain_relevance_score")).alias("d"), (-F.col("score")).alias("s"), F.col("item_id").cast("string").alias("item_id"))
    listed = lambda kind: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, key))), lambda x: x["item_id"])
    n = {r: F.count_if(F.col("research_relevance") == r).alias(f"{r}_relevance_count") for r in RANK}
    best = F.max(F.greatest("score", "domain_relevance_score")).alias("max_score")
    by = items.groupBy("material_id").agg(F.min("material_title").alias("material_title"), *n.values(), best, listed("text").alias("passages"), listed("image").alias("image_passages"))
    senses = items.groupBy("material_id", "sense").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.row_number().over(Window.partitionBy("material_id").orderBy(F.desc("n"), "sense"))).filter("k <= 3")
    top = senses.groupBy(F.col("material_id").alias("m")).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "sense"))), lambda x: x["sense"]).alias("dominant_senses"))
    both = by.join(top, by["material_id"].eqNullSafe(top["m"])).drop("m")
    return both.orderBy(F.desc("high_relevance_count"), F.desc("medium_relevance_count"), F.desc("max_score"), F.lower("material_title"))


def image_text(*parts: Column) -> Column:
    """The parts that aren't empty, a blank line between them, cleaned."""
    return clean_extracted(F.concat_ws("\n\n", *[F.nullif(p, F.lit("")) for p in parts]))


# What image labels open with, phrases that are no label, and words of doubt.
PREAMBLE = r"(?i)^(the image|this image|the provided image|the image you've provided)\s+(appears to be|shows|contains|depicts|is)\s+"
VAGUE = ("visible objects and features", "visible features", "here are the visible objects and features", "not fully legible", "cannot determine")
DOUBT = ("could be", "might be", "appears to", "suggests", "likely", "possibly", "purpose", "imply", "significance")


def image_labels(text: Column, most: int = 12, longest: int = 60) -> Column:
    """A description as a list of labels, '; ' between them: no preamble, no emphasis or numbering, nothing long, vague or doubtful, no repeats."""
    bare = F.regexp_replace(F.replace(F.regexp_replace(clean_extracted(text), PREAMBLE, ""), F.lit("**"), F.lit("")), r"(?U)\b\d+\.\s*", "")
    label = lambda x: F.regexp_replace(F.lower(F.regexp_replace(x, r"^[ .:\-]+|[ .:\-]+$", "")), r"(?U)\s+", " ")
    good = lambda x: (x != "") & (F.length(x) <= longest) & ~x.isin(*VAGUE) & ~contains_any(x, DOUBT)
    found = F.filter(F.transform(F.split(bare, r"(?U)[,;\n]|\s+-\s+"), label), good)
    return F.coalesce(F.array_join(F.slice(F.array_distinct(found), 1, most), "; "), F.lit(""))
