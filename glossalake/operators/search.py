"""Full-text search, and search by meaning over passages and images."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import Lexicon
from ..functions.text import cosine, search_words
from .documents import snippets
from .evidence import classified, image_text, matched_terms, parse_terms, themes
from .repository import image_labels

#: Columns of the full-text index.
INDEXED = ("content_text", "page_ref", "source_locator")
#: Fixed values of the ranking, of the least cosine of an image without a term, and of the text that an answer is made from.
K1, B, LEAST_IDF, LEAST_COSINE, PASSAGE = 1.2, 0.75, 1e-6, 0.62, 1600


@dataclass(frozen=True)
class Phrase:
    """Words in a row, in one of `columns`; `prefix`: the last one may go on."""

    words: tuple[str, ...]
    prefix: bool = False
    columns: tuple[str, ...] = INDEXED


Node = Phrase | tuple
_LEXEME = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([()])|([{][^}]*[}]|[^\W_]\w*)\s*:|([^\s"()*:+]+)|([*+]))')


def parse_query(query: str, columns: Sequence[str] = INDEXED) -> Node:
    """A tree of ('and' | 'or' | 'not', left, right) and phrases. Grammar: words and "phrases" (all must be found), OR, AND, NOT, a star after
    a word for prefixes, `column :` or `{columns} :` before a phrase, parentheses. NOT binds most, then AND, then OR. Other marks are errors."""
    at, lexemes = 0, []
    while at < len(query.rstrip()):
        found = _LEXEME.match(query, at)
        if not found:
            raise ValueError(f"full-text syntax error near {query[at:at + 10]!r}")
        lexemes.append(found.groups())
        at = found.end()
    place = 0

    def peek(i: int) -> str | None:
        return lexemes[place][i] if place < len(lexemes) else None

    def words(text: str) -> tuple[str, ...]:
        return tuple(t for t in re.split(r"[\W_]+", _plain(text)) if t)

    def leaf() -> Node:
        nonlocal place
        within = tuple(columns)
        if peek(2):
            within = tuple(c for c in re.split(r"[{}\s]+", peek(2)) if c)
            if unknown := set(within) - set(columns):
                raise ValueError(f"no such column: {', '.join(sorted(unknown))}")
            place += 1
        if peek(1) == "(":
            place += 1
            node = either()
            if peek(1) != ")":
                raise ValueError("full-text syntax error: ) is missing")
            place += 1
            return node
        text = peek(0) if peek(0) is not None else peek(3)
        if text is None or peek(0) is None and re.search(r"[^\w]", text):
            raise ValueError("full-text syntax error")
        place += 1
        found, prefix = words(text), False
        while peek(4) == "+":
            place += 1
            found += words(peek(0) if peek(0) is not None else peek(3) or "")
            place += 1
        if peek(4) == "*":
            prefix = True
            place += 1
        return Phrase(found, prefix, within)

    def word(x: str) -> bool:
        return peek(3) == x and peek(0) is None

    def but() -> Node:
        nonlocal place
        node = leaf()
        while word("NOT"):
            place += 1
            node = ("not", node, leaf())
        return node

    def both() -> Node:
        nonlocal place
        node = but()
        while place < len(lexemes) and not word("OR") and peek(1) != ")":
            place += word("AND")
            node = ("and", node, but())
        return node

    def either() -> Node:
        nonlocal place
        node = both()
        while word("OR"):
            place += 1
            node = ("or", node, both())
        return node

    if not lexemes:
        raise ValueError("an empty full-text query")
    tree = either()
    if place < len(lexemes):
        raise ValueError("full-text syntax error")
    return tree


def _plain(text: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def _leaves(node: Node) -> list[Phrase]:
    return [node] if isinstance(node, Phrase) else [x for n in node[1:] for x in _leaves(n)]


def _count(words: Column, p: Phrase) -> Column:
    """Occurrences of a phrase in words that a blank goes before and after; overlapping ones count."""
    return F.regexp_count(words, F.lit(f" (?={re.escape(' '.join(p.words))}{'' if p.prefix else ' '})")) if p.words else F.lit(0)


def bm25(docs: DataFrame, query: str | Node, key: str = "id", text: Sequence[str] = INDEXED) -> DataFrame:
    """(id, score) of the rows that fit a full-text query, smaller is better. Phrases' frequencies are summed over the columns.

    A scan counts the corpus (rows, mean length, rows by phrase) in one aggregation of one row, which is broadcast to a scan that scores: no
    action runs here, and no token leaves its row.
    """
    tree = parse_query(query, text) if isinstance(query, str) else query
    phrases = list(dict.fromkeys(_leaves(tree)))
    tokens = docs.select(F.col(key).alias("id"), *[search_words(F.coalesce(F.col(c), F.lit(""))).alias(f"t_{c}") for c in text])
    counted = tokens.select("id", sum((F.regexp_count(F.col(f"t_{c}"), F.lit(r" (?=\S)")) for c in text), F.lit(0)).alias("dl"), *[sum((_count(F.col(f"t_{c}"), p) for c in p.columns), F.lit(0)).alias(f"tf{i}") for i, p in enumerate(phrases)])
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(phrases))])

    def fits(node: Node) -> Column:
        if isinstance(node, Phrase):
            return F.col(f"tf{phrases.index(node)}") > 0
        left, right = fits(node[1]), fits(node[2])
        return left & right if node[0] == "and" else left | right if node[0] == "or" else left & ~right

    score = F.lit(0.0)
    for i in range(len(phrases)):
        df, f = F.col(f"df{i}"), F.col(f"tf{i}").cast("double")
        idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
        score = score - idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return counted.filter(fits(tree)).join(F.broadcast(stats)).select("id", score.alias("score"))


def full_text(segments: DataFrame, materials: DataFrame, query: str, material_id: str | None = None, limit: int = 50) -> DataFrame:
    """The best `limit` segments for a query, with their material's title and a snippet; the corpus' counts are of all materials."""
    if not 1 <= limit <= 500 or not 2 <= len(query.strip()) <= 200:
        raise ValueError("limit must be 1 to 500, and a query of 2 to 200 characters is needed")
    tree = parse_query(query.strip())
    m = materials.select(F.col("id").alias("m_id"), F.col("title").alias("material_title"))
    rows = segments.select("id", "material_id", "source_kind", "source_locator", "page_ref")
    rows = rows if material_id is None else rows.filter(F.col("material_id") == material_id)
    found = bm25(segments, tree).join(rows, "id").join(m, F.col("material_id") == F.col("m_id")).drop("m_id").orderBy(F.round("score", 8), "id").limit(limit)
    words = sorted({w for p in _leaves(tree) for w in p.words})
    shown = snippets(segments.select("id", "content_text"), words).withColumnRenamed("id", "s_id")
    return found.join(shown, F.col("id") == F.col("s_id"), "left").drop("s_id").withColumnRenamed("snippet", "snippet_text")




def _scored(embeddings: DataFrame, query: Sequence[float]) -> Column:
    return cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]))


def citation(title: str = "material_title", authors: str = "material_authors", year: str = "material_year") -> Column:
    return F.struct("material_id", F.col(title).alias("title"), F.col(authors).alias("authors"), F.col(year).alias("year"), "segment_id", "page_ref", "source_locator")


def _titles(materials: DataFrame) -> DataFrame:
    return materials.select(F.col("id").alias("m_id"), F.col("title").alias("material_title"), F.col("authors").alias("material_authors"), F.col("year").alias("material_year"))


def semantic(embeddings: DataFrame, segments: DataFrame, materials: DataFrame, query: Sequence[float], model: str, material_id: str | None = None, limit: int = 12) -> DataFrame:
    """The `limit` passages nearest to a query vector under a model, with material and citation.

    Of the embeddings only ids and scores go on; the joins come before the limit, as embeddings without a segment or a material don't count.
    """
    if not 1 <= limit <= 50:
        raise ValueError("limit must be 1 to 50")
    e = embeddings.filter(F.col("model") == model).select("segment_id", F.round(_scored(embeddings, query), 10).alias("score"))
    s = segments.select(F.col("id").alias("s_id"), "material_id", "source_kind", "source_locator", "page_ref", "page_index", "content_text")
    s = s if material_id is None else s.filter(F.col("material_id") == material_id)
    ids = e.join(s.select("s_id", F.col("material_id").alias("of")), F.col("segment_id") == F.col("s_id")).join(materials.select(F.col("id").alias("m")), F.col("of") == F.col("m")).select("segment_id", "score")
    top = ids.orderBy(F.desc("score"), "segment_id").limit(limit)
    full = s.join(F.broadcast(top), F.col("segment_id") == F.col("s_id")).join(_titles(materials), F.col("material_id") == F.col("m_id")).drop("s_id", "m_id")
    return full.withColumn("citation", citation()).withColumn("evidence_type", F.lit("text_passage")).orderBy(F.desc("score"), "segment_id")


def related_observations(observations: DataFrame, found: DataFrame, limit: int = 40) -> DataFrame:
    """Observations of the segments or of the materials of `found`, the newest first."""
    of_segments = observations.join(F.broadcast(found.select(F.col("segment_id").alias("s")).distinct()), F.col("source_segment_id") == F.col("s"), "left_semi")
    of_materials = observations.join(F.broadcast(found.select(F.col("material_id").alias("m")).distinct()), F.col("material_id") == F.col("m"), "left_semi")
    return of_segments.union(of_materials).dropDuplicates(["id"]).orderBy(F.desc("updated_at"), "id").limit(limit)


def image_search(embeddings: DataFrame, images: DataFrame, materials: DataFrame, observations: DataFrame, query: str, vector: Sequence[float], model: str, version: str, material_id: str | None = None, limit: int = 12) -> DataFrame:
    """Images whose text holds a term of the query, or whose vector's cosine is LEAST_COSINE or more: those with a term first, then by cosine."""
    terms = parse_terms(query)
    e = embeddings.filter((F.col("model") == model) & (F.col("method_version") == version)).select(F.col("image_id"), F.round(_scored(embeddings, vector), 10).alias("score"))
    i = images if material_id is None else images.filter(F.col("material_id") == material_id)
    labels = image_labels(observations).select(F.col("source_image_id").alias("l_id"), F.col("labels").alias("observation_labels"))
    both = e.join(i.withColumnRenamed("id", "i_id"), F.col("image_id") == F.col("i_id")).join(labels, F.col("image_id") == F.col("l_id"), "left").join(_titles(materials), F.col("material_id") == F.col("m_id")).drop("i_id", "l_id", "m_id")
    text = image_text(F.col("ocr_text"), F.col("visual_caption"), F.col("observation_labels"), F.col("page_ref"), F.col("source_locator"), F.col("evidence_type"))
    hit = both.withColumn("matched_terms", matched_terms(text, terms)).withColumn("contains_exact_term", F.size("matched_terms") > 0).filter(F.col("contains_exact_term") | (F.col("score") >= LEAST_COSINE))
    shown = hit.withColumns({
        "image_url": image_url(F.col("material_id"), F.col("image_id")), "evidence_level": F.when(F.col("contains_exact_term"), "direct_image_text_match").otherwise("semantic_image_neighbor"),
        "retrieval_basis": F.when(F.col("contains_exact_term"), F.concat(F.lit("OCR/caption matched: "), F.array_join("matched_terms", ", "), F.lit("; ranked with image-text embedding."))).otherwise("Semantic image-text match from OCR/caption text; exact search token not found."),
    })
    return shown.orderBy(F.desc("contains_exact_term"), F.desc("score"), "image_id").limit(limit).drop("image_path")


def image_url(material_id: Column, image_id: Column) -> Column:
    return F.concat(F.lit("/api/v1/repository/materials/"), material_id, F.lit("/images/"), image_id.cast("string"))


def multimodal(texts: DataFrame, images: DataFrame) -> DataFrame:
    """Passages and images as they were found, side by side by kind, never ranked together."""
    a = texts.select(F.lit("text").alias("kind"), F.col("segment_id").cast("string").alias("item_id"), "material_id", "score")
    return a.union(images.select(F.lit("image").alias("kind"), F.col("image_id").cast("string"), "material_id", "score"))


def evidence_report(texts: DataFrame, images: DataFrame, query: str, words: Lexicon = Lexicon()) -> DataFrame:  # noqa: B008
    """Themes, one a material, of passages and images found, each classified by the query's terms."""
    terms = parse_terms(query)
    columns = ("material_id", "material_title", "kind", "item_id", "score", "domain_relevance_score", "research_relevance", "sense")
    a = classified(texts.drop("evidence_type"), terms, "content_text", "source_kind", "source_locator", words)
    text = image_text(F.col("ocr_text"), F.col("visual_caption"), F.col("source_locator"), F.col("page_ref"))
    b = classified(images.drop("evidence_type").withColumn("own_text", text), terms, "own_text", "source_kind", "source_locator", words)
    rows = lambda df, kind, key: df.withColumns({"kind": F.lit(kind), "item_id": F.col(key).cast("string")}).select(*columns)
    return themes(rows(a, "text", "segment_id").union(rows(b, "image", "image_id")))


def evidence_text(texts: DataFrame, most: int = PASSAGE) -> DataFrame:
    """One row: the passages found, numbered from 1 by rank, as an answer's evidence; no rows give an empty text."""
    line = F.concat(F.coalesce("material_title", F.lit("None")), F.lit(" ("), F.coalesce(F.nullif("page_ref", F.lit("")), F.lit("unknown page")), F.lit("): "), F.substring(F.coalesce("content_text", F.lit("")), 1, most))
    ranked = texts.agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "segment_id", line.alias("line")))).alias("r"))  # a search's rows: 50 at most
    return ranked.select(F.array_join(F.transform("r", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["line"])), "\n\n").alias("evidence"))


def ask(texts: DataFrame, question: str, answer) -> str:
    """What the function `answer(question, evidence)` makes of the passages found; without any it isn't called."""
    evidence = evidence_text(texts).first()["evidence"]
    return answer(question, evidence) if evidence else "No retrieved passages were available to answer from the current corpus."
