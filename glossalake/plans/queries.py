"""The engine's registered queries over the driver's tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import Lexicon
from ..operators import clustering as G
from ..operators import documents as D
from ..operators import evidence as E
from ..operators import images as P
from ..operators import indexing as I
from ..operators import lexical as X
from ..operators import repository as R
from ..operators import search as S
from ..operators import store as K
from ..operators import tiles as V
from ..operators import web as W
from ..sources import text_tables as C
from ..sources.fixtures import oracle, views
from ..streaming import maintenance as M

GLOSSES = ["PROMO", "SMALL"]
STAR = "SELECT l.*, f.Value AS form_value, p.Concepticon_Gloss AS parameter_name FROM languages l JOIN forms f ON l.ID = f.Language_ID JOIN parameters p ON f.Parameter_ID = p.ID"
OK = "TRY_CAST(Latitude AS DOUBLE) <> 0 AND TRY_CAST(Longitude AS DOUBLE) <> 0"
LEXICAL = ("languages", "forms", "parameters")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, *names: str, sql: str | None = None):
    """Registers a function of the named views."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(*views(spark, sf_dir, *names))
        if sql:
            ORACLE_SQL[name] = oracle(sql, *names)
        return f

    return add


IN = "('PROMO', 'SMALL')"
query("full_data_combined", *LEXICAL, sql=f"SELECT ID, Glottocode, CAST(Latitude AS DOUBLE) AS Latitude, CAST(Longitude AS DOUBLE) AS Longitude, form_value, parameter_name, dataset_name FROM ({STAR}) s WHERE parameter_name IN {IN} AND {OK}")(lambda l, f, p: X.full_data(l, f, p, GLOSSES))
query("data_star_by_gloss", *LEXICAL, sql=f"SELECT * FROM ({STAR}) s WHERE parameter_name IN {IN}")(lambda l, f, p: X.star(l, f, p, GLOSSES))
query("data_form_param_filter", *LEXICAL, sql=f"SELECT * FROM ({STAR}) s WHERE lower(form_value) LIKE '%no-_%' AND lower(parameter_name) LIKE '%eco%'")(lambda l, f, p: X.search(X.star(l, f, p), form="NO-_", parameter="Eco"))
query("data_languages_only", "languages", sql="SELECT * FROM languages WHERE lower(Name) LIKE '%00001%'")(lambda l: X.search(l, name="00001"))
query("data_combined_search", *LEXICAL, sql=f"SELECT * FROM ({STAR}) s WHERE parameter_name IN {IN} AND (lower(Name) LIKE '%7%' OR lower(dataset_name) LIKE '%7%')")(lambda l, f, p: X.search(X.star(l, f, p, GLOSSES), name="7", also="dataset_name"))
query("data_page", "languages", sql="SELECT * FROM languages ORDER BY ID LIMIT 100 OFFSET 50")(lambda l: X.page(l, ["ID"], 100, 50))
query("data_total", *LEXICAL, sql=f"SELECT count(*) AS total FROM ({STAR}) s WHERE parameter_name IN {IN}")(lambda l, f, p: X.star(l, f, p, GLOSSES).agg(F.count(F.lit(1)).alias("total")))
query("coord_filter", "languages", sql=f"SELECT ID, CAST(Latitude AS DOUBLE) AS Latitude, CAST(Longitude AS DOUBLE) AS Longitude FROM languages WHERE {OK}")(lambda l: X.located(l).select("ID", "Latitude", "Longitude"))
query("flat_search", "flat", sql="SELECT * FROM flat WHERE lower(Name) LIKE '%1%' OR lower(Description) LIKE '%1%'")(lambda d: X.search(d, name="1", also="Description"))
_S, _N, _W, _E = X.box(10.0, 20.0, 3000.0)
query("bbox_radius", "languages", sql=f"SELECT ID FROM languages WHERE TRY_CAST(Latitude AS DOUBLE) BETWEEN {_S!r} AND {_N!r} AND TRY_CAST(Longitude AS DOUBLE) BETWEEN {_W!r} AND {_E!r}")(lambda l: X.in_box(l, 10.0, 20.0, 3000.0).select("ID"))
query("catalog_counts", "languages", sql=f"SELECT dataset_name, count(*) AS n FROM languages WHERE {OK} GROUP BY 1")(X.catalog)
query("catalog_counts_by_gloss", *LEXICAL, sql=f"SELECT dataset_name, count(DISTINCT ID) AS n FROM ({STAR}) s WHERE parameter_name IN {IN} AND {OK} GROUP BY 1")(lambda l, f, p: X.catalog_by_gloss(l, f, p, GLOSSES))
query("catalog_combined_total", *LEXICAL, sql=f"SELECT 'Combined' AS dataset_name, CAST(sum(n) AS BIGINT) AS n FROM (SELECT dataset_name, count(DISTINCT ID) AS n FROM ({STAR}) s WHERE parameter_name IN {IN} AND {OK} GROUP BY 1)")(lambda l, f, p: X.combined_total(X.catalog_by_gloss(l, f, p, GLOSSES)))
query("dataset_list", "languages", sql="SELECT DISTINCT dataset_name FROM languages")(lambda l: l.select("dataset_name").distinct())
query("gloss_list", "parameters", sql="SELECT DISTINCT Concepticon_Gloss FROM parameters WHERE Concepticon_Gloss IS NOT NULL ORDER BY 1")(lambda p: p.select("Concepticon_Gloss").dropna().distinct().orderBy("Concepticon_Gloss"))
query("gloss_index_build", *LEXICAL, sql=f"SELECT DISTINCT dataset_name, parameter_name AS Concepticon_Gloss FROM ({STAR}) s WHERE parameter_name IS NOT NULL")(X.gloss_index)
query("gloss_list_for_datasets", *LEXICAL, sql=f"SELECT DISTINCT parameter_name AS Concepticon_Gloss FROM ({STAR}) s WHERE parameter_name IS NOT NULL AND dataset_name IN ('FRANCE', 'CHINA', 'NATION_1')")(lambda l, f, p: X.gloss_index(l, f, p).filter(F.col("dataset_name").isin("FRANCE", "CHINA", "NATION_1")).select("Concepticon_Gloss").distinct())
query("gloss_search", "parameters", sql="SELECT DISTINCT Concepticon_Gloss FROM parameters WHERE lower(Concepticon_Gloss) LIKE '%m%' ORDER BY 1")(lambda p: p.filter(T.like_any_case(F.col("Concepticon_Gloss"), "M")).select("Concepticon_Gloss").distinct().orderBy("Concepticon_Gloss"))
query("schema_types", "languages")(X.schema_kinds)
query("json_sanitize", "flat", sql="SELECT ID, CASE WHEN ID % 3 = 0 THEN NULL ELSE CAST(ID AS DOUBLE) END AS v FROM flat")(lambda d: X.json_safe(d.select("ID", F.when(F.col("ID") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("ID").cast("double")).alias("v"))))
TILES = "SELECT z, x, y FROM (VALUES (1), (3), (6)) a(z), (VALUES (0), (1)) b(x), (VALUES (0), (1)) c(y)"


def _tiles(spark: SparkSession, _: str) -> DataFrame:
    b = X.tile_bounds(spark.sql("SELECT explode(array(1, 3, 6)) AS z").select("z", F.explode(F.array(F.lit(0), F.lit(1))).alias("x")).select("z", "x", F.explode(F.array(F.lit(0), F.lit(1))).alias("y")))
    return b.select("z", "x", "y", *[F.round(c, 6).alias(c) for c in ("west", "south", "east", "north")])


QUERIES["tile_bounds"] = _tiles
ORACLE_SQL["tile_bounds"] = f"SELECT z, x, y, round(x / pow(2.0::DOUBLE, z) * 360 - 180, 6) AS west, round(degrees(atan(sinh(pi() * (1 - 2.0::DOUBLE * (y + 1) / pow(2.0::DOUBLE, z))))), 6) AS south, round((x + 1) / pow(2.0::DOUBLE, z) * 360 - 180, 6) AS east, round(degrees(atan(sinh(pi() * (1 - 2.0::DOUBLE * y / pow(2.0::DOUBLE, z))))), 6) AS north FROM ({TILES})"
query("tile_points", "languages", sql="SELECT ID, CAST(floor((CAST(Longitude AS DOUBLE) + 90) / 180 * 4096) AS INT) AS gx, CAST(floor((ln(tan(radians(45 + 60.0::DOUBLE / 2))) - ln(tan(radians(45 + CAST(Latitude AS DOUBLE) / 2)))) / (ln(tan(radians(45 + 60.0::DOUBLE / 2))) - ln(tan(radians(45 - 60.0::DOUBLE / 2)))) * 4096) AS INT) AS gy FROM languages WHERE TRY_CAST(Latitude AS DOUBLE) BETWEEN -60 AND 60 AND TRY_CAST(Longitude AS DOUBLE) BETWEEN -90 AND 90")(lambda l: X.in_tile(l, -90.0, -60.0, 90.0, 60.0).select("ID", "gx", "gy"))
CONCEPTS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
query("binary_matrix", *LEXICAL, sql=f"SELECT ID, Glottocode, Latitude, Longitude, {', '.join(f'CAST(max(CASE WHEN parameter_name = {chr(39)}{c}{chr(39)} THEN 1 ELSE 0 END) AS INT) AS {c}' for c in CONCEPTS)} FROM ({STAR}) s WHERE parameter_name IS NOT NULL AND Latitude IS NOT NULL GROUP BY ALL")(lambda l, f, p: X.binary_matrix(X.star(l, f, p), ["ID", "Glottocode", "Latitude", "Longitude"], "parameter_name", "form_value", CONCEPTS))
query("matrix_coverage", *LEXICAL, sql=f"SELECT round(count(*) * 100.0::DOUBLE / (count(DISTINCT ID) * count(DISTINCT parameter_name)), 1) AS coverage FROM (SELECT DISTINCT ID, parameter_name FROM ({STAR}) s WHERE parameter_name IS NOT NULL)")(lambda l, f, p: X.coverage(X.star(l, f, p), "ID", "parameter_name"))

MF = ("materials", "files")
_FILES = "LEFT JOIN (SELECT material_id AS fm, count(id) AS file_count FROM files GROUP BY 1) f ON f.fm = m.id"
query("material_list", *MF, sql="SELECT m.*, count(f.id) AS file_count FROM materials m LEFT JOIN files f ON f.material_id = m.id GROUP BY ALL")(R.with_file_count)
_LIKES = " OR ".join(f"lower(coalesce({c}, '')) LIKE '%{{q}}%'" for c in (*R.SEARCHED, "original_filename"))
_SEARCH = f"SELECT m.*, count(f.id) AS file_count FROM materials m LEFT JOIN files f ON f.material_id = m.id WHERE ({_LIKES} OR EXISTS (SELECT 1 FROM observations o WHERE o.material_id = m.id AND (lower(observed_text) LIKE '%{{q}}%' OR lower(coalesce(notes, '')) LIKE '%{{q}}%' OR lower(coalesce(context_quote, '')) LIKE '%{{q}}%')))"
query("material_search_exists", *MF, "observations", sql=_SEARCH.format(q="no 1") + " GROUP BY ALL")(lambda m, f, o: R.search_materials(m, f, o, "NO 1"))
query("material_search_file", *MF, "observations", sql=_SEARCH.format(q="e.t") + " GROUP BY ALL")(lambda m, f, o: R.search_materials(m, f, o, "e.t"))
query("material_page", *MF, "observations", sql=_SEARCH.format(q="a") + " AND status = 'ready_for_text_extraction' AND source_type = 'pdf' GROUP BY ALL ORDER BY updated_at DESC, id LIMIT 3 OFFSET 1")(lambda m, f, o: R.list_materials(m, f, o, "a", status="ready_for_text_extraction", source_type="pdf", limit=3, offset=1)[0])
query("material_total", *MF, "observations", sql="SELECT count(*) AS total FROM (" + _SEARCH.format(q="a") + " AND source_type = 'pdf' GROUP BY m.id, ALL)".replace("m.id, ALL", "ALL"))(lambda m, f, o: R.list_materials(m, f, o, "a", source_type="pdf")[1])
query("collection_counts", "materials", sql="SELECT collection, count(*) AS n FROM materials WHERE collection IS NOT NULL AND trim(collection) <> '' GROUP BY 1 ORDER BY lower(collection)")(R.collection_counts)
_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY material_id ORDER BY created_at DESC, id DESC) AS k FROM runs) WHERE k = 1)"
query("extraction_status", "materials", "runs", "segments", sql=f"SELECT m.id, r.status AS run_status, coalesce(s.n, 0) AS segment_count, CASE WHEN r.id IS NULL THEN 'not_extracted' WHEN r.status IN ('running', 'extracting', 'in_progress') THEN 'extracting' WHEN r.status IN ('error', 'failed') THEN 'extract_error' WHEN coalesce(s.n, 0) > 0 THEN 'extracted' ELSE 'no_text_found' END AS extraction_status FROM materials m LEFT JOIN {_LATEST} r ON r.material_id = m.id LEFT JOIN (SELECT material_id, count(*) AS n FROM segments WHERE material_id <> 'src3' GROUP BY 1) s ON s.material_id = m.id")(lambda m, r, s: R.extraction_status(m, r, s.filter("material_id <> 'src3'")))
query("unindexed_segments", "segments", "segment_embeddings", sql="SELECT id FROM segments s WHERE NOT EXISTS (SELECT 1 FROM segment_embeddings e WHERE e.segment_id = s.id AND e.model = 'm1') ORDER BY id LIMIT 200")(lambda s, e: R.unindexed(s, e, "m1", 200).select("id"))
query("unindexed_images", "images", "image_embeddings", sql="SELECT id FROM images i WHERE NOT EXISTS (SELECT 1 FROM image_embeddings e WHERE e.image_id = i.id AND e.model = 'm0' AND e.method_version = 'v2')")(lambda i, e: R.unindexed(i, e, "m0", key="image_id", version="v2").select("id"))
_CASCADE = """(SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY abs(page_index - p), segment_id) AS k FROM (SELECT *, min(level) OVER (PARTITION BY image_id) AS least FROM (
SELECT i.id AS image_id, s.id AS segment_id, s.page_index, i.page_index AS p, s.source_locator, s.page_ref, s.content_text, CASE WHEN s.page_index = i.page_index AND s.source_locator = i.source_locator THEN 1 WHEN s.page_index = i.page_index THEN 2 ELSE 3 END AS level
FROM images i JOIN segs s ON i.material_id = s.material_id AND s.page_index BETWEEN greatest(0, i.page_index - 1) AND i.page_index + 1)) WHERE level = least)"""
_SOME, _SOMES = "(id * 7) % 11 > 4", "(SELECT * FROM segments WHERE (id * 7) % 11 > 4)"
query("image_context_cascade", "images", "segments", sql=f"SELECT image_id, segment_id, level FROM {_CASCADE} WHERE k <= 6".replace("segs", _SOMES))(lambda i, s: R.image_context(i, s.filter(_SOME)).drop("k"))


def clean_sql(text: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({text}, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


def extracted_sql(text: str) -> str:
    """As clean_extracted(), for texts without manuscript line numbers."""
    inner = rf"regexp_replace(regexp_replace({text}, '\r\n?', chr(10), 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F]', ' ', 'g')"
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({inner}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' *\n *', chr(10), 'g'), '^\s+|\s+$', '', 'g')"


query("clean_text", "segments", sql=f"SELECT id, {clean_sql('content_text')} AS text FROM segments")(lambda s: s.select("id", T.clean_report_text(F.col("content_text")).alias("text")))
_SHORT = "replace(content_text, '.', '.' || chr(13) || chr(10) || '   ' || chr(7))"
query("trim_context", "segments", sql=rf"SELECT id, CASE WHEN length(t) <= 200 THEN t ELSE regexp_replace(regexp_replace(substring(t, 1, 200), ' [^ ]*$', ''), '^\s+|\s+$', '', 'g') END AS text FROM (SELECT id, {extracted_sql(_SHORT)} AS t FROM segments)")(lambda s: s.select("id", T.trim_context(F.replace("content_text", F.lit("."), F.lit(".\r\n   \x07")), 200, plain=True).alias("text")))
query("observation_defaults", "observations", "segments", "images", sql=f"""SELECT o.id, coalesce(nullif(o.source_page_ref, ''), nullif(s.page_ref, ''), nullif(i.page_ref, '')) AS source_page_ref, coalesce(nullif(o.source_locator, ''), nullif(s.source_locator, ''), nullif(i.source_locator, '')) AS source_locator,
coalesce(nullif(o.context_quote, ''), nullif(s.content_text, ''), nullif({extracted_sql("concat_ws(chr(10) || chr(10), nullif(visual_caption, ''), nullif(ocr_text, ''))")}, '')) AS context_quote FROM observations o LEFT JOIN segs s ON o.source_segment_id = s.id LEFT JOIN images i ON o.source_image_id = i.id""".replace("segs", _SOMES))(lambda o, s, i: R.observation_defaults(o, s.filter(_SOME), i).select("id", "source_page_ref", "source_locator", "context_quote"))
query("index_status", "segments", "segment_embeddings", "images", "image_embeddings", sql="SELECT (SELECT count(*) FROM segments) AS segments, (SELECT count(*) FROM segment_embeddings WHERE model = 'm0') AS indexed_segments, (SELECT count(*) FROM images) AS images, (SELECT count(*) FROM image_embeddings WHERE model = 'm0' AND method_version = 'v2') AS indexed_images")(lambda s, e, i, j: R.index_status(s, e, i, j, "m0", "v2"))

_TOKENS = r"list_filter(string_split_regex(strip_accents(lower(coalesce({c}, ''))), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_COUNT = {"idiot": "list_filter({t}, lambda x: x = 'idiot')", "the": "list_filter({t}, lambda x: x = 'the')", "page": "list_filter({t}, lambda x: x = 'page')", "txt": "list_filter({t}, lambda x: x = 'txt')", "clo*": "list_filter({t}, lambda x: starts_with(x, 'clo'))", "in the": "list_filter(range(1, len({t})), lambda i: {t}[i] = 'in' AND {t}[i + 1] = 'the')"}


def bm25_sql(leaves: list[str], fit: str, columns: dict[str, tuple[str, ...]] | None = None) -> str:
    tf = lambda x: " + ".join(f"len({_COUNT[x].format(t='t_' + c)})" for c in (columns or {}).get(x, S.INDEXED))
    n = range(len(leaves))
    idf = lambda i: f"greatest(ln((n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)), 1e-6::DOUBLE)"
    score = "".join(f" - {idf(i)} * tf{i}::DOUBLE * 2.2::DOUBLE / (tf{i}::DOUBLE + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))" for i in n)
    counted = f"SELECT id, {' + '.join(f'len(t_{c})' for c in S.INDEXED)} AS dl, {', '.join(f'{tf(x)} AS tf{i}' for i, x in enumerate(leaves))} FROM (SELECT id, {', '.join(_TOKENS.format(c=c) + f' AS t_{c}' for c in S.INDEXED)} FROM segments)"
    return f"SELECT id, round(0.0{score}, 8) AS score FROM (SELECT *, count(*) OVER () AS n, avg(dl) OVER () AS avgdl, {', '.join(f'count(*) FILTER (tf{i} > 0) OVER () AS df{i}' for i in n)} FROM ({counted})) WHERE {fit}"


def _bm25(text: str):
    return lambda s: S.bm25(s, text).select("id", F.round("score", 8).alias("score"))


query("bm25_search", "segments", sql=bm25_sql(["idiot", "the"], "tf0 > 0 AND tf1 > 0"))(_bm25("idiot the"))
query("fts_phrase_prefix", "segments", sql=bm25_sql(["in the", "clo*"], "tf0 > 0 OR tf1 > 0"))(_bm25('"in the" OR clo*'))
query("fts_not_column", "segments", sql=bm25_sql(["page", "txt", "idiot"], "(tf0 > 0 AND tf1 > 0) AND NOT tf2 > 0", {"txt": ("source_locator",)}))(_bm25("(page source_locator : txt) NOT idiot"))
query("fts_search", "segments", "materials", sql="SELECT f.id, material_id, m.title AS material_title, source_kind, source_locator, page_ref, f.score FROM (" + bm25_sql(["idiot", "the"], "tf0 > 0 AND tf1 > 0") + ") f JOIN segments s ON s.id = f.id JOIN materials m ON m.id = s.material_id ORDER BY f.score, f.id LIMIT 20")(lambda s, m: S.full_text(s, m, "the idiot", limit=20).drop("snippet_text").withColumn("score", F.round("score", 8)))
query("fts_snippets", "segments", "materials")(lambda s, m: S.full_text(s, m, "the idiot", limit=20).select("id", "snippet_text"))

_TERMS = ["this", "In  the"]
_LEX = Lexicon(domain=("tion", "idiot", "ent"), tool=("clown", "ment"), production=("moron", "ing t"), paper=("daluang", "stupid"), negative=("trash", "ugly"), ritual=("drum", "fool"), lexical=("tool", "lo"))


def classified_sql(rows: str, text: str, kind: str, loc: str, terms: list[str], w: Lexicon) -> str:
    """SQL for classified(): every column of `rows`, score, sense and relevance."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    any_of = lambda col, words: "(" + " OR ".join(f"contains({col}, {q(x)})" for x in words) + ")"
    exact = " + ".join(f"regexp_matches(tx, {q(T.term_pattern(t).replace('(?iU)', '(?i)'))})::INT" for t in terms)

    def near(term: str) -> str:
        n, ps = len(term), f"string_split(low, {q(term.lower())})"
        starts = f"list_transform(range(1, len({ps})), lambda i: CAST(coalesce(list_sum(list_transform({ps}[1:i], lambda p: length(p))), 0) + (i - 1) * {n} AS INT))"
        return f"len(list_filter({starts}, lambda x: {any_of(f'substring(low, greatest(x - 120, 0) + 1, least(x, 120) + {n} + 120)', w.domain)})) > 0"

    wordlist = r"((contains(wl, 'language name') AND contains(wl, 'concept') AND contains(wl, 'form')) OR contains(wl, 'concept_group') OR contains(wl, 'pound_action') OR regexp_matches(wl, '\bconcept\s*,') OR ends_with(lower(loc), '.csv'))"
    biblio = r"(contains(bl, 'bibliography') OR contains(bl, 'references') OR contains(bl, 'works cited') OR (len(regexp_extract_all(tx, '\(\d{4}[a-z]?\)|\b\d{4}\.')) >= 3 AND len(regexp_extract_all(bl, '\b(?:journal|press|university|proceedings|bulletin)\b')) >= 2 AND length(tx) < 2500))"
    base = f"SELECT *, lower(tx) AS low, lower(kd || ' ' || loc || ' ' || substring(tx, 1, 1000)) AS wl, lower(kd || ' ' || loc || ' ' || tx) AS bl FROM (SELECT *, coalesce({text}, '') AS tx, coalesce({kind}, '') AS kd, coalesce({loc}, '') AS loc FROM ({rows}) rows_)"
    cues = f"SELECT *, {exact} AS c_exact, {' + '.join(f'contains(low, {q(x)})::INT' for x in w.domain)} AS c_domain, ({' OR '.join(map(near, terms))}) AS c_near, {any_of('low', w.tool)} AS c_tool, {any_of('low', w.production)} AS c_production, {wordlist} AS c_wordlist, {any_of('low', w.negative)} AS c_negative, {biblio} AS c_biblio, {any_of('low', w.paper)} AS c_paper, {any_of('low', w.ritual)} AS c_ritual, {any_of('low', w.lexical)} AS c_lexical FROM ({base})"
    score = "round(greatest(0.0::DOUBLE, least(least(c_exact * 1.5::DOUBLE, 4.0) + least(c_domain * 0.45::DOUBLE, 4.0) + CASE WHEN c_near THEN 2.0::DOUBLE ELSE 0 END + CASE WHEN c_tool THEN 1.5::DOUBLE ELSE 0 END + CASE WHEN c_production THEN 1.8::DOUBLE ELSE 0 END + CASE WHEN c_wordlist THEN 1.5::DOUBLE ELSE 0 END - CASE WHEN c_negative THEN 2.5::DOUBLE ELSE 0 END - CASE WHEN c_biblio THEN 1.5::DOUBLE ELSE 0 END, 10.0)), 3)"
    pick = """CASE WHEN c_wordlist THEN 'lexical_wordlist' WHEN c_biblio THEN 'bibliographic_lead' WHEN c_paper THEN 'bark_paper_or_related_technology' WHEN c_tool AND (c_near OR c_domain > 0) THEN 'tool_or_beater' WHEN c_production AND (c_near OR c_domain > 0) THEN 'production_action'
WHEN c_ritual THEN 'ritual_or_non_barkcloth_action' WHEN c_negative THEN 'metaphor_or_general_usage' ELSE 'needs_review' END"""
    level = """CASE sense WHEN 'lexical_wordlist' THEN CASE WHEN c_lexical OR domain_relevance_score >= 3 THEN 'high' ELSE 'medium' END WHEN 'bibliographic_lead' THEN CASE WHEN c_domain > 0 THEN 'medium' ELSE 'low' END WHEN 'bark_paper_or_related_technology' THEN CASE WHEN c_near OR domain_relevance_score >= 5 THEN 'high' ELSE 'medium' END
WHEN 'tool_or_beater' THEN 'high' WHEN 'production_action' THEN 'high' WHEN 'ritual_or_non_barkcloth_action' THEN CASE WHEN c_domain > 0 THEN 'medium' ELSE 'low' END WHEN 'metaphor_or_general_usage' THEN 'low' ELSE CASE WHEN c_domain > 0 OR domain_relevance_score >= 3 THEN 'medium' ELSE 'low' END END"""
    return f"SELECT *, {level} AS research_relevance FROM (SELECT *, {score} AS domain_relevance_score, {pick} AS sense FROM ({cues}))"


query("relevance_score", "segments", sql=f"SELECT id, domain_relevance_score AS score FROM ({classified_sql('SELECT * FROM segments', 'content_text', 'source_kind', 'source_locator', _TERMS, _LEX)})")(lambda s: E.classified(s, _TERMS, "content_text", "source_kind", "source_locator", _LEX).select("id", F.col("domain_relevance_score").alias("score")))
query("evidence_sense", "segments", sql=f"SELECT id, sense, research_relevance FROM ({classified_sql('SELECT * FROM segments', 'content_text', 'source_kind', 'source_locator', _TERMS, _LEX)})")(lambda s: E.classified(s, _TERMS, "content_text", "source_kind", "source_locator", _LEX).select("id", "sense", "research_relevance"))
query("looks_like_wordlist", "segments", sql="SELECT id FROM (" + classified_sql("SELECT id, CASE WHEN id % 9 = 0 THEN 'Language Name; concept; FORM ' || content_text WHEN id % 9 = 1 THEN 'x concept , ' || content_text ELSE content_text END AS body, source_kind, source_locator FROM segments", "body", "source_kind", "source_locator", ["this"], _LEX) + ") WHERE c_wordlist")(lambda s: s.withColumn("body", F.when(F.col("id") % 9 == 0, F.concat(F.lit("Language Name; concept; FORM "), "content_text")).when(F.col("id") % 9 == 1, F.concat(F.lit("x concept , "), "content_text")).otherwise(F.col("content_text"))).filter(E.looks_like_wordlist(F.col("body"), F.col("source_kind"), F.col("source_locator"))).select("id"))
query("looks_like_bibliography", "segments", sql="SELECT id FROM (" + classified_sql("SELECT id, CASE WHEN id % 3 = 0 THEN content_text || ' (1999a) Press 2001. 2003. University' ELSE content_text END AS body, source_kind, source_locator FROM segments", "body", "source_kind", "source_locator", ["this"], _LEX) + ") WHERE c_biblio")(lambda s: s.withColumn("body", F.when(F.col("id") % 3 == 0, F.concat("content_text", F.lit(" (1999a) Press 2001. 2003. University"))).otherwise(F.col("content_text"))).filter(E.looks_like_bibliography(F.col("body"), F.col("source_kind"), F.col("source_locator"))).select("id"))
_PARAS = rf"""SELECT id, t, list_filter(list_transform(string_split_regex(t, '\n\s*\n+'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS ps FROM (SELECT id, {clean_sql("replace(content_text, '. ', '.' || chr(10) || ' ' || chr(10))")} AS t FROM segments)"""
_CTX = rf"""SELECT id, CAST(i - 1 AS INT) AS paragraph_index, before, match, after, ctx, list_filter(['this', 'In the'], lambda x: regexp_matches(match, '(?i)\b' || replace(lower(x), ' ', '\s+') || '\b')) AS mt, list_filter(['this', 'In the'], lambda x: regexp_matches(ctx, '(?i)\b' || replace(lower(x), ' ', '\s+') || '\b')) AS ct FROM (
SELECT id, i, coalesce(ps[i - 1], '') AS before, ps[i] AS match, coalesce(ps[i + 1], '') AS after, concat_ws(chr(10) || chr(10), nullif(coalesce(ps[i - 1], ''), ''), ps[i], nullif(coalesce(ps[i + 1], ''), '')) AS ctx FROM (SELECT id, ps, unnest(range(1, len(ps) + 1)) AS i FROM ({_PARAS}) WHERE len(ps) > 1))"""
_AIRED = "replace(content_text, '. ', '.\n \n')"


def _aired(s: DataFrame) -> DataFrame:
    """Segments with a blank line after each sentence; only those of two paragraphs or more, as SQL has no packing of sentences."""
    out = s.withColumn("content_text", F.replace("content_text", F.lit(". "), F.lit(".\n \n")))
    return out.filter(F.size(F.filter(F.split(T.clean_report_text(F.col("content_text")), r"\n\s*\n+"), lambda p: T.stripped(p) != "")) > 1)


query("kwic_report", "segments", sql=f"SELECT id, paragraph_index, before, match, after, list_aggregate(mt, 'string_agg', ',') AS matched_terms, list_aggregate(ct, 'string_agg', ',') AS terms_in_context, len(ct) = 2 AS all_terms_in_context FROM ({_CTX}) WHERE len(mt) > 0")(lambda s: E.term_contexts(_aired(s), E.parse_terms("this, In  the;THIS")).withColumns({c: F.array_join(c, ",") for c in ("matched_terms", "terms_in_context")}).drop("context_text"))
_REPORT = f"SELECT * FROM ({classified_sql('SELECT c.id AS segment_id, paragraph_index, ctx, len(ct) = 2 AS all_terms_in_context, material_id, title, source_kind, source_locator, page_index FROM (' + _CTX + ') c JOIN segments s ON s.id = c.id JOIN materials m ON m.id = s.material_id WHERE len(mt) > 0', 'ctx', 'source_kind', 'source_locator', ['this', 'In the'], _LEX)}) ORDER BY list_position(['high', 'medium', 'low'], research_relevance), domain_relevance_score DESC, lower(title), page_index, segment_id, paragraph_index LIMIT 200"
query("context_report", "segments", "materials", sql=f"SELECT segment_id, paragraph_index, material_id, title AS material_title, sense, research_relevance, domain_relevance_score FROM ({_REPORT})")(lambda s, m: E.context_report(_aired(s), m, "this, In the", words=_LEX).select("segment_id", "paragraph_index", "material_id", "material_title", "sense", "research_relevance", "domain_relevance_score"))
query("cooccurrence_count", "segments", "materials", sql=f"SELECT count(*) AS total_matches, count(*) FILTER (all_terms_in_context) AS cooccurrence_count FROM ({_REPORT})")(lambda s, m: E.cooccurrences(E.context_report(_aired(s), m, "this, In the", words=_LEX)))
query("near_domain", "segments", sql="SELECT id FROM (" + classified_sql("SELECT * FROM segments", "content_text", "source_kind", "source_locator", ["The"], Lexicon(domain=("idiot", "clown"))) + ") WHERE c_near")(lambda s: s.filter(E.near_domain(F.lower("content_text"), ["The"], ("idiot", "clown"))).select("id"))
query("wordlist_in_text", "materials")(lambda m: m.select("id", E.wordlist_rows(["beat"])(F.concat(F.lit("Some words\nLanguage Name,Concept,Form,Source\n"), "id", F.lit(',"to, beat",ta,x\nOther,stone,po,y'))).alias("rows")))
query("image_label_text", "images", sql=r"""SELECT id, coalesce(array_to_string(list_transform(list_sort(list_transform(map_entries(map_from_entries(list_transform(list_reverse(list_transform(list_zip(ls, range(1, len(ls) + 1)), lambda z: {'k': z[1], 'v': z[2]})), lambda z: {'k': z.k, 'v': 0}))), lambda e: e.key)), lambda x: x), '; '), '') AS labels FROM (SELECT id, list_distinct(ls) AS ls FROM (SELECT id, list_filter(list_transform(string_split_regex(replace(regexp_replace(t, '(?i)^(the image|this image|the provided image|the image you''ve provided)\s+(appears to be|shows|contains|depicts|is)\s+', ''), '**', ''), '[,;\n]|\s+-\s+'), lambda x: regexp_replace(lower(regexp_replace(x, '^[ .:\-]+|[ .:\-]+$', '', 'g')), '\s+', ' ', 'g')), lambda x: x <> '' AND length(x) <= 60 AND NOT regexp_matches(x, 'could be|might be|appears to|suggests|likely|possibly|purpose|imply|significance')) AS ls FROM (SELECT id, 'This image shows a Cup; cup - a **plate** ' || chr(10) || 'possibly old, ' || coalesce(ocr_text, 'none') AS t FROM images)))""")(lambda i: i.select("id", F.array_join(F.array_sort(F.split(E.image_labels(F.concat(F.lit("This image shows a Cup; cup - a **plate** \npossibly old, "), F.coalesce("ocr_text", F.lit("none")))), "; ")), "; ").alias("labels")))
query("keyword_ngrams", "segments", sql=r"""SELECT phrase, CAST(sum(w) AS BIGINT) AS score FROM (
SELECT unnest(t) AS phrase, 1 AS w FROM tk UNION ALL
SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])), 3 FROM tk WHERE len(t) >= 2 UNION ALL
SELECT unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])), 5 FROM tk WHERE len(t) >= 3) GROUP BY 1 HAVING sum(w) >= 2""".replace("FROM tk", r"FROM (SELECT list_filter(regexp_extract_all(lower(content_text), '[a-z][a-z0-9''-]{2,}'), lambda x: x NOT IN ('the', 'and', 'that')) AS t FROM segments)"))(lambda s: R.keyword_scores(s, ["the", "and", "that"]))
query("citation", "segments", "materials", sql="SELECT s.id AS segment_id, m.id || '|' || m.title || '|' || coalesce(m.authors, '') || '|' || m.year || '|' || s.page_ref || '|' || s.source_locator AS line FROM segments s JOIN materials m ON m.id = s.material_id")(lambda s, m: s.withColumnRenamed("id", "segment_id").join(S._titles(m), F.col("material_id") == F.col("m_id")).withColumn("c", S.citation()).select("segment_id", F.concat_ws("|", "c.material_id", "c.title", F.coalesce("c.authors", F.lit("")), "c.year", "c.page_ref", "c.source_locator").alias("line")))
query("material_total_groups", *MF, sql="SELECT count(DISTINCT m.id) AS total FROM materials m LEFT JOIN files f ON f.material_id = m.id WHERE lower(original_filename) LIKE '%e%'")(lambda m, f: m.join(f.filter(T.like_any_case(F.col("original_filename"), "e")), m["id"] == f["material_id"], "left_semi").agg(F.count(F.lit(1)).alias("total")))
query("ready_queue", "materials", sql="SELECT * FROM materials WHERE status = 'ready_for_text_extraction' ORDER BY updated_at DESC, id LIMIT 25")(R.ready_queue)
query("observation_summary", "observations", sql="SELECT material_id, observation_type, count(*) AS n FROM observations GROUP BY ALL")(R.observation_summary)
query("image_labels_concat", "observations", sql="SELECT source_image_id, string_agg(line, chr(10) ORDER BY line) AS labels FROM (SELECT source_image_id, observation_type || ': ' || observed_text || CASE WHEN trim(coalesce(notes, '')) <> '' THEN ' - ' || notes ELSE '' END AS line FROM observations WHERE source_image_id IS NOT NULL) GROUP BY 1")(R.image_labels)
query("related_observations", "observations", sql="SELECT id, observation_type, observed_text FROM observations WHERE source_segment_id IN (1, 2, 3) OR material_id IN ('src1') ORDER BY updated_at DESC, id LIMIT 40")(lambda o: o.filter(F.col("source_segment_id").isin(1, 2, 3) | F.col("material_id").isin("src1")).orderBy(F.desc("updated_at"), "id").limit(40).select("id", "observation_type", "observed_text"))
query("upsert_embeddings", "segment_embeddings", sql="SELECT segment_id, CASE WHEN segment_id % 5 = 0 THEN 'm9' ELSE model END AS model FROM segment_embeddings")(lambda e: R.upsert(e.select("segment_id", "model"), e.filter("segment_id % 5 = 0").select("segment_id", F.lit("m9").alias("model")), "segment_id"))
query("cascade_delete", "materials", "segments", sql="SELECT id, material_id FROM segments WHERE material_id NOT IN (SELECT id FROM materials WHERE status = 'draft')")(lambda m, s: R.delete_cascade(s, m.filter("status = 'draft'")).select("id", "material_id"))
query("set_null_refs", "observations", "segments", sql="SELECT id, CASE WHEN source_segment_id % 4 = 0 THEN NULL ELSE source_segment_id END AS source_segment_id FROM observations")(lambda o, s: R.set_null(o, s.filter("id % 4 = 0"), "source_segment_id").select("id", "source_segment_id"))
query("invalidate_image_embeddings", "observations", "segment_embeddings", sql="SELECT segment_id FROM segment_embeddings WHERE segment_id NOT IN (SELECT source_image_id FROM observations WHERE source_image_id IS NOT NULL AND observation_type = 'click')")(lambda o, e: e.join(o.filter("observation_type = 'click' AND source_image_id IS NOT NULL").select(F.col("source_image_id").alias("segment_id")).distinct(), "segment_id", "left_anti").select("segment_id"))
query("term_matches", "segments", sql=r"SELECT id, CASE WHEN a AND b THEN 'in the,clown' WHEN a THEN 'in the' ELSE 'clown' END AS terms, a AND b AS all_terms FROM (SELECT id, regexp_matches(content_text, '(?i)\bin\s+the\b') AS a, regexp_matches(content_text, '(?i)\bclown\b') AS b FROM segments) WHERE a OR b")(lambda s: s.select("id", E.matched_terms(F.col("content_text"), ["in the", "clown"]).alias("m")).filter("size(m) > 0").select("id", F.array_join("m", ",").alias("terms"), (F.size("m") == 2).alias("all_terms")))
query("slugify", "materials", sql="SELECT id, translate(lower(title), ' /-', '___') AS slug FROM materials")(lambda m: m.select("id", T.slug(F.col("title")).alias("slug")))
query("filename_sanitize", "files", sql=r"SELECT id, regexp_replace(regexp_replace(regexp_extract(id || '*x. ', '[^/\\]*$'), '[^A-Za-z0-9._ -]+', '_', 'g'), '^[. ]+|[. ]+$', '', 'g') AS name FROM files")(lambda f: f.select("id", T.safe_filename(F.concat("id", F.lit("*x. "))).alias("name")))
query("header_normalize", "languages", sql=r"SELECT DISTINCT regexp_replace(regexp_replace(lower(Name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS header FROM languages")(lambda l: l.select(T.header_name(F.col("Name")).alias("header")).distinct())
_QV = [1.0 if i % 3 else -0.5 for i in range(64)]
_QL = "[" + ", ".join(f"{x}::DOUBLE" for x in _QV) + "]"
query("semantic_topk", "segment_embeddings", sql=f"SELECT segment_id, round(list_sum(list_transform(list_zip(embedding, {_QL}), lambda z: z[1]::DOUBLE * z[2])), 5) AS score FROM segment_embeddings ORDER BY score DESC, segment_id LIMIT 12")(lambda e: R.semantic_top(e, _QV))
_COS = f"round(list_sum(list_transform(list_zip(embedding, {_QL}), lambda z: z[1]::DOUBLE * z[2])), 10)"
_HITS = f"SELECT segment_id, {_COS} AS score, s.*, m.title AS material_title FROM segment_embeddings e JOIN segments s ON s.id = e.segment_id JOIN materials m ON m.id = s.material_id WHERE e.model = 'm0' ORDER BY score DESC, segment_id LIMIT 12"
_SEM = ("segment_embeddings", "segments", "materials")
query("semantic_search", *_SEM, sql=f"SELECT segment_id, round(score, 5) AS score, material_id, material_title, page_ref FROM ({_HITS})")(lambda e, s, m: S.semantic(e, s, m, _QV, "m0").select("segment_id", F.round("score", 5).alias("score"), "material_id", "material_title", "page_ref"))
query("semantic_related", *_SEM, "observations", sql=f"SELECT id, observation_type FROM observations WHERE source_segment_id IN (SELECT segment_id FROM ({_HITS})) OR material_id IN (SELECT material_id FROM ({_HITS})) ORDER BY updated_at DESC, id LIMIT 40")(lambda e, s, m, o: S.related_observations(o, S.semantic(e, s, m, _QV, "m0")).select("id", "observation_type"))
_IMG = ("image_embeddings", "images", "materials", "observations")
_LABELS = "(SELECT source_image_id, string_agg(line, chr(10) ORDER BY line) AS observation_labels FROM (SELECT source_image_id, observation_type || ': ' || observed_text || CASE WHEN trim(coalesce(notes, '')) <> '' THEN ' - ' || notes ELSE '' END AS line FROM observations WHERE source_image_id IS NOT NULL) GROUP BY 1)"
_ITEXT = extracted_sql("concat_ws(chr(10) || chr(10), nullif(ocr_text, ''), nullif(visual_caption, ''), nullif(observation_labels, ''), nullif(page_ref, ''), nullif(source_locator, ''), nullif(i.evidence_type, ''))")
_IHITS = rf"SELECT * FROM (SELECT image_id, {_COS} AS score, i.material_id, m.title AS material_title, ocr_text, visual_caption, page_ref, source_locator, source_kind, regexp_matches({_ITEXT}, '(?i)\bocr\s+4\b') AS a, regexp_matches({_ITEXT}, '(?i)\bpage\b') AND image_id % 2 = 9 AS b FROM image_embeddings e JOIN images i ON i.id = e.image_id JOIN materials m ON m.id = i.material_id LEFT JOIN {_LABELS} l ON l.source_image_id = i.id WHERE model = 'm0' AND method_version = 'v2') WHERE a OR score >= 0.62 ORDER BY a DESC, score DESC, image_id LIMIT 12"
_images = lambda e, i, m, o: S.image_search(e, i, m, o, "ocr  4", _QV, "m0", "v2")
query("image_search", *_IMG, sql=f"SELECT image_id, round(score, 5) AS score, a AS contains_exact_term, '/api/v1/repository/materials/' || material_id || '/images/' || image_id AS image_url FROM ({_IHITS})")(lambda e, i, m, o: _images(e, i, m, o).select("image_id", F.round("score", 5).alias("score"), "contains_exact_term", "image_url"))
query("multimodal_search", *_SEM, "image_embeddings", "images", "observations", sql=f"SELECT 'text' AS kind, CAST(segment_id AS VARCHAR) AS item_id, material_id FROM ({_HITS}) UNION ALL SELECT 'image', CAST(image_id AS VARCHAR), material_id FROM ({_IHITS})")(lambda e, s, m, ie, i, o: S.multimodal(S.semantic(e, s, m, _QV, "m0"), _images(ie, i, m, o)).drop("score"))
_PARTS = "SELECT material_id, material_title, CAST(segment_id AS VARCHAR) AS item, score, domain_relevance_score AS d, research_relevance AS r, sense FROM (" + classified_sql(_HITS, "content_text", "source_kind", "source_locator", ["this", "In the"], _LEX) + ") UNION ALL SELECT material_id, material_title, CAST(image_id AS VARCHAR), score, domain_relevance_score, research_relevance, sense FROM (" + classified_sql(f"SELECT *, {extracted_sql(chr(99) + 'oncat_ws(chr(10) || chr(10), nullif(ocr_text, ' + chr(39) * 2 + '), nullif(visual_caption, ' + chr(39) * 2 + '), nullif(source_locator, ' + chr(39) * 2 + '), nullif(page_ref, ' + chr(39) * 2 + '))')} AS own FROM ({_IHITS})", "own", "source_kind", "source_locator", ["this", "In the"], _LEX) + ")"
query("evidence_themes", *_SEM, "image_embeddings", "images", "observations", sql=f"""SELECT t.material_id, material_title, high_relevance_count, medium_relevance_count, low_relevance_count, max_score, dominant FROM (SELECT material_id, min(material_title) AS material_title, count(*) FILTER (r = 'high') AS high_relevance_count, count(*) FILTER (r = 'medium') AS medium_relevance_count, count(*) FILTER (r = 'low') AS low_relevance_count, round(max(greatest(score, d)), 5) AS max_score FROM ({_PARTS}) GROUP BY 1) t
JOIN (SELECT material_id, string_agg(sense, ',' ORDER BY k) AS dominant FROM (SELECT material_id, sense, row_number() OVER (PARTITION BY material_id ORDER BY count(*) DESC, sense) AS k FROM ({_PARTS}) GROUP BY 1, 2) WHERE k <= 3 GROUP BY 1) d ON d.material_id = t.material_id""")(lambda e, s, m, ie, i, o: S.evidence_report(S.semantic(e, s, m, _QV, "m0"), _images(ie, i, m, o), "this, In the", _LEX).select("material_id", "material_title", "high_relevance_count", "medium_relevance_count", "low_relevance_count", F.round("max_score", 5).alias("max_score"), F.array_join("dominant_senses", ",").alias("dominant")))
query("answer_evidence", *_SEM, sql=f"SELECT string_agg('[' || k || '] ' || material_title || ' (' || page_ref || '): ' || substring(content_text, 1, 1600), chr(10) || chr(10) ORDER BY k) AS evidence FROM (SELECT *, row_number() OVER (ORDER BY score DESC, segment_id) AS k FROM ({_HITS}))")(lambda e, s, m: S.evidence_text(S.semantic(e, s, m, _QV, "m0")))
query("vector_normalize", "segment_embeddings", sql="SELECT segment_id, round(list_sum(list_transform(u, lambda x: x * x)), 9) AS square FROM (SELECT segment_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM segment_embeddings)")(lambda e: e.select("segment_id", F.round(T.dot(T.unit(F.col("embedding")), T.unit(F.col("embedding"))), 9).alias("square")))
query("last_n_history", "sessions", sql="SELECT session_id, turn, role, content FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS k FROM sessions) WHERE k <= 10")(X.last_turns)
query("chunk_segments", "segments")(lambda s: D.chunks(s, 600))
query("context_paragraphs", "segments")(D.context_paragraphs)
query("auto_keywords", "segments")(lambda s: D.auto_keywords(s, ["the", "and", "that"]))
query("snippet", "segments", sql=r"""SELECT id, CASE WHEN f > 1 THEN ' … ' ELSE '' END || list_aggregate(list_transform(w[f:f + 15], lambda x: CASE WHEN regexp_replace(lower(x), '[^\p{L}\p{N}]+', '', 'g') IN ('idiot', 'clown') THEN '[' || x || ']' ELSE x END), 'string_agg', ' ') || CASE WHEN f + 16 <= len(w) THEN ' … ' ELSE '' END AS snippet
FROM (SELECT id, w, greatest(k - 8, 1) AS f FROM (SELECT id, w, list_position(list_transform(w, lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}]+', '', 'g') IN ('idiot', 'clown')), true) AS k FROM (SELECT id, list_filter(string_split_regex(content_text, '\s+'), lambda x: x <> '') AS w FROM segments)) WHERE k > 0)""")(lambda s: D.snippets(s, ["idiot", "clown"]))
query("json_array_extract", "materials", sql=r"""SELECT id, '["' || list_aggregate(json_extract_string(m, '$[*]'), 'string_agg', '", "') || '"]' AS found FROM (SELECT id, regexp_extract(CASE WHEN status = 'draft' THEN 'Take ["' || id || '",' || chr(10) || '"x"] or ["y"]' ELSE 'Take [none' END, '(?s)\[.*?\]') AS m FROM materials) WHERE m <> ''""")(lambda m: m.select("id", D.json_array(F.when(F.col("status") == "draft", F.concat(F.lit('Take ["'), "id", F.lit('",\n"x"] or ["y"]'))).otherwise("Take [none")).alias("a")).filter("a IS NOT NULL").select("id", F.concat(F.lit('["'), F.array_join("a", '", "'), F.lit('"]')).alias("found")))
query("tile_counts", "languages", sql="SELECT CAST(floor((lo + 180) / 360 * 16) AS INT) AS x, CAST(floor((1 - ln(tan(radians(45 + la / 2))) / pi()) / 2 * 16) AS INT) AS y, count(*) AS n FROM (SELECT TRY_CAST(Latitude AS DOUBLE) AS la, TRY_CAST(Longitude AS DOUBLE) AS lo FROM languages) WHERE abs(la) < 85.0511 AND lo >= -180 AND lo < 180 GROUP BY 1, 2")(lambda l: D.tile_counts(l, 4))
QUERIES["html_extract"] = lambda spark, sf_dir: W.html_extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
query("extracted_clean", "segments")(lambda s: s.select("id", W.clean_extracted(F.col("content_text")).alias("content_text")))


def _crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a page: those to three others by number, as the hrefs in the tables lead to no stored page."""
    urls = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("url"))
    n = urls.agg(F.count("*").alias("n"))
    edges = urls.join(F.broadcast(n)).select(F.col("url").alias("src"), "n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("pos")).select("src", "pos", F.expr("(src * 7 + pos) % n").alias("dst"))
    return W.crawl(edges, urls, 0, 3, 200).select("url", "depth", "status")


QUERIES["crawl_bfs"] = _crawl
ORACLE_SQL["crawl_bfs"] = "WITH RECURSIVE c AS (SELECT count(*) AS n FROM pages), e AS (SELECT page_id AS src, (page_id * 7 + k) % n AS dst FROM pages, c, (VALUES (1), (2), (3)) v(k)), r(url, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.url WHERE r.depth < 3) SELECT url, min(depth) AS depth, CASE WHEN url IN (SELECT page_id FROM pages) THEN 'ok' ELSE 'fetch_error' END AS status FROM r GROUP BY url"

query("export_with_names", *LEXICAL, sql=f"SELECT ID, Name, Glottocode, CAST(Latitude AS DOUBLE) AS Latitude, CAST(Longitude AS DOUBLE) AS Longitude, form_value, parameter_name, dataset_name FROM ({STAR}) s WHERE parameter_name IN {IN} AND {OK}")(lambda l, f, p: X.export(l, f, p, GLOSSES))
query("tile_join", *LEXICAL, sql="SELECT l.*, f.Value AS form_value, p.Name AS parameter_name FROM languages l JOIN forms f ON l.ID = f.Language_ID JOIN parameters p ON f.Parameter_ID = p.ID WHERE lower(f.Value) LIKE '%no-1%' AND lower(p.Name) LIKE '%a%'")(lambda l, f, p: X.tile_rows(l, f, p, "NO-1", "A"))
query("tile_projection", "languages", sql="SELECT * EXCLUDE (Latitude, Longitude), 'Combined' AS dataset FROM languages WHERE TRY_CAST(Latitude AS DOUBLE) BETWEEN -60 AND 60 AND TRY_CAST(Longitude AS DOUBLE) BETWEEN -90 AND 90")(lambda l: X.in_tile(l, -90.0, -60.0, 90.0, 60.0).drop("Latitude", "Longitude", "gx", "gy").withColumn("dataset", F.lit("Combined")))
query("mvt_tiles", "languages")(lambda l: V.tiles(l, 3, "languages").select("z", "x", "y", F.length("tile").alias("bytes")))
query("datasets_with_gloss", *LEXICAL, sql=f"SELECT DISTINCT dataset_name FROM ({STAR}) s WHERE parameter_name IN {IN}")(lambda l, f, p: X.datasets_with(X.gloss_index(l, f, p), GLOSSES))
query("cluster_languages", *LEXICAL)(lambda l, f, p: G.cluster(X.binary_matrix(X.star(l, f, p), ["ID"], "parameter_name", "form_value", CONCEPTS), order=("ID",)).select("ID", "cluster_id"))
query("cluster_summary", *LEXICAL)(lambda l, f, p: G.summary(G.cluster(X.binary_matrix(X.star(l, f, p), ["ID"], "parameter_name", "form_value", CONCEPTS), order=("ID",))))
query("csv_text", "languages", sql="SELECT concat_ws(',', ID, Name, Glottocode) AS line FROM languages")(lambda l: C.csv_lines(l.select("ID", "Name", "Glottocode")))
query("csv_row_count", "segments", sql="SELECT id, length(content_text) - length(replace(content_text, chr(10), '')) AS n FROM segments")(lambda s: s.select("id", C.csv_row_count(F.col("content_text")).cast("long").alias("n")))
query("store_insert", "materials", sql="SELECT id, title, status FROM materials UNION ALL SELECT 'new', 'A title', 'uploaded'")(lambda m: K.insert(m, [{"id": "new", "title": "A title"}], {"status": "uploaded"}).select("id", "title", "status"))
query("store_update", "materials", sql="SELECT id, CASE WHEN id = 'src2' THEN 'Other' ELSE title END AS title, CASE WHEN id = 'src2' THEN '2025' ELSE updated_at END AS updated_at, year FROM materials")(lambda m: K.update(m, "id", "src2", {"title": "Other"}, "2025").select("id", "title", "updated_at", "year"))
query("ensure_column", "materials", sql="SELECT id, year, 'x' AS extra FROM materials")(lambda m: K.ensure_column(K.ensure_column(m, "extra", "string", "x"), "year", "int").select("id", "year", "extra"))
query("delete_material", "materials", "files", "segments", sql="SELECT 'materials' AS name, count(*) AS n FROM materials WHERE id <> 'src2' UNION ALL SELECT 'files', count(*) FROM files WHERE material_id IS NULL OR material_id <> 'src2' UNION ALL SELECT 'segments', count(*) FROM segments WHERE material_id IS NULL OR material_id <> 'src2'")(lambda m, f, s: _counted(K.delete_material({"materials": m, "files": f, "segments": s}, "src2")))
query("foreign_references", "observations", "segments", sql="SELECT o.id FROM observations o WHERE source_segment_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM segments s WHERE s.id = o.source_segment_id + 1 AND s.material_id = o.material_id)")(lambda o, s: K.owned(o.withColumn("source_segment_id", F.col("source_segment_id") + 1), s, "source_segment_id").select("id"))
query("affected_images", "observations", sql="SELECT DISTINCT source_image_id AS image_id FROM observations WHERE source_image_id IS NOT NULL AND (observation_type = 'click' OR id % 3 = 0)")(lambda o: K.affected_images(o.filter("observation_type = 'click'"), o.filter("id % 3 = 0")))
query("observation_filter", "observations", sql="SELECT id FROM observations WHERE material_id = 'src1' AND observation_type = 'view' ORDER BY updated_at DESC, id LIMIT 100")(lambda o: K.listing(o.filter("material_id = 'src1' AND observation_type = 'view'"), "observations", 100).select("id"))
query("file_listing", "files", sql="SELECT id, original_filename FROM files WHERE material_id = 'src1' AND file_size > 0 ORDER BY uploaded_at DESC, id")(lambda f: K.without_internal(K.listing(K.uploads(f.filter("material_id = 'src1'")), "files")).select("id", "original_filename"))
query("run_listing", "runs", sql="SELECT id, status FROM runs WHERE material_id = 'src1' ORDER BY created_at DESC, id DESC LIMIT 20")(lambda r: K.listing(r.filter("material_id = 'src1'"), "runs", 20).select("id", "status"))
query("capped_segments", "segments", "files", sql="SELECT s.id FROM segments s JOIN files f ON f.id = s.material_id || '/' || split_part(s.source_locator, '.', 1) WHERE s.material_id = 'src1' ORDER BY uploaded_at, f.id, s.id LIMIT 5")(lambda s, f: K.capped(s.filter("material_id = 'src1'").select("id", F.col("id").alias("chunk"), F.concat("material_id", F.lit("/"), F.substring_index("source_locator", ".", 1)).alias("file_id")), f.select("id", "uploaded_at"), 5).select("id"))
QUERIES["repository_constants"] = lambda spark, _: R.constants(spark)
ORACLE_SQL["repository_constants"] = "SELECT kind, value FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, vs in (("source_type", R.SOURCE_TYPES), ("status", R.STATUSES), ("observation_type", R.OBSERVATION_TYPES)) for v in vs) + ") t(kind, value)"
QUERIES["report_terms"] = lambda spark, _: spark.createDataFrame([(t,) for t in E.parse_terms("paper  mulberry, Tapa;tapa\nbeat ,, ")], "term string")
ORACLE_SQL["report_terms"] = "SELECT term FROM (VALUES ('paper mulberry'), ('Tapa'), ('beat')) t(term)"
query("normal_urls", "links", sql="SELECT id, CASE WHEN id % 5 = 0 THEN NULL ELSE trim(discovered_url) END AS url FROM links")(lambda l: l.select("id", T.normal_url(F.concat(F.when(F.col("id") % 5 == 0, "ftp:").otherwise(" "), "discovered_url", F.lit(" \n"))).alias("url")))
query("json_vectors", "segment_embeddings", sql="SELECT segment_id, round(CAST(embedding[1] AS DOUBLE), 4) AS first, len(embedding) AS n FROM segment_embeddings")(lambda e: e.select("segment_id", T.json_vector(F.to_json("embedding")).alias("v")).select("segment_id", F.round(F.col("v")[0], 4).alias("first"), F.size("v").cast("long").alias("n")))
query("hamming_fingerprints", "materials", sql="SELECT id, CAST(list_sum(list_transform(range(1, 65), lambda i: bit_count(xor(instr('0123456789abcdef', substr(sha256(id), i, 1)) - 1, instr('0123456789abcdef', substr(sha256(title), i, 1)) - 1)))) AS INT) AS bits FROM materials")(lambda m: m.select("id", T.hamming_hex(F.sha2("id", 256), F.sha2("title", 256)).cast("int").alias("bits")))
query("near_images", "images")(lambda i: P.drop_near_images(i.withColumn("fingerprint", F.when(F.col("id") % 9 > 0, F.sha2((F.col("id") % 50).cast("string"), 256)).otherwise(""))).select("id"))
query("informative_images", "segments", sql="SELECT id FROM (SELECT id, list_transform(range(0, 64), lambda i: (id * 7 + i * (id % 4)) % 256) AS px FROM segments) WHERE NOT (list_max(px) - list_min(px) < 8 OR list_stddev_pop(px) < 3 OR ((list_avg(px) < 4 OR list_avg(px) > 251) AND list_stddev_pop(px) < 8))")(lambda s: s.filter(P.informative(F.expr("transform(sequence(0, 63), i -> cast((id * 7 + i * (id % 4)) % 256 as int))"))).select("id"))
query("token_index", "segments", sql="SELECT token, id, count(*) AS n FROM (SELECT id, unnest(" + " || ".join(_TOKENS.format(c=c) for c in S.INDEXED) + ") AS token FROM segments) GROUP BY 1, 2")(I.token_table)
query("token_index_follows", "segments", sql="SELECT count(*) AS n, sum(n) AS tokens FROM (SELECT token, id, count(*) AS n FROM (SELECT id, unnest(" + " || ".join(_TOKENS.format(c=c) for c in S.INDEXED) + ") AS token FROM (SELECT id, page_ref, source_locator, CASE WHEN id % 10 = 1 THEN 'new words' ELSE content_text END AS content_text FROM segments WHERE id % 10 <> 0)) GROUP BY 1, 2)")(lambda s: I.follow(I.token_table(s), s.filter("id % 10 = 1").withColumn("content_text", F.lit("new words")), s.filter("id % 10 = 0")).agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("tokens")))


query("index_segments", "segments", "segment_embeddings", sql="SELECT segment_id, CASE WHEN segment_id IN (SELECT id FROM segments WHERE id NOT IN (SELECT segment_id FROM segment_embeddings WHERE model = 'm1') ORDER BY id LIMIT 50) THEN 'm1' ELSE model END AS model FROM (SELECT segment_id, model FROM segment_embeddings UNION ALL SELECT id, 'm1' FROM (SELECT id FROM segments WHERE id NOT IN (SELECT segment_id FROM segment_embeddings WHERE model = 'm1') ORDER BY id LIMIT 50) WHERE id NOT IN (SELECT segment_id FROM segment_embeddings))")(lambda s, e: I.index_segments(s, e.select("segment_id", F.lit("").alias("material_id"), "model", F.transform("embedding", lambda x: x.cast("double")).alias("embedding")), "m1", _embed_locally(), 50).select("segment_id", "model"))
query("index_images", "images", "image_embeddings", "segments", "observations")(lambda i, e, s, o: I.index_images(i, e.select("image_id", F.lit("").alias("material_id"), "model", "method_version", F.transform("embedding", lambda x: x.cast("double")).alias("embedding")), s, o, "m0", "v2", _embed_locally(), informative=F.col("id") % 7 != 0, limit=20)[2])
query("live_sessions", "observations", sql="SELECT session_id, state FROM (SELECT material_id AS session_id, arg_max(observation_type, (updated_at, observation_type)) AS state, max(updated_at) AS saved_at FROM observations GROUP BY 1) WHERE CAST(saved_at AS TIMESTAMP) + INTERVAL 21600 SECOND > (SELECT CAST(max(updated_at) AS TIMESTAMP) FROM observations)")(lambda o: _live(o).select("session_id", "state"))
query("job_states", "observations", sql="SELECT material_id AS job_id, arg_max(observation_type, (updated_at, r)) AS status FROM (SELECT *, CASE observation_type WHEN 'queued' THEN 1 ELSE 0 END AS r FROM (SELECT material_id, updated_at, CASE WHEN id % 3 = 0 THEN 'queued' ELSE 'running' END AS observation_type, id FROM observations)) GROUP BY 1")(lambda o: M.job_states(o.select(F.col("material_id").alias("job_id"), F.col("updated_at").alias("at"), F.when(F.col("id") % 3 == 0, "queued").otherwise("running").alias("status"))).select("job_id", "status"))
query("material_keywords", "segments")(lambda s: D.material_keywords(s, ["the", "and", "that"]))
query("image_context_text", "images", "segments")(lambda i, s: R.image_context_text(i, s))
QUERIES["page_links"] = lambda spark, sf_dir: W.page_links(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _embed_locally():
    """A function made here goes to the workers by value: they need not have this package."""

    def embed(texts):
        return [[float(len(t)), 1.0] for t in texts]

    return embed


def _counted(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.union(one)
    return out


def _live(observations: DataFrame) -> DataFrame:
    """Sessions that live when the last row was written."""
    events = observations.select(F.col("material_id").alias("session_id"), F.col("observation_type").alias("state"), F.col("updated_at").alias("saved_at"))
    last = events.agg(F.max("saved_at").alias("now"))
    return M.live_sessions(events, last)


def _crawl_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl over the links of the stored pages, from the one with the least url; most links lead out of the tables."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    urls = pages.select(T.normal_url(F.col("url")).alias("url"), "html").dropna(subset=["url"])
    root = urls.agg(F.min("url")).first()[0]
    return W.crawl(W.page_links(urls), urls.select("url"), root, 2, 100).select("url", "depth", "status")


QUERIES["crawl_pages"] = _crawl_pages
