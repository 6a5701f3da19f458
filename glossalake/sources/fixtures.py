"""Adapters from the driver's tables to the shapes the queries read; the SQL is valid in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_COORD = "CASE WHEN {k} % 17 = 0 THEN NULL WHEN {k} % 19 = 0 THEN '0.0' WHEN {k} % 23 = 0 THEN 'n/a' ELSE CAST(CAST((({k} * 7919) % 680) - 340 AS DOUBLE) / 4 AS STRING) END AS Latitude, CAST(CAST((({k} * 104729) % 1440) - 720 AS DOUBLE) / 4 AS STRING) AS Longitude"

VIEWS: dict[str, str] = {
    "languages": f"SELECT c_custkey AS ID, c_name AS Name, concat('g', c_custkey) AS Glottocode, c_mktsegment AS Family, n_name AS dataset_name, {_COORD.format(k='c_custkey')} FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "parameters": "SELECT p_partkey AS ID, p_name AS Name, CASE WHEN p_size % 13 = 0 THEN NULL ELSE upper(p_type) END AS Concepticon_Gloss FROM part",
    "forms": "SELECT o_custkey AS Language_ID, l_partkey AS Parameter_ID, concat(l_returnflag, l_linestatus, '-', l_linenumber) AS Value FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "flat": f"SELECT s_suppkey AS ID, s_name AS Name, concat('supplier of nation ', s_nationkey) AS Description, {_COORD.format(k='s_suppkey')} FROM supplier",
    "materials": "SELECT source AS id, concat('Material ', source) AS title, CASE CAST(substring(source, 4) AS INT) % 3 WHEN 0 THEN 'ready_for_text_extraction' WHEN 1 THEN 'draft' ELSE 'reviewed' END AS status, CASE CAST(substring(source, 4) AS INT) % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE concat('Collection ', CAST(substring(source, 4) AS INT) % 5) END AS collection, concat('2024-01-', lpad(CAST(CAST(substring(source, 4) AS INT) + 1 AS STRING), 2, '0'), 'T00:00:00+00:00') AS updated_at, CASE CAST(substring(source, 4) AS INT) % 3 WHEN 0 THEN NULL ELSE concat('Author ', CAST(substring(source, 4) AS INT) % 4) END AS authors, CAST(1990 + CAST(substring(source, 4) AS INT) AS STRING) AS year, CASE CAST(substring(source, 4) AS INT) % 2 WHEN 0 THEN 'pdf' ELSE 'slide' END AS source_type, CASE CAST(substring(source, 4) AS INT) % 5 WHEN 1 THEN NULL ELSE concat('notes no ', CAST(substring(source, 4) AS INT) % 6) END AS abstract_or_notes, concat('ref ', CAST(substring(source, 4) AS INT) % 3) AS raw_reference, CASE CAST(substring(source, 4) AS INT) % 4 WHEN 2 THEN 'kw' END AS keywords, CASE CAST(substring(source, 4) AS INT) % 6 WHEN 5 THEN 'auto' END AS auto_keywords FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) s",
    "files": "SELECT DISTINCT concat(source, '/', lang) AS id, source AS material_id, concat(lang, '.txt') AS original_filename, CASE lang WHEN 'en' THEN '2024-02-03' ELSE '2024-02-01' END AS uploaded_at, CASE lang WHEN 'de' THEN 0 ELSE 1000 END AS file_size, concat('/x/', lang) AS stored_path FROM documents",
    "segments": "SELECT doc_id AS id, source AS material_id, doc_id % 40 + 1 AS page_index, concat('page:', doc_id % 40 + 1) AS page_ref, CASE WHEN doc_id % 30 = 7 THEN concat(lang, '.csv') ELSE concat(lang, '.txt') END AS source_locator, CASE WHEN doc_id % 20 = 3 THEN 'references' ELSE 'document' END AS source_kind, text AS content_text FROM documents",
    "observations": "SELECT event_id AS id, event_type AS observation_type, props AS observed_text, user_id AS source_segment_id, CASE WHEN event_id % 2 = 0 THEN event_id % 500 END AS source_image_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN ' ' ELSE concat('note ', event_id % 11) END AS notes, ts AS updated_at, source AS material_id, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN 'page:0' END AS source_page_ref, CASE WHEN event_id % 5 = 0 THEN 'own.txt' END AS source_locator, CASE WHEN event_id % 4 = 0 THEN concat('quote ', event_id % 13) END AS context_quote FROM events JOIN documents ON user_id = doc_id",
    "runs": "SELECT event_id AS id, source AS material_id, CASE WHEN event_id % 5 = 0 THEN 'running' WHEN event_id % 5 = 1 THEN 'failed' WHEN event_id % 5 = 2 THEN 'empty' ELSE 'ok' END AS status, ts AS created_at FROM events JOIN documents ON user_id = doc_id WHERE event_type IN ('view', 'click')",
    "segment_embeddings": "SELECT vec_id AS segment_id, concat('m', label % 2) AS model, embedding FROM embeddings",
    "images": "SELECT vec_id AS id, source AS material_id, vec_id % 40 + 1 AS page_index, concat(lang, '.txt') AS source_locator, b.text AS visual_caption, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE concat('ocr ', vec_id % 9) END AS ocr_text, concat('page:', vec_id % 40 + 1) AS page_ref, 'document' AS source_kind, 'figure' AS evidence_type, concat('/files/', vec_id, '.png') AS image_path, concat('2024-01-', lpad(CAST(vec_id % 28 + 1 AS STRING), 2, '0')) AS created_at FROM embeddings JOIN benchmark b ON b.item_id = vec_id % 40 JOIN documents ON doc_id = vec_id",
    "image_embeddings": "SELECT vec_id AS image_id, 'm0' AS model, CASE WHEN vec_id % 5 = 0 THEN 'v1' ELSE 'v2' END AS method_version, embedding FROM embeddings WHERE vec_id % 3 <> 1",
    "links": "SELECT page_id AS id, concat('src', page_id % 20) AS material_id, url AS discovered_url, CASE WHEN page_id % 3 = 0 THEN 'ok' ELSE 'fetch_error' END AS status FROM pages",
    "sessions": "SELECT conv_id AS session_id, turn, role, text AS content FROM conversations",
}
_BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def views(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named views as DataFrames over the Parquet tables of sf_dir."""
    sql = " ".join(VIEWS[n] for n in names)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _BASE if t in sql}
    out = []
    for n in names:
        text = VIEWS[n]
        for t, df in tables.items():
            df.createOrReplaceTempView(t)
        out.append(spark.sql(text))
    return out


def oracle(body: str, *names: str) -> str:
    """DuckDB SQL of a query over the named views."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names) + "\n" + body if names else body
