"""Tools, csv tables, clustering, tiles, extraction, images and the engine, on small cases worked out by hand."""

import io
import json
import random
import struct
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossalake import tools
from glossalake.engine import Engine
from glossalake.functions import text as T
from glossalake.operators import clustering, evidence, images, search, store, tiles, web
from glossalake.sources import extraction, text_tables
from glossalake.sources.fixtures import views
from glossalake.streaming import maintenance

SF = "/root/testdata/sf0.001"
CSV = "LangID,Language Name,parameter,Word form,Y,lng,Form 2\nl1,One,WATER,wai,1.5,2,x\nl1,One,FIRE,ahi,1.5,2,y\nl2,Two,WATER, ,3,4,z\n"


def test_standard_names():
    names = text_tables.standard_names(["LangID", "Language Name", "parameter", "Word form", "Y", "lng", "Form 2", "Gloss"])
    assert names == {"LangID": "LangID", "parameter": "Concept", "Word form": "Form", "Y": "Latitude", "lng": "Longitude"}
    assert text_tables.missing_columns(["Concept", "Form"]) == ["Latitude", "Longitude", "Glottocode or LangID"]
    assert text_tables.coordinate_columns(["LATITUDE", "x"]) == ("LATITUDE", None)


def test_csv_round(spark, tmp_path):
    df = text_tables.normalised(text_tables.parse_csv(spark, CSV))
    assert df.columns == ["LangID", "Language Name", "Concept", "Form", "Latitude", "Longitude", "Form 2"] and df.count() == 3
    assert text_tables.preview(df, 1)[1] == 3
    assert text_tables.csv_text(df).splitlines()[1] == "l1,One,WATER,wai,1.5,2,x"
    stream = pa.ipc.open_stream(text_tables.arrow_stream(df.limit(0)))
    assert stream.schema.names == df.columns and stream.read_all().num_rows == 0
    (tmp_path / "a.csv").write_text(CSV)
    at = str(tmp_path / "out")
    assert text_tables.migrate(spark, {"a": str(tmp_path / "a.csv")}, at) == ["a"] and text_tables.migrate(spark, {"a": str(tmp_path / "a.csv")}, at) == []
    assert set(text_tables.readable(spark, {"a": f"{at}/a.parquet", "b": f"{at}/b.parquet"})) == {"a"}
    text_tables.write_gloss_index(spark.createDataFrame([("d", "B"), ("d", "A"), ("e", None), ("e", "")], "dataset_name string, Concepticon_Gloss string"), at, "csv")
    assert [r[0] for r in text_tables.read_csv(spark, f"{at}/glosses").collect()] == ["A", "B"]
    made = text_tables.synthetic(spark, 4, 3, 5)
    assert not text_tables.wordlist_faults({k: v for k, v in made.items() if k != "flat"}) and made["forms"].count() == 12
    assert "missing table: forms" in text_tables.wordlist_faults({"languages": made["languages"]})


def test_replies():
    assert tools.balanced('x {"a": "}", "b": {"c": 1}} y') == '{"a": "}", "b": {"c": 1}}' and tools.balanced("{") is None
    assert tools.plain_reply('{"text": "hi"}') == "hi" and tools.plain_reply('so {"tool": "x", "params": {}} there {"a": 1}') == 'so  there {"a": 1}'
    assert tools.plain_reply('```json\n{"action": "x"}\n```\nok') == "ok" and tools.plain_reply(None) == ""
    assert tools.decide('Well: {"tool": "cluster", "params": {"a": 1}}').tool == "cluster"
    assert tools.decide('```json\n{"text": "yes"}\n```').text == "yes" and tools.decide('{"tool": "x"').text == '{"tool": "x"' and tools.decide("").text == tools.LOST
    assert tools.flat_object('say {"a": {"query": "q"}}') == {"query": "q"} and tools.string_list('a ["x", "y"]') == ["x", "y"] and tools.string_list("[x]") is None


def test_tools(spark):
    state = tools.State()
    assert tools.run_tool(spark, "nope", {}, state).error and tools.run_tool(spark, "cluster", {}, state).error == "No data available."
    assert tools.run_tool(spark, "read_csv", {"csv_data": CSV}, state).data["row_count"] == 3
    assert tools.run_tool(spark, "normalize_spoken_language_csv", {"csv_data": CSV}, state).data["ok"] and state.latest_data_rows == 3
    got = tools.run_tool(spark, "to_binary_matrix", {}, state)
    assert got.data["summary"] == {"languages": 1, "concepts": 2, "avg_coverage": 100.0} and state.matrix_concepts == 2
    assert tools.run_tool(spark, "style_patch", {"field": "a", "column_names": ["b"]}, state).data["error"]
    assert tools.State.from_json(state.to_json()) == state and tools.State.from_json(None) == tools.State()
    assert tools.run_tool(spark, "propose_wordlist", {"topic": "food"}, state, lambda p: 'here: ["EAT", "DRINK"]').success and state.wordlist == ["EAT", "DRINK"]
    replies = iter(['{"tool": "search_available_concepts", "params": {"query": "small"}}', "Done."])
    l, f, p = views(spark, SF, "languages", "forms", "parameters")
    reply, result = tools.turn(spark, state, "find", lambda m: next(replies), {"languages": l, "forms": f, "parameters": p})
    assert reply == "Done." and result.success and state.wordlist and all("SMALL" in w for w in state.wordlist) and len(state.history) == 2
    found = tools.run_tool(spark, "query_spatial_linguistic_data", {"glosses": ["promo"]}, state, tables={"languages": l, "forms": f, "parameters": p})
    assert state.latest_data_source == "query" and found.data["row_count"] > 0
    assert tools.turn(spark, state, "x", lambda m: 1 / 0)[0].startswith("LLM error") and len(tools.shown(found)) == tools.SHOWN


def test_clusters(spark):
    rng = random.Random(4)
    rows = [(f"{c}{i}", c, *(int((c == "a") == (k < 10) and rng.random() < 0.95) for k in range(20))) for c in "ab" for i in range(12)]
    rows.append(("odd", "o", *([1, 0] * 10)))
    kind = "LangID string, kind string, " + ", ".join(f"w{k} int" for k in range(20))
    out = clustering.cluster(spark.createDataFrame(rows, kind).drop("kind"))
    got = {r.LangID: r.cluster_id for r in out.collect()}
    assert {got[f"a{i}"] for i in range(12)} - {-1} and not ({got[f"a{i}"] for i in range(12)} & {got[f"b{i}"] for i in range(12)}) - {-1}
    s = clustering.summary(out).first()
    assert s.total_clusters == 2 and s.clustered_languages + s.noise_points == 25 and s.clustered_languages > 18
    labels = clustering._clusterer()
    pts = np.concatenate([np.random.default_rng(k).normal(c, 0.1, (15, 2)) for k, c in enumerate(((0, 0), (5, 5), (0, 9)))] + [np.array([[50.0, 50.0]])])
    found = labels(pts, 5, 3, "euclidean")
    assert [len(set(found[i : i + 15])) for i in (0, 15, 30)] == [1, 1, 1] and len(set(found[:45])) == 3 and found[45] == -1
    assert (labels(np.zeros((20, 3)), 5, 3, "jaccard") == -1).all() and labels(np.zeros((1, 3)), 5, 3, "jaccard").tolist() == [-1]
    with pytest.raises(ValueError):
        clustering.cluster(spark.createDataFrame([("a",)], "LangID string"))


def test_clusters_of_many_equal_rows(spark):
    """12,000 rows of four kinds, and a few odd ones: equal rows have one label, that of the rows one by one where these fit."""
    kinds = [(1, 1, 0, 0), (1, 1, 1, 0), (0, 0, 0, 1), (0, 0, 1, 1)]
    make = lambda n: [(i, *kinds[i % 4]) for i in range(n)] + [(n + i, *v) for i, v in enumerate([(1, 0, 0, 1), (None, 1, 1, 1)])]
    kind = "ID long, a int, b int, c int, d int"
    out = clustering.cluster(spark.createDataFrame(make(12_000), kind), order=("ID",)).toPandas()
    assert list(out.columns) == ["ID", "a", "b", "c", "d", "cluster_id"] and sorted(out["ID"]) == list(range(12_002))
    found = out.groupby(["a", "b", "c", "d"], dropna=False)["cluster_id"].agg(["nunique", "first", "size"])
    assert len(found) == 6 and (found["nunique"] == 1).all() and out["a"].isna().sum() == 1
    few = clustering.cluster(spark.createDataFrame(make(400), kind), order=("ID",)).toPandas()
    assert few.groupby(["a", "b", "c", "d"], dropna=False)["cluster_id"].first().tolist() == found["first"].tolist()
    assert clustering.summary(clustering.cluster(spark.createDataFrame(make(12_000), kind), order=("ID",))).first().total_clusters == 4


def _fields(data: bytes):
    at = 0

    def number():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        elif tag & 7 == 1:
            yield tag >> 3, struct.unpack("<d", data[at : at + 8])[0]
            at += 8
        else:
            n = number()
            yield tag >> 3, data[at : at + n]
            at += n


def test_vector_tiles(spark):
    points = spark.createDataFrame([(1, "A", "10.0", "20.0"), (2, None, "10.0", "20.1"), (3, "A", "x", "1"), (4, "B", "-80", "-170")], "ID long, Name string, Latitude string, Longitude string")
    found = tiles.tiles(points, 2, "langs").collect()
    near = {(r.x, r.y): r.tile for r in found}[2, 1]
    (kind, layer), = _fields(bytes(near))
    parts = list(_fields(layer))
    assert kind == 3 and dict(parts)[1] == b"langs" and dict(parts)[5] == 4096 and dict(parts)[15] == 2
    assert [v for k, v in parts if k == 3] == [b"ID", b"Name"] and sum(k == 2 for k, _ in parts) == 2
    one = tiles.one_tile(points, (0.0, 0.0, 90.0, 66.5), "langs").first().tile
    assert len(one) and len(tiles.one_tile(points, (100.0, 0.0, 110.0, 10.0), "langs").first().tile) == 0


def _pptx(texts):
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i, t in enumerate(texts, 1):
            z.writestr(f"ppt/slides/slide{i}.xml", f"<p:sld {a}><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sld>")
        z.writestr("ppt/media/image1.png", b"png")
    return out.getvalue()


def test_extraction(spark):
    files = [
        (1, "m", "a.txt", "Grüße\n\nzwei".encode()), (2, "m", "b.txt", "Gr\xfc\xdfe".encode("latin-1")), (3, "m", "c.rtf", rb"{\rtf1{\fonttbl x;}caf\'e9\par two}"), (4, "m", "d.pptx", _pptx(["one", "two"])),
        (5, "m", "e.pptx", b"broken"), (6, "m", "f.txt", b""), (7, "n", "g.txt", ("word " * 3000).encode()),
    ]
    df = spark.createDataFrame([(*f[:3], bytearray(f[3])) for f in files], "id long, material_id string, original_filename string, content binary")
    segments, warnings = extraction.extract(df)
    got = {(r.file_id, r.page_ref): r.content_text for r in segments.collect()}
    assert got[1, "chunk:1"] == "Grüße\n\nzwei" and got[2, "chunk:1"] == "Grüße" and got[3, "chunk:1"].split() == ["café", "two"] and got[4, "slide:2.1"] == "two"
    assert sorted(k for i, k in got if i == 7) == ["chunk:1", "chunk:2", "chunk:3"] and {r.file_id for r in warnings.collect()} == {5, 6}
    assert extraction.embedded_images(df).count() == 1


def test_images(spark):
    a, b = "0" * 64, "0" * 63 + "3"
    rows = [(1, "m", 1, a), (2, "m", 2, b), (3, "m", 3, a), (4, "m", 4, "f" * 64), (5, "m", 5, ""), (6, "m", 6, ""), (7, "n", 1, b), (8, None, 1, b), (9, "m", 7, None)]
    df = spark.createDataFrame(rows, "id long, material_id string, page_index int, fingerprint string")
    assert sorted(r.id for r in images.drop_near_images(df).collect()) == [1, 4, 5, 6, 7, 8, 9]
    assert [r[0] for r in spark.createDataFrame([(a, b), (a, "x"), (None, a)], "a string, b string").select(T.hamming_hex(F.col("a"), F.col("b"))).collect()] == [2, 999, 999]
    px = spark.createDataFrame([([0, 255] * 128,), ([9] * 256,), ([],)], "p array<int>")
    assert [r[0] for r in px.select(images.informative(F.col("p"))).collect()] == [True, False, True]
    assert [r[0] for r in px.select(images.average_hash(F.col("p"))).collect()] == ["5" * 64, "f" * 64, ""]


def test_labels_and_wordlists(spark):
    text = "The image shows 1. A Bowl, bowl;\nvisible features - it could be old, **Net**"
    assert spark.createDataFrame([(text,), (None,)], "t string").select(evidence.image_labels(F.col("t")).alias("x")).collect()[0].x == "a bowl; bowl; net"
    table = 'Some\nLanguage Name,Concept,Form,Source\n"A, b",to beat,ta,x\nB,stone,po,y'
    read = evidence._table_reader()
    assert [r["language_name"] for r in read(table, [], 20)] == ["A, b", "B"] and read("a,b\nc,d", [], 20) is None
    got = spark.createDataFrame([(table,), (None,)], "t string").select(evidence.wordlist_rows(["beating", "beat"])("t").alias("r")).collect()
    assert len(got[0].r) == 1 and got[0].r[0].form == "ta" and got[1].r is None


def test_full_text_grammar(spark):
    rows = [(1, "Étude of the sea", "p:1", "a.txt"), (2, "the études; sea of", "p:2", "b.txt"), (3, "of the of the", "p:1", None), (4, None, None, None)]
    df = spark.createDataFrame(rows, "id long, content_text string, page_ref string, source_locator string")
    ids = lambda q: sorted(r.id for r in search.bm25(df, q).collect())
    assert ids("etude sea") == [1] and ids("etude*") == [1, 2] and ids('"of the"') == [1, 3] and ids("sea NOT etude") == [2]
    assert ids("page_ref : 1") == [1, 3] and ids("txt OR (of AND p)") == [1, 2, 3] and ids("{page_ref source_locator} : txt") == [1, 2] and ids("of + the") == [1, 3]
    for bad in ("a-b", '"open', "(a", "nope : a", "", "a )"):
        with pytest.raises(ValueError):
            search.parse_query(bad)


def test_links(spark):
    pages = spark.createDataFrame([("http://a.org/x/", '<a href="y">1</a><a href="mailto:z">2</a><a href="HTTP://b.org">3</a>'), (None, "<a href=x>"), ("http://c.org", None)], "url string, html string")
    assert [(r.src, r.dst) for r in web.page_links(pages).orderBy("pos").collect()] == [("http://a.org/x/", "http://a.org/x/y"), ("http://a.org/x/", "http://b.org")]


def _engine(spark, embed=None):
    names = ("languages", "forms", "parameters", "materials", "files", "segments", "observations", "runs", "images", "segment_embeddings", "image_embeddings")
    tables = dict(zip(names, views(spark, SF, *names), strict=True))
    wide = lambda df, key: df.withColumn("material_id", F.lit("src1")).withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))
    tables |= {"segment_embeddings": wide(tables["segment_embeddings"], "segment_id"), "image_embeddings": wide(tables["image_embeddings"], "image_id"), "archaeology": views(spark, SF, "flat")[0]}
    return Engine(spark, tables, "m0", "v2", embed)


def test_engine(spark):
    e = _engine(spark)
    assert e.catalog().filter("dataset_name = 'Combined'").count() == 1 and e.glosses(["FRANCE"]).count() >= 0
    page, total = e.data("spoken_language", search="7", limit=5)
    assert page.count() == 5 and total.first().total > 5 and e.data("archaeology", search="1")[1].first().total > 0
    with pytest.raises(ValueError):
        e.data("nope")
    assert len(e.tile("spoken_language", "Combined", 1, 0, 0).first().tile) > 0 and e.constants().count() == 21
    assert e.semantic_search("x").count() == 0 and e.ask("x", lambda q, t: "never").startswith("No retrieved")
    e.create_material({"id": "new", "title": "A", "source_type": "pdf"}, "2025-01-01")
    e.update_material("new", {"title": "B"}, "2025-01-02")
    r = e.material("new").first()
    assert (r.title, r.status, r.updated_at, r.file_count) == ("B", "uploaded", "2025-01-02", 0)
    with pytest.raises(ValueError):
        e.create_material({"id": "x", "source_type": "nope"}, "2025")
    e.delete_material("new")
    with pytest.raises(LookupError):
        e.material("new")
    s = e["segments"].filter("material_id IS NOT NULL").first()
    n = e["image_embeddings"].count()
    image = e["images"].join(e["image_embeddings"].filter("image_id > 0").select(F.col("image_id").alias("i")), F.col("id") == F.col("i")).filter("material_id IS NOT NULL").first()
    e.create_observation({"id": 10**9, "material_id": image.material_id, "observed_text": "x", "observation_type": "term", "source_image_id": image.id}, "2025")
    made = e["observations"].filter(f"id = {10**9}").first()
    assert made.source_page_ref == image.page_ref and e["image_embeddings"].count() == n - 1
    with pytest.raises(ValueError):
        e.create_observation({"id": 1, "material_id": "src1" if s.material_id != "src1" else "src2", "observed_text": "x", "source_segment_id": s.id}, "2025")
    e.delete_observation(10**9)
    assert e.observations(image.material_id, "view").count() >= 0 and e.index_status().count() == 1


def test_engine_with_a_model(spark):
    dims = 64

    def model():
        def embed(texts):
            return [[float((len(t) * (k + 3)) % 17 - 8) for k in range(dims)] for t in texts]

        return embed

    e = _engine(spark, model())
    before = e["segment_embeddings"].filter("model = 'm0'").count()
    e.index_segments(limit=5)
    assert e["segment_embeddings"].filter("model = 'm0'").count() == before + 5
    found = e.semantic_search("some words", limit=3)
    assert found.count() == 3 and found.first().citation.material_id is not None
    assert "[1] Material" in search.evidence_text(found).first().evidence and e.ask("q", lambda q, t: t[:3]) == "[1]"
    assert e.evidence_report("page").count() > 0 and e.multimodal_search("page", limit=2).count() == 4
    c = e.index_images(limit=3, informative=F.col("id") % 2 == 0)
    assert c.first().processed_image_count == 3 and c.first().removed_blank_count > 0


def test_rows_of_other_materials(spark):
    o = spark.createDataFrame([(1, "m", 5), (2, "n", 5), (3, "m", None), (4, "m", 6)], "id int, material_id string, source_segment_id int")
    s = spark.createDataFrame([(5, "m")], "id int, material_id string")
    assert sorted(r.id for r in store.owned(o, s, "source_segment_id").collect()) == [2, 4]
    store.check_owned(o.filter("id IN (1, 3)"), s, "source_segment_id")


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "m", "a b a", "p", "l"), (2, "m", "b", "p", "l")], "id long, material_id string, content_text string, page_ref string, source_locator string")
    rows.write.parquet(src)
    stream = lambda: spark.readStream.schema(rows.schema).parquet(src)
    for writer, at in ((maintenance.token_stream(stream(), out), "t"), (maintenance.embedding_stream(stream(), out, "m0", lambda ts: [[float(len(t)), 0.0] for t in ts]), "e")):
        writer.option("checkpointLocation", str(tmp_path / at)).trigger(availableNow=True).start().awaitTermination(120)
    assert {(r.token, r.id, r.n) for r in maintenance.latest(spark, out, "tokens", "id").collect()} >= {("a", 1, 2), ("b", 1, 1), ("b", 2, 1)}
    assert sorted(r.segment_id for r in maintenance.latest(spark, out, "segment_embeddings", "segment_id").collect()) == [1, 2]
    events = spark.createDataFrame([("s", json.dumps({"a": 1}), "2025-01-01 00:00:00"), ("s", "{}", "2025-01-01 01:00:00"), ("t", "{}", "2024-12-31 00:00:00")], "session_id string, state string, saved_at string")
    now = spark.createDataFrame([("2025-01-01 06:00:00",)], "t string")
    assert [(r.session_id, r.state) for r in maintenance.live_sessions(events, now).collect()] == [("s", "{}")]
    timed = events.withColumn("saved_at", F.col("saved_at").cast("timestamp"))
    assert sorted(r.turns for r in maintenance.session_stream(timed).collect()) == [1, 2]
    jobs = spark.createDataFrame([("j", "running", 2), ("j", "done", 2), ("k", "queued", 1)], "job_id string, status string, at int")
    assert {(r.job_id, r.status) for r in maintenance.job_states(jobs).collect()} == {("j", "done"), ("k", "queued")}
