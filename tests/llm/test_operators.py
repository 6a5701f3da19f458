"""The training-data operators against SQL, brute force, round trips and edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glossalake.llm import encoding, exact_dedup, graph_ann, lm, mixing, quality, registry, sharding, simhash, toxicity, urls

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, size long, _part int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and names that clash with the operators' own."""
    rows = [
        (1, "a b  c", "en", "s1", 6, "r", 1, 1), (2, "a b\tc", "en", "s1", 6, "r", 1, 1), (2, "a b\tc", "en", "s1", 6, "r", 1, 1), (3, None, None, None, None, None, None, None),
        (4, "", "en", "s2", 0, "", 0, 0), (None, "a b c", "en", None, 5, "r", 2, 2), (6, "word " * 30000, "en", "s2", 150000, "r", 3, 3), (7, "x" * 5000, "en", "s3", 5000, "r", 3, 3), (8, "▁né 日本 \x00", "de", "s3", 9, "r", 3, 3),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (4, 0, 0), (6, 0, 1), (99, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(registry.ORACLE_SQL[name]).df()
    got = registry.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    rows = lambda d: sorted(repr([None if pd.isna(v) else float(v) if not isinstance(v, str) else v for v in r]) for r in d.astype(object).itertuples(index=False))
    assert rows(got) == rows(want)


def test_shards(spark, odd):
    for df, shards in ((spark.read.parquet(f"{SF}/documents.parquet"), 40), (odd, 3)):
        got = sharding.shard_by_bytes(df, shards).toPandas()
        want = df.toPandas()
        assert len(got) == len(want)
        assert Counter(got["text_crc32"]) == Counter(zlib.crc32((t or "").encode()) for t in want["text"])
        assert Counter(got["size"]) == Counter(len((t or "").encode()) + 16 for t in want["text"])
        for _, g in got.groupby("shard"):
            assert sorted(g["slot"]) == list(range(len(g)))
        sums = got.groupby("shard")["size"].sum()
        assert sums.max() <= got["size"].sum() / shards + got["size"].max()
        order = got.sort_values(["shard", "slot"])["doc_id"].dropna()
        assert order.is_monotonic_increasing


def test_shards_against_a_plain_prefix_sum(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    size = {i: len((t or "").encode()) + 16 for i, t in df.select("doc_id", "text").collect()}
    total, before, slots = sum(size.values()), 0, Counter()
    want = {}
    for i in sorted(size):
        shard = min(39, 40 * (2 * before + size[i]) // (2 * total))
        want[i] = (size[i], shard, slots[shard])
        slots[shard] += 1
        before += size[i]
    assert {r.doc_id: (r["size"], r.shard, r.slot) for r in sharding.shard_by_bytes(df).collect()} == want


def test_content_sort_edges(odd):
    for n in (1, 5):
        got = exact_dedup.content_sort(odd, ranges=n).toPandas()
        abc = got[got["text_sha256"] == got.loc[got["doc_id"] == 1, "text_sha256"].iloc[0]]
        assert len(abc) == 4 and set(abc["group_size"]) == {4} and set(abc["keep_id"]) == {1} and abc["kept"].sum() == 1
        assert got["kept"].sum() == 5
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns and kept.count() == 5


def test_mix_edges(odd):
    got = mixing.fair_queue(odd).toPandas()
    assert len(got) == 9 and (got["taken"] <= 2 * got["size"]).all()
    assert mixing.mix(odd).columns == odd.columns
    again = mixing.fair_queue(odd).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    assert Counter(map(repr, got[key].to_numpy().tolist())) == Counter(map(repr, again[key].to_numpy().tolist()))


def test_mix_targets(spark):
    got = mixing.targets(spark.createDataFrame([("a", 10), ("b", 100), ("c", 100), (None, 0)], "source string, source_size long")).toPandas().set_index("place")["target"].sort_index()
    assert got.tolist() == pytest.approx([20.0, 295 * 2 / 3, 295 / 3, 0.0])


def _components(prints: list[int]) -> list[int]:
    root = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3 and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    return root


@pytest.mark.parametrize("hot", [512, 1])
def test_links_against_brute_force(spark, hot):
    rng = random.Random(hot)
    prints = {0}
    for _ in range(30):
        base = rng.getrandbits(64)
        for _ in range(6):
            prints.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {(r.a, r.b) for r in simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp long"), hot).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}


def test_variants_are_not_broadcast(spark):
    """Spark takes the 64 variants of each fingerprint for as small as the fingerprints; gathered in the driver they fill it."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
        plan = simhash.near_links(spark.range(100).select(F.col("id").alias("fp")))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = re.findall(r"(\w+Join) \[a_tag", plan)
    assert len(joins) == 2 and set(joins) == {"SortMergeJoin"}


def test_simhash_components(spark, odd):
    from xxhash import xxh64_intdigest

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = simhash.near_groups(docs).toPandas().sort_values("doc_id")
    prints = []
    for t in docs.toPandas().sort_values("doc_id")["text"]:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        h = [xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else [0]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    assert got["fingerprint"].tolist() == [f"{p:016x}" for p in prints]
    root = pd.Series(_components(prints))
    ids = got["doc_id"].reset_index(drop=True)
    assert got["component_id"].tolist() == ids.groupby(root).transform("min").tolist()
    assert simhash.near_groups(odd).count() == 9
    assert simhash.drop_near_copies(odd).columns == odd.columns


def test_near_copies_keep_one_row_of_each_component(spark):
    a, b, c, d = "red green blue", "one two three", "tall oak tree", "cold grey sea"
    rows = [(7, a), (7, b), (7, c), (8, a), (None, a), (None, d), (None, d.upper()), (9, None), (10, "")]
    got = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, (r.text or "").lower()) for r in got) == Counter([(7, a), (7, b), (7, c), (None, d), (9, "")])


def test_toxicity(spark, odd, labels):
    for sf, least in (("sf0.01", 0.6), ("sf0.1", 0.9)):
        sf = f"/root/testdata/{sf}"
        got = toxicity.op6_pattern_grammar(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
        out = got[got["held_out"]]
        assert out.loc[out["toxic"] == 0, "predicted"].mean() < 0.01 and out.loc[out["toxic"] == 1, "predicted"].mean() > least
    langs = got.merge(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    assert langs[(langs["toxic"] == 1) & langs["held_out"]].groupby("lang")["predicted"].mean().min() > 0.85
    assert toxicity.toxicity(odd, labels).count() == 9
    assert toxicity.drop_toxic(odd, labels).columns == odd.columns


def test_grammar():
    model = toxicity.Model({"idiot": 4.0}, {"scumm": 4.0}, -5.0)
    plain, negated, reported, aimed = (model.score(t) for t in ("an idiot so here", "not an idiot here", "wrote an idiot here", "you an idiot here"))
    assert negated < plain and reported < plain < aimed
    assert model.score("a SCUMMERY thing") > 0.3 > model.score("") == model.score(None) == model.score("they had no time to kill")


def test_threats_need_a_target_and_heed_negation_and_report():
    score = toxicity.Model({}, {}, -5.0).score
    plain = score("I will kill you")
    assert plain > 0.8 and score("ich werde dich umbringen") == score("te voy a matar") == score("I will kill them") == plain
    assert score("he said I will not kill you") < score("I will not kill you") < score("he said I will kill you") < plain
    assert max(map(score, ("we beat them in the final", "I kill time", "you will kill time", "kill. you", "kill it with some of your", "they will not beat anyone"))) < 0.3


def test_composition_against_one_machine():
    """The chain of transducers gives what a single machine over tuples of states gives, and what a plain reading of threats gives."""
    rng, g = random.Random(2), toxicity.grammar()
    symbols = ["insult", "threat", "you", "object", "them", "modal", "negation", "report", "other"]
    product: dict[tuple, tuple] = {}

    def step(states, symbol):
        if (states, symbol) not in product:
            new, out, factor = [], symbol, 1.0
            for s, part in zip(states, g.parts, strict=True):
                s, out, f = part.step(s, out)
                new.append(s)
                factor *= f
            product[states, symbol] = (tuple(new), out, factor)
        return product[states, symbol]

    for _ in range(3000):
        text = [rng.choice(symbols) for _ in range(rng.randint(0, 9))]
        states, want = (0, 0, 0, 0), {"insult!": 0.0, "threat!": 0.0}
        for x in text:
            states, out, factor = step(states, x)
            if out in want:
                want[out] += 3.0 * factor
        got = g.run([(x, 3.0) for x in text])
        assert got == pytest.approx(want)
        assert (got["insult!"] > 0) == ("insult" in text)
        if not {"threat"} & set(text) or not {"you", "object", "them"} & set(text):
            assert got["threat!"] == 0


def test_encoding(odd):
    pieces, rng = encoding.load(), random.Random(3)
    for _ in range(500):
        x = "".join(rng.choice("▁abctheéß日 ,\n") for _ in range(rng.randint(0, 40)))
        assert pieces.decode(pieces.encode(x)) == x
        if x:
            best = list(pieces.viterbi(x, window=10**6))
            assert all(list(pieces.viterbi(x, window=w)) == best for w in (1, 2, 7))
    for r in encoding.encode_documents(odd).collect():
        assert r.n_pieces == len(r.ids)
    got = Counter(r.decoded_crc32 for r in encoding.encode_documents(odd).collect())
    assert got == Counter(zlib.crc32((r.text or "").encode()) for r in odd.collect())


def test_viterbi_against_all_segmentations():
    pieces = encoding.Pieces({"a": (1, -3.0), "b": (2, -3.0), "ab": (3, -4.0), "ba": (4, -2.5), "aba": (5, -6.0)}, list(range(100, 356)))

    def best(x):
        return max(((s + r, (i, *ids)) for p, (i, s) in pieces.pieces.items() if x.startswith(p) for r, ids in [best(x[len(p) :])]), default=(0.0, ()), key=lambda t: t[0]) if x else (0.0, ())

    for x in ("abab", "bababa", "aabbaab"):
        score = {i: s for i, s in pieces.pieces.values()}
        assert all(sum(score[i] for i in pieces.viterbi(x, w)) == pytest.approx(best(x)[0]) for w in (1, 3, 50))


def test_encoding_against_another_decoder(spark):
    """Whole real texts, over the whole vocabulary, against the unigram decoder of the tokenizers library; as many pieces as the merges give, or fewer."""
    import sentencepiece
    from tokenizers import Tokenizer, models

    pieces, merges = encoding.load(), sentencepiece.SentencePieceProcessor(model_file=encoding.MODEL)
    names = [f"<{i}>" for i in range(merges.get_piece_size())]
    scores = [-1e9] * len(names)
    for p, (i, s) in pieces.pieces.items():
        names[i], scores[i] = p, s
    other = Tokenizer(models.Unigram(list(zip(names, scores, strict=True)), unk_id=0, byte_fallback=False))
    by_id = {i: s for i, s in pieces.pieces.values()}
    own, theirs, compared = 0, 0, 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").filter("text IS NOT NULL AND text <> ''").collect():
        ids = pieces.encode(r.text)
        own, theirs = own + len(ids), theirs + len(merges.encode(r.text))
        if set(ids) <= set(by_id):  # nothing spelt in bytes
            want = [i for x in pieces.stretch.findall(encoding.SPACE_MARK + r.text.replace(" ", encoding.SPACE_MARK)) for i in other.encode(x).ids]
            assert sum(by_id[i] for i in ids) == pytest.approx(sum(by_id[i] for i in want))
            compared += 1
    assert compared > 20 and own < 1.02 * theirs


def test_streaming_commits_long_before_the_end():
    pieces = encoding.load()
    text = "abcdefgh" * 3000
    stream = pieces.viterbi(text, window=64)
    assert [next(stream) for _ in range(5)] == list(pieces.viterbi(text, window=10**6))[:5]
    assert len(stream.gi_frame.f_locals["back"]) < 200 and stream.gi_frame.f_locals["start"] < 200


def _true_links(rows: list[tuple]) -> tuple[dict, dict]:
    """n_links and component_id of rows (vec_id, vector, label), by all cosines."""
    good = [(i, np.array(x, float), k) for i, x, k in rows if k is not None and x and all(v is not None and math.isfinite(v) for v in x) and any(x)]
    links = {i: [j for j, y, m in good if j != i and m == k and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98] for i, x, k in good}
    part = {i: i for i, _, _ in rows}
    while any(part[j] < part[i] for i in links for j in links[i]):
        part |= {i: min(part[j] for j in [i, *links[i]]) for i in links}
    return {i: len(links.get(i, ())) for i in part}, part


@pytest.mark.parametrize("cell", [40, 60, 2048])
def test_vectors_against_brute_force(spark, cell):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 8))
    v = np.concatenate([base + rng.standard_normal(base.shape) * 0.08 for _ in range(6)])
    blob = rng.standard_normal(8) + rng.standard_normal((130, 8)) * 0.002  # all alike: no splitting makes it smaller
    rows = [(i, [float(x) for x in r], i % 2) for i, r in enumerate(v)] + [(400 + i, [float(x) for x in r], 1) for i, r in enumerate(blob)]
    rows += [(900, None, 0), (901, [0.0] * 8, 0), (902, [float("nan")] * 8, 1), (903, [float(x) for x in v[0]], 0), (904, [1.0, None], 1), (905, [float(x) for x in v[0]], None), (906, [float("inf")] * 8, 1), (907, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out, audit = graph_ann.near_vectors(df, cell=cell)
    got = out.toPandas().set_index("vec_id")
    links, parts = _true_links(rows)
    assert got["n_links"].to_dict() == links and got["component_id"].to_dict() == parts
    assert all(r.kept == (i == parts[i]) for i, r in got.iterrows())
    hits, true = audit.first()
    assert hits == true == sum(n for i, n in links.items() if i % graph_ann.AUDIT == 0) - 1  # vector 903, equal to 0, is of its node


def test_vectors_on_the_tables(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got = graph_ann.op7_pruned_graph(spark, "/root/testdata/sf0.01").toPandas().set_index("vec_id")
    links, parts = _true_links(rows)
    assert got["n_links"].to_dict() == links and got["component_id"].to_dict() == parts


def test_float_vectors_are_written_once_as_floats(spark, monkeypatch):
    """As stored, without a second copy in double precision, and with the links that double precision gives."""
    written = []
    monkeypatch.setattr(graph_ann, "materialise", lambda df, keep=graph_ann.materialise: written.append(df.dtypes) or keep(df))
    df = spark.createDataFrame([(i, [1.0, i * 1e-2, 0.1], 0) for i in range(60)], "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, graph_ann.near_vectors(df)[0].collect()))
    kinds = [[kind for _, kind in columns if kind in ("array<float>", "array<double>")] for columns in written]
    assert {tuple(k) for k in kinds} == {(), ("array<float>",)}
    assert got == sorted(map(tuple, graph_ann.near_vectors(df.withColumn("embedding", F.col("embedding").cast("array<double>")))[0].collect()))


def test_shards_of_some_thousands_have_no_copies(spark):
    """As many rows as vectors: 6,000 of a label are one graph, not overlapping ones."""
    x = np.random.default_rng(2).standard_normal((6_000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    nodes = spark.createDataFrame(pd.DataFrame({"label": 1, "vec": x.tolist(), "rid": range(len(x)), "n": 1, "norm": 1.0}), "label int, vec array<double>, rid long, n long, norm double")
    assert graph_ann.shards(nodes, math.sqrt(2 - 2 * 0.98)).count() == len(x)


def test_forest_of_a_crowd():
    """Pairs that are joined already aren't walked one by one."""
    pairs = graph_ann._Pairs(pd.DataFrame({"rid": range(300), "n": 1, "cell": "c", "cells": [["c"]] * 300}))
    a, b = np.nonzero(~np.eye(300, dtype=bool))
    pairs.add(a, b)
    assert (pairs.root == 0).all() and (pairs.linked == 299).all()
    pairs.top = None  # not called again
    pairs.add(a, b)


def test_odd_vectors(spark):
    kind = "vec_id long, embedding array<double>, label int, cell string, rid long, n int, vec int"
    rows = [(None, [1.0, 0.0], 0, "c", 1, 1, 1), (5, [1.0, 0.0], 0, "c", 1, 1, 1), (5, [1.0, 0.0], 0, "c", 1, 1, 1), (5, [0.0, 1.0], 0, "c", 1, 1, 1), (None, [0.0, 0.0], 0, "c", 1, 1, 1), (7, [1.0, 0.0], 1, "c", 1, 1, 1)]
    df = spark.createDataFrame(rows, kind)
    got = graph_ann.audited(df).collect()
    assert Counter(tuple(r) for r in got) == Counter([(None, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (5, 0, 5, True), (None, 0, None, True), (7, 0, 7, True)])
    assert graph_ann.audited(df.limit(0)).count() == 0 and graph_ann.audited(df.filter("label > 5")).count() == 0


def test_low_recall_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(graph_ann, "LEAST_RECALL", 1.1)
    with pytest.raises(RuntimeError, match="recall"):
        graph_ann.audited(spark.createDataFrame([(i, [1.0, i * 1e-3], 0) for i in range(40)], "vec_id long, embedding array<double>, label int"))


def test_urls(spark):
    rows = [(1, "http://a.org/x", '<link rel="canonical" href="http://n.net/es/1">'), (2, "http://A.org/y", '<meta http-equiv="refresh" content="0; url=/x">'), (3, "http://www.example.com/en/q", "<LINK href=http://a.org/x rel=canonical>"), (4, None, None), (5, "nothing", "")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i].verdict for i in range(1, 6)] == ["block", "block", "allow", "allow", "allow"]
    assert got[2].host == "a.org" and got[5].host == got[5].path == "" and got[3].rule == "www.example.com/en/"


def test_all_alias_links(spark):
    bad = "http://n.net/es/d/"
    rows = [
        (1, "http://n.net/es/d/i", '<link rel=canonical href=x.html><link href="../y" rel="canonical">'), (2, "http://q.org/1", f'<meta content="0; URL={bad}i" http-equiv=Refresh>'),
        (3, "http://q.org/2?a=1&b=2", ""), (4, "http://n.net/fr/p", "<link rel=canonical href='http://q.org/2?a=1&amp;b=2'>"), (5, "http://q.org/3", "<meta http-equiv=refresh content='5; url=?p=2'>"), (6, "http://q.org/3?p=2", f"<link rel=canonical href='{bad}i'>"),
        (7, "http://q.org/4", f"<link rel=canonical href=/z><link rel=canonical href={bad}i>"), (8, "http://q.org/5", f"<link rel=next href={bad}i><link rel=canonical href=/5>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    edges = {(r.a, r.b) for r in urls.alias_edges(pages).collect()}
    assert {("n.net/es/d/i", "n.net/es/d/x.html"), ("n.net/es/d/i", "n.net/es/y"), ("q.org/3", "q.org/3?p=2"), ("n.net/fr/p", "q.org/2?a=1&b=2")} <= edges
    got = {r.page_id: r.verdict for r in urls.judge(pages).collect()}
    assert [got[i] for i in range(1, 9)] == ["block"] * 7 + ["allow"]


def test_quality(spark, odd, labels):
    got = quality.op1_importance_resampling(spark, "/root/testdata/sf0.01").toPandas().merge(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas(), on="doc_id")
    rates = got.groupby("quality")["kept"].mean()
    assert rates[1] > 0.95 and rates[0] < 0.5
    assert quality.importance(odd, labels).count() == 9


def test_importance_against_brute_force(spark):
    from xxhash import xxh32_intdigest

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").collect(), spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    low, mask = 2**32, 2**64 - 1

    def grams(text):
        one = [xxh32_intdigest(w, quality.SEED) for w in re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())]
        mixed = [(a * 0x9E3779B1 + b * 0x85EBCA77 + 1) & mask for a, b in zip(one, one[1:], strict=False)]
        return [x % quality.BUCKETS for x in one] + [(((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & mask) >> 20) % quality.BUCKETS for x in mixed]

    assert low > max(xxh32_intdigest(b"x", 1), 0)
    good = set(labels.loc[labels["quality"] == 1, "doc_id"])
    all_, mine = Counter(), Counter()
    for r in docs:
        g = grams(r.text)
        all_.update(g)
        mine.update(g if r.doc_id in good else ())
    n, m = sum(all_.values()) + quality.BUCKETS, sum(mine.values()) + quality.BUCKETS
    want = {r.doc_id: sum(math.log((mine[b] + 1) / m) - math.log((all_[b] + 1) / n) for b in grams(r.text)) for r in docs}
    got = quality.op1_importance_resampling(spark, SF).toPandas().set_index("doc_id")
    assert all(got.loc[i, "log_ratio"] == pytest.approx(v, abs=1e-6) for i, v in want.items())
    k = round(len(docs) * len(good) / len(labels["doc_id"].unique()))
    assert set(got.sort_values("gumbel_key", ascending=False).index[:k]) == set(got.index[got["kept"]])
    noise = got["gumbel_key"] - got["log_ratio"]
    assert abs(noise.mean() - 0.5772) < 0.3 and 0.9 < noise.std() < 1.7  # Gumbel's mean and deviation


def test_aliases_against_sql(spark):
    """Chains, cycles, a hub and pages of their own: components and verdicts as DuckDB finds them."""
    rng = random.Random(8)
    urls_ = [f"http://{rng.choice(['a.org', 'n.net', 'x.com', 'b.example.com', 'www.example.com'])}/{rng.choice(['en', 'es', 'fr', 'q'])}/{i}" for i in range(240)]
    links = [(i, i + 1) for i in range(0, 40)] + [(i, 41 + (i - 41 + 1) % 20) for i in range(41, 61)] + [(i, 61) for i in range(62, 120)] + [(rng.randrange(120, 240), rng.randrange(120, 240)) for _ in range(40)]
    html = {}
    for k, (a, b) in enumerate(links):
        html[a] = html.get(a, "") + (f'<link rel="canonical" href="{urls_[b]}">' if k % 2 else f'<meta http-equiv="refresh" content="0; url={urls_[b]}">')
    rows = [(i, u, html.get(i, "<p>")) for i, u in enumerate(urls_)]
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    # The oracle reads one link of a kind from a page; these pages have their links in one column each instead.
    con.register("links", pd.DataFrame([(urls_[a].split("://")[1], urls_[b].split("://")[1]) for a, b in links], columns=["a", "b"]))
    sql = registry.ORACLE_SQL["op5_redirect_equivalence"]
    sql = re.sub(r"named AS \(.*?\nsym AS \(SELECT a, b FROM edge", "edge AS (SELECT a, b FROM links),\nsym AS (SELECT a, b FROM edge", sql, flags=re.DOTALL)
    want = {r.page_id: (None if pd.isna(r.rule) else r.rule, r.verdict) for r in con.execute(sql).df().itertuples()}
    assert got == want and Counter(v for _, v in want.values())["block"] > 40 and any(r is None and v == "block" for r, v in want.values())
    edges = spark.createDataFrame([("http://p.org/1", "http://p.org/2"), ("http://p.org/2", "http://n.net/es/x"), (None, "http://p.org/3")], "a string, b string")
    some = spark.createDataFrame([(1, "http://p.org/1", None, "k"), (1, "http://p.org/1", None, "k"), (None, "http://p.org/3", None, "k"), (4, None, "<link rel=canonical href=http://n.net/es/x>", "k")], "page_id long, url string, html string, node string")
    assert Counter((r.page_id, r.verdict) for r in urls.judge(some, edges=edges).collect()) == Counter([(1, "block"), (1, "block"), (None, "allow"), (4, "allow")])
    assert urls.judge(some.limit(0)).count() == 0


def test_lm(spark, odd):
    got = lm.op3_attention(spark, SF).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")["text"]
    words = {i: [*re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower()), None] for i, t in docs.items()}
    c = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in words.items():
        assert got.loc[i, "n_tokens"] == len(ws) and got.loc[i, "n_known"] == sum(c[w] > 0 for w in ws) and got.loc[i, "train_tokens"] == n
        assert got.loc[i, "base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
    assert (got["score"] < 0).all()
    assert lm.score_documents(odd).count() == 9


def test_attention_gradients():
    rng = np.random.default_rng(0)
    model = lm.Attention()
    model.w = {k: rng.standard_normal(a.shape) * 0.2 for k, a in model.w.items()}
    n, s = 3, lm.STRIDE
    args = (rng.integers(0, lm.CLASSES, (n, 2 * s)), np.ones((n, 2 * s), bool), rng.standard_normal((n, s, lm.CLASSES)), rng.integers(0, lm.CLASSES, (n, s)), np.ones((n, s)))
    _, g = model.grads(*args)
    for k in model.w:
        at = (1, 2)
        model.w[k][at] += 1e-4
        up = model.grads(*args)[0]
        model.w[k][at] -= 2e-4
        down = model.grads(*args)[0]
        model.w[k][at] += 1e-4
        assert (up - down) / 2e-4 == pytest.approx(g[k][at], rel=2e-2, abs=1e-5)


def test_attention_scores():
    rng = np.random.default_rng(1)
    n, s = 5, lm.STRIDE
    for size in (0.3, 8.0):  # the larger weights need rows shifted by their maximum
        model = lm.Attention()
        model.w = {k: (rng.standard_normal(a.shape) * size).astype(np.float32) for k, a in model.w.items()}
        live = np.ones((n, 2 * s), bool)
        live[0, :s] = False
        direct = np.log(rng.dirichlet(np.ones(lm.CLASSES), (n, s))).astype(np.float32)
        args = (rng.integers(0, lm.CLASSES, (n, 2 * s)), live, direct, rng.integers(0, lm.CLASSES, (n, s)))
        z, _ = model.forward(*args[:3])
        assert np.allclose(np.exp(z).sum(-1), 1, atol=1e-4)
        own, begin = model.log_probs(*args)
        assert np.allclose(own, np.take_along_axis(z, args[3][..., None], -1)[..., 0], atol=1e-3)
        assert np.allclose(np.exp(begin), np.exp(z)[..., : lm.FIRST + 1].sum(-1), atol=1e-3)


def test_lm_knows_context(spark):
    got = lm.op3_attention(spark, "/root/testdata/sf0.01").filter("not held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > got.b


def test_lm_learns_from_all_training_texts(spark, monkeypatch):
    rows = [(i, f"one two {'three ' * (i or 1)}unlikelyword{i}") for i in [*range(1, 40), None, None]]
    near, weights = [], []
    classify, load = lm.Tables.classify, lm.Attention.load
    monkeypatch.setattr(lm.Tables, "classify", lambda self, n: (near.append(n.copy()), classify(self, n))[1])
    monkeypatch.setattr(lm.Attention, "load", lambda self, w: (weights.append(w), load(self, w))[1])
    for some in (rows, rows[-2:]):
        near.clear(), weights.clear()
        assert lm.score_documents(spark.createDataFrame(some, "doc_id long, text string")).count() == len(some)
        want = 0
        for i, text in some:
            if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2:
                n = sum(len(lm.subwords(w)) for w in lm.tokens(text))
                want += sum(max(0, n - d) for d in range(1, lm.NEAR + 1))
        assert near[0].sum() == want
        assert len(weights) == lm.ROUNDS and np.abs(weights[-1][-lm.WIDTH * lm.CLASSES :]).max() > 0


def test_lm_scores_do_not_depend_on_files(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    a, b = (lm.score_documents(docs.repartition(n, "text")).toPandas().set_index("doc_id")["score"].sort_index() for n in (1, 7))
    assert np.allclose(a, b, rtol=1e-5)


def test_lm_neither_writes_nor_shuffles_texts(spark, monkeypatch):
    """Texts are cut once and go on as numbers; in how many chunks makes no difference."""
    written = []
    monkeypatch.setattr(lm, "materialise", lambda df, keep=lm.materialise: written.append(df.columns) or keep(df))
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    whole = lm.score_documents(docs)
    assert written and not any("text" in columns for columns in written)
    assert "text" not in whole._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(lm, "CHUNK", 3_000)
    monkeypatch.setattr(lm, "BLOCK", 64 << 20)  # as one block, as before
    a, b = (x.toPandas().set_index("doc_id").sort_index() for x in (whole, lm.score_documents(docs)))
    assert np.allclose(a["score"], b["score"], rtol=1e-5) and np.allclose(a["base_score"], b["base_score"]) and a["n_known"].equals(b["n_known"])


def test_lm_cuts_many_words_as_one():
    words = [b"the", b"|", b"x" * 700, "Éméntàment".encode(), b"\xff\xfe", "\u3000\u00a0\u2028".encode(), b"!!\x00\x1c", "\U0001f600".encode()]
    for some in (words, [w for w in words if w != b"\xff\xfe"], []):
        pieces, cuts = lm.cut(some)
        assert pieces.tolist() == [i for w in some for i in lm.subwords(w)] and cuts.tolist() == [len(lm.subwords(w)) for w in some]


def test_lm_probabilities_sum_to_one():
    """At one place, over whole words, spelt words and the end, by the parts that the score is made of: the mass of all that may come first is 1."""
    rng = np.random.default_rng(3)
    model = lm.Attention()
    model.w = {k: (rng.standard_normal(a.shape) * 0.3).astype(np.float32) for k, a in model.w.items()}
    n, s = 2, lm.STRIDE
    args = (rng.integers(0, lm.CLASSES, (n, 2 * s)), np.ones((n, 2 * s), bool), np.log(rng.dirichlet(np.ones(lm.CLASSES), (n, s))).astype(np.float32))
    total = 0.0
    for c in range(lm.FIRST + 1):
        own, begin = model.log_probs(*args, np.full((n, s), c))
        total = total + np.exp(own - begin)
    assert np.allclose(total, 1, atol=1e-3)


def test_empty_tables(odd, labels):
    none, no_labels = odd.limit(0), labels.limit(0)
    for df in (sharding.shard_by_bytes(none), exact_dedup.content_sort(none), mixing.fair_queue(none), simhash.near_groups(none), toxicity.toxicity(none, no_labels), encoding.encode_documents(none), quality.importance(none, no_labels), lm.score_documents(none)):
        assert df.count() == 0


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    left = docs.toPandas()
    left = left[[model.score(t) < toxicity.THRESHOLD for t in left["text"]]].sort_values("doc_id")
    left = left[~left["text"].fillna("").map(lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t)).duplicated()].reset_index(drop=True)
    root = pd.Series(_components([simhash.fingerprint(t) for t in left["text"]]))
    left = left[left["doc_id"] == left["doc_id"].groupby(root).transform("min")]
    con = duckdb.connect()
    con.register("documents", left)
    mixed = con.execute(registry.ORACLE_SQL["op8_fair_queue"]).df()
    words = dict(zip(mixed["doc_id"], zip(mixed["size"], mixed["taken"], strict=True), strict=True))
    pieces, text = encoding.load(), dict(zip(left["doc_id"], left["text"], strict=True))
    rows = corpus_pipeline.run(spark, SF).collect()
    taken = Counter(r.doc_id for r in rows)
    assert all(taken[i] == (t // n if n else taken[i]) for i, (n, t) in words.items()) and set(taken) <= set(words)
    assert all(r.ids == pieces.encode(text[r.doc_id]) and r.decoded_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in rows)


def test_pipeline_stages_on_empty_and_odd_rows(spark, odd, labels, tmp_path):
    for name, rows in (("none", odd.limit(0)), ("odd", odd)):
        at = str(tmp_path / name)
        rows.write.parquet(f"{at}/documents.parquet")
        labels.write.parquet(f"{at}/labels.parquet")
        left = rows
        for stage, f in corpus_pipeline.STAGES:
            left = f(spark, left, at)
            assert stage == "encoding" or left.columns == rows.columns
        assert corpus_pipeline.run(spark, at).count() == left.count() and (left.count() > 0) == (name == "odd")


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SF)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = out.collect()
    assert 0 < len(rows) and max(Counter(r.doc_id for r in rows).values()) <= 2
    assert all(r.decoded_crc32 == zlib.crc32(docs[r.doc_id].encode()) for r in rows)
