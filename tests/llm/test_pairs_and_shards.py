"""Near-duplicates, vectors, search, shards, licenses, and the pipeline."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entries
from tablewright.llm import embeddings, graph, kdtree, licenses, maxscore, queries, setsketch, words
from tests.llm.test_text_models import words as plain_words


def rooted(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_sets(texts):
    out = {}
    for i, t in texts.items():
        w = plain_words(t)
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def brute_near(texts):
    sets, inverse, links = shingle_sets(texts), defaultdict(list), []
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in inverse[s])
        links += [(i, j) for j, c in shared.items() if 100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c)]
        for s in sets[i]:
            inverse[s].append(i)
    return sets, rooted(links, sets)


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 300)] + [(400, 400), (None, 3), (500, 501), (501, 500)]
    edges += [(rng.randint(600, 900), rng.randint(600, 900)) for _ in range(200)]
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert found == rooted(real, {x for e in real for x in e})
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingles_of_batches_equal_plain_ones():
    import pyarrow as pa

    texts = [None, "", "a b c d e f", "A  b\tc d\ne F", "x", "longwordlongwordlongword other longwordlongwordlongword a b c", "y z"]
    found = words.text_shingles(pa.array(texts), 5)
    plain = shingle_sets(dict(enumerate(texts)))
    assert [len(f) for f in found] == [len(plain[i]) for i in range(len(texts))]
    assert (found[2] == found[3]).all() and not set(found[4].tolist()) & set(found[6].tolist())


def test_sketches_merge_and_estimate_similarity():
    rng = np.random.default_rng(3)
    plan = setsketch.SketchPlan()
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = pool[:2000], pool[500:2500]
    ra, rb, both = setsketch.sketch([a, b, pool[:2500]], plan.registers, plan.base)
    assert (setsketch.merge(ra, rb) == both).all()
    grid = np.linspace(0.01, 0.99, 99)
    fit = setsketch.log_likelihoods((ra > rb).sum(), (ra < rb).sum(), 2000.0, 2000.0, plan.registers, plan.base, grid)
    assert grid[fit.argmax()] == pytest.approx(0.6, abs=0.1)


def near_copies(rng, n_groups=12, size=25):
    out = []
    for _ in range(n_groups):
        base = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(rng.randint(6, 120))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 20))):
                copy[rng.randrange(len(copy))] = "new%d" % rng.randrange(10_000)
            out.append(" ".join(copy))
    return out


def test_near_duplicates_equal_brute_force(docs):
    rng = random.Random(7)
    texts = near_copies(rng) + [None, "", " \n", "one two", "one two", "ONE  two", "x " * 5000] + ["hot copy of one text here"] * 150
    frame = docs(*texts)
    for plan in (setsketch.SketchPlan(), setsketch.SketchPlan(block=16)):
        out = {r.doc_id: r for r in setsketch.near_duplicates(frame, plan).collect()}
        sets, component = brute_near(dict(enumerate(texts)))
        assert {i: r.component_id for i, r in out.items()} == component
        assert all(out[i].n_shingles == len(sets[i]) and out[i].kept == (component[i] == i) for i in out)
    assert setsketch.near_duplicates(frame.limit(0)).count() == 0


def test_near_duplicates_with_null_and_repeated_ids(docs):
    copies = " ".join(f"w{k}" for k in range(60))
    rows = [
        (None, "a text of its own without any id"), (None, copies), (5, copies + " end"), (5, "another text that shares the id five"),
        (7, "two rows equal in all they hold"), (7, "two rows equal in all they hold"), (None, None), (None, ""), (9, ""),
        (None, "only rows without an id hold this"), (None, "only rows without an id hold this"),
    ]
    out = setsketch.near_duplicates(docs(*[t for _, t in rows], ids=[i for i, _ in rows])).collect()
    found = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out)
    assert found == Counter([
        (None, 4, None, True), (None, 56, 5, False), (5, 57, 5, True), (5, 3, 5, True), (7, 3, 7, True), (7, 3, 7, False),
        (None, 0, None, True), (None, 0, None, True), (9, 0, 9, True), (None, 3, None, True), (None, 3, None, False),
    ])


def test_no_copies_stage_keeps_rows_with_null_and_repeated_ids(spark):
    import corpus_pipeline as p

    texts = ["one text of its own without id", "first of two texts with one id", "second and other text of that id", "second and other text of that id"]
    rows = [(i, t, "en", "s", len(t)) for i, t in zip((None, 3, 3, 4), texts, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = p.drop_copies(spark, docs, "")
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=repr) == sorted(rows[:3], key=repr)


def test_near_duplicates_of_the_sample(sample):
    texts = {r.doc_id: r.text for r in sample.select("doc_id", "text").collect()}
    found = {r.doc_id: r.component_id for r in setsketch.near_duplicates(sample).collect()}
    assert found == brute_near(texts)[1]


VECTORS = "vec_id long, embedding array<float>, label int, x long, rep long"


def vector_frame(spark, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, 16))
    rows = [base[i % 40] + rng.normal(size=16) * (0.12 if i % 3 else 0.0) for i in range(240)]
    rows = [r.astype(np.float32).tolist() for r in rows]
    rows += [None, [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [], [3.0], [9.0]]
    return rows, spark.createDataFrame([(i, r, 1, 2, 3) for i, r in enumerate(rows)], VECTORS)


def usable(rows):
    return {i: np.array(r, float) for i, r in enumerate(rows) if r and all(x is not None and np.isfinite(x) for x in r)}


def test_vector_links_equal_brute_force(spark):
    rows, frame = vector_frame(spark)
    good = {i: np.pad(v, (0, 16 - len(v))) for i, v in usable(rows).items() if np.any(v)}
    cosine = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    links = [(i, j) for i in good for j in good if i < j and cosine(good[i], good[j]) >= 0.95]
    degree, component = Counter(x for link in links for x in link), rooted(links, range(len(rows)))
    for plan in (embeddings.LinkPlan(), embeddings.LinkPlan(block=16, pivots=4, chunk=5)):
        out = {r.vec_id: r for r in embeddings.links(frame, plan).collect()}
        assert {i: r.n_links for i, r in out.items()} == {i: degree[i] for i in range(len(rows))}
        assert {i: r.component_id for i, r in out.items()} == component
        assert all(r.kept == (r.component_id == r.vec_id) for r in out.values())
    assert embeddings.links(frame.limit(0)).count() == 0


def test_vector_links_with_null_and_repeated_ids(spark):
    rows = [(None, [1.0, 0.0]), (None, [0.0, 1.0]), (1, [1.0, 0.01]), (1, [-1.0, 0.0]), (2, [0.01, 1.0]), (3, [0.0, -1.0]), (None, None), (None, [-1.0, 1.0]), (1, [0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = embeddings.links(frame).collect()
    assert sorted((tuple(r) for r in out), key=repr) == sorted(
        [(None, 1, 1, False), (1, 1, 1, True), (None, 1, 2, False), (2, 1, 2, True), (1, 0, 1, True), (3, 0, 3, True), (None, 0, None, True), (None, 0, None, True), (1, 0, 1, True)], key=repr
    )


def test_search_with_null_and_repeated_ids(spark):
    rows = [(None, [3.0, 0.0]), (20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [3.0, 0.0]), (1, [0.0, 2.0]), (None, None), (40, [None, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for plan in (maxscore.SearchPlan(), maxscore.SearchPlan(k=20, chunk=2, shard=2, query_block=1)):
        out = [tuple(r) for r in maxscore.search(frame, F.col("vec_id") % 20 == 0, plan).collect()]
        first, second = 64 * 64 * 3, 64 * 64 * 2
        wanted = [(20, 1, 1, first), (20, 2, None, first), (20, 3, 1, 0), (20, 4, 20, 0), (20, 1, 1, second), (20, 2, 1, 0), (20, 3, 20, 0), (20, 4, None, 0)]
        assert sorted(out, key=repr) == sorted(wanted, key=repr)


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 40)) * np.exp(rng.normal(size=(300, 40)))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, s, e = embeddings.quantize(x)
    exact, rough = x @ x.T, (q.astype(int) @ q.T.astype(int)) * np.outer(s, s)
    bound = e[:, None] * (1 + e[None, :]) + e[None, :] * (1 + e[:, None]) + np.outer(e, e)
    assert (np.abs(exact - rough) <= bound).all()


def test_search_equals_brute_force(spark):
    rows, frame = vector_frame(spark)
    scaled = {i: np.floor(64 * np.pad(np.array(v, np.float32).astype(float), (0, 16 - len(v)))).astype(int) for i, v in usable(rows).items()}
    for plan in (maxscore.SearchPlan(), maxscore.SearchPlan(k=7, shard=40, query_block=5, chunk=8, probe=3)):
        got = defaultdict(list)
        for r in maxscore.search(frame, F.col("vec_id") % 20 == 0, plan).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r["rank"], r.vec_id, r.score))
        for q in [i for i in scaled if i % 20 == 0]:
            best = sorted((-int(scaled[q] @ v), i) for i, v in scaled.items() if i != q)[: plan.k]
            assert got.pop(q) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
        assert not got
    few = maxscore.search(frame.where("vec_id in (0, 5, 7)"), F.col("vec_id") == 0).collect()
    assert [r["rank"] for r in few] == [1, 2]
    assert maxscore.search(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_shards_are_equal_and_gapless(spark, docs):
    rng = random.Random(8)
    texts = ["w" * rng.randint(0, 300) for _ in range(3000)] + ["the same text"] * 1500 + [None, ""]
    frame = docs(*texts).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("doc_id") % 50)))
    dimensions = {"length": kdtree.magnitude(F.octet_length("text")), "source": kdtree.category("source"), "lang": kdtree.category("lang")}
    out = kdtree.shard(frame, dimensions).toPandas()
    assert sorted(out.doc_id) == list(range(len(texts)))
    for r in out.itertuples():
        raw = (texts[r.doc_id] or "").encode()
        assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw)
    bytes_of = out.groupby("shard")["size"].sum()
    assert sorted(bytes_of.index) == list(range(40)) and bytes_of.max() - bytes_of.min() <= 0.05 * bytes_of.mean() + 316
    for _, s in out.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    assert set(out.law) == {"bytes"} and out.grown_shard.isna().all()
    assert kdtree.shard(frame.limit(0), dimensions).count() == 0
    assert kdtree.shard(frame.limit(3), dimensions).count() == 3


def test_slots_are_gapless_with_null_and_repeated_ids(docs):
    rng = random.Random(9)
    texts = ["w" * rng.randint(0, 300) for _ in range(400)]
    ids = [None if k % 3 == 0 else k // 4 for k in range(400)]
    dimensions = {"length": kdtree.magnitude(F.octet_length("text"))}
    out = kdtree.shard(docs(*texts, ids=ids), dimensions, kdtree.TreePlan(shards=2)).toPandas()
    bytes_of = out.groupby("shard")["size"].sum()
    assert len(out) == 400 and len(bytes_of) == 2 and bytes_of.max() - bytes_of.min() <= 0.05 * bytes_of.mean() + 316
    for _, s in out.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))


def test_license_notices(docs):
    mit, apache = dict(licenses.TEMPLATES)["MIT"], dict(licenses.TEMPLATES)["Apache-2.0-line"]
    changed = mit.replace("sublicense", "relicense").upper()
    texts = [None, "", "mit", mit, "x " * 500 + changed + " y" * 300, f"a\n{apache}\nb", "licensed*** under### the&&& Apache!! License, Version 2.0", mit[: len(mit) // 3], "word " * 60_000]
    out = {(r.doc_id, r.license): r for r in licenses.scan(docs(*texts)).collect()}
    assert set(out) == {(3, "MIT"), (4, "MIT"), (5, "Apache-2.0-line"), (6, "Apache-2.0-line")}
    assert out[3, "MIT"].containment == 1 and out[3, "MIT"].start_word == 0
    assert 0.75 <= out[4, "MIT"].containment < 1 and out[4, "MIT"].start_word == 500
    assert licenses.scan(docs()).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, small, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    found, wanted = entries.queries()[name](spark, small).toPandas(), con.execute(queries.ORACLES[name]).df()
    rows = lambda df: sorted(map(tuple, df[sorted(df.columns)].values.tolist()))
    assert sorted(found.columns) == sorted(wanted.columns) and rows(found) == rows(wanted)


def test_native_operators_run_no_python(spark, small, plan_text):
    for name in ("op4_kd_tree_shards", "op7_license_scan"):
        assert not any(w in plan_text(entries.queries()[name](spark, small)) for w in ("Python", "Pandas", "Arrow"))


def test_every_operator_is_registered():
    names = [n for n in entries.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entries.queries()


def test_pipeline_stages(spark, small):
    import corpus_pipeline as p
    from tablewright.llm import packing, pii, toxicity

    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    clean = p.drop_toxic(spark, docs, small)
    model = toxicity.fit(docs, labels, F.lit(True))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert set(texts) == {i for i, s in scores.items() if s < p.TOXIC}
    single = p.drop_copies(spark, clean, small)
    component = brute_near(texts)[1]
    kept = {r.doc_id: r.text for r in single.collect()}
    assert set(kept) == {i for i, c in component.items() if i == c}
    hidden = {r.doc_id: r for r in p.hide_personal_data(spark, single, small).collect()}
    learnt = pii.fit(single)
    for i, text in kept.items():
        base = pii.base_spans(text)
        assert hidden[i].text == pii.redacted(text, base + pii.added_spans(text, base, learnt)) and hidden[i].n_chars == len(hidden[i].text)
    assert all(stage(spark, docs, small).columns == docs.columns for _, stage in p.STAGES[:-1])
    pieces = p.run(spark, small).toPandas()
    assert set(pieces.doc_id) == set(kept)
    again = packing.pack_documents(spark.createDataFrame([(i, r.text) for i, r in hidden.items()], "doc_id long, text string"), queries.public_tokenizers.path("byte_bpe_50k.json")).toPandas()
    assert pieces.groupby("doc_id").length.sum().to_dict() == again.groupby("doc_id").length.sum().to_dict()
