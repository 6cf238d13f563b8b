"""Operators for training data against brute force, exact round trips, and awkward rows."""

import itertools
import random
import re
import time
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import canonical, chunking, clusters, leakage, near_dup, neighbours, pii, ranking, tokenise, vectors
from loomgraph.llm.pii_model import TAGS, Tagger, _lstm, fresh, gradient

WORD = re.compile(r"[^\W_]+")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---------- near duplicates
def test_registers_merge():
    r = np.random.default_rng(0)
    a, b = (r.integers(-(2**62), 2**62, n) for n in (40, 70))
    ra, rb, both = near_dup.registers(np.concatenate([a, b, np.union1d(a, b)]), np.array([0, 40, 110, 110 + len(np.union1d(a, b))]))
    assert (np.maximum(ra, rb) == both).all()


def test_estimate_follows_similarity():
    r = np.random.default_rng(1)
    for j in (0.3, 0.6, 0.9):
        n, k = 200, round(2 * 200 * j / (1 + j))
        common, x, y = r.integers(0, 2**62, k), r.integers(0, 2**62, n - k), r.integers(0, 2**62, n - k)
        regs = near_dup.registers(np.concatenate([common, x, common, y]), np.array([0, n, 2 * n]), 1000)
        e = near_dup.estimate(regs[:1], regs[1:], np.array([n]), np.array([n]))[0]
        assert abs(e - k / (2 * n - k)) < 0.06


def test_near_duplicate_pairs(spark):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(60):
        t = r.sample(vocab, 40)
        texts.append(" ".join(t))
        for _ in range(r.randrange(4)):
            u = t[:]
            for _ in range(r.randrange(9)):
                u[r.randrange(len(u))] = r.choice(vocab)
            r.shuffle(u)
            texts.append(" ".join(u).upper())
    texts += [texts[0]] * 5 + ["short note"] * 4 + [None, "", "   "]
    data = list(enumerate(texts)) + [(0, texts[0]), (None, texts[1])]
    sets = {i: frozenset(WORD.findall(t.lower())) for i, t in enumerate(texts) if t and len(set(WORD.findall(t.lower()))) >= 20}
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(sorted(sets.items()), 2) if len(x & y) / len(x | y) >= 0.7}
    df = spark.createDataFrame(data, "id bigint, t string").withColumn("words", F.lit("clash")).withColumn("cls", F.lit(1))
    got = rows(near_dup.near_duplicate_pairs(df, "id", F.col("t")))
    assert len(got) == len(set(got)) and set(got) == want
    g = {r.id: r for r in near_dup.near_duplicate_groups(df, "id", F.col("t")).collect()}
    assert set(g) == set(sets) and all(g[a].grp == g[b].grp for a, b in want)
    assert rows(near_dup.near_duplicate_pairs(df.limit(0), "id", F.col("t"))) == []


# ---------- pieces
def brute_pieces(t, limit=512, least=256, overlap=50):
    ws, out, s = " \t\n\r", [], 0
    rules = (lambda e: t[:e].endswith("\n\n") or t[:e].endswith("\n\r\n"), lambda e: (t[e - 2] in ".!?" and t[e - 1] in ws) or t[e - 1] in "。！？", lambda e: t[e - 1] in ws)
    while len(t) - s > limit:
        e = next((x for f in rules for x in range(s + limit, s + least, -1) if f(x)), s + limit)
        out.append((s, e))
        s = e - overlap
    return [*out, (s, len(t))]


def test_near_duplicates_by_some_bands_at_a_time(spark, monkeypatch):
    """Ten bands a shuffle: the pairs, groups and counts of all at once."""
    rng = np.random.default_rng(5)
    base = [[f"w{j}" for j in rng.integers(0, 5000, 60)] for _ in range(30)]
    texts = [(i, " ".join(base[i % 30][i // 30 * 2 :] + [f"x{i}"])) for i in range(150)]
    df = spark.createDataFrame(texts, "id bigint, t string")
    run = lambda f: rows(f(df, "id", F.col("t")))
    want = [run(f) for f in (near_dup.near_duplicate_pairs, near_dup.near_duplicate_groups)]
    monkeypatch.setattr(near_dup, "BAND_ROWS", 1)
    assert len(want[0]) > 200 and [run(f) for f in (near_dup.near_duplicate_pairs, near_dup.near_duplicate_groups)] == want


def test_near_duplicates_broadcast_nothing_by_estimate(spark, tmp_path):
    """The lists of bands are far larger than Spark's estimate, so a broadcast side would have to fit the driver at any size."""
    df = spark.createDataFrame([(i, " ".join(f"w{i % 7}x{j}" for j in range(30))) for i in range(40)], "id bigint, t string")
    df.write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    for f in (near_dup.near_duplicate_pairs, near_dup.near_duplicate_groups):
        plan = f(df, "id", F.col("t"))._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_pieces(spark):
    r = random.Random(5)
    texts = ["".join(r.choice("abc  .!?\n\r\t。é😀") for _ in range(r.randrange(500, 4000))) for _ in range(40)] + ["x" * 3000, "x" * 512, "y" * 513, "", None, "\n\r\n" * 400, "a. " * 50_000]
    want = [(i, *p) for i, t in enumerate(texts) if t and len(t) > 512 for p in brute_pieces(t)]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string").withColumn("start_at", F.lit(9))
    assert rows(chunking.split_texts(df, "id", "t")) == sorted(want)
    for x in chunking.split_texts(df, "id", "t", with_text=True).collect():
        assert x.piece == texts[x.id][x.start_at : x.end_at]
    assert chunking.split_texts(df.limit(0), "id", "t").collect() == []


def test_pieces_by_units():
    sums = np.concatenate([[0], np.cumsum([3, 900, 2, 2, 2])])
    got = chunking.pieces(sums, [np.array([1, 3])], 6, 1, 2)
    assert got[-1][1] == 5 and all(b > a for a, b in got)


# ---------- vectors
def cloud(seed=2, groups=12, n=40, noise=150):
    r = np.random.default_rng(seed)
    c = r.standard_normal((groups, 64))
    x = np.concatenate([k + r.standard_normal((n, 64)) * 0.25 * r.uniform(0.3, 1.4) for k in c] + [r.standard_normal((noise, 64))])
    return (x * r.uniform(0.01, 50, (len(x), 1))).astype(np.float32)


def vector_table(spark, x, extra=()):
    data = [(i, [float(f) for f in v], 1) for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(data, "vec_id bigint, embedding array<float>, updated_at int")


BAD = [(9001, None, 1), (9002, [], 1), (9003, [0.0] * 64, 1), (9004, [1.0] * 63, 1), (9005, [float("nan")] + [1.0] * 63, 1), (9006, [float("inf")] + [1.0] * 63, 1), (None, [1.0] * 64, 1), (9007, [None] + [1.0] * 63, 1)]


def brute_clusters(x, t=0.8, least=5):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T >= t
    seen, out = set(), {}
    for i in range(len(x)):
        if i not in seen:
            comp, todo = {i}, [i]
            while todo:
                for j in np.flatnonzero(s[todo.pop()]):
                    if int(j) not in comp:
                        comp.add(int(j))
                        todo.append(int(j))
            seen |= comp
            if len(comp) >= least:
                out |= dict.fromkeys(comp, min(comp))
    return out


@pytest.mark.parametrize("block", [8192, 64])
def test_clusters(spark, block):
    x = cloud()
    x[5] = x[3]
    v = vectors.usable(vector_table(spark, x, [*BAD, (0, [float(f) for f in x[0]], 2)]))
    assert v.count() == len(x)
    got = {r.id: r.cluster_id for r in clusters.vector_clusters(v, block=block).collect()}
    assert got == brute_clusters(x)


def test_bands_some_at_a_time(spark, monkeypatch):
    """With few rows at once there are several tables of bands; they have the same keys and give the same clusters and degrees."""
    r = np.random.default_rng(12)
    x = np.concatenate([r.normal(size=(1, 64)) + r.normal(0, 0.35, (n, 64)) for n in (40, 25, 9, 6, 5, 4)] + [r.normal(size=(200, 64))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<float>")
    told = lambda: {(y.id, y.cluster_id, y.part_id, y.size) for y in clusters.described_clusters(df, tight=0.9).collect()}
    keys = lambda: {y.id: y["keys"] for y in clusters.banded(df, 0.8)[0].collect()}
    whole, all_keys = told(), keys()
    monkeypatch.setattr(clusters, "AT_ONCE", 1)
    parts = [{y.id: y["keys"] for y in p.collect()} for p in clusters.banded(df, 0.8)]
    assert len(parts) > 1 and all(len(k) <= 3 for p in parts for k in p.values())
    assert {i: [k for p in parts for k in p[i]] for i in all_keys} == all_keys
    assert len(whole) > 80 and told() == whole


def test_links_near_the_threshold(spark):
    """Pairs that bytes can't decide are settled on the vectors; sets of random vectors have the similarity that sizes the bands."""
    r = np.random.default_rng(4)
    rows, want = [], set()
    for k in range(400):
        x, z = r.standard_normal((2, 64))
        x /= np.linalg.norm(x)
        z -= (z @ x) * x
        z /= np.linalg.norm(z)
        c = 0.8 + (k % 41 - 20) * 2e-4
        y = c * x + np.sqrt(1 - c * c) * z
        rows += [x * 3, y * 0.5]
        a, b = (np.float32(v).astype(float) for v in rows[-2:])
        if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.8:
            want.add(2 * k)
    v = vectors.usable(vector_table(spark, np.array(rows)))
    got = {r.id - r.id % 2 for r in clusters.vector_clusters(v, least=2).collect()}
    assert got <= want and len(want - got) <= 0.05 * len(want)
    x, z = r.standard_normal((2, 3000, 64)).astype(np.float32)
    c = clusters.cells(x, 7)
    near = clusters.cells(np.float32(0.8) * x + np.float32(0.6) * z, 7)
    assert abs((c == clusters.cells(z, 7)).mean() - 1 / 8) < 0.01 and abs((c == near).mean() - clusters.common(0.8)) < 0.03
    m = clusters.minhashes(np.concatenate([c, near]), 40, 7)
    both = (c == near).sum(1)
    assert abs((m[:3000] == m[3000:]).mean() - (both / (2 * clusters.SETS - both)).mean()) < 0.02


def test_described_clusters(spark):
    v = vectors.usable(vector_table(spark, cloud(4, 4, 30, 20)))
    got = clusters.described_clusters(v, tight=0.9).collect()
    assert {r.id for r in got} == {r.id for r in clusters.vector_clusters(v).collect()}
    for part in {r.part_id for r in got}:
        own = [r for r in got if r.part_id == part]
        assert own[0].size == len(own) and sorted(r.typical_rank for r in own if r.typical_rank) == list(range(1, min(3, len(own)) + 1))
        top = max(own, key=lambda r: r.typical)
        assert next(r for r in own if r.typical_rank == 1).typical == top.typical
    assert clusters.vector_clusters(v.limit(0)).collect() == []


def test_encode_improves_with_beam():
    x = vectors.unit(cloud().astype(float)).astype(np.float32)
    ix = neighbours.fit(x, 4, 4)

    def error(beam):
        codes, _ = neighbours.encode(x, ix.books, beam)
        return ((x - sum(ix.books[j][codes[:, j]] for j in range(4))) ** 2).sum()

    assert error(4) <= error(1) * 1.001
    codes, length = neighbours.encode(x, ix.books)
    assert np.allclose(length, np.linalg.norm(sum(ix.books[j][codes[:, j]] for j in range(4)), axis=1), atol=1e-4)


@pytest.mark.parametrize("kw", [{}, {"cell_rows": 100, "block": 50}])
def test_neighbours_recall(spark, kw):
    x = cloud(7, 20, 50, 300)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {i: set(np.argsort(-s[i])[:5].tolist()) for i in range(len(x))}
    got = neighbours.nearest_vectors(vectors.usable(vector_table(spark, x, BAD)), 5, **kw).collect()
    assert all(abs(r.similarity - s[r.id, r.other]) < 1e-6 for r in got)
    recall = sum(r.other in want[r.id] for r in got) / (5 * len(x))
    assert recall >= 0.95 and max(r["rank"] for r in got) == 5
    few = neighbours.nearest_vectors(vectors.usable(vector_table(spark, x[:1])), 5)
    assert few.collect() == [] and neighbours.nearest_vectors(vectors.usable(vector_table(spark, x[:3])), 5).count() == 6


def test_cells_out_of_reach_are_left_out():
    """With a least cosine a query leaves out cells, and never one that holds a vector of that cosine."""
    r = np.random.default_rng(8)
    base = r.normal(size=(300, 16))
    x = np.concatenate([base + r.normal(0, s, base.shape) for s in (0, 0.02, 0.05, 0.1, 0.2)])
    u = vectors.unit(x).astype(np.float32)
    centres = neighbours.fit(u, 40, 1).centres
    near = u @ centres.T - 0.5 * (centres * centres).sum(1)
    top, cos, held = np.tile(np.arange(40), (len(u), 1)), u.astype(np.float64) @ u.T.astype(np.float64), near.argmax(1)
    for least in (0.9, 0.98):
        use = neighbours.within_reach(u, near, top, centres, least)
        a, b = np.nonzero(cos >= least)
        assert len(a) > 2 * len(u) and use[a, held[b]].all() and use.mean() < 0.5


def test_neighbours_recall_with_many_cells(spark):
    """Ten thousand rows in 625 cells: the cells that a query visits must grow with their number."""
    r = np.random.default_rng(3)
    x = (r.standard_normal((10_000, 12)) @ r.standard_normal((12, 64))).astype(np.float32)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    asked = range(0, len(x), 20)
    s = u[asked] @ u.T
    s[np.arange(len(s)), list(asked)] = -2
    want = {i: set(np.argsort(-row)[:5].tolist()) for i, row in zip(asked, s, strict=True)}
    got = neighbours.nearest_vectors(vectors.usable(vector_table(spark, x)), 5, queries="id % 20 = 0", cell_rows=16).collect()
    assert sum(g.other in want[g.id] for g in got) / (5 * len(want)) >= 0.9
    assert [neighbours.visited(c, 8) for c in (1, 119, 1200)] == [8, 8, 38]


# ---------- ranking
def brute_first(hits):
    for k, v in hits.items():
        if all(sum((a if a is not None else -1e300) > (b if b is not None else -1e300) for a, b in zip(v, w, strict=True)) >= 2 for m, w in hits.items() if m != k):
            return k
    return None


def hit_table(spark, seed=1):
    r = random.Random(seed)
    data, want = [], {}
    for q in range(120):
        base = 10 ** r.uniform(-2, 4)
        hits = {f"n{i}": tuple(None if r.random() < 0.15 else round(r.random() * base * c, 1 if base > 10 else 3) for c in (1, 100, 0.01)) for i in range(r.randrange(1, 9))}
        data += [(q, k, *v) for k, v in hits.items()]
        want[q] = brute_first(hits)
    return spark.createDataFrame(data, "query_id bigint, node_id string, vector_score double, bm25_score double, rrf_score double"), want


@pytest.mark.parametrize("hot", [50_000, 3])
def test_majority_firsts(spark, hot):
    df, want = hit_table(spark)
    got = {r.query_id: r.node_id for r in ranking.majority_firsts(ranking.fused_scores(df, hot=hot)).collect()}
    assert got == {q: n for q, n in want.items() if n is not None}


def test_fused_scores(spark):
    from statistics import NormalDist

    df, _ = hit_table(spark)
    a = {(r.query_id, r.node_id): r for r in ranking.fused_scores(df).collect()}
    b = {(r.query_id, r.node_id): r for r in ranking.fused_scores(df, hot=3).collect()}
    assert len(a) == df.count() and all(a[k].fused == pytest.approx(b[k].fused, abs=1e-9) for k in a)
    ps = spark.createDataFrame([(p,) for p in (1e-6, 0.01, 0.2, 0.5, 0.9, 0.999)], "p double")
    for r in ps.select("p", ranking.inverse_normal(F.col("p")).alias("z")).collect():
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), abs=1e-7)
    assert ranking.fused_scores(df.limit(0)).collect() == []
    one = ranking.fused_scores(spark.createDataFrame([(1, "a", 5.0, None, 1.0)], df.schema)).first()
    assert one.fused == 0


# ---------- personal information
def test_gradient():
    r = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in fresh(3).items()}
    p["trans"] = r.normal(0, 0.3, p["trans"].shape)
    x = r.integers(1, 100, (7, 3))
    x[5:, 1] = 0
    m, y = (x > 0).astype(float), r.integers(0, len(TAGS), (7, 3)) * (x > 0)
    _, g = gradient(p, x, y, m)
    for k, i in (("uf", (1, 2)), ("ub", (0, 5)), ("wo", (2, 1)), ("trans", (1, 0)), ("start", (2,)), ("wf", (x[2, 1], 3)), ("bb", (4,))):
        old = p[k][i]
        p[k][i] = old + 1e-3
        a, _ = gradient(p, x, y, m)
        p[k][i] = old - 1e-3
        b, _ = gradient(p, x, y, m)
        p[k][i] = old
        assert g[k][i] == pytest.approx((a - b) / 2e-3, rel=2e-2, abs=2e-3)


def tagger():
    with np.load(pii.WEIGHTS) as z:
        return Tagger({k: z[k] for k in z.files})


def test_held_out_accuracy():
    """On texts that the tagger wasn't fitted on (every eighth by checksum), by place and exact start."""
    import pyarrow.parquet as pq

    from loomgraph.llm.pii_labels import labelled
    from loomgraph.llm.pii_train import held_out

    hit = miss = extra = 0
    for t in ("memories", "chat_messages"):
        texts = [x for x in pq.read_table(f"/root/testdata/sf0.1/{t}.parquet", columns=["content"]).column(0).unique().to_pylist() if x and held_out(x)]
        for text, found in zip(texts, pii.places(tagger(), texts), strict=True):
            a, b = {(k, s) for k, s, _ in labelled(text)}, {(k, s) for k, s, _ in found}
            hit, miss, extra = hit + len(a & b), miss + len(a - b), extra + len(b - a)
    assert hit / (hit + miss) > 0.98 and hit / (hit + extra) > 0.98


def test_sentences_from_elsewhere():
    """Hand-written sentences whose names, streets and numbers aren't made of the tables' parts."""
    from loomgraph.llm.pii_phrases import measured

    texts = measured()
    hit = miss = extra = 0
    for (_, places), found in zip(texts, pii.places(tagger(), [t for t, _ in texts]), strict=True):
        a, b = {(k, s) for k, s, _ in places}, {(k, s) for k, s, _ in found}
        hit, miss, extra = hit + len(a & b), miss + len(a - b), extra + len(b - a)
    assert hit / (hit + miss) > 0.7 and hit / (hit + extra) > 0.75


def test_decoding_skips_only_what_is_outside():
    """Rows that aren't walked are those for which the full walk gives tag 0 throughout."""
    r = np.random.default_rng(2)
    t = tagger()
    e = r.normal(0, 2, (30, len(TAGS), 500)).astype(np.float32)
    e[:, 0] += r.choice([0, 2, 5, 9], 500)
    full = t._viterbi(e)
    assert (t.decode(e) == full).all() and 0 < len(t._open(e)) < 500


def test_emissions_pass_over_padding():
    """Emissions are those of the trained form, and steps in which a batch is nearly all padding cost little."""
    with np.load(pii.WEIGHTS) as z:
        p = {k: z[k] for k in z.files}
    r, t = np.random.default_rng(4), tagger()
    size = np.sort(r.integers(1, 61, 40))
    x = np.where(np.arange(60)[:, None] < size, r.integers(1, 102, (60, 40)), 0).astype(np.uint8)
    mask = (x > 0).astype(np.float32)
    h = np.concatenate([_lstm(x, mask, p["wf"], p["uf"], p["bf"])[0], _lstm(x[::-1], mask[::-1], p["wb"], p["ub"], p["bb"])[0][::-1]], 2)
    want = (h @ p["wo"] + p["bo"]).transpose(0, 2, 1)
    assert np.abs(t.emissions(x) - want)[np.broadcast_to(x[:, None] > 0, want.shape)].max() < 1e-3
    full = r.integers(1, 102, (288, 1024)).astype(np.uint8)
    few = full.copy()
    few[8:, :-1] = 0
    cost = []
    for y in (full, few):
        began = time.process_time()
        t.emissions(y)
        cost.append(time.process_time() - began)
    assert cost[1] < 0.5 * cost[0]


def test_windows_agree_with_whole(spark):
    """A place found in a short text is found at its offset in a very long one."""
    s = "Signed by Dr. Duvon Yarrandtin (driver's license D-4792-7870-K) for raitvled. cc <duvon.yarrandtin@drivilv.example> when done.\n"
    pad = "Every Project in caipoa must reach drezetr through KNOWS, unless gokor has replayed the centroid table. "
    one = pii.places(tagger(), [s])[0]
    assert {k for k, _, _ in one} == {"person", "idnum", "email"} and s[one[0][1] :].startswith("Duvon")
    long_ = pad * 700 + s + pad * 300
    assert [(k, a - len(pad) * 700) for k, a, _ in pii.places(tagger(), [long_])[0]] == [(k, a) for k, a, _ in one]
    df = spark.createDataFrame([("m", 1, s), ("m", 2, None), ("m", 3, ""), ("m", 4, " \n"), ("m", 5, "😀 ok")], "src string, record_id bigint, text string").withColumn("kind", F.lit("x"))
    got = {r.record_id: r.text for r in pii.redacted_texts(df).collect()}
    assert got[1].startswith("Signed by Dr. [PERSON] (driver's license [IDNUM]) for") and "[EMAIL]" in got[1]
    assert (got[2], got[3], got[4], got[5]) == (None, "", " \n", "😀 ok")
    assert pii.found_places(df.limit(0)).collect() == []


# ---------- token ids
def test_token_ids_and_back(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenise.VOCABULARY)
    t.encode_special_tokens = True
    r = random.Random(6)
    texts = ["Hello, world! it's <|endoftext|> 3.14\n\n  x", "", None, "日本語のテキスト。", "a b c　d \u0085 e", "  \n\t ", "naïve café — ünï", "👩‍👩‍👧 emoji", "x" * 20_000, " " * 50, "I'LL we'll 's"]
    texts += ["".join(r.choice("ab cé1_\n'!日 ​　") for _ in range(r.randrange(200))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("block", F.lit(1)).withColumn("ids", F.lit("x"))
    for size in (2_000_000, 500):
        ids = tokenise.token_ids(df, block_chars=size)
        got = {x.doc_id: x.ids for x in ids.collect()}
        assert got == {i: t.encode(s or "", add_special_tokens=False).ids for i, s in enumerate(texts)}
    assert {x.doc_id: x.text for x in tokenise.decoded_texts(ids).collect()} == {i: s or "" for i, s in enumerate(texts)}
    assert tokenise.token_ids(df.limit(0)).collect() == []


# ---------- leaks
def test_leaks(spark):
    r = random.Random(8)
    w = [f"t{i}" for i in range(40)]
    items = [(i, " ".join(r.choice(w) for _ in range(r.randrange(5, 60)))) for i in range(30)] + [(30, None), (31, ""), (32, "one two")]
    items.append((33, items[0][1]))
    docs = []
    for i in range(300):
        parts = [r.choice(w) for _ in range(r.randrange(40))]
        src = r.choice(items[:30])[1].split()
        a = r.randrange(len(src))
        docs.append((i, " ".join([*parts, *src[a : a + r.randrange(5, 30)], *parts[:5]]).title()))
    docs += [(300, None), (301, ""), (302, items[1][1].replace(" ", " ​")), (302, items[1][1])]
    grams = {}
    for i, p in items:
        q = leakage.words(p)
        for k in range(len(q) - 11):
            grams.setdefault(tuple(q[k : k + 12]), set()).add(i)
    want = {(d, i) for d, t in docs for q in [leakage.words(t)] for k in range(len(q) - 11) for i in grams.get(tuple(q[k : k + 12]), ())}
    d, e = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(5)), spark.createDataFrame(items, "item_id bigint, passage string")
    leaks = leakage.leaked_items(d, e)
    assert {(x.doc_id, x.item_id) for x in leaks.collect()} == want
    assert leakage.leaked_items(d, e.limit(0)).collect() == [] and leakage.leaked_items(d.limit(0), e).collect() == []
    assert {(x.doc_id, x.item_id) for x in leakage.leaked_items(d, e, shard_words=200).collect()} == want  # many shards, reduced corpus
    got = leakage.without_leaks(d, e, max_words=12).collect()
    assert sorted((x.doc_id for x in got), key=str) == sorted((i for i, _ in docs), key=str)
    hit = {i for i, _ in want}
    for x in got:
        assert (x.removed > 0) == ((x.doc_id, x.text) not in docs)
    assert {x.doc_id for x in got if x.removed} == hit
    assert leakage.without_leaks(d, e.limit(0)).filter("removed > 0").collect() == []


def test_cleaned():
    t = "Intro: " + " ".join(f"a{i}" for i in range(20)) + ", then İstanbul ﬁnal. " + "x " * 100
    assert leakage.cleaned(t, [1], [21], 20, 0.9) == (t.replace(" ".join(f"a{i}" for i in range(20)), ""), 20)
    assert leakage.cleaned(t, [1, 5], [13, 21], 20, 0.9)[1] == 20  # overlapping spans count once
    assert leakage.cleaned(t, [1], [13], 20, 0.9) == (t, 0)
    assert leakage.cleaned(t, [1], [13], 20, 0.01)[1] == 12
    cut_ = leakage.cleaned("İİ one two " + "three " * 3, [1], [3], 2, 0.5)
    assert cut_ == ("İİ  " + "three " * 3, 2)


def test_selected_runs():
    """Texts with twelve words in common share a run whatever stands around them."""
    r = random.Random(5)
    for _ in range(300):
        common = [str(r.randrange(50)) for _ in range(12)]
        a, b = ([str(r.randrange(50)) for _ in range(r.randrange(30))] + common + [str(r.randrange(50)) for _ in range(r.randrange(30))] for _ in range(2))
        assert set(leakage.selected_runs(a, 12)) & set(leakage.selected_runs(b, 12))
    assert len(leakage.selected_runs(["a"] * 11, 12)) == 0


def test_leaks_in_shards(spark):
    p = [" ".join(f"{c}{i}" for i in range(15)) for c in "abc"]
    d = spark.createDataFrame([(1, p[0] + " " + p[2]), (2, p[1])], "doc_id bigint, text string")
    got = leakage.leaked_items(d, spark.createDataFrame(list(enumerate(p)), "item_id bigint, passage string"), shard_words=20)
    assert sorted((x.doc_id, x.item_id, x.longest) for x in got.collect()) == [(1, 0, 15), (1, 2, 15), (2, 1, 15)]


# ---------- one form
def test_canonical_form():
    c = canonical.canonical
    same = [("ＡＢＣ　１", "ABC 1"), ("é", "é"), ("a​b﻿c­d", "abcd"), ("x y z", "x y z"), ("раура", "paypa"), ("ΑΒΕ", "ABE"), ("ё", "ё"), ("ё", "ë"), ("й", "й"), ("ｶﾞ", "ガ"), ("ﾎﾟ", "ポ"), ("が", "が"), ("e​́", "é"), ("한", "한")]
    for a, b in same:
        assert c(a) == c(b), (a, b)
    for a, b in [("a", "A"), ("e", "é"), ("a b", "ab"), ("a.", "a"), ("a\nb", "a b"), ("0", "O"), ("ﬁ", "fi"), ("ß", "ss"), ("и", "й"), ("👩‍👧", "👩👧")]:
        assert c(a) != c(b), (a, b)
    r = random.Random(2)
    pool = "aeо́̈​　Ａｶﾞёй и 한하e😀‍"
    for _ in range(2000):
        t = "".join(r.choice(pool) for _ in range(12))
        assert c(c(t)) == c(t) and unicodedata.is_normalized("NFC", c(t))


def test_table_has_no_conflict():
    assert canonical.checked() > 3000
    for a, b in [("Ꭺꓮ", "AA"), ("օⲣ", "op"), ("а́", "á"), ("ো", "ো"), ("ｶﾞﾊﾟ", "ガパ"), ("ﾡￂ", "가"), ("é​̣", "ẹ́")]:
        assert canonical.canonical(a) == canonical.canonical(b), (a, b)


def test_look_classes(spark):
    texts = [(1, "a b"), (2, "a\u00a0b"), (3, "a b"), (4, "A b"), (5, None), (6, ""), (7, "​"), (8, "z"), (8, "z"), (9, "ａ b")] + [(i, "stock") for i in range(100, 130)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("form", F.lit(1))
    got = rows(canonical.look_classes(df))
    assert got == sorted([(1, 1, 4, 3), (2, 1, 4, 3), (3, 1, 4, 3), (9, 1, 4, 3), (4, 4, 1, 1), (8, 8, 1, 1)] + [(i, 100, 30, 1) for i in range(100, 130)])
    assert canonical.look_classes(df.limit(0)).collect() == []


def test_look_alikes(spark):
    texts = [(1, "a b"), (2, "a b"), (3, "a b"), (4, "a b"), (5, "A b"), (6, None), (7, ""), (8, "​"), (9, " "), (10, " "), (11, "z"), (11, "z")] + [(i, "stock") for i in range(100, 180)] + [(200, "stоck"), (None, "stоck")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("raw", F.lit("x")).withColumn("form", F.lit(1))
    want = [(1, 2), (1, 4), (2, 3), (2, 4), (3, 4)] + [(i, 200) for i in range(100, 180)]
    assert rows(canonical.look_alikes(df)) == want
    assert canonical.look_alikes(df.limit(0)).collect() == []
    assert {r.doc_id: r.text for r in canonical.canonical_texts(df.filter("doc_id in (2, 6, 7)")).collect()} == {2: "a b", 6: None, 7: ""}
