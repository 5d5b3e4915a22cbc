"""Near-duplicates, searches, URL models and the pipeline against brute force."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import frame, prose, texts
from thicket.llm import components, neardup, shingles, topk, urls


def brute_classes(rows):
    """The least doc_id of each connected component of Jaccard similarity 0.8 on sets of 5 words."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().split()
        k = min(5, len(w))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((str(d), str(least.get(root(i), d))) for i, (d, _) in enumerate(rows))


def test_near_duplicates(spark):
    got = sorted((str(r.doc_id), str(r.class_id)) for r in neardup.classes(frame(spark)).collect())
    assert got == brute_classes(texts())
    kept = neardup.deduplicate(frame(spark))
    assert kept.columns == frame(spark).columns
    ids = collections.Counter(r["doc_id"] for r in kept.collect())
    assert ids[1] == 1 and ids[5] == 1 and not ids[6] and not ids[7] and ids[2] == ids[3] == ids[4] == 1
    assert neardup.classes(frame(spark, [])).count() == 0 and neardup.deduplicate(frame(spark, [])).count() == 0


def test_one_row_of_a_class_stays(spark):
    """Whatever ids its rows have: null, repeated, or shared with another text."""
    base = prose(31, 200).split()
    near = [" ".join(base[:k] + ["other"] + base[k + 1 :]) for k in (20, 60, 100)]
    rows = [(5, near[0]), (5, near[0]), (None, near[1]), (None, near[2]), (9, " ".join(base))]
    rows += [(None, prose(32, 80)), (None, prose(32, 80)), (7, prose(33, 60)), (7, prose(34, 60)), (None, None), (None, None), (3, "")]
    kept = [(r["doc_id"], r[1]) for r in neardup.deduplicate(frame(spark, rows)).collect()]
    want = [(5, near[0]), (None, prose(32, 80)), (7, prose(33, 60)), (7, prose(34, 60)), (None, None), (None, None), (3, "")]
    assert sorted(map(str, kept)) == sorted(map(str, want))
    got = sorted((str(r.doc_id), str(r.class_id)) for r in neardup.classes(frame(spark, rows)).collect())
    assert got == brute_classes(rows)


@pytest.mark.parametrize("repeats", [1, 20, 400])
def test_recall_of_pairs_with_repeated_passages(repeats):
    """Pairs near the limit whose passages repeat unequally are candidates as often as their sets say."""
    import pyarrow as pa

    pairs, texts_ = 150, []
    for i in range(pairs):
        words = [f"{w}{i}x{k}" for k, w in enumerate(prose(9000 + i, 400).split())]
        texts_ += [" ".join(words), " ".join(words[:200] + words[200:] * repeats + [f"n{i}x{k}" for k in range(85 if repeats == 1 else 80)])]
    sets = [set(shingles.shingles(t.encode())[0].tolist()) for t in texts_]
    near = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    assert all(0.8 <= j < 0.85 for j in near)
    raw = [t.encode() for t in texts_]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(raw))), pa.array(raw), pa.array(raw), pa.array(range(len(raw)))], names=["row", "raw", "key", "doc_id"])
    bands = [set(b) for out in neardup._sign(5, neardup.BANDS, neardup.ROWS)([batch]) for b in out.column(2).to_pylist()]
    assert sum(bool(a & b) for a, b in zip(bands[::2], bands[1::2])) >= 0.99 * pairs


def test_family_of_near_copies_loses_no_link(spark, monkeypatch):
    """Hundreds of copies, each with edits of its own, so that many pairs lie about the limit; blocks
    are small, so that a bucket spans several."""
    monkeypatch.setattr(neardup, "BLOCK", 32)
    base, pick, rows = prose(77, 200).split(), random.Random(5), []
    for i in range(260):
        w = list(base)
        for _ in range(pick.choice([1, 2, 3, 4, 5, 6, 9])):
            w[pick.randrange(len(w))] = f"edit{pick.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, prose(2000 + i, 90)) for i in range(40)] + [(2000 + i, rows[3][1]) for i in range(100)]
    got = sorted((str(r.doc_id), str(r.class_id)) for r in neardup.classes(frame(spark, rows)).collect())
    assert got == brute_classes(rows)


def test_probability_jaccard_and_signature():
    pick = random.Random(2)
    a = prose(1, 300).split()
    for edits in (3, 10, 25):
        b = list(a) + a[:40] * 3
        for _ in range(edits):
            b[pick.randrange(300)] = f"e{pick.random()}"
        (h, n), (g, m) = shingles.shingles(" ".join(a).encode()), shingles.shingles(" ".join(b).encode())
        x, y = dict(zip(h.tolist(), shingles.damped(n))), dict(zip(g.tolist(), shingles.damped(m)))
        every = set(x) | set(y)
        brute = sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in every) for d in x if d in y)
        assert abs(brute - shingles.probability_jaccard(h, shingles.damped(n), g, shingles.damped(m))) < 1e-9
        equal = (shingles.signature(h, shingles.damped(n), 4000) == shingles.signature(g, shingles.damped(m), 4000)).mean()
        assert abs(equal - brute) < 0.035


def test_links_and_components(spark):
    pick = np.random.RandomState(1)
    sets = [np.unique(pick.randint(0, 60, 40)).astype(np.uint64) for _ in range(30)] + [np.arange(3, dtype=np.uint64)] * 2
    want = [(i, j) for i in range(32) for j in range(i + 1, 32) if len(np.intersect1d(sets[i], sets[j])) >= 0.5 * len(np.union1d(sets[i], sets[j]))]
    assert [tuple(p) for p in neardup.links(sets, 0.5).tolist()] == want
    edges = [(i, i + 1) for i in range(0, 60) if i % 7] + [(100, 3), (5, 61), (61, 5), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, row int, value string").repartition(3)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "CHUNK", 3)
    pick = np.random.RandomState(4)
    rows = [(i, pick.randn(8).round(2).tolist()) for i in range(300)]
    rows += [(400, rows[0][1]), (401, rows[0][1]), (402, rows[0][1])]  # ties
    rows += [(600, [70000.0] + [0.5] * 7), (601, [1e6, -1e6] * 4), (602, [-3e5] * 8), (650, [2.0**20] + [-1.0] * 7)]  # large values
    rows += [(500, None), (501, [float("nan")] * 8), (502, [1.0, None] * 4), (503, [float("inf")] * 8), (None, [9.0] * 8), (504, []), (505, [0.5] * 10)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0, 5).collect())
    sound = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in sound:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in sound if i != q)
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])]
    assert got == sorted(want)
    assert topk.top_k(vectors(spark, []), F.col("vec_id") % 50 == 0, 5).count() == 0
    few = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (50, [-1.0, 1.0]), (50, [-1.0, 1.0])]
    assert topk.top_k(vectors(spark, few), F.col("vec_id") % 50 == 0, 5).count() == 9


def test_bit_sliced_sums():
    pick = np.random.RandomState(9)
    values, queries = pick.randint(-500, 500, (130, 5)), pick.randint(-300, 300, (7, 5))
    low, bits, slices = topk.build(values)
    assert len(slices) == sum(bits)
    found = list(topk.search(np.arange(130), np.arange(130), low, bits, slices, np.full(7, -1), queries, 130))
    assert {(i, r): s for i, r, _, s in found} == {(i, r): int(queries[i] @ values[r]) for i in range(7) for r in range(130)}


def test_top_k_of_any_size(spark):
    """Components beyond 64 bits: exact as long as the scores of the k best fit."""
    huge = [(0, [1.0, 0.0]), (1, [0.5, 2.0**70]), (2, [0.25, -(2.0**70)]), (50, [0.0, 1.0]), (3, [1.0, 1.0])]
    kind = "vec_id long, embedding array<double>"
    df = spark.createDataFrame(huge, kind)
    got = [(r.rank, r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") == 0, 5).orderBy("rank").collect()]
    assert got == [(1, 3, 65536), (2, 1, 32768), (3, 2, 16384), (4, 50, 0)]
    with pytest.raises(Exception, match="query 50 and vector 1 "):
        topk.top_k(df, F.col("vec_id") == 50, 1).collect()
    assert [(r.vec_id, r.score) for r in topk.top_k(df.filter("vec_id <> 1"), F.col("vec_id") == 50, 2).orderBy("rank").collect()] == [(3, 65536), (0, 0)]
    assert topk.whole([[2.0**70, -0.001]], 256.0).tolist() == [[1 << 78, -1]]


URLS = ["http://a.b.COM/en/1", "https://example.com/en/7x?q", "https://Example.com/EN/7", "http://com/en/", "http://xcom/en/2", "ftp://h.net/de/#f", "http://example.net/de/89", "http://k.org?es/", "http://k.org/es/x", "no scheme/en/", "", None, "://", "http://a.net//de/", "http://u:p@w.example.com:80/en/7"]


def brute_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, None))
    return host, path, rule, verdict


def test_url_rules_and_models(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(100 + i, f"http://s{i % 40}.example.com/en/{i}") for i in range(400)] + [(600 + i, f"http://s{i}.info/en/{'7' if i % 2 else '3'}{i:02d}") for i in range(60)]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in rows], "page_id long, url string, host string, rule int").repartition(3)
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    for i, u in rows:
        host, path, rule, verdict = brute_rule(u)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), u
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert got[URLS.index("")].verdict == got[URLS.index(None)].verdict == "allow"
    assert np.mean([got[600 + i].verdict == ("allow" if i % 2 else "block") for i in range(60)]) > 0.8
    assert urls.judge(pages.limit(0)).count() == 0


def test_url_rules_are_the_contracts(spark):
    """The contract's list with its words, written out here and not read from the code."""
    contract = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert [(h + p, v) for v, h, p in urls.RULES] == list(contract.items())
    rows = [(2 * i + j, f"http://{sub}{rule}1?q", rule, verdict) for i, (rule, verdict) in enumerate(contract.items()) for j, sub in enumerate(("", "a.B."))]
    rows += [(20, "http://example.net/de/7", "net/de/", "allow"), (21, "http://x.EXAMPLE.net/de/81", "example.net/de/8", "block"), (22, "http://example.com/en/8", "com/en/", "block")]
    got = urls.judge(spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")).collect()
    assert {r.page_id: (r.rule, r.verdict) for r in got} == {i: (rule, verdict) for i, _, rule, verdict in rows}


def brute_chance(texts, context, letter, letters):
    """Witten-Bell by counting in the padded texts themselves."""
    lower = brute_chance(texts, context[1:], letter, letters) if context else 1 / letters
    padded = ["\x01" * 4 + t + "\x03" for t in texts]
    after = [s[i] for s in padded for i in range(4, len(s)) if s[i - len(context) : i] == context]
    kinds = len(set(after))
    return (after.count(letter) + kinds * lower) / (len(after) + kinds) if after else lower


def test_url_model_against_counting():
    accepted, rejected = ["/en/1", "/en/22", "/fr/3", "a.\x02/é"], ["/xx/9?q=1", "/en/9", "", "/en/9🙂"]
    models = [urls.Model(part, 4, 20) for part in (accepted, rejected)]
    for text in ["/en/1", "/xy/\x01\x01", "", "🙂é", "/en/22/en/22"]:
        contexts, grams, size = urls.windows([text, "x"], 4)
        assert size.tolist() == [len(text) + 1, 2]
        s = "\x01" * 4 + text + "\x03"
        for model, part in zip(models, (accepted, rejected)):
            got = model.chances(contexts, grams)[: len(text) + 1]
            want = [brute_chance(part, s[i - 4 : i], s[i], 20) for i in range(4, len(s))]
            assert np.allclose(got, want, rtol=1e-12)
    every = set("".join(accepted)) | {"\x03"}  # chances of all characters sum to 1
    assert abs(sum(brute_chance(accepted, "/en/", c, len(every)) for c in every) - 1) < 1e-9


def test_url_verdicts_against_brute_force(spark):
    """Every verdict of the method, from counts made anew in plain Python."""
    pick = random.Random(1)
    name = lambda: "".join(pick.choice("abcdefgh") for _ in range(4))
    rows = [(i, f"http://{name()}.example.com/en/7{i}") for i in range(30)] + [(100 + i, f"http://{name()}.org/es/{name()}") for i in range(30)]
    rows += [(200 + i, f"http://{name()}.info/{pick.choice(['en/7', 'es/'])}{name()}") for i in range(25)]
    rows += [(300, "http://x.info/" + "es/" * 20_000), (None, "http://x.info/en/71"), (301, None), (302, "http://y.org/es/" + "z" * 5000), (303, "")]
    pages = spark.createDataFrame([(i, u, "r", 1.5) for i, u in rows], "page_id long, url string, verdict string, rejected double").repartition(3)
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    assert got[302].rule == "org/es/" and got[303].verdict == got[301].verdict == "allow"
    ids = [u for _, u in rows if u and len(u) <= urls.LONGEST]
    order = {r.url: k for k, r in enumerate(spark.createDataFrame([(u,) for u in set(ids)], "url string").orderBy(F.xxhash64("url"), "url").collect())}
    examples = [[urls.shown(u) for u in sorted({u for u in ids if brute_rule(u)[3] == v}, key=order.get)] for v in ("allow", "block")]
    fit, held = [[x for i, x in enumerate(p) if i % 4] for p in examples], [p[::4] for p in examples]
    letters = len(set("".join(examples[0] + examples[1]))) + 2

    def ratio(t):
        s = "\x01" * 4 + t + "\x03"
        logs = [math.log(brute_chance(fit[1], s[i - 4 : i], s[i], letters)) - math.log(brute_chance(fit[0], s[i - 4 : i], s[i], letters)) for i in range(4, len(s))]
        return sum(logs) / len(logs)

    x, y = np.array([ratio(t) for p in held for t in p]), np.repeat([0.0, 1.0], [len(p) for p in held])
    slope, shift = urls._logistic(x, y, np.where(y == 1, 0.5 / len(held[1]), 0.5 / len(held[0])))
    for i, u in rows[60:85] + [rows[86]]:
        p = 1 / (1 + math.exp(-(slope * ratio(urls.shown(u)) + shift)))
        assert abs(got[i].rejected - p) < 1e-9 and got[i].verdict == ("block" if p >= 0.5 else "allow")
    assert got[300].verdict == "block"


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline
    from thicket.llm import mixing, quality, secrets

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id for r in quality.score(docs).filter("kept").collect()}
    one = corpus_pipeline.STAGES[0][1](spark, docs, sf_dir)
    rows = sorted((r.doc_id, r.text) for r in one.collect())
    assert one.columns == docs.columns and {i for i, _ in rows} == kept
    two = corpus_pipeline.STAGES[1][1](spark, one, sf_dir)
    assert {str(r.doc_id) for r in two.collect()} == {c for _, c in brute_classes(rows)}
    three = corpus_pipeline.STAGES[2][1](spark, two, sf_dir)
    assert three.count() == two.count() and secrets.scan(three).filter("n_assign + n_access + n_hex > 0").count() == 0
    four = corpus_pipeline.STAGES[3][1](spark, three, sf_dir)
    assert {r.doc_id for r in four.collect()} == {r.doc_id for r in mixing.weigh(three).filter("kept").collect()} and four.columns == docs.columns
    five = corpus_pipeline.STAGES[4][1](spark, four, sf_dir)
    assert {r.doc_id for r in five.collect()} == {r.doc_id for r in four.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "secret_scan", "mix_sources", "pack_sequences"]
    assert corpus_pipeline.run(spark, sf_dir).count() == five.count()


@pytest.mark.parametrize("name", ["op3_mixing", "op6_near_duplicates", "op7_licenses", "op8_topk", "op9_secrets"])
def test_sql_agrees(spark, sf_dir, name):
    import duckdb

    from thicket.llm import registry

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = c.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(found.columns)
    assert sorted(str(tuple(r[n] for n in found.columns)) for r in got.collect()) == sorted(map(str, found.fetchall()))


@pytest.mark.parametrize("heavy", [1 << 19, 40, 1])
def test_url_models_learn_from_every_url(spark, monkeypatch, heavy):
    """More URLs a verdict than a sample of 20,000 holds, some of them long: chances as by counting all of them, however
    many windows are joined rather than sent."""
    monkeypatch.setattr(urls, "HEAVY", heavy)
    many = 24_000 if heavy > 40 else 300
    rows = [(i, f"http://a.example.com/en/7{i % 7}{i}") for i in range(many)] + [(many + i, f"http://b.org/es/{i}x{i % 5}") for i in range(many)]
    rows += [(2 * many + i, f"http://b.org/es/{c * 2500}") for i, c in enumerate("qrstuvwyz")]
    asked = [f"http://c.info/{t}" for t in ("en/71", "es/9x3", "qqqqqqqq", "zz/yy", "en/777é")]
    rows += [(3 * many + i, u) for i, u in enumerate(asked)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string").repartition(3)).collect()}
    assert len(got) == len(rows)
    known = spark.createDataFrame([(u, brute_rule(u)[3]) for _, u in rows if brute_rule(u)[3]], "url string, verdict string")
    known = known.orderBy(F.xxhash64("url"), "url").collect()
    parts = [[urls.shown(r.url) for r in known if r.verdict == v] for v in ("allow", "block")]
    letters = len(set("".join(parts[0] + parts[1]))) + 2
    models = [urls.Model([t for i, t in enumerate(p) if i % 4], 4, letters) for p in parts]

    def ratios(texts):
        contexts, grams, size = urls.windows(texts, 4)
        log = np.log(models[1].chances(contexts, grams)) - np.log(models[0].chances(contexts, grams))
        return np.add.reduceat(log, np.cumsum(size) - size) / size

    held = [p[::4] for p in parts]
    y = np.repeat([0.0, 1.0], [len(p) for p in held])
    slope, shift = urls._logistic(ratios(held[0] + held[1]), y, np.where(y == 1, 0.5 / len(held[1]), 0.5 / len(held[0])))
    for (i, u), x in zip(rows[-len(asked) :], ratios([urls.shown(u) for u in asked])):
        assert abs(got[i].rejected - 1 / (1 + math.exp(-(slope * x + shift)))) < 1e-9, u


def test_pipeline_keeps_no_copy_of_the_rows(spark):
    """What the first two stages leave in the shared folder, beside their results, is small against the texts."""
    import pathlib

    import corpus_pipeline
    from thicket.llm import scratch

    pick = random.Random(3)
    rows = [(i, " ".join(pick.choice("the of and to in".split()) + f" {pick.getrandbits(64):x}" for _ in range(800))) for i in range(300)]
    rows += [(1000 + i, rows[i][1]) for i in range(30)]
    docs = scratch.table(spark.createDataFrame(rows, "doc_id long, text string"), "input")
    size = lambda: sum(f.stat().st_size for p in scratch._used for f in pathlib.Path(p.removeprefix("file://")).rglob("*") if f.is_file())
    before = size()
    of_input = sum(f.stat().st_size for f in pathlib.Path(docs.scratch_path.removeprefix("file://")).rglob("*.parquet"))
    assert corpus_pipeline.quality_rules(spark, docs, "").count() > 0
    assert size() - before < 0.2 * of_input
    before = size()
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == set(range(300))
    assert size() - before < 0.2 * of_input


@pytest.mark.parametrize("bits", [8, 1 << 26])
def test_rows_that_share_id_and_text_or_a_bit(spark, monkeypatch, bits):
    """One whole row of those that share id and text stays, the first; rows that share a bitmap's bit with others stay too."""
    monkeypatch.setattr(neardup, "LEAST_BITS", bits)
    monkeypatch.setattr(neardup, "MOST_BITS", bits)
    rows = [(i, prose(100 + i, 60), i) for i in range(40)] + [(i, prose(100 + i, 60), 100 + i) for i in range(0, 40, 4)]
    rows += [(None, prose(7, 60), 200), (None, prose(7, 60), 201), (50, prose(107, 60), 202), (None, None, 203), (None, None, 204), (3, " ", 205)]
    kept = neardup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, n int").coalesce(1))
    want = [*range(40), 200, 203, 204, 205]
    assert sorted(r.n for r in kept.collect()) == want
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(str(r) for r in rows if r[2] in want)
