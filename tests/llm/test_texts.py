"""Operators on whole texts against brute force."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from tests.llm.cases import frame, texts
from thicket.llm import licenses, mixing, packing, quality, registry, secrets, tokenio, toxicity
from thicket.llm.tokens import BYTE_LEVEL, LETTERS, PLAIN, WORD_LEVEL, Encoder

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def by_row(df, *columns):
    return sorted((tuple(str(r[c]) for c in columns)) for r in df.collect())


def brute_quality(t):
    t = t or ""
    words, seen, dup = SPACE.findall(t), set(), 0
    for line in t.split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)]


def test_quality_counts(spark):
    got = by_row(quality.score(frame(spark)), "doc_id", *quality.COUNTS, "base_failed")
    want = []
    for i, t in texts():
        n = brute_quality(t)
        want.append(tuple(map(str, [i, *n, n[0] < 50 or 100 * n[4] > 50 * n[0]])))
    assert got == sorted(want)
    kept = quality.keep(frame(spark))
    assert kept.columns == frame(spark).columns
    assert {r.doc_id for r in kept.collect()} >= {1, 5, 6, 7, 8, None} and not {2, 3, 4, 16} & {r.doc_id for r in kept.collect()}
    assert quality.score(frame(spark, [])).count() == 0 and quality.keep(frame(spark, [])).count() == 0


def test_quality_estimate_against_plain_em():
    """The estimate on counted patterns equals one that walks over every document."""
    pick = np.random.RandomState(3)
    good = pick.rand(400) < 0.7
    votes = [[0 if pick.rand() < 0.3 else (1 if (pick.rand() < 0.85) == g else -1) for _ in range(5)] for g in good]
    share, rates = quality.fit([(v, 1) for v in votes])
    counted = collections.Counter(map(tuple, votes))
    share2, rates2 = quality.fit([(list(v), n) for v, n in sorted(counted.items())])
    assert abs(share - share2) < 1e-6 and np.allclose(rates, rates2, atol=1e-6)
    p = np.array(quality.posterior(votes, (share, rates)))
    for v, q in list(zip(votes, p))[:50]:
        a = math.prod(rates[k][0][v[k] + 1] for k in range(5)) * share
        b = math.prod(rates[k][1][v[k] + 1] for k in range(5)) * (1 - share)
        assert abs(q - a / (a + b)) < 1e-9
    assert ((p > 0.5) == good).mean() > 0.9


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_librarys(name):
    encoder = Encoder(registry.tokenizer(name))
    samples = [t or "" for _, t in texts()] + ["a  b\n\n c   d", "don't we'll ’s", "İ ſs ² ªb", "_a__b 12a3", "\n\n  \n x", "\x1c\x85"]
    for t in samples:
        assert encoder.encode(t) == encoder.whole(t), t[:40]


def library_ids(name, t, end):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(registry.tokenizer(name)).encode(t or "", add_special_tokens=False).ids, end]


def test_packing_round_trip(spark):
    rows = packing.pack(frame(spark), registry.tokenizer("byte_bpe_50k.json"), 64, 0).collect()
    by_doc = collections.defaultdict(list)
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_doc[r.doc_id].append(r)
    for i, t in texts():
        want = library_ids("byte_bpe_50k.json", t, 0)
        times = 2 if i == 1 else 1
        pieces = sorted(by_doc[i], key=lambda r: (r.start, r.sequence_id))
        assert sum(r.length for r in pieces) == times * len(want)
        for r in pieces:
            assert np.frombuffer(r.ids, "<u4").tolist() == want[r.start : r.start + r.length] and r.doc_tokens == len(want)
            assert r.continues == (r.start + r.length < len(want))
    filled = collections.defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for s, parts in filled.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or s == max(filled)
    assert packing.pack(frame(spark, []), registry.tokenizer("byte_bpe_50k.json")).count() == 0


def test_token_blocks_round_trip(spark, tmp_path, monkeypatch):
    tokenio.write(frame(spark), str(tmp_path / "shards"), registry.tokenizer("word_bpe_49k.json"), 1)
    got = by_row(tokenio.read(spark, str(tmp_path / "shards")), "start", "doc_id", "n_tokens", "ids_crc32")
    want, at = [], 0
    for i, t in sorted(texts(), key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = np.array(library_ids("word_bpe_49k.json", t, 1), dtype="<u4")
        want.append((str(at), str(i), str(len(ids)), str(zlib.crc32(ids.tobytes()))))
        at += len(ids)
    assert got == sorted(want)
    files = sorted((tmp_path / "shards" / "shards").iterdir())
    assert len(files) == tokenio.manifest(spark, str(tmp_path / "shards")).count() and all(f.name.startswith("p") for f in files)
    monkeypatch.setattr(tokenio, "mounted", lambda path: None)  # a store that only Spark reaches
    tokenio.write(frame(spark), str(tmp_path / "store"), registry.tokenizer("word_bpe_49k.json"), 1)
    assert by_row(tokenio.read(spark, str(tmp_path / "store")), "start", "doc_id", "n_tokens", "ids_crc32") == got
    monkeypatch.undo()
    files[0].unlink()
    with pytest.raises(ValueError, match="other files"):
        tokenio.read(spark, str(tmp_path / "shards"))
    tokenio.write(frame(spark, []), str(tmp_path / "none"), registry.tokenizer("word_bpe_49k.json"), 1)
    assert tokenio.read(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 4097, 20_000])
def test_blocks_round_trip(n):
    pick = np.random.RandomState(n)
    ids = (pick.randint(0, 300, n) + np.where(pick.rand(n) < 0.05, pick.randint(0, 2**31, n), 0)).astype(np.uint32)
    docs, counts, back = tokenio.read_shard(tokenio.shard_bytes([5, None], [n, 0], ids))
    assert docs == [5, None] and counts.tolist() == [n, 0] and (back == ids).all()
    if n > 4096:  # outliers don't widen the blocks
        assert len(tokenio.shard_bytes([5], [n], ids)) < 2.2 * n + 2000


def test_one_document_is_read_by_seeking():
    import io

    class Counting(io.BytesIO):
        taken = 0

        def read(self, *args):
            out = super().read(*args)
            self.taken += len(out)
            return out

    pick = np.random.RandomState(1)
    counts = pick.randint(0, 900, 3000).tolist() + [0, 12_288, 1]
    ids = pick.randint(0, 49_000, sum(counts)).astype(np.uint32)
    whole = tokenio.shard_bytes(list(range(len(counts))), counts, ids)
    starts = np.cumsum(counts) - counts
    for i in [0, 1, 17, 1500, 2999, 3000, 3001, 3002]:
        f = Counting(whole)
        assert (tokenio.document(f, i) == ids[starts[i] : starts[i] + counts[i]]).all()
        assert f.taken < 0.08 * len(whole)
    with pytest.raises(IndexError):
        tokenio.document(io.BytesIO(whole), len(counts))
    with pytest.raises(ValueError):
        tokenio.document(io.BytesIO(b"x" * 100), 0)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_librarys_on_random_strings(name):
    encoder, pick = Encoder(registry.tokenizer(name)), np.random.RandomState(0)
    letters = list("abCDé ñüß0179'sred_-.,!?()[]{}@#$%&*+=<>/|~`\"\\^:;\t\n\r") + ["  ", "'ll", "'RE", "ſ", "İ", "²", "🙂", "the", " of", "\u00a0", "\u2028", "\x85", "ﬁ", "e\u0301", "中"]
    for _ in range(4000):
        t = "".join(letters[k] for k in pick.randint(0, len(letters), pick.randint(0, 25)))
        assert encoder.encode(t) == encoder.whole(t), t


def test_patterns_of_the_plain_range():
    plain = [chr(i) for i in range(1 << 16) if PLAIN.fullmatch(chr(i))]
    assert [c for c in plain if re.fullmatch(r"[^\W\d_]", c)] == [c for c in plain if re.fullmatch(f"[{LETTERS}]", c)]
    assert all(PLAIN.fullmatch(c.lower()) for c in plain)
    byte_level = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
    word_level = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
    pick, often = np.random.RandomState(2), list("''  \n\t_stredvml0123.,-AŽž")
    for _ in range(4000):
        t = "".join((often if k % 3 else plain)[k % len(often if k % 3 else plain)] for k in pick.randint(0, 1 << 20, pick.randint(0, 25)))
        assert byte_level.findall(t) == BYTE_LEVEL.findall(t) and word_level.findall(t) == WORD_LEVEL.findall(t), t


def test_licenses_base(spark):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    extra = [(20, "This is GNU General Public License, version 3 and GPL cc  by/CC-BY"), (21, "All rights reserved all rights reserved")]
    want = []
    for i, t in texts() + extra:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        places, labels = [], set()
        for phrase, label in phrases.items():
            p = phrase.split()
            found = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            places += found
            labels |= {label} if found else set()
        want.append(tuple(map(str, [i, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))])))
    df = licenses.scan(frame(spark, texts() + extra))
    assert by_row(df, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want)
    labels = {r.doc_id: r.labels for r in df.collect()}
    assert labels[13] == "cc-by,mit,reserved" and labels[20] == "cc-by,gpl,gpl-3.0"
    assert licenses.scan(frame(spark, [])).count() == 0


def test_licenses_find_every_template_whatever_else_the_file_holds(spark):
    everyday = "free copies of the files and documentation, at no charge to any person who may use, modify or distribute software for a purpose "
    pairs = [(a, b) for a in licenses.TEMPLATES for b in licenses.TEMPLATES]
    rows = [(i, f"{a[1]}. {b[1]}") for i, (a, b) in enumerate(pairs)]
    rows += [(900, ". ".join(t for _, t, _ in licenses.TEMPLATES)), (901, everyday + "Licensed under the MIT license"), (902, everyday + "Licensed under the Apache License, Version 2.0")]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    for i, (a, b) in enumerate(pairs):
        assert {a[0], b[0]} <= set(got[i].labels.split(",")), rows[i]
    assert {x[0] for x in licenses.TEMPLATES} <= set(got[900].labels.split(","))
    assert got[901].labels == "mit" and got[902].labels == "apache-2.0"


def brute_licenses(text):
    """Labels and score by laying every template at every place."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    labels, best = set(), 0.0
    for label, template, keys in licenses.TEMPLATES:
        cut = template.split()
        keyed = set()
        for key in keys:
            at = next(i for i in range(len(cut)) if cut[i : i + len(key.split())] == key.split())
            keyed |= set(range(at, at + len(key.split())))
        for start in range(1 - len(cut), len(words)):
            equal = [i for i, w in enumerate(cut) if 0 <= start + i < len(words) and words[start + i] == w]
            if keyed <= set(equal) and len(equal) / len(cut) >= licenses.LEAST_COVERED:
                labels.add(label)
                best = max(best, len(equal) / len(cut))
    labels |= {label for phrase, label in licenses.PHRASES.items() if f" {phrase} " in f" {' '.join(words)} "}
    return ",".join(sorted(labels)), best


def test_licenses_against_every_template_at_every_place(spark):
    pick = np.random.RandomState(6)
    vocabulary = sorted({w for _, t, _ in licenses.TEMPLATES for w in t.split()})
    rows = list(texts())
    for i in range(150):  # templates with words changed, put in, or cut off, among their own words
        parts = []
        for _ in range(pick.randint(1, 6)):
            words = licenses.TEMPLATES[pick.randint(len(licenses.TEMPLATES))][1].split()
            for _ in range(pick.randint(0, 4)):
                at = pick.randint(len(words))
                words[at : at + pick.randint(0, 2)] = [vocabulary[pick.randint(len(vocabulary))]] * pick.randint(0, 2)
            parts += [" ".join(words[pick.randint(0, 2) :]), " ".join(vocabulary[k] for k in pick.randint(0, len(vocabulary), pick.randint(0, 9)))]
        rows.append((100 + i, " ".join(parts).title()))
    rows.append((300, "Permission LICENSE copies files " * 30_000 + "LICENSED under the mit license"))
    rows.append((301, "under the mit license İ CC BY"))
    got = sorted((str(r.doc_id), r.labels, round(r.score, 9)) for r in licenses.scan(frame(spark, rows)).collect())
    want = {i: brute_licenses(t) if i != 300 else ("mit", 1.0) for i, t in rows}
    assert got == sorted((str(i), want[i][0], round(want[i][1], 9)) for i, _ in rows)


def test_secrets(spark):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    extra = [(20, "token=abc: secret=abcdefgh PASSWORD:\"xxxxxx🙂\" api_key = key=12 AKIAX AKIA" + "Z9" * 10), (21, "ab1 ghp_aB3dE5fG7hI9jK1lM3nO5pQ7rS9tU1vW3xY5 end")]
    want = []
    for i, t in texts() + extra:
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        want.append(tuple(map(str, [i, *(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest()])))
    df = secrets.scan(frame(spark, texts() + extra))
    assert by_row(df, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(want)
    assert {r.doc_id: r.spans for r in df.collect()}[21] == "entropy:4:44"
    redacted = secrets.redact(frame(spark, texts() + extra))
    assert redacted.columns == frame(spark).columns
    text = {r["doc_id"]: r[1] for r in redacted.collect()}
    assert text[21] == "ab1 [SECRET] end" and text[2] is None and "hunter2" not in text[12] and text[5] == dict(texts())[5]
    assert secrets.scan(frame(spark, [])).count() == 0


def test_secrets_of_the_form_of_paths_and_of_mixed_hex(spark):
    key, mixed = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYQ2mPLzKEYs", "aB3f0C9e1D7a2F4b8E6c" "5A0d9B3f1C7e"
    path = "/usr/local/share/python3/site-packages/Module"
    rows = [(1, f"aws_secret_access_key = {key}"), (2, f"id {mixed} end"), (3, f"see {path} there")]
    got = {r.doc_id: r.spans for r in secrets.scan(frame(spark, rows)).collect()}
    assert got == {1: f"entropy:24:{24 + len(key)}", 2: f"entropy:3:{3 + len(mixed)}", 3: ""}
    pick = np.random.RandomState(11)
    keys = ["".join(pick.choice(list("0123456789abcdefABCDEF"), 32)) for _ in range(100)]
    found = secrets.scan(frame(spark, list(enumerate(keys)))).filter("spans <> ''").count()
    assert found >= 98


def highest(t, width):
    windows = [collections.Counter(t[i : i + width]).values() for i in range(len(t) - width + 1)]
    return max(-sum(c / width * math.log2(c / width) for c in w) for w in windows)


def test_highest_entropy(spark):
    from pyspark.sql import functions as F

    pick = np.random.RandomState(8)
    samples = ["a" * 30, "abcdefghijklmnopqrstuvwxyz0123", "aB3dE5fG7hI9jK1lM3nO5pQ7", "thethethethethethethethe" * 3, "x" * 20]
    samples += ["".join(pick.choice(list("abcdefgé🙂+/=")[: pick.randint(2, 12)], pick.randint(20, 90))) for _ in range(60)]
    for width in (7, 20):
        got = spark.createDataFrame([(s,) for s in samples], "t string").select("t", secrets.highest_entropy(F.col("t"), width).alias("e")).collect()
        for r in got:
            assert abs(r.e - highest(r.t, width)) < 1e-9


def brute_spans(t):
    """All spans by Python's own regular expressions, entropies counted afresh for each window."""
    t = t or ""
    assign = re.compile(secrets.ASSIGN, re.A)
    base = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    for m in re.finditer(secrets.CANDIDATE, t):
        x = m[0]
        allowed = any(re.search(f, x) and (f != secrets.PATH or len(re.findall(secrets.MIXED, x)) < secrets.LEAST_MIXED) for f in secrets.ALLOWED)
        least = next((e for _, forms, e in secrets.CLASSES if all(re.search(f, x) for f in forms)), None)
        if not allowed and least is not None and highest(x, secrets.WIDTH) >= least and not any(a < m.end() and m.start() < b for a, _, b in base if _ < 3):
            base.append((m.start(), 3, m.end()))
    return sorted(base)


def test_secrets_against_brute_force(spark, monkeypatch):
    """Many spans of all kinds in one text, touching and overlapping; folds in small pieces."""
    pick = np.random.RandomState(12)
    parts = ["token=abcdefgh", "é🙂", " ", " ", "AKIA" + "Q7" * 9, "0123456789abcdef" * 2, "key: ", "Secret : 'x9_x9_x9", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYQ2mPLzKEYs", "zqxwkvjhgtrpbnmcdfls", "/usr/local/share/python/lib", "ThisIsAVeryLongClassNameHere"]
    rows = [(i, "".join(parts[k] for k in pick.randint(0, len(parts), pick.randint(1, 60)))) for i in range(60)] + texts()[1:]
    monkeypatch.setattr(secrets, "PIECE", 4)
    got = sorted((str(r.doc_id), r.spans) for r in secrets.scan(frame(spark, rows)).collect())
    assert got == sorted((str(i), ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in brute_spans(t))) for i, t in rows)
    want = {}
    for i, t in rows[:60]:
        out, at = "", 0
        for a, _, b in brute_spans(t):
            out += "" if a < at else t[at:a] + "[SECRET]"
            at = max(at, b)
        want[i] = out + t[at:]
    assert {r["doc_id"]: r[1] for r in secrets.redact(frame(spark, rows[:60])).collect()} == want


def test_secrets_in_a_run_of_a_million_characters(spark):
    import time

    pick = np.random.RandomState(4)
    letters = "".join(pick.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 1_000_000))
    began = time.time()
    assert secrets.scan(frame(spark, [(1, letters)])).collect()[0].spans == "entropy:0:1000000"
    assert time.time() - began < 90
    many = " ".join(f"token=abcdefgh{i}" for i in range(20_000))
    assert secrets.scan(frame(spark, [(1, many)])).collect()[0].n_assign == 20_000


def test_mixing(spark, sf_dir):
    docs = registry.table(spark, sf_dir, "documents")
    rows = mixing.weigh(docs).toPandas()
    total = rows.n_tokens.sum()
    for m in mixing.MARGINS:
        tokens = rows.groupby(m).n_tokens.sum()
        share = (tokens / total) ** mixing.POWERS[m]
        want = share / share.sum()
        got = (rows.n_tokens * rows.weight).groupby(rows[m]).sum() / total
        assert abs(got / want - 1).max() < 0.005, m
        expected = (rows.n_tokens * rows.chance).groupby(rows[m]).sum()  # what the sample holds on average
        assert abs(expected / expected.sum() / want - 1).max() < 0.01, m
    assert (rows.chance == 1).any() and (rows.n_tokens * rows.chance).sum() > 0.5 * total
    assert set(mixing.sample(docs).toPandas().doc_id) == set(rows[rows.kept].doc_id)
    edge = mixing.weigh(frame(spark)).collect()
    assert len(edge) == len(texts()) and all(r.n_tokens >= 1 and 0 <= r.chance <= 1 for r in edge)
    assert mixing.sample(frame(spark)).columns == frame(spark).columns
    assert mixing.weigh(frame(spark, [])).count() == 0 and mixing.sample(frame(spark, [])).count() == 0


def test_mixing_to_given_targets(spark, monkeypatch):
    """A hot source; cells as arrays and as a table give the same chances, and those meet the targets."""
    pick, rows = np.random.RandomState(3), []
    for i in range(3000):
        source = "hot" if i % 3 == 0 else f"s{pick.randint(4)}"
        lang = "en" if pick.rand() < (0.6 if source == "hot" else 0.4) else "de"
        rows.append((i, "word " * int(pick.randint(1, 30)), lang, source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    aim = {"source": {"hot": 0.2, "s0": 0.2, "s1": 0.2, "s2": 0.2, "s3": 0.2}, "lang": {"en": 0.45, "de": 0.55}}
    few = mixing.weigh(docs, aim).toPandas()
    for m in ("source", "lang"):
        got = (few.n_tokens * few.chance).groupby(few[m]).sum()
        assert abs(got / got.sum() / got.index.map(aim[m]) - 1).max() < 0.01
        kept = few[few.kept].groupby(m).n_tokens.sum()
        assert abs(kept / kept.sum() - kept.index.map(aim[m])).max() < 0.05
    without = mixing.weigh(docs, {"lang": {"de": 1.0}}).toPandas()
    assert not without[(without.lang == "en") & without.kept].size and without[without.lang == "de"].kept.any()
    monkeypatch.setattr(mixing, "FEW_CELLS", 1)
    many = mixing.weigh(docs, aim).toPandas()
    assert few.sort_values("doc_id").chance.round(5).tolist() == many.sort_values("doc_id").chance.round(5).tolist()


def toxic_rows(seed=1000, n=400):
    from tests.llm.cases import prose

    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        t = prose(seed + i, 60).split()
        if bad:
            t[30] = ["blarghole", "snivelrot", "zounderk"][i // 3 % 3]
        rows.append((i, " ".join(t)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_learns_and_tolerates_gaps(spark):
    rows, labels = toxic_rows()
    rows += [(1001, "a house blarg-hole river"), (1002, "b l a r g h o l e"), (1003, "quiet green river"), (1004, None), (1005, ""), (1006, "walk blarg hole over"), (1007, "sing blar gxhole by")]
    rows += [(1008, "the stone wind " * 30_000 + "blarghole " + "open close " * 30_000), (1009, "the stone wind. " * 30_000), (1010, "!!! ... \n\n ---"), (None, "snivelrot")]
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(frame(spark, rows), marked).collect()}
    held = [(got[i].score, i % 3 == 0) for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(400)) and got[None].held_out
    ranked = np.array([y for _, y in sorted(held, key=lambda x: -x[0])])
    precision = (ranked * np.cumsum(ranked) / np.arange(1, len(ranked) + 1)).sum() / ranked.sum()
    assert precision > 0.98 and np.mean([(s >= 0.5) == y for s, y in held]) > 0.97
    for i, want in ((1001, 1), (1002, 1), (1003, 0), (1006, 1), (1007, 1), (1008, 1), (1009, 0), (None, 1)):
        assert got[i].predicted == want, i
    assert got[1004].score == got[1005].score == got[1010].score < 0.5
    none = toxicity.score(frame(spark), marked.filter("doc_id < 0")).collect()
    assert len(none) == len(texts()) and {r.score for r in none} == {0.0}
    assert toxicity.score(frame(spark, []), marked).count() == 0


def brute_pieces(text):
    """Sentences cut into pieces, as words of folded letters, in plain Python."""
    out = []
    for sentence in re.split(r"[.!?](?=[\t-\r ]|$)|\n", text):
        words = ["".join(chr(96 + c) if 0 < c < 27 else chr(200 + c) for c in (int(toxicity.FOLD[x]) for x in w.encode()) if c != 255) for w in sentence.split()]
        words = [w for w in words if w]
        joined = []
        for k, w in enumerate(words):
            if k and len(w) == 1 and len(words[k - 1]) == 1:
                joined[-1] += w
            else:
                joined.append(w)
        if joined:
            count = max(1, -(-(len(joined) - toxicity.PIECE) // toxicity.STEP) + 1)
            out += [joined[toxicity.STEP * i : toxicity.STEP * i + toxicity.PIECE] for i in range(count)]
    return out


def brute_features(piece):
    """Weights of the triples of one instance, by walking over all of them."""
    s, out = " " + " ".join(piece) + " ", collections.Counter()
    for i in range(len(s)):
        for j in range(i + 1, len(s)):
            for k in range(j + 1, min(len(s), i + toxicity.SPAN)):
                ends = s[i] == " " or s[k] == " "
                if s[j] != " " and not (ends and " " in s[i + 1 : k]):
                    out[s[i] + s[j] + s[k]] += toxicity.DECAY ** (k - i + 1)
    length = math.sqrt(sum(v * v for v in out.values()))
    return {t: v / length for t, v in out.items()}


def test_toxicity_features_and_highest_sentence():
    samples = ["You id-iot, m0 ron! i d i o t x. A b\nwords of one. two", "aaaa aaaa aaaa aaaa aaaa. b", "é à ü 🙂 éé x", "One. two three four five six seven eight nine", "..!? a", "no stop at all " * 9]
    table = np.random.RandomState(5).randn(toxicity.LETTERS**3).astype(np.float32)
    code = lambda c: 0 if c == " " else ord(c) - 96 if ord(c) < 200 else ord(c) - 200
    for t in samples:
        text = toxicity.Letters(t.encode())
        want = brute_pieces(t)
        assert [[bytes(code(c) for c in w) for w in p] for p in want] == [[text.word(k) for k in range(a, b)] for a, b in zip(text.low, text.high)]
        decisions = []
        for i, p in enumerate(want):
            index, weight = toxicity.features(text.codes[text.starts[i] : text.ends[i]])
            brute = {code(x[0]) * 3600 + code(x[1]) * 60 + code(x[2]): v for x, v in brute_features(p).items()}
            assert index.tolist() == sorted(brute) and np.allclose(weight, [brute[x] for x in sorted(brute)])
            decisions.append(sum(v * float(table[x]) for x, v in brute.items()))
        best, at = toxicity.highest(text, table)
        assert abs(best - max(decisions)) < 1e-5 and abs(decisions[at] - best) < 1e-5


def test_toxicity_machine_equals_one_in_kernel_values():
    """With every instance a landmark, the machine is the support vector machine of the whole kernel matrix."""
    words = "you id iot moron fool the house green river stone wind talk sing".split()
    pick = np.random.RandomState(2)
    pieces = [" ".join(words[k] for k in pick.randint(0, len(words), 3)) for _ in range(40)]
    y = np.array([1.0 if "moron" in p or "fool" in p else -1.0 for p in pieces])
    found = [brute_features(p.split()) for p in pieces]
    kernel = np.array([[sum(v * b.get(t, 0.0) for t, v in a.items()) for b in found] for a in found])
    instances = [toxicity.features(t.codes) for t in (toxicity.Letters(p.encode()) for p in pieces)]
    basis = toxicity.Basis(instances)
    x = basis.project(instances)
    assert np.allclose(x @ x.T, kernel, atol=1e-6)
    weight, bias = toxicity.squared_hinge(x[y > 0], x[y < 0])
    # The same problem over coefficients of the instances, f = K a + b, by plain gradient steps on its optimum:
    # at the optimum a_i = 2 c_i y_i max(0, 1 - y_i f_i), and the sum of a is that of the constant's small rule.
    f = x @ weight + bias
    c = toxicity.COST * len(y) / 2 / np.where(y > 0, (y > 0).sum(), (y < 0).sum())
    a = 2 * c * y * np.maximum(0, 1 - y * f)
    assert np.allclose(kernel @ a + bias, f, atol=1e-4) and abs(a.sum() - 1e-6 * bias) < 1e-4
    table = basis.table(weight)
    for p, want in zip(pieces, f):
        assert abs(toxicity.highest(toxicity.Letters(p.encode()), table)[0] + bias - want) < 1e-3
