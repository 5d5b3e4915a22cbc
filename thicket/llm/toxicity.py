"""Toxicity by a support vector machine on a gap-weighted subsequence string kernel.

Instances are sentences; one of more than `PIECE` words is cut into overlapping pieces of that many, so
that an insult is not drowned in a long one. The kernel compares two of them by the subsequences of
three letters that they share: letters may have gaps, up to a span of `SPAN`, and each occurrence weighs
`DECAY` to the power of its span. A space is a gap too, so `id-iot`, `idxiot`, `id iot` and `i d io t` stay
near `idiot`; at either end of a subsequence within one word, a word's edge counts as a letter. Kernel
values are divided by the lengths of both feature vectors. Case, accents on ASCII letters' places and common
digit-for-letter swaps are folded, punctuation is dropped, and words of one letter in a row are put
together.

Labels belong to documents, and their sentences inherit them: those of clean documents are negative, and of a
toxic one some sentence is positive. First, that is any with a word that toxic documents have significantly
oftener; then, as usual with such bags, the one that the machine ranks highest, and the machine is trained
anew, with those sentences of clean documents that came near the margin. Nyström landmarks (some of the
positive instances, some of the negative ones) span the feature space, and the machine is a linear one in it
(squared hinge loss, Newton's steps).

A decision of that machine is linear in the subsequences, so the landmarks fold into one table with a weight for
each triple of letters: prefix sums over a whole text give the undivided decision of every sentence. A
document's figure is its highest sentence's decision; lengths are counted out only for the sentences that bounds
leave. A logistic curve, fitted on a fourth of the labelled documents that the machine was not trained on, and
weighted back to their true shares, makes it a score from 0 to 1.

Training rows are at most `most` of each label, those with the least hash of the id, of up to `LONGEST`
characters; that bounds what the driver holds. All documents are scored over whole texts.

Defined cases: a null or empty text, or one without letters, scores as a text whose only sentence has the
decision 0; without examples of both labels every score is the share of label 1 (0 if there are no labels);
contradictory labels of one doc_id both count; repeated rows score alike; a null doc_id is held out; texts of
any length are scored whole; an empty table gives an empty result; other columns are never read, whatever their
names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

SPAN, DECAY = 5, 0.6
PIECE, STEP = 4, 2  # words; any run of PIECE - STEP + 1 words lies in one piece
LETTERS = 60  # 0 is a word's edge, 1 to 26 are letters, 27 is a digit, the rest are letters beyond ASCII
MOST, LONGEST = 1200, 20_000
LANDMARKS, NEGATIVES, ROUNDS, COST = 800, 5000, 3, 30.0
#: Sentences whose lengths are counted out at a time.
TOGETHER = 12
#: Words that tell the first positive sentences, at most, and the least likelihood-ratio statistic of one (about
#: 1 in 10,000 by chance).
SEEDS, SURE = 400, 15.0
#: Digits and signs written for letters.
SWAPS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}
_DROP = 255


def _folding() -> np.ndarray:
    """The letter of each byte of UTF-8: white space separates, other signs and first bytes of a
    character beyond ASCII are dropped (later bytes tell its letters apart, in either case)."""
    table = np.full(256, _DROP, dtype=np.uint8)
    for i in range(26):
        table[ord("a") + i] = table[ord("A") + i] = i + 1
    for digit in "0123456789":
        table[ord(digit)] = 27
    for sign, letter in SWAPS.items():
        table[ord(sign)] = ord(letter) - 96
    table[[9, 10, 11, 12, 13, 32]] = 0
    table[0x80:0xC0] = 28 + (np.arange(0x80, 0xC0) & 0x1F)
    return table


FOLD = _folding()


class Letters:
    """A text's folded letters: each sentence's words with a 0 before, between and after them."""

    def __init__(self, raw: bytes):
        data = np.frombuffer(raw, dtype=np.uint8)
        codes = FOLD[data]
        space = np.append(codes == 0, True)
        ends = ((data == 46) | (data == 33) | (data == 63)) & space[1:] | (data == 10)
        held = codes != _DROP
        sentence = np.cumsum(ends) - ends
        codes, sentence = codes[held], sentence[held]
        inside = codes != 0
        letters, sentence = codes[inside], sentence[inside]
        self.codes, self.starts, self.ends = np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.words = self.starts
        if not len(letters):
            return
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        starts = first[inside]
        starts[1:] |= sentence[1:] != sentence[:-1]
        starts = np.flatnonzero(starts)
        of = sentence[starts]  # each word's sentence
        size = np.diff(np.append(starts, len(letters)))
        joins = (size[1:] == 1) & (size[:-1] == 1) & (of[1:] == of[:-1])  # spelled-out words
        keep = np.append(True, ~joins)
        starts, of = starts[keep], of[keep]
        size = np.diff(np.append(starts, len(letters)))
        opens = np.append(True, of[1:] != of[:-1])
        before = np.cumsum(opens) + np.arange(len(starts))  # zeros before each word
        self.codes = np.zeros(len(letters) + len(starts) + int(opens.sum()), dtype=np.uint8)
        self.codes[np.arange(len(letters)) + np.repeat(before, size)] = letters
        self.words = starts + before  # where each word starts
        self.sizes = size
        # Pieces: words from `low` to before `high`.
        edges = np.append(np.flatnonzero(opens), len(starts))
        count = np.diff(edges)
        pieces = np.maximum(1, -(-(count - PIECE) // STEP) + 1)
        low = np.repeat(edges[:-1], pieces) + STEP * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        high = np.minimum(low + PIECE, np.repeat(edges[1:], pieces))
        self.starts = self.words[low] - 1
        self.ends = self.words[high - 1] + size[high - 1] + 1
        self.low, self.high = low, high

    def word(self, i: int) -> bytes:
        return self.codes[self.words[i] : self.words[i] + self.sizes[i]].tobytes()


def triples(codes: np.ndarray):
    """(offset of the third letter, index of the triple, whether it counts) for each gap, by its first letter."""
    n = len(codes)
    one = codes.astype(np.int32)
    two, three = one * LETTERS, one * (LETTERS * LETTERS)
    edge = codes == 0
    spaces = np.concatenate([[0], np.cumsum(edge, dtype=np.int32)])
    for b in range(2, SPAN):
        if n <= b:
            return
        between = spaces[b:n] != spaces[1 : n - b + 1]  # a space inside
        whole = ~(between & (edge[: n - b] | edge[b:]))
        for a in range(1, b):
            # Where the next sentence starts, two zeros stand in a row: nothing reaches across them.
            yield b, three[: n - b] + two[a : n - b + a] + one[b:], whole & ~edge[a : n - b + a]


def features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The feature vector of one instance: indexes of its triples and their weights, divided by its length."""
    found = [(index[ok], DECAY ** (b + 1)) for b, index, ok in triples(codes)]
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    index, again = np.unique(np.concatenate([i for i, _ in found]), return_inverse=True)
    weight = np.bincount(again, np.repeat([w for _, w in found], [len(i) for i, _ in found]), len(index))
    return index, weight / (np.sqrt(weight @ weight) or 1.0)


def _lengths(found: list, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The lengths of some pieces' feature vectors; found: the triples of the whole text."""
    keys, weights = [], []
    for b, index, ok in found:
        size = np.maximum(ends - b - starts, 0)
        piece = np.repeat(np.arange(len(starts)), size)
        at = np.repeat(starts - np.cumsum(size) + size, size) + np.arange(size.sum())
        good = ok[at]
        keys.append(piece[good] * LETTERS**3 + index[at[good]])
        weights.append(np.full(len(keys[-1]), DECAY ** (b + 1)))
    every, weight = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(every, kind="stable")
    every, weight = every[order], weight[order]
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    sums = np.add.reduceat(weight, first)
    return np.sqrt(np.bincount(every[first] // LETTERS**3, sums * sums, len(starts)))


def highest(text: Letters, table: np.ndarray) -> tuple[float, int]:
    """The highest decision, without the constant, of a text's pieces, and that piece; (0, -1) without any."""
    if not len(text.starts):
        return 0.0, -1
    n, starts, ends = len(text.codes), text.starts, text.ends
    total, square, most = (np.zeros(len(starts)) for _ in range(3))
    found = list(triples(text.codes))
    for b in range(2, SPAN):
        same = [(index, ok) for c, index, ok in found if c == b]
        if not same:
            break
        first, last = np.minimum(starts, n - b), np.maximum(np.minimum(ends - b, n - b), np.minimum(starts, n - b))
        run = np.zeros(n - b + 1)
        np.cumsum(sum(table[index] * ok for index, ok in same), out=run[1:])
        total += (run[last] - run[first]) * DECAY ** (b + 1)
        np.cumsum(sum(ok.astype(np.float64) for _, ok in same), out=run[1:])
        count = run[last] - run[first]
        square += count * DECAY ** (2 * b + 2)
        most += count * DECAY ** (b + 1)
    # An instance's length is at least that of distinct triples, and at most that of one triple all over.
    some = square > 0
    bound = np.zeros(len(starts))
    bound[some] = total[some] / np.where(total[some] > 0, np.sqrt(square[some]), most[some])
    best, at = -np.inf, -1
    order = np.argsort(-bound, kind="stable")
    for low in range(0, len(order), TOGETHER):
        now = order[low : low + TOGETHER]
        if bound[now[0]] <= best:
            break
        value, asked = np.zeros(len(now)), some[now]
        if asked.any():
            value[asked] = total[now[asked]] / _lengths(found, starts[now[asked]], ends[now[asked]])
        top = int(value.argmax())
        if value[top] > best:
            best, at = float(value[top]), int(now[top])
    return best, at


class Basis:
    """Projects instances on the span of landmarks; holds only the triples that occur in them."""

    def __init__(self, landmarks: list[tuple[np.ndarray, np.ndarray]]):
        self.columns = np.unique(np.concatenate([index for index, _ in landmarks]))
        self.place = np.full(LETTERS**3, len(self.columns), dtype=np.int32)  # the last column stays 0
        self.place[self.columns] = np.arange(len(self.columns))
        marks = np.zeros((len(landmarks), len(self.columns) + 1))
        for i, (index, weight) in enumerate(landmarks):
            marks[i, self.place[index]] = weight
        values, vectors = np.linalg.eigh(marks @ marks.T)
        good = values > 1e-9 * values[-1]
        # Nyström: an instance's features are its kernel values with the landmarks times this root.
        self.rows = marks.T @ (vectors[:, good] / np.sqrt(values[good]))

    def project(self, instances: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return np.array([weight @ self.rows[self.place[index]] for index, weight in instances]).reshape(len(instances), self.rows.shape[1])

    def table(self, weight: np.ndarray) -> np.ndarray:
        """The weight of each triple of letters in the decision that `weight` makes on features."""
        out = np.zeros(LETTERS**3, dtype=np.float32)
        out[self.columns] = (self.rows @ weight)[:-1]
        return out


class Machine:
    """The landmarks' machine folded into a table of triples, and its curve for documents."""

    def __init__(self, toxic: list[str], clean: list[str], shares: tuple[int, int] = (0, 0)):
        """shares: how many rows of label 1 and 0 there are in all, before the sample."""
        counts = shares if sum(shares) else (len(toxic), len(clean))
        self.table, self.bias, self.slope, self.shift = np.zeros(LETTERS**3, dtype=np.float32), 0.0, 0.0, 0.0
        self.constant = counts[0] / sum(counts) if sum(counts) else 0.0
        self.fitted = bool(toxic and clean)
        if not self.fitted:
            return
        texts = [[Letters(t.encode()) for t in part] for part in (toxic, clean)]
        # Every fourth document is left to the curve; a lone one serves for both.
        bags = [[t for i, t in enumerate(part) if i % 4 != 3] for part in texts]
        held = [part[3::4] or part for part in texts]
        order = np.random.RandomState(7)
        seeds = set(self._seeds(*([{t.word(i) for i in range(len(t.words))} for t in part] for part in bags)))
        negative = self._some(bags[1], order, NEGATIVES)
        positive = [(t, i) for t in bags[0] for i in range(len(t.starts)) if any(t.word(w) in seeds for w in range(t.low[i], t.high[i]))]
        if not positive or not negative:
            self.fitted = False
            return
        start = self._features([positive[i] for i in sorted(order.permutation(len(positive))[:NEGATIVES])])
        plain = self._features(negative)
        basis = Basis([*(start[i] for i in order.permutation(len(start))[: LANDMARKS // 2]), *plain[: LANDMARKS // 2]])
        first, rest = basis.project(start), basis.project(plain)
        found, near = first, rest[:0]
        for k in range(ROUNDS):
            weight, self.bias = squared_hinge(found, np.vstack([rest, near]))
            self.table = basis.table(weight)
            if k + 1 < ROUNDS:
                tops = [(t, *highest(t, self.table)) for t in bags[0]]
                found = basis.project(self._features([(t, i) for t, s, i in tops if i >= 0 and s + self.bias > -0.5]) or start)
                close = [(t, *highest(t, self.table)) for t in bags[1]]
                near = np.vstack([near, basis.project(self._features([(t, i) for t, s, i in close if i >= 0 and s + self.bias > -0.9]))])
        x = np.array([highest(t, self.table)[0] + self.bias for part in held for t in part])
        y = np.repeat([1.0, 0.0], [len(part) for part in held])
        weights = np.repeat([counts[0] / len(held[0]), counts[1] / len(held[1])], [len(part) for part in held])
        self.slope, self.shift = _curve(x, y, weights / weights.sum())

    @staticmethod
    def _some(bags: list[Letters], order: np.random.RandomState, most: int) -> list[tuple[Letters, int]]:
        every = [(t, i) for t in bags for i in range(len(t.starts))]
        return [every[i] for i in order.permutation(len(every))[:most]]

    @staticmethod
    def _features(pieces: list[tuple[Letters, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
        return [features(t.codes[t.starts[i] : t.ends[i]]) for t, i in pieces]

    @staticmethod
    def _seeds(toxic: list[set], clean: list[set]) -> list[bytes]:
        """Words of three letters or more that toxic documents have significantly oftener, strongest first."""
        count: dict[bytes, list[int]] = {}
        for k, part in enumerate((toxic, clean)):
            for bag in part:
                for w in bag:
                    if len(w) > 2:
                        count.setdefault(w, [0, 0])[k] += 1
        found, total = [], len(toxic) + len(clean)
        for w, (a, b) in count.items():
            wanted = (a + b) * len(toxic) / total
            if a > 1 and a > 1.5 * wanted:
                table = ((a, wanted), (b, a + b - wanted), (len(toxic) - a, len(toxic) - wanted), (len(clean) - b, len(clean) - a - b + wanted))
                found.append((-2 * sum(n * np.log(n / m) for n, m in table if n), w))  # the likelihood-ratio statistic
        return [w for g, w in sorted(found)[:SEEDS] if g <= -SURE]

    def figure(self, raw: bytes) -> float:
        return highest(Letters(raw), self.table)[0] + self.bias

    def score(self, raw: bytes) -> float:
        if not self.fitted:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.figure(raw) + self.shift, -60, 60))))


def squared_hinge(positive: np.ndarray, negative: np.ndarray) -> tuple[np.ndarray, float]:
    """Both classes weigh the same; the constant is not regularised."""
    x = np.vstack([positive, negative])
    x = np.hstack([x, np.ones((len(x), 1))])
    y = np.repeat([1.0, -1.0], [len(positive), len(negative)])
    c = COST * len(x) / 2 / np.repeat([len(positive), len(negative)], [len(positive), len(negative)])
    rule = np.eye(x.shape[1])
    rule[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])

    def loss(w):
        return 0.5 * w @ rule @ w + (c * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()

    for _ in range(100):
        on = y * (x @ w) < 1
        part, cost = x[on], c[on]
        step = np.linalg.solve(rule + 2 * (part * cost[:, None]).T @ part, 2 * part.T @ (cost * y[on])) - w
        size, now = 1.0, loss(w)
        while loss(w + size * step) > now and size > 1e-4:
            size /= 2
        w = w + size * step
        if size * np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic regression in one variable with a light penalty, by Newton's steps with halving."""

    def loss(p):
        z = p[0] * x + p[1]
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + 1e-5 * (p**2).sum()

    p = np.zeros(2)
    for _ in range(100):
        q = 1 / (1 + np.exp(-(p[0] * x + p[1])))
        g = np.array([(weight * (q - y) * x).sum(), (weight * (q - y)).sum()]) + 2e-5 * p
        h = weight * q * (1 - q)
        hess = np.array([[(h * x * x).sum(), (h * x).sum()], [(h * x).sum(), h.sum()]]) + 2e-5 * np.eye(2)
        step = np.linalg.solve(hess, g)
        size = 1.0
        while loss(p - size * step) > loss(p) and size > 1e-6:
            size /= 2
        p = p - size * step
        if np.abs(step).max() * size < 1e-9:
            break
    return max(0.0, float(p[0])), float(p[1])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Machine:
    """The machine from at most `most` labelled rows of each label outside the held-out part."""
    docs = scratch.only(docs, "doc_id", "text")
    known = scratch.only(labels, "doc_id", "toxic").filter(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts: dict[int, list[str]] = {}
    for k in (1, 0):
        fits = docs.filter(F.length("text") <= LONGEST).join(known.filter(F.col("toxic") == k).select("doc_id").distinct(), "doc_id", "left_semi")
        ids = [r.doc_id for r in fits.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]
        rows = docs.filter(F.col("doc_id").isin(ids) & (F.length("text") <= LONGEST))  # of a repeated id one text
        texts[k] = [r.text for r in sorted(rows.groupBy("doc_id").agg(F.min("text").alias("text")).collect())] if ids else []
    return Machine(texts[1], texts[0], (counts.get(1, 0), counts.get(0, 0)))


def score(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, held_out, score and predicted."""
    spark = docs.sparkSession
    scratch.workers_import(spark)
    sent = spark.sparkContext.broadcast(train(docs, labels, most))  # one weight for each triple of letters

    def run(batches):
        machine = sent.value
        for batch in batches:
            scores = [machine.score(x.as_py() or b"") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = scratch.only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
