"""Quality rules as weak supervision.

Each rule reads a text's statistics and votes good (+1), bad (-1) or abstains (0). No rule decides
alone: an expectation-maximisation over all documents' votes estimates, without labels, each rule's
accuracy and the share of good documents, and a document's posterior probability of being good
replaces all-must-pass filtering.

Only the count of each vote pattern enters the estimate, so one aggregation with map-side sums
gives at most 3 ** len(RULES) rows, whatever the corpus holds; the iterations run on those.

Words are runs of other characters than space and U+0009 to U+000D; lines end at U+000A.

Defined cases: a null or empty text has no words: its counts are 0, its base check fails and every
rule abstains but those that its statistics allow; repeated rows each vote and each are returned; an
empty table gives an empty result; columns besides the id and text are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

#: Frequent function words of the languages in hand.
COMMON = frozenset(
    b"the of and to in is that it for was on are as with his they at be this from have or by not but what "
    b"la le les de des du un une et est en que qui dans pour par sur pas avec au ce il elle son "
    b"der die das und ist von zu den mit nicht ein eine auf dem sich als auch es an werden "
    b"el los las y del se por con no su al lo como para una ".split()
)
#: Symbols counted, and characters that separate words.
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
#: A text with fewer words, or a larger share of words in repeated three-word windows, fails at once.
LEAST_WORDS, MOST_REPEATED = 50, 0.5

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATS = [*COUNTS, "n_lines", "n_upper", "n_letters", "n_common", "n_distinct", "n_ends", "n_alpha_words"]


def text_stats(raw: bytes) -> list[int]:
    """The statistics named in STATS, of one whole text in UTF-8."""
    words = raw.split()  # bytes split at exactly the six separators
    n = len(words)
    of = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    chars = len(raw) - int(of[0x80:0xC0].sum())
    upper, lower = int(of[65:91].sum()), int(of[97:123].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    if n > 2:
        windows = list(zip(words, words[1:], words[2:]))
        seen = Counter(windows)
        if len(seen) < len(windows):
            until = 0
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeated += i + 3 - max(i, until)
                    until = i + 3
    per = Counter(words)
    common = sum(per[w] for w in per.keys() & COMMON)
    alpha = sum(k for w, k in per.items() if w.strip(b".,;:!?'\"()").replace(b"-", b"").isalpha() or not w.isascii())
    ends = sum(k for w, k in per.items() if w.endswith((b".", b"?", b"!")) and not w.endswith(b"!!"))
    symbols = sum(int(of[c]) for c in SYMBOLS)
    words_chars = chars - sum(int(of[c]) for c in SPACES)
    letters = upper + lower + int(of[0xC0:].sum())
    return [n, words_chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), upper, letters, common, len(per), ends, alpha]


def _stats(batches):
    names = ["doc_id", *STATS]
    for batch in batches:
        raw = batch.column(1)
        rows = [text_stats(x.as_py() or b"") for x in raw]
        columns = list(zip(*rows)) if rows else [[] for _ in STATS]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=names)


def _vote(bad, good=None):
    vote = F.when(bad, -1)
    return (vote if good is None else vote.when(good, 1)).otherwise(0).cast("tinyint")


def _share(part: str, whole: str):
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def rules() -> dict:
    """Name and vote of each rule. Most know one symptom of bad text and abstain without it."""
    some, more = F.col("n_words") >= 10, F.col("n_words") >= 50
    common, ends = _share("n_common", "n_words"), _share("n_ends", "n_words")
    return {
        "symbols": _vote(_share("n_symbols", "n_words") > 0.2),
        "word_size": _vote(~_share("word_chars", "n_words").between(2.0, 14.0)),
        "lines": _vote((F.col("n_lines") >= 3) & (_share("n_dup_lines", "n_lines") > 0.3)),
        "windows": _vote(_share("n_repeat_words", "n_words") > 0.3),
        "case": _vote(some & (_share("n_upper", "n_letters") > 0.4)),
        "variety": _vote(more & (_share("n_distinct", "n_words") < 0.1)),
        "letters": _vote(some & (_share("n_alpha_words", "n_words") < 0.75)),
        "function_words": _vote(some & (common < 0.03), some & (common >= 0.08)),
        "sentences": _vote(more & (ends < 0.005), some & ends.between(0.02, 0.4)),
    }


#: Columns of a model's rates: bad, abstain, good.
VOTES = (-1, 0, 1)


def fit(patterns: list[tuple[list[int], int]], iterations: int = 200) -> tuple[float, list]:
    """Expectation-maximisation over (votes, count): the share of good documents, and for each rule
    and class (good, bad) the rates of voting bad, abstaining and voting good.

    A rule's accuracy on a class is its rate of right votes there against its rate of wrong ones.
    Rules are held to be no worse than chance, which tells the classes apart; one pseudo-document
    for each vote keeps the rates off 0 and 1.
    """
    if not patterns:
        return 0.5, []
    votes = np.array([v for v, _ in patterns])
    count = np.array([c for _, c in patterns], dtype=float)
    cast = np.stack([votes == v for v in VOTES], axis=2).astype(float)  # pattern, rule, vote
    overall = (count[:, None, None] * cast).sum(axis=0) / count.sum()
    rates = np.stack([overall * (0.2, 1, 1) + (0.01, 0.01, 0.1), overall * (4, 1, 0.5) + (0.1, 0.01, 0.01)], axis=1)
    rates /= rates.sum(axis=2, keepdims=True)
    good = 0.8
    for _ in range(iterations):
        p = _posterior(cast, good, rates)
        was, was_good = rates, good
        good = float(np.clip((count * p).sum() / count.sum(), 0.01, 0.99))
        rates = np.stack([((count * w)[:, None, None] * cast).sum(axis=0) for w in (p, 1 - p)], axis=1) + 1.0
        rates /= rates.sum(axis=2, keepdims=True)
        for vote, better in ((0, 1), (2, 0)):  # a bad vote is no rarer on bad documents, a good one on good
            wrong = rates[:, better, vote] < rates[:, 1 - better, vote]
            rates[wrong, :, vote] = rates[wrong, :, vote].mean(axis=1, keepdims=True)
        rates /= rates.sum(axis=2, keepdims=True)
        if abs(was_good - good) < 1e-9 and np.abs(was - rates).max() < 1e-9:
            break
    return good, rates.tolist()


def _posterior(cast: np.ndarray, good: float, rates: np.ndarray) -> np.ndarray:
    odds = np.log(rates[:, 0] / rates[:, 1])  # rule, vote
    log_odds = math.log(good / (1 - good)) + np.einsum("prv,rv->p", cast, odds)
    return 1 / (1 + np.exp(-np.clip(log_odds, -700, 700)))


def posterior(votes: list[list[int]], model: tuple[float, list]) -> list[float]:
    """The probability that a document with these votes is good."""
    if not votes:
        return []
    cast = np.stack([np.array(votes) == v for v in VOTES], axis=2).astype(float)
    return _posterior(cast, model[0], np.array(model[1])).tolist()


def _model(stats: DataFrame) -> tuple[DataFrame, list[str]]:
    """The posterior of each vote pattern that occurs, at most 3 ** 9 of them."""
    votes = [f"vote_{n}" for n in rules()]
    found = sorted(stats.groupBy(*votes).agg(F.count(F.lit(1)).alias("n")).collect())
    patterns = [list(r[:-1]) for r in found]
    model = fit([(p, r[-1]) for p, r in zip(patterns, found)])
    rows = [(*p, q) for p, q in zip(patterns, posterior(patterns, model))]
    return stats.sparkSession.createDataFrame(rows, ", ".join(f"{v} tinyint" for v in votes) + ", posterior double"), votes


def score(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, kept, the posterior and each rule's vote (`vote_...`)."""
    scratch.workers_import(docs.sparkSession)
    schema = ", ".join(f"{c} long" for c in ["doc_id", *STATS])
    texts = scratch.only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    cast = [v.alias(f"vote_{n}") for n, v in rules().items()]
    stats = scratch.table(texts.mapInArrow(_stats, schema).select("doc_id", *COUNTS, *cast), "quality")
    of, votes = _model(stats)
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return (
        stats.join(F.broadcast(of), votes)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("posterior") >= threshold))
        .select("doc_id", *COUNTS, "base_failed", "kept", "posterior", *votes)
    )


def _stats_column(raw: pa.Array) -> pa.Array:
    rows = [text_stats(x.as_py() or b"") for x in raw]
    columns = list(zip(*rows)) if rows else [[] for _ in STATS]
    scratch.trim()
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=STATS)


def keep(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents kept, with the input's columns.

    Statistics are computed twice, once to count the votes and once beside the rows, so that neither a copy of
    the rows nor a join by id is needed and repeated or missing ids don't matter. Only texts go to Python.
    """
    scratch.workers_import(docs.sparkSession)
    rows, back = scratch.beside(docs, "text")
    whole = [f"c{i}" for i in range(len(back))]
    # Called deterministic it would be run once for the filter and again for the votes.
    measure = F.arrow_udf(_stats_column, ", ".join(f"{s} long" for s in STATS)).asNondeterministic()
    rows = rows.select(*whole, measure(F.col("text").cast("binary")).alias("of")).select(*whole, "of.*")
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    cast = [v.alias(f"vote_{n}") for n, v in rules().items()]
    rows = rows.select(*whole, *cast, failed.alias("failed"))
    of, votes = _model(rows)
    return rows.filter("NOT failed").join(F.broadcast(of), votes).filter(F.col("posterior") >= threshold).select(*back)
