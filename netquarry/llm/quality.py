"""Quality classifier: a weak-label model over heuristic labellers, and a hashed linear scorer trained on its posteriors.

No human label is used. Labellers look at a document and vote good, bad or abstain; expectation-maximisation estimates
from all votes how accurate each is; the posterior of a document's votes is the label that the scorer learns.
"""

from __future__ import annotations

import math
import operator
import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm.common import bounded_batches, only_memo, slices, utf8

BAD, ABSTAIN, GOOD = 0, 1, 2
#: Size of the scorer's weight vector (a power of two).
DIMENSIONS = 1 << 16
#: Documents that the scorer is trained on, about; the choice goes by a hash of the row.
TRAIN_ROWS = 4000
MEMO_WORDS = 250_000
_punctuation = string.punctuation.encode()
_upper = string.ascii_uppercase.encode()
_decorated = re.compile(rb"[!-/:-@\\[-`{-~]{2,}(?:\s|$)")  # a word that ends in two signs or more
_shape = [(re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[0-9]+"), b"0")]


def below(x: float, good: float, bad: float) -> int:
    """Good under the first bound, bad over the second, between them an abstention."""
    return GOOD if x <= good else BAD if x > bad else ABSTAIN


#: name -> vote; each gets the facts of one document.
LABELLERS = {
    "symbols": lambda f: ABSTAIN if f["words"] < 10 else below(f["symbols"], 0.05, 0.12),
    "decorated": lambda f: below(f["decorated"], 0.05, 0.2),
    "capitals": lambda f: ABSTAIN if f["words"] < 10 else below(f["capitals"], 0.06, 0.3),
    "stutter": lambda f: below(f["stutter"], 0.02, 0.1),
    "top_word": lambda f: ABSTAIN if f["words"] < 20 else below(f["top_word"], 0.12, 0.25),
    "variety": lambda f: ABSTAIN if not 20 <= f["words"] <= 2000 else GOOD if f["variety"] >= 0.6 else BAD if f["variety"] < 0.35 else ABSTAIN,
    "bare_symbols": lambda f: below(f["bare_symbols"], 0.01, 0.1),
    "word_length": lambda f: ABSTAIN if f["words"] < 20 else GOOD if 3.5 <= f["word_length"] <= 7 else BAD if not 2.5 <= f["word_length"] <= 9 else ABSTAIN,
    "repeated_lines": lambda f: ABSTAIN if f["lines"] < 4 else below(f["repeated_lines"], 0.1, 0.3),
    "emptiness": lambda f: BAD if not f["words"] else ABSTAIN,
}


def facts(data: bytes, words: list[bytes]) -> dict[str, float]:
    n, size = len(words), len(data)
    lines = [x for x in data.split(b"\n") if x.strip()]
    return {
        "words": n, "lines": len(lines),
        "symbols": (size - len(data.translate(None, _punctuation))) / max(1, size),
        "capitals": (size - len(data.translate(None, _upper))) / max(1, size),
        "decorated": len(_decorated.findall(data)) / max(1, n),
        "stutter": sum(map(operator.eq, words, words[1:])) / max(1, n),
        "top_word": max(Counter(words).values(), default=0) / max(1, n),
        "variety": len(set(words)) / max(1, n),
        "bare_symbols": sum([not w.strip(_punctuation) for w in words]) / max(1, n),
        "word_length": len(data.decode()) / max(1, n) - 1,
        "repeated_lines": 1 - len(set(lines)) / max(1, len(lines)),
    }


def pattern(data: bytes, words: list[bytes]) -> int:
    """The labellers' votes as one number in base 3."""
    f, code = facts(data, words), 0
    for vote in LABELLERS.values():
        code = code * 3 + vote(f)
    return code


def votes_of(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(len(LABELLERS) - 1, -1, -1) % 3


class LabelModel:
    """Two classes; each labeller has a probability for good and bad votes in each class, votes being independent in a class.

    An abstention says nothing. At first a document is taken for bad if any labeller votes so.
    """

    def __init__(self, counts: dict[int, int], rounds: int = 100, smooth: float = 1.0):
        self.codes = np.array(sorted(counts), np.int64)
        weight = np.array([counts[c] for c in self.codes.tolist()], float)
        votes = votes_of(self.codes) if len(self.codes) else np.zeros((0, len(LABELLERS)), np.int64)
        one_hot = (votes[:, :, None] == np.arange(3)) & (np.arange(3) != ABSTAIN)
        good = np.where((votes == BAD).any(1), 0.1, 0.9)
        for _ in range(rounds):
            self.prior = (weight @ good + smooth) / (weight.sum() + 2 * smooth)
            self.tables = []
            for share in (1 - good, good):
                n = np.einsum("p,pjv->jv", weight * share, one_hot) + smooth
                n[:, ABSTAIN] = 0
                n /= n.sum(1, keepdims=True)
                n[:, ABSTAIN] = 1  # so that it leaves every product as it is
                self.tables.append(n)
            before, good = good, self.posteriors(votes)
            if len(good) and np.abs(good - before).max() < 1e-9:
                break
        self.posterior = dict(zip(self.codes.tolist(), good.tolist()))

    def of(self, code: int) -> float:
        """The probability that a document with this pattern of votes is good; the pattern need not have been counted."""
        if code not in self.posterior:
            self.posterior[code] = float(self.posteriors(votes_of(np.array([code])))[0])
        return self.posterior[code]

    def posteriors(self, votes: np.ndarray) -> np.ndarray:
        j = np.arange(len(LABELLERS))
        bad, good = (np.log(t[j, votes]).sum(1) + math.log(p) for t, p in zip(self.tables, (1 - self.prior, self.prior)))
        return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))

    def accuracies(self) -> dict[str, float]:
        """For each labeller the probability that it is right when it votes."""
        (bad, good), p = self.tables, self.prior
        right, cast = (1 - p) * bad[:, BAD] + p * good[:, GOOD], (1 - p) * (bad[:, BAD] + bad[:, GOOD]) + p * (good[:, BAD] + good[:, GOOD])
        return dict(zip(LABELLERS, (right / cast).tolist()))


class Features(dict):
    """Word -> packed hashed features: the word without case and its shape."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MEMO_WORDS:
            self.clear()
        shape = word
        for kind, sign in _shape:
            shape = kind.sub(sign, shape)
        packed = np.array([zlib.crc32(word.lower()) % DIMENSIONS, zlib.crc32(b"shape " + shape) % DIMENSIONS], np.uint32).tobytes()
        if len(word) < 100:
            self[word] = packed
        return packed


_features = Features()
_repeat = zlib.crc32(b"same word again") % DIMENSIONS


def features(words: list[bytes]) -> np.ndarray:
    """The document's hashed features, with repeats."""
    again = sum(map(operator.eq, words, words[1:]))
    return np.concatenate([np.frombuffer(b"".join(map(_features.__getitem__, words)), np.uint32), np.full(2 * again, _repeat, np.uint32)])


def train_scorer(rows: list[tuple[np.ndarray, float]], rounds: int = 8, rate: float = 2.0, decay: float = 1e-6) -> np.ndarray:
    """Logistic regression by AdaGrad over rows of (features, posterior); the last weight is the intercept."""
    w, seen = np.zeros(DIMENSIONS + 1), np.full(DIMENSIONS + 1, 1e-3)
    for _ in range(rounds):
        for x, y in rows:
            at, n = np.unique(x, return_counts=True)
            value = n / max(1, len(x))
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w[at] @ value) + w[-1]))))
            g = (p - y) * value + decay * w[at]
            seen[at] += g * g
            w[at] -= rate * g / np.sqrt(seen[at])
            seen[-1] += (p - y) ** 2
            w[-1] -= 0.1 * (p - y) / math.sqrt(seen[-1])
    return w.astype(np.float32)


def vote_counts(df: DataFrame, text_col: str = "text") -> dict[int, int]:
    """How many rows have each pattern of votes; at most 3 to the number of labellers, however many rows there are.

    A null text counts as empty; repeated rows count as often as they come; an empty table has no pattern.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for part in slices(batches):
            n.update([pattern(x, x.split()) for x in utf8(part.column("text"))])
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array(list(n.values()), pa.int64())], ["code", "n"])

    bounded_batches(df)
    counts = df.select(F.col(text_col).alias("text")).mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return {r.code: r.n for r in counts.collect()}


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> tuple[LabelModel, np.ndarray]:
    """The label model of all rows' votes, and the scorer trained on about `rows` of them.

    The sample goes by a hash of id and text, so repeated rows are in it together or not at all; a text of more than 20,000
    bytes is in it less often, as the bytes that it is longer. A null text counts as empty, a null id is an id like any
    other. An empty table gives a model without votes (every posterior 0.5) and weights of zero.
    """
    counts = vote_counts(df, text_col)
    model = LabelModel(counts)
    total = sum(counts.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = [(features(words).astype(np.int32), model.of(pattern(x, words))) for x in utf8(part.column("text")) for words in [x.split()]]
            yield pa.RecordBatch.from_arrays([part.column("u"), pa.array([x.tobytes() for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.float64())], ["u", "x", "y"])

    u = F.pmod(F.xxhash64(F.lit("quality"), id_col, text_col), F.lit(1 << 40))
    # the features of a text are as long as the text, so the sample is bounded in bytes too: long texts are rarer in it
    chance = F.least(F.lit(1.0), F.lit(rows / max(1, total)) * F.least(F.lit(1.0), F.lit(20_000.0) / F.greatest(F.lit(1), F.coalesce(F.octet_length(text_col), F.lit(0)))))
    sample = df.select(u.alias("u"), F.col(text_col).alias("text")).where(F.col("u") < chance * (1 << 40))
    got = sorted(sample.mapInArrow(run, "u long, x binary, y double").toLocalIterator(), key=lambda r: (r.u, r.y, bytes(r.x)))
    return model, train_scorer([(np.frombuffer(r.x, np.int32), r.y) for r in got])


def score(df: DataFrame, model: LabelModel, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, posterior, score) for every row: the label model's and the scorer's probability that the text is good.

    A null text counts as empty, which is a pattern of votes like any other and the scorer's intercept. Patterns that the
    model was not made from have a posterior too. Rows are independent: repeated rows and null ids come out as they came in; an empty table gives an empty one; other columns of
    df are not read. What is sent along has a fixed size (the weights) or one entry for each pattern of votes.
    """
    sent = df.sparkSession.sparkContext.broadcast((weights, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_memo("quality", _features.clear)
        w, labels = sent.value
        for part in slices(batches):
            p, s = [], []
            for x in utf8(part.column("text")):
                words = x.split()
                at = features(words)
                p.append(labels.of(pattern(x, words)))
                s.append(1 / (1 + math.exp(-max(-30.0, min(30.0, (float(w[at].mean()) if len(at) else 0.0) + float(w[-1]))))))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(p, pa.float64()), pa.array(s, pa.float64())], ["id", "posterior", "score"])

    bounded_batches(df)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, posterior double, score double").withColumnRenamed("id", id_col)
