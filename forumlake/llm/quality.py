"""Quality classifier from weak labels.

1. Heuristic labellers vote junk, good or nothing on every document.
2. Votes are summed up by pattern (at most 3 ** labellers rows, whatever the corpus), and
   expectation-maximisation on the patterns estimates each labeller's accuracy and the
   share of good documents.
3. The posterior of its pattern is a document's soft label. A hashed linear scorer is
   fitted to the soft labels of a bounded sample (``SAMPLE`` documents, chosen by a hash
   of the id), and then scores every document.

Nothing is shuffled but the vote patterns. Defined results: a NULL or empty text draws no
votes and is scored like any other; repeated rows score alike; NULL ids give NULL ids and
are never in the sample; other columns pass through; an empty table gives an empty one
and a scorer that accepts everything.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from forumlake.llm.common import byte_texts, named_again, numbered, with_fields

SAMPLE = 20_000  # documents that the scorer is fitted to, at most (in expectation)
WIDTH = 1 << 12  # hashed features
THRESHOLD = 0.5
GOOD, JUNK, NOTHING = 1, -1, 0
_NOT_CAPITALS = bytes(set(range(256)) - set(range(65, 91)))
_NOT_LETTERS = bytes(set(range(128)) - set(range(65, 91)) - set(range(97, 123)))
_SHAPE = bytes(ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else ord("0") if 48 <= c <= 57 else c for c in range(256))
_RUNS = re.compile(rb"(.)\1+")


@dataclass(frozen=True)
class Shares:
    """What the labellers look at, as shares of a text's words (or letters)."""

    words: int
    bars: float
    symbols: float
    capitals: float
    shouts: float
    echoes: float
    distinct: float
    ends: float


def shares(text: bytes, words: list[bytes]) -> Shares:
    n = max(1, len(words))
    letters = max(1, len(text.translate(None, _NOT_LETTERS)))
    return Shares(
        len(words),
        words.count(b"|") / n,
        sum(map(text.count, (b"*", b"#", b"$", b"%", b"&"))) / n,
        len(text.translate(None, _NOT_CAPITALS)) / letters,
        text.count(b"!") / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        len(set(words)) / n,
        sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / n,
    )


def votes(s: Shares) -> tuple[int, ...]:
    """One vote per labeller. Most know one kind of junk and say nothing of the rest: a text
    without bars is not good for that. Two speak for both sides, with a gap between."""
    if s.words < 5:
        return (NOTHING,) * 7
    junk = lambda found: JUNK if found else NOTHING
    both = lambda good, bad: JUNK if bad else GOOD if good else NOTHING
    return (
        junk(s.bars > 0.1),
        junk(s.symbols > 0.3),
        junk(s.capitals > 0.3),
        junk(s.shouts > 0.2),
        junk(s.echoes > 0.15),
        both(s.distinct > 0.3, s.distinct < 0.15) if s.words >= 50 else NOTHING,
        both(s.ends < 0.3, s.ends > 0.5),
    )


LABELLERS = ("bars", "symbols", "capitals", "shouts", "echoes", "distinct", "ends")


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents, and P(vote | class) by labeller: [labeller, class (junk, good), vote + 1]."""

    good: float
    given: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(good | votes) of each row of votes; a silent labeller says nothing."""
        prior = np.log([max(1 - self.good, 1e-9), max(self.good, 1e-9)])
        ratio = np.tile(prior, (len(patterns), 1))
        for k in range(patterns.shape[1]):
            said = patterns[:, k] != NOTHING
            ratio[said] += np.log(self.given[k][:, patterns[said, k] + 1]).T
        return 1 / (1 + np.exp(np.clip(ratio[:, 0] - ratio[:, 1], -50, 50)))

    def accuracies(self) -> dict[str, float]:
        """Share of a labeller's votes that are right."""
        right = self.given[:, 1, 2] * self.good + self.given[:, 0, 0] * (1 - self.good)
        wrong = self.given[:, 1, 0] * self.good + self.given[:, 0, 2] * (1 - self.good)
        return dict(zip(LABELLERS, (right / np.maximum(right + wrong, 1e-9)).tolist()))


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> LabelModel:
    """Expectation-maximisation over vote patterns; it starts from "junk if any labeller says so"."""
    p = np.where((patterns == JUNK).any(axis=1), 0.1, 0.9)
    for _ in range(rounds):
        weight = np.stack([(1 - p) * counts, p * counts])
        given = np.empty((patterns.shape[1], 2, 3))
        for k in range(patterns.shape[1]):
            for v in (JUNK, NOTHING, GOOD):
                given[k, :, v + 1] = (weight[:, patterns[:, k] == v].sum(axis=1) + 0.5) / (weight.sum(axis=1) + 1.5)
        model = LabelModel(float((weight[1].sum() + 1) / (counts.sum() + 2)), given)
        now = model.posterior(patterns)
        if np.abs(now - p).max(initial=0) < 1e-6:
            break
        p = now
    return model


class Features:
    """Hashed features of a text: word shapes, pairs of shapes, and coarse shares."""

    def __init__(self) -> None:
        self.shapes: dict[bytes, bytes] = {}

    def shape(self, word: bytes) -> bytes:
        found = self.shapes.get(word)
        if found is None:
            if len(self.shapes) > 300_000:
                self.shapes = {}
            found = self.shapes[word] = _RUNS.sub(rb"\1", word.translate(_SHAPE))[:12]
        return found

    def __call__(self, words: list[bytes], s: Shares) -> tuple[list[int], list[float]]:
        shapes = list(map(self.shape, words))
        found: Counter = Counter()
        n = max(1, len(words))
        for shape, count in Counter(shapes).items():
            found[zlib.crc32(shape) % WIDTH] += count / n
        for (a, b), count in Counter(zip(shapes, shapes[1:])).items():
            found[zlib.crc32(a + b" " + b) % WIDTH] += count / n
        for name in ("bars", "symbols", "capitals", "shouts", "echoes", "distinct", "ends"):
            step = min(10, int(getattr(s, name) * 10)) if s.words >= 5 else -1
            found[zlib.crc32(b"%s=%d" % (name.encode(), step)) % WIDTH] += 1.0
        return list(found.keys()), list(found.values())


def vote_rows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(votes(shares(b, b.split()))) for b in byte_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "votes"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(each, "doc_id bigint, votes array<int>")


def sample_rows(docs: DataFrame, id_col: str, text: str, total: int) -> list:
    """Features and votes of the sampled documents."""
    share = min(1.0, SAMPLE / max(1, total))
    chosen = F.pmod(F.xxhash64(F.col(id_col).cast("bigint")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    some = docs.where(F.col(id_col).isNotNull() & chosen).select(F.col(text).alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            rows = []
            for body in byte_texts(batch.column(0)):
                words = body.split()
                s = shares(body, words)
                rows.append((list(votes(s)), *features(words, s)))
            columns = list(zip(*rows)) if rows else [[]] * 3
            kinds = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["votes", "places", "weights"])

    return some.mapInArrow(each, "votes array<int>, places array<int>, weights array<float>").toArrow()


def fit_scorer(places: list[np.ndarray], values: list[np.ndarray], soft: np.ndarray, steps: int = 300, rate: float = 0.5, decay: float = 1e-5) -> np.ndarray:
    """Weights of a logistic scorer (the last is the bias), by full-batch Adam on soft labels."""
    w = np.zeros(WIDTH + 1)
    if not len(soft):
        w[-1] = 10.0
        return w
    rows = np.repeat(np.arange(len(soft)), [len(p) for p in places])
    at, x = np.concatenate(places).astype(np.int64), np.concatenate(values).astype(float)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = np.bincount(rows, x * w[at], len(soft)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - soft) / len(soft)
        g = np.append(np.bincount(at, x * error[rows], WIDTH), error.sum()) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (0.1 + 0.9 * (1 - t / steps)) * 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w


@dataclass(frozen=True)
class QualityModel:
    labels: LabelModel
    weights: np.ndarray


def fit_quality(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> QualityModel:
    """Votes of all documents, then a scorer fitted to the posterior labels of the sample."""
    voted = vote_rows(docs, id_col, text).groupBy("votes").count().toPandas()
    patterns = np.asarray(voted["votes"].tolist(), np.int64).reshape(-1, len(LABELLERS))
    counts = voted["count"].to_numpy(float)
    order = np.lexsort(patterns.T)
    labels = fit_labels(patterns[order], counts[order])
    rows = sample_rows(docs, id_col, text, int(counts.sum()))
    told = np.asarray(rows["votes"].to_pylist(), np.int64).reshape(-1, len(LABELLERS))
    places = [np.asarray(x, np.int64) for x in rows["places"].to_pylist()]
    values = [np.asarray(x) for x in rows["weights"].to_pylist()]
    return QualityModel(labels, fit_scorer(places, values, labels.posterior(told)))


def scored(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """``docs`` with ``__score`` (probability of good quality), ``__posterior`` and ``__votes``, which replace columns of these names."""
    docs = docs.drop("__score", "__posterior", "__votes")
    place = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, features = shared.value, Features()
        for batch in batches:
            z, told = [], []
            for body in byte_texts(batch.column(place)):
                words = body.split()
                s = shares(body, words)
                at, x = features(words, s)
                z.append(float(np.dot(model.weights[at], x)) + model.weights[-1])
                told.append(votes(s))
            p = 1 / (1 + np.exp(-np.clip(np.asarray(z, float), -30, 30)))
            posterior = model.labels.posterior(np.asarray(told, np.int64).reshape(-1, len(LABELLERS)))
            columns = [*batch.columns, pa.array(p), pa.array(posterior), pa.array([list(t) for t in told], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "__score", "__posterior", "__votes"])

    return docs.mapInArrow(each, with_fields(docs, ("__score", "double"), ("__posterior", "double"), ("__votes", "array<int>")))


def accepted(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier keeps, columns as they were."""
    rows, names = numbered(docs)
    kept = scored(rows, fit_quality(docs, id_col, text), names[text]).where(F.col("__score") >= threshold)
    return named_again(kept, names)
