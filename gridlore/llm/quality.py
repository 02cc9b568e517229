"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Document statistics (shape of words, lines, characters, repetition) of the whole text are scaled and
mapped by cos(xW + b), which approximates a Gaussian kernel. Partitions sum Z'Z and Z'y; the sums of
the sums solve the ridge system on the driver, its size fixed by the number of features. An isotonic
fit over a second, disjoint part of the training rows turns ridge scores into probabilities.

Only `max_train_rows` labelled rows (hash order of their ids) are ever used, so the label side of the
join to texts is small enough to broadcast by construction; scoring reads every document once.

Defined cases: null and empty texts have all-zero statistics and are scored like others; a null
doc_id is scored and is not held out; without labels of both classes the score is the share of ones
(0.5 without any label); repeated rows repeat.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import docs_text, is_held_out, labelled_sample, map_texts, one_text

_WORD = re.compile(r"[^\s]+")
_VOWELS = frozenset("aeiouyäöüéèêàáíóúñ")


def statistics(text: str) -> list[float]:
    """Statistics of a whole text; lengths enter as logarithms, all else as ratios."""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * N_STATISTICS
    counts = Counter(words)
    singles = sum(1 for c in counts.values() if c == 1)
    top = max(counts.values())
    lines = [x for x in text.split("\n") if x.strip()]
    distinct_lines = len(set(lines))
    letters = chars_in = digits = upper = marks = 0
    spaces = text.count(" ") + text.count("\n") + text.count("\t")
    kinds = Counter(text)
    for c, k in kinds.items():
        if c.isalpha():
            letters += k
            upper += k if c.isupper() else 0
            chars_in += k if c.lower() in _VOWELS else 0
        elif c.isdigit():
            digits += k
        elif not c.isspace():
            marks += k
    stops = kinds[","] + kinds["."] + kinds[";"] + kinds[":"] + kinds["?"] + kinds["!"]
    shares = np.fromiter(kinds.values(), float) / chars
    bigrams = Counter(zip(words, words[1:], strict=False))
    lengths = np.fromiter(map(len, words), float, n)
    alike = sum(1 for a, b in zip(words, words[1:], strict=False) if a == b)
    bare = sum(k for w, k in counts.items() if not any(map(str.isalnum, w)))
    ends = sum(k for w, k in counts.items() if not w[-1].isalnum())
    capital = sum(k for w, k in counts.items() if w[0].isupper())
    return [
        np.log1p(n), np.log1p(chars), lengths.mean(), lengths.std(), np.log1p(lengths.max()), letters / chars,
        digits / chars, upper / max(1, letters), chars_in / max(1, letters), marks / chars, (marks - stops) / chars,
        stops / n, spaces / chars, len(counts) / n, singles / n, top / n,
        1 - len(bigrams) / max(1, n - 1), max(bigrams.values(), default=0) / max(1, n - 1), alike / n, bare / n,
        ends / n, capital / n, float(-(shares * np.log2(shares)).sum()), n / max(1, len(lines)),
        distinct_lines / max(1, len(lines)), len(set(text)) / np.sqrt(chars),
    ]


N_STATISTICS = 26


@dataclass
class QualityModel:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phases: np.ndarray
    ridge: np.ndarray | None
    knots_x: np.ndarray = field(default_factory=lambda: np.array([0.0]))
    knots_y: np.ndarray = field(default_factory=lambda: np.array([0.5]))

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.centre) / self.scale, -6, 6)
        z = np.sqrt(2 / len(self.phases)) * np.cos(x @ self.weights + self.phases)
        return np.hstack([z, x / 6, np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.zeros(len(stats)) if self.ridge is None else self.features(stats) @ self.ridge

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots_x, self.knots_y), 0.0, 1.0)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool equal x, then adjacent violators; knots at the mean x of each pool, both strictly rising."""
    at, place, n = np.unique(x, return_inverse=True, return_counts=True)
    total = np.bincount(place, y, len(at))
    pools: list[list[float]] = []  # sum y, count, sum x
    for b, k, a in zip(total, n, at, strict=True):
        pools.append([float(b), float(k), float(a * k)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", max_train_rows: int = 20_000,
    n_fourier: int = 192, gamma: float = 0.15, ridge: float = 0.3, seed: int = 11, parts: int = 8,
) -> QualityModel:
    """Fit on at most max_train_rows labelled rows (a documented bound); four fifths for the ridge
    system and one fifth for calibration."""
    sample = F.broadcast(labelled_sample(labels, label, max_train_rows))

    def rows(ids: list, texts: list[str]) -> dict:
        return {"doc_id": ids, "stats": [statistics(t) for t in texts]}

    known = one_text(docs_text(docs).join(sample.select("doc_id"), "doc_id", "left_semi"))
    stats = map_texts(known, "doc_id long, stats array<double>", rows).join(sample, "doc_id")
    # At most `parts` partitions of a bounded number of short vectors, whatever the input's size.
    stats = stats.repartition(parts, "doc_id").sortWithinPartitions("doc_id").persist()
    try:
        moments = stats.select(F.posexplode("stats"), "label").groupBy("pos").agg(
            F.avg("col").alias("mean"), F.stddev_pop("col").alias("std"), F.count("*").alias("n"), F.avg("label").alias("share")
        ).orderBy("pos").collect()  # one row a statistic
        rng = np.random.default_rng(seed)
        weights = rng.normal(0, np.sqrt(2 * gamma / N_STATISTICS * 4), (N_STATISTICS, n_fourier))
        phases = rng.uniform(0, 2 * np.pi, n_fourier)
        if not moments:
            return QualityModel(np.zeros(N_STATISTICS), np.ones(N_STATISTICS), weights, phases, None)
        share = moments[0]["share"]
        model = QualityModel(
            np.array([m["mean"] for m in moments]), np.array([max(m["std"], 1e-6) for m in moments]), weights, phases, None,
            np.array([0.0]), np.array([share]),
        )
        if share in (0.0, 1.0):
            return model
        width = n_fourier + N_STATISTICS + 1

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((width, width + 1))
            for batch in batches:
                z = model.features(np.array(batch.column("stats").to_pylist()))
                y = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
                total += z.T @ np.hstack([z, y[:, None]])
            yield pa.RecordBatch.from_pydict({"total": [total.tobytes()]})

        fold = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(5))
        partial = stats.where(fold != 0).coalesce(parts).mapInArrow(sums, "total binary").collect()  # `parts` rows of fixed size
        total = sum((np.frombuffer(p.total).reshape(width, width + 1) for p in partial), np.zeros((width, width + 1)))
        model.ridge = np.linalg.solve(total[:, :-1] + ridge * np.eye(width), total[:, -1])
        held = stats.where(fold == 0).select("stats", "label").collect()  # a fifth of the bounded sample
        if held:
            x, y = model.raw(np.array([r["stats"] for r in held])), np.array([float(r["label"]) for r in held])
            model.knots_x, model.knots_y = isotonic(x, y)
        return model
    finally:
        stats.unpersist()


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""

    def rows(ids: list, texts: list[str]) -> dict:
        s = model.score(np.array([statistics(t) for t in texts]))
        return {"doc_id": ids, "held_out": [is_held_out(i) for i in ids], "score": s, "predicted": (s >= threshold).astype("i4")}

    return map_texts(docs_text(docs), "doc_id long, held_out boolean, score double, predicted int", rows)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """docs without those that the classifier rejects; scored and filtered in one pass over the rows."""
    model, at = fit(docs, labels), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in range(0, batch.num_rows, 512):
                part = batch.slice(cut, 512)
                stats = np.array([statistics(t or "") for t in part.column(at).to_pylist()])
                yield part.filter(pa.array(model.score(stats) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
