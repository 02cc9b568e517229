"""Toxicity by compression distance: two zstandard dictionaries, window compression lengths.

One dictionary is trained on toxic text and one on ordinary text. Every window of a text is
compressed with both; a window that comes out shorter under the toxic dictionary holds what toxic
text repeats. Ordinary training is on all windows of the training texts. Windows of toxic documents are
mostly ordinary, so toxic training is on their telling words only: those with a letter group that is far
commoner in toxic documents. The per-document evidence (largest and summed
gains over all windows) is turned into a probability by thresholds calibrated on training rows that
trained no dictionary.

Defined cases: null and empty texts have no evidence and get the lowest calibrated score; without
labels of both classes the score is the share of ones (0 without labels); a null doc_id is scored;
repeated rows repeat; windows cover whole texts, however long.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import docs_text, drop_materialised, is_held_out, labelled_sample, map_texts, materialise, one_text
from .quality import isotonic

_WORDS = re.compile(rb"[^\s]+")


def windows(text: str, size: int) -> list[bytes]:
    """The whole lower-cased text as UTF-8 in windows of about size bytes, cut at white space where there is any."""
    raw = text.lower().encode()
    out, at, end = [], 0, len(raw)
    while at < end:
        to = at + size
        if to < end:
            space = raw.rfind(b" ", at + size // 2, to)
            to = space + 1 if space > 0 else to
        out.append(raw[at:to])
        at = to
    return out


@dataclass
class ToxicModel:
    toxic: bytes = b""
    ordinary: bytes = b""
    window: int = 512
    strategy: int = zstandard.STRATEGY_LAZY2
    min_match: int = 4
    search_log: int = 4
    coef: np.ndarray = field(default_factory=lambda: np.zeros(1 + N_EVIDENCE))
    knots_x: np.ndarray = field(default_factory=lambda: np.array([0.0]))
    knots_y: np.ndarray = field(default_factory=lambda: np.array([0.0]))
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def gains(self, text: str) -> np.ndarray:
        """For each window the bytes that the toxic dictionary saves over the ordinary one."""
        parts = windows(text, self.window)
        if not parts:
            return np.zeros(1)
        a, b = _compressors(self)
        return np.array([len(b.compress(p)) - len(a.compress(p)) for p in parts], float)

    def evidence(self, text: str) -> list[float]:
        g = self.gains(text)
        up = np.sort(np.maximum(g, 0))[::-1]
        n = len(g)
        return [up[0], up[:3].sum(), math.log1p(up.sum()), up.sum() / n, g.mean(), (g >= 4).sum() / n, math.log1p(n)]

    def raw(self, evidence: np.ndarray) -> np.ndarray:
        return np.hstack([np.ones((len(evidence), 1)), evidence]) @ self.coef

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(evidence), self.knots_x, self.knots_y), 0.0, 1.0)


N_EVIDENCE = 7
_made: dict[str, tuple] = {}


def _compressors(model: ToxicModel) -> tuple:
    """The two compressors of a model, made once a process; the newest model replaces older ones."""
    if model.key not in _made:
        _made.clear()
        pair = []
        for content in (model.toxic + model.ordinary, model.ordinary):  # ordinary text keeps its distances
            settings = zstandard.ZstdCompressionParameters(
                strategy=model.strategy, min_match=model.min_match, window_log=16, hash_log=14, chain_log=14,
                search_log=model.search_log, target_length=32, write_content_size=False, write_dict_id=False,
            )
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if content else None
            if d is not None:
                d.precompute_compress(compression_params=settings)
            pair.append(zstandard.ZstdCompressor(dict_data=d, compression_params=settings))
        _made[model.key] = tuple(pair)
    return _made[model.key]


def train_content(samples: list[bytes], size: int, **cover: int) -> bytes:
    """A zstandard-trained dictionary; where there is too little to train on, the newest samples as raw content."""
    if len(samples) >= 8:
        try:
            return zstandard.train_dictionary(size, samples, **cover).as_bytes()
        except zstandard.ZstdError:
            pass
    return b" ".join(samples)[-size:]


def telling_words(toxic: list[str], ordinary: list[str], gram: int = 4, ratio: float = 8.0, share: float = 0.02) -> list[bytes]:
    """Occurrences in toxic documents of words with a letter group that is far commoner in toxic documents.

    They are the toxic text that the toxic dictionary is trained on: other words of toxic documents
    are ordinary and would only teach what both classes share.
    """
    def spread(texts: list[str]) -> Counter:
        seen: Counter = Counter()
        for t in texts:
            words = set(_WORDS.findall(t.lower().encode()))
            seen.update({(b" " + w)[i : i + gram + 1] for w in words for i in range(max(1, len(w) - gram + 1))})
        return seen

    a, b = spread(toxic), spread(ordinary)
    na, nb = max(1, len(toxic)), max(1, len(ordinary))
    least = max(4, share * na)
    telling = {g for g, n in a.items() if n >= least and n / na > ratio * (b[g] + 1) / nb}
    out = []
    for t in toxic:
        for w in _WORDS.findall(t.lower().encode()):
            padded = b" " + w
            if any(padded[i : i + gram + 1] in telling for i in range(max(1, len(w) - gram + 1))):
                out.append(padded)
    return out


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method for a small logistic model with a constant term."""
    z = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_texts(ids: list[int], texts: list[str], y: np.ndarray, window: int = 512, ordinary_bytes: int = 4_096, toxic_bytes: int = 1_024, **settings) -> ToxicModel:
    """Fit on training rows held in memory (a bounded sample). Even and odd hashes: dictionaries, thresholds."""
    model = ToxicModel(window=window, **settings)
    if not len(y) or y.min() == y.max():
        model.knots_y = np.array([float(y.mean()) if len(y) else 0.0])
        return model
    half = np.array([zlib.crc32(b"fold" + str(i).encode()) % 2 for i in ids]) == 0
    tox = [t for t, k, h in zip(texts, y, half, strict=True) if k and h]
    plain = [t for t, k, h in zip(texts, y, half, strict=True) if not k and h]
    segments = telling_words(tox, plain)
    model.ordinary = train_content([w for t in plain for w in windows(t, window)], ordinary_bytes)
    model.toxic = train_content([b"".join(segments[i : i + 8]) for i in range(0, len(segments), 8)], toxic_bytes, k=40, d=8) if segments else b""
    rest = np.flatnonzero(~half)
    if not len(rest) or y[rest].min() == y[rest].max():
        rest = np.arange(len(y))
    x = np.array([model.evidence(texts[i]) for i in rest])
    model.coef = logistic(x, y[rest].astype(float))
    model.knots_x, model.knots_y = isotonic(model.raw(x), y[rest].astype(float))
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_train_rows: int = 6_000, max_train_bytes: int = 64 << 20, **options) -> ToxicModel:
    """Fit on at most max_train_rows labelled rows, held in the driver's memory.

    Both bounds are of the training sample only. Where its texts together exceed max_train_bytes, whole rows go
    from the end of the sample's hash order, so a text is used whole or not at all.
    """
    sample = F.broadcast(labelled_sample(labels, label, max_train_rows))
    known = one_text(docs_text(docs).join(sample.select("doc_id"), "doc_id", "left_semi")).join(sample, "doc_id")
    known = materialise(known, "training-texts")  # at most max_train_rows
    used, size = [], 0
    for r in known.select("doc_id", F.octet_length("text").alias("n"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").collect():
        size += r["n"]
        if size > max_train_bytes:
            break
        used.append((r["doc_id"],))
    chosen = F.broadcast(docs.sparkSession.createDataFrame(used, "doc_id long"))
    rows = sorted(known.join(chosen, "doc_id").collect(), key=lambda r: r["doc_id"])  # bounded in rows and bytes
    drop_materialised(known)
    return fit_texts([r["doc_id"] for r in rows], [r["text"] for r in rows], np.array([r["label"] for r in rows], int), **options)


def score(docs: DataFrame, model: ToxicModel, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""

    def rows(ids: list, texts: list[str]) -> dict:
        s = model.score(np.array([model.evidence(t) for t in texts]))
        return {"doc_id": ids, "held_out": [is_held_out(i) for i in ids], "score": s, "predicted": (s >= threshold).astype("i4")}

    return map_texts(docs_text(docs), "doc_id long, held_out boolean, score double, predicted int", rows)
