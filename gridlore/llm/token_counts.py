"""Token counts: pieces are counted once per distinct pre-token and joined to document frequencies.

1. Documents are dealt to slices (bounded in rows and bytes, or one document). A slice's distinct pre-tokens
   are dealt to buckets by their hash; a bucket of a slice is one row: its pre-tokens and, for each of them, the
   packed (document, frequency) pairs. One more row holds the slice's documents.
2. Buckets are shuffled, so all rows with a pre-token meet in one task, which asks the library for each distinct
   one's pieces once and joins these to the pairs: frequency times pieces, summed by document.
3. Sums are shuffled back to their slices and added up.

A pre-token in over 1 / COMMON of a slice's documents is dealt to one of SALTS buckets by the slice, so that no task gets
all rows of a very common one; it is counted once in each of these. The buckets' number follows from the texts' bytes.
No id list of a document is ever built, and no text is shuffled, only distinct pre-tokens of slices.

Defined cases: a null or empty text has 0 bytes and 0 tokens; repeated rows give repeated results;
a null doc_id stays null; texts of any length are counted whole; special strings inside a text count one each.
docs should be a table or another input whose partitions come out alike when they are read again.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import docs_text, slices, text_partitions
from .pretokens import ByteLevelEncoder, split_all

#: Bounds of a slice; a longer document is a slice of its own.
SLICE_ROWS, SLICE_BYTES = 4096, 4 << 20
#: Text that the pre-tokens of one shuffle partition come from, at most, and at least in small tables.
BUCKET_BYTES, LEAST_BYTES = 64 << 20, 16 << 20
COMMON, SALTS = 8, 16
#: An entry of a slice's row of documents.
DOC = np.dtype([("id", "<i8"), ("valid", "u1"), ("n_bytes", "<i8"), ("special", "<i8")])


@functools.cache
def _counter(path: str) -> ByteLevelEncoder:
    return ByteLevelEncoder(path, len)


def slice_rows(ids: list, texts: list[str], encoder: ByteLevelEncoder, buckets: int, salt: int) -> tuple[bytes, list[tuple[int, bytes]]]:
    """The packed documents of a slice, and (bucket, packed pre-tokens with their pairs)."""
    docs = np.zeros(len(ids), DOC)
    docs["id"], docs["valid"] = [i or 0 for i in ids], [i is not None for i in ids]
    parts, owners = [], []
    odd: defaultdict[bytes, Counter] = defaultdict(Counter)  # pre-tokens of texts that aren't plain, by document
    for at, text in enumerate(texts):
        docs["n_bytes"][at] = len(text.encode())
        if encoder.plain(text):
            cut = encoder.portions(text)
            parts += cut
            owners += [at] * len(cut)
            continue
        for kind, part in encoder.segments(text):
            if kind == "special":
                docs["special"][at] += 1
            else:
                for w in part:
                    odd[w.encode()][at] += 1
    found = split_all(parts)
    place = np.repeat(np.array(owners, np.int64), np.diff(found.ends, prepend=0))
    key, n = np.unique(found.numbers.astype(np.int64) * len(ids) + place, return_counts=True)
    words = found.distinct
    if odd:
        number = {w: i for i, w in enumerate(words)}
        extra = np.array([(number.setdefault(w, len(number)) * len(ids) + at, k) for w, of in odd.items() for at, k in of.items()], np.int64)
        # A document is either plain or not, so these keys are new.
        key, n = np.concatenate((key, extra[:, 0])), np.concatenate((n, extra[:, 1]))
        order = np.argsort(key)
        key, n, words = key[order], n[order], list(number)
    word, doc = key // len(ids), key % len(ids)
    spread = np.bincount(word, minlength=len(words))  # documents of each pre-token
    bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    bucket = (bucket + np.where(spread * COMMON > len(ids), salt % SALTS * 0x9E3779B1, 0)) % buckets
    order = np.argsort(bucket, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    dealt = np.argsort(rank[word], kind="stable")
    doc, n = doc[dealt], n[dealt].astype("<u4")
    pairs = np.concatenate(([0], np.cumsum(spread[order])))
    edges = np.concatenate(([0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)])) if len(order) else []
    gaps = gaps_of(doc, pairs[:-1])
    rows = []
    for a, b in zip(edges, edges[1:], strict=False):
        some = slice(pairs[a], pairs[b])
        parts = (SEPARATOR.join([words[i] for i in order[a:b].tolist()]), spread[order[a:b]].astype("<u2"), gaps[some], n[some])
        rows.append((int(bucket[order[a]]), pack(parts)))
    return docs.tobytes(), rows


#: A byte that UTF-8 never has.
SEPARATOR = b"\xff"


def pack(parts: tuple) -> bytes:
    """Byte strings and arrays with their lengths, compressed."""
    raw = [p if isinstance(p, bytes) else p.tobytes() for p in parts]
    return zstandard.compress(np.array([len(parts), *map(len, raw)], "<u4").tobytes() + b"".join(raw), 1)


def unpack(packed: bytes) -> list[bytes]:
    raw = zstandard.decompress(packed)
    n = int.from_bytes(raw[:4], "little")
    ends = (np.concatenate(([0], np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64))) + 4 * n + 4).tolist()
    return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def gaps_of(doc: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rising runs of documents, each from one of starts, as differences, which take less room."""
    out = np.diff(doc, prepend=0)
    out[starts] = doc[starts]
    return out.astype("<u2")


def pairs_of(packed: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Pre-tokens, documents of each, and all pairs' documents and frequencies."""
    words, spread, gaps, n = unpack(packed)
    spread = np.frombuffer(spread, "<u2")
    run = np.cumsum(np.frombuffer(gaps, "<u2"), dtype=np.int64)
    starts = np.cumsum(spread, dtype=np.int64)[:-1]
    before = np.concatenate(([0], run[starts - 1]))
    return words.split(SEPARATOR), spread, run - np.repeat(before, spread), np.frombuffer(n, "<u4")


def frequencies(docs: DataFrame, tokenizer_path: str, buckets: int) -> DataFrame:
    """(slice, bucket, packed): a row for each bucket of a slice's pre-tokens; bucket -1: the slice's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _counter(tokenizer_path)
        first = TaskContext.get().partitionId()
        for at, (ids, texts) in enumerate(slices(batches, SLICE_ROWS, SLICE_BYTES)):
            own, rows = slice_rows(ids, texts, encoder, buckets, first + at)
            for cut in range(0, len(rows) + 1, 64):
                some = [(-1, own), *rows][cut : cut + 64]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([first << 32 | at] * len(some), pa.int64()), pa.array([b for b, _ in some], pa.int64()), pa.array([p for _, p in some], pa.binary())],
                    names=["slice", "bucket", "packed"],
                )

    return docs_text(docs).mapInArrow(run, "slice long, bucket long, packed binary")


def summed(dealt: DataFrame, tokenizer_path: str) -> DataFrame:
    """(slice, packed) of frequencies' rows: what their pre-tokens add to each document; documents' rows stay.

    dealt: all rows with a pre-token of one bucket are in one partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pieces = _counter(tokenizer_path), {}
        for batch in batches:
            out = []
            for bucket, packed in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                packed = packed.as_py()
                if bucket >= 0:
                    words, spread, doc, n = pairs_of(packed)
                    new = list(set(words).difference(pieces))
                    pieces.update(zip(new, encoder.make_counts(new), strict=True))
                    counts = np.fromiter(map(pieces.__getitem__, words), np.int64, len(words))
                    total = np.bincount(doc, np.repeat(counts, spread) * n)  # exact below 2^53
                    doc = np.flatnonzero(total)
                    packed = pack((gaps_of(doc, np.array([0])), total[doc].astype("<u4")))
                out.append(packed)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["slice", "bucket", "packed"])

    return dealt.mapInArrow(run, "slice long, bucket long, packed binary")


def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(documents, tokens) of each slice. batches: slice, bucket, packed, sorted, so a slice's documents come first."""
    docs = total = None
    for batch in batches:
        for bucket, packed in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            if bucket < 0:
                if docs is not None:
                    yield docs, total
                docs = np.frombuffer(packed.as_py(), DOC)
                total = docs["special"].copy()
            else:
                gaps, n = unpack(packed.as_py())
                total[np.cumsum(np.frombuffer(gaps, "<u2"), dtype=np.int64)] += np.frombuffer(n, "<u4")  # a document is in it once
    if docs is not None:
        yield docs, total


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document."""
    parts = text_partitions(docs, BUCKET_BYTES, LEAST_BYTES)
    rows = frequencies(docs, tokenizer_path, 4 * parts)  # several buckets a partition even out
    added = summed(rows.repartition(parts, F.when(F.col("bucket") < 0, -F.col("slice") - 1).otherwise(F.col("bucket"))), tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, total in totals(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs["id"], mask=docs["valid"] == 0), pa.array(docs["n_bytes"]), pa.array(total), pa.array(total > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    back = added.repartition(parts, "slice").sortWithinPartitions("slice", "bucket")
    return back.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
