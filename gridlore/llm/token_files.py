"""Token-id output: flat unsigned integer files with 64-bit document offsets.

write_token_files() range-partitions documents by doc_id, encodes each partition once and writes
  shard-NNNNNN.bin   ids, unsigned little-endian, 16 bits where the vocabulary allows, else 32
  shard-NNNNNN.idx   unsigned 64-bit offsets (documents + 1 of them), counted in ids
  shard-NNNNNN.doc   a doc id as signed 64-bit and a validity byte for each document
Files appear under their final name by a rename, so a task that is run again after a lost executor
replaces a file by the same bytes. A shard's base is the prefix sum of the shards before it; only one
row a shard (never a document) comes to the driver for that. Shards are sized by the texts' bytes, and all
three files are written as streams.

read_token_files() maps the files into memory (on a store without local paths it reads them whole,
a shard at a time) and gives one row a document.

Defined cases: a null text is empty and still has its end id; a null doc_id sorts first and reads
back as null; rows that repeat a doc_id stay, ordered by a hash of the text; an empty table gives no
rows.
"""

from __future__ import annotations

import functools
import json
import os
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, slices, text_partitions
from .pretokens import ByteLevelEncoder, split_all

SHARD = "shard-{:06d}"


#: A shard holds about this much text at most, and a shard of a small table at least the other.
SHARD_BYTES, LEAST_BYTES = 128 << 20, 4 << 20
#: Bounds of the texts that are encoded at once; a longer one is alone.
SLICE_ROWS, SLICE_BYTES = 4096, 4 << 20
#: One entry of a .doc file.
DOC = np.dtype([("id", "<i8"), ("valid", "u1")])


def _packer(width: int):
    kind = {array(c).itemsize: c for c in "HIL"}[width]
    if sys.byteorder == "little":
        return lambda ids: array(kind, ids).tobytes()
    return lambda ids: np.array(ids, f"<u{width}").tobytes()


@functools.cache
def _encoder(path: str, width: int) -> ByteLevelEncoder:
    return ByteLevelEncoder(path, _packer(width))


def encode_packed(texts: list[str], encoder: ByteLevelEncoder, width: int) -> list[bytes]:
    """Each text's ids as packed integers, through the distinct pre-tokens of all texts and the table of known ones."""
    parts, owners, out = [], [], [b""] * len(texts)
    get = encoder.pieces.__getitem__
    for at, text in enumerate(texts):
        if encoder.plain(text):
            cut = encoder.portions(text)
            parts += cut
            owners += [at] * len(cut)
        else:
            out[at] = b"".join([encoder.value([part]) if kind == "special" else b"".join([get(w.encode()) for w in part]) for kind, part in encoder.segments(text)])
    found = split_all(parts)
    pieces = encoder.pieces.all(found.distinct, lambda words: encoder.make_packed(words, width))
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // width
    flat = np.frombuffer(b"".join(pieces), f"<u{width}")
    each = sizes[found.numbers]  # ids of every place
    ends = np.cumsum(each)
    begins = (np.cumsum(sizes) - sizes)[found.numbers]  # where these lie among the distinct ones' ids
    ids = flat[np.repeat(begins - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
    limits = np.append(0, ends)[found.ends].tolist()
    for at, a, b in zip(owners, [0, *limits], limits, strict=False):
        out[at] += ids[a:b].tobytes()
    return out


def id_width(tokenizer_path: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def shard_count(docs: DataFrame) -> int:
    return text_partitions(docs, SHARD_BYTES, LEAST_BYTES)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None = 0) -> DataFrame:
    """Write every document's ids under folder (a URI); returns the manifest, one row a shard."""
    spark = docs.sparkSession
    width = id_width(tokenizer_path)
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    end = b"" if end_id is None else int(end_id).to_bytes(width, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path, width)
        shard = TaskContext.get().partitionId()
        fs, root = pafs.FileSystem.from_uri(folder)
        name, own = f"{root}/{SHARD.format(shard)}", uuid.uuid4().hex
        beside = {kind: f"{name}.{kind}.{own}" for kind in ("bin", "idx", "doc")}
        at = n_docs = 0
        with ExitStack() as stack:
            out = {kind: stack.enter_context(fs.open_output_stream(path)) for kind, path in beside.items()}
            out["idx"].write(bytes(8))
            for ids, texts in slices(batches, SLICE_ROWS, SLICE_BYTES):
                packed = [p + end for p in encode_packed(texts, encoder, width)]
                offsets = at + np.cumsum([len(p) // width for p in packed], dtype="<u8")
                docs = np.array([(i or 0, i is not None) for i in ids], DOC)
                out["bin"].write(b"".join(packed))
                out["idx"].write(offsets.astype("<u8").tobytes())
                out["doc"].write(docs.tobytes())
                at, n_docs = int(offsets[-1]), n_docs + len(ids)
        # Whole files appear under their names, so readers and repeated tasks never see parts.
        for kind, path in beside.items():
            fs.move(path, f"{name}.{kind}") if n_docs else fs.delete_file(path)
        if n_docs:
            yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [n_docs], "n_ids": [at]})

    # Rows that agree in doc_id and text have the same ids, so any order of them gives the same files; the
    # last key only lets very many of them lie in several shards.
    keys = ["doc_id", "tie", "spread"]
    dealt = (
        docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("spread"))
        .repartitionByRange(shard_count(docs), *keys)
        .sortWithinPartitions(*keys)
        .select("doc_id", "text")
    )
    manifest = dealt.mapInArrow(encode, "shard long, n_docs long, n_ids long")
    rows = sorted((r.shard, r.n_docs, r.n_ids) for r in manifest.collect())  # one row a shard
    base, listed = 0, []
    for shard, n_docs, n_ids in rows:
        listed.append({"shard": shard, "n_docs": n_docs, "n_ids": n_ids, "base": base})
        base += n_ids
    with fs.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps({"width": width, "shards": listed}).encode())
    return spark.createDataFrame(
        [(s["shard"], s["n_docs"], s["n_ids"], s["base"]) for s in listed],
        "shard long, n_docs long, n_ids long, base long",
    )


def _mapped(fs: pafs.FileSystem, path: str, dtype) -> np.ndarray:
    """A memory map where the file is local, else the bytes of this one shard."""
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    with fs.open_input_file(path) as file:
        return np.frombuffer(file.read(), dtype)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, ids widened to 32 bits."""
    fs, root = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{root}/manifest.json") as file:
        manifest = json.loads(file.read())
    shards, width = manifest["shards"], manifest["width"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for at in batch.column(0).to_pylist():
                shard = shards[at]
                name = f"{root}/{SHARD.format(shard['shard'])}"
                ids = _mapped(fs, f"{name}.bin", "<u2" if width == 2 else "<u4")
                offsets = _mapped(fs, f"{name}.idx", "<u8").astype("i8")
                n = len(offsets) - 1
                docs = _mapped(fs, f"{name}.doc", DOC)
                for cut in range(0, n, 4096):
                    some = range(cut, min(cut + 4096, n))
                    crc = [zlib.crc32(ids[offsets[i] : offsets[i + 1]].astype("<u4")) for i in some]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(docs["id"][cut : some.stop], pa.int64(), mask=docs["valid"][cut : some.stop] == 0),
                            pa.array(offsets[cut : some.stop] + shard["base"], pa.int64()),
                            pa.array(np.diff(offsets[cut : some.stop + 1]), pa.int64()),
                            pa.array(crc, pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return spark.range(0, len(shards), 1, max(1, len(shards))).mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int | None = 0) -> DataFrame:
    """Write to a new folder of the shared scratch space, then read back."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "token-files")
    write_token_files(docs, folder, tokenizer_path, end_id)
    return read_token_files(spark, folder)
