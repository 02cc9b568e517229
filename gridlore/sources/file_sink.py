"""Files as a sink: rows (path, content) written whole and atomically, wherever the file system is.

A file is written beside its place and then moved there, so a reader never sees a part of one, and a task that runs
again after a lost executor replaces it by the same bytes. An outcome says written only after the move.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder's name in the shared folder of the session (spark.checkpoint.dir).

    Where that is unset, a session in one process gets a folder of its own, a cluster one in the warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        local = spark.sparkContext.master.startswith("local")
        root = f"file://{tempfile.mkdtemp(prefix='gridlore-')}" if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/gridlore-scratch"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


OUTCOMES = "path string, target string, outcome string, bytes long, error string"


def place(fs: pafs.FileSystem, path: str, content: bytes) -> None:
    """content under path by a move; its folder is made if it isn't there."""
    folder = path.rsplit("/", 1)[0]
    fs.create_dir(folder, recursive=True)
    beside = f"{folder}/.{uuid.uuid4().hex}"
    try:
        with fs.open_output_stream(beside) as out:
            out.write(content)
        fs.move(beside, path)
    except OSError:
        if fs.get_file_info(beside).type == pafs.FileType.File:
            fs.delete_file(beside)
        raise


def save_files(rows: DataFrame, root: str, target: str = "path") -> DataFrame:
    """(path, target, outcome written/failed, bytes, error) of rows (path, content[, error]); root is a URI.

    target names the column with the file's place below root. A row without content or place fails with its
    error, and an error of the file system is that row's only. Rows are written when the result is consumed, once
    for each time that it is: write the outcomes to a table and read them there.
    """
    has_error = "error" in rows.columns
    chosen = rows.select("path", rows[target].alias("target"), "content", *(["error"] if has_error else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            out: dict[str, list] = {"path": [], "target": [], "outcome": [], "bytes": [], "error": []}
            for i in range(batch.num_rows):  # one file's content at a time
                path, at, content = (batch.column(k)[i].as_py() for k in range(3))
                error = batch.column(3)[i].as_py() if has_error else None
                if content is None or at is None:
                    error = error or ("no content" if content is None else "no place")
                else:
                    try:
                        place(fs, f"{base}/{at}", content)
                    except OSError as e:
                        error = str(e)
                done = error is None
                for k, v in zip(out, (path, at, "written" if done else "failed", len(content) if done else None, error), strict=True):
                    out[k].append(v)
            kinds = {"bytes": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()], names=list(out))

    return chosen.mapInArrow(run, OUTCOMES)
