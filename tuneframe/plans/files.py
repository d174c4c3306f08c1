"""Files made from the test tables, for the queries that read files.

They stand in the shared checkpoint folder (``spark.checkpoint.dir``). Tasks
write them one by one, each under its final name at once and with the same
bytes whenever a task is tried again.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneframe.session import ensure_checkpoint_dir
from tuneframe.sources.files import qualified


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared checkpoint folder."""
    return f"{qualified(spark, ensure_checkpoint_dir(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _put(uri: str, data: bytes) -> None:
    if not uri.startswith("file:"):
        from pyarrow import fs as pafs
        fs, inner = pafs.FileSystem.from_uri(quote(uri, safe="/:@"))
        fs.create_dir(os.path.dirname(inner), recursive=True)
        with fs.open_output_stream(inner) as out:
            out.write(data)
        return
    path = "/" + uri[5:].lstrip("/")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(part, "wb") as out:
        out.write(data)
    os.replace(part, path)


def put_files(files: DataFrame, folder: str) -> str:
    """Write every row of ``files`` (path below ``folder``, head, body: binary)
    as one file; a ``.safetensors`` file begins with the length of its head, 8
    bytes. Returns ``folder``."""
    def run(batches: Iterator) -> Iterator:
        import pandas as pd
        for pdf in batches:
            for path, head, body in zip(pdf["path"], pdf["head"], pdf["body"], strict=True):
                framed = path.lower().endswith(".safetensors") and head is not None
                _put(f"{folder}/{path}", (len(head).to_bytes(8, "little") if framed else b"") + (head or b"") + (body or b""))
            yield pd.DataFrame({"n": [len(pdf)]})

    files.select("path", "head", "body").mapInPandas(run, "n long").agg(F.sum("n")).collect()
    return folder


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed now, while its files and settings are as they are."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
