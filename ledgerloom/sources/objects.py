"""Stored objects: listing and upload checks."""

from __future__ import annotations

import os
import re
import shutil
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Object keys are ``{user_id}/{document_id}.pdf``, PDFs start with these bytes.
KEY_PATTERN = r"^([^/]+)/([^/]+)\.[A-Za-z0-9]+$"
PDF_MAGIC = b"%PDF-"
# Spark's writers give missing and empty names this one, and escape these characters.
NO_NAME = "__HIVE_DEFAULT_PARTITION__"
ESCAPED = re.compile(r"""[\x00-\x1f\x7f"#%'*/:=?\\{\[\]^]""")
# The owner and the document of an object that store_objects made, from its path.
STORED_PATTERN = r"/user=([^/]+)/document=([^/.]+)[./]"


def mounted_path(spark: SparkSession, root: str) -> str | None:
    """``root`` as a plain path where it lies on a file system that all machines mount, else ``None``."""
    scheme, _, path = root.partition(":") if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", root) else ("", "", root)
    if not scheme:
        scheme = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS").partition(":")[0]
    return "/" + path.lstrip("/") if scheme == "file" else None


def store_objects(rows: DataFrame, root: str) -> None:
    """Store the text of every row (user, document, text; null: empty) and a line break as an object below ``root``.

    On a mounted file system tasks write the files themselves, named ``user={user}/document={document}.{n}.txt``, into a folder
    per task that appears under its name when it is whole, so a repeated task leaves no object twice. Spark's writers make a folder and
    a checksum file per object there and start a process for every mode they set. Elsewhere Spark writes a folder per object;
    ``STORED_PATTERN`` reads both. A document's name must hold no dot.
    """
    rows = rows.select(*[F.col(c).cast("string") for c in ("user", "document")], "text")
    path = mounted_path(rows.sparkSession, root)
    if path is None:
        rows.write.partitionBy("user", "document").text(root)
        return

    def name(value: str | None) -> str:
        return ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", value) if value else NO_NAME

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        # Spark lists no folder whose name begins so.
        begun, whole = (Path(path, f) for f in (f"_part-{task.partitionId()}-{task.taskAttemptId()}", f"part-{task.partitionId()}"))
        n = 0
        for batch in batches:
            for i in range(batch.num_rows):
                user, document, text = (batch.column(c)[i] for c in range(3))
                folder = begun / f"user={name(user.as_py())}"
                if not folder.exists():
                    folder.mkdir(parents=True)
                with open(folder / f"document={name(document.as_py())}.{n}.txt", "wb") as f:
                    f.write((text.as_py() or b"") + b"\n")
                n += 1
        if n:
            try:
                begun.rename(whole)
            except OSError:
                # Another attempt at the same rows was first.
                if not whole.exists():
                    raise
                shutil.rmtree(begun)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    os.makedirs(path)
    rows.withColumn("text", F.col("text").cast("binary")).mapInArrow(put, "n bigint").agg(F.sum("n")).collect()


def scan_objects(
    spark: SparkSession,
    root: str,
    glob: str = "*.pdf",
    with_content: bool = False,
    max_bytes: int | None = None,
    layout: str = KEY_PATTERN,
) -> DataFrame:
    """List stored objects below ``root``: key, owner, document, size, modification time.

    ``layout`` is a pattern of the key, the last two steps of the path, with the owner and the document as groups. Without ``with_content`` the content column is pruned, so no object is opened. Objects of more
    than ``max_bytes`` are listed with a null content and not opened either: the reader checks sizes
    from the listing.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(root)
    )
    # Spark reports full URIs; the key is what follows the last two slashes of the layout.
    key = F.regexp_extract("path", r"([^/]+/[^/]+)$", 1)
    columns = [
        "path",
        key.alias("key"),
        F.nullif(F.regexp_extract(key, layout, 1), F.lit("")).alias("user_id"),
        F.nullif(F.regexp_extract(key, layout, 2), F.lit("")).alias("document_id"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified_at"),
    ]
    if not with_content:
        return files.select(*columns)
    if max_bytes is None:
        return files.select(*columns, "content")
    opened = files.filter(F.col("length") <= max_bytes).select(*columns, "content")
    listed = files.filter(F.col("length") > max_bytes).select(*columns, F.lit(None).cast("binary").alias("content"))
    return opened.unionByName(listed)


def validate_uploads(
    objects: DataFrame,
    magic: bytes = PDF_MAGIC,
    max_mb: int = 30,
    page_counts: DataFrame | None = None,
    max_pages: int = 600,
) -> DataFrame:
    """Check every object; adds ``ok`` and ``reasons`` (an array, empty when all is well).

    ``objects`` needs ``key``, ``size`` and ``content``; ``page_counts`` is (key, page_count).
    A key that leaves its root or does not name an owner and a document is rejected. The content of
    an object that is too big may be null (``scan_objects`` with ``max_bytes``) and is not judged then.
    """
    if page_counts is not None:
        objects = objects.join(page_counts.select("key", "page_count"), "key", "left")
    else:
        objects = objects.withColumn("page_count", F.lit(None).cast("int"))
    head = F.substring("content", 1, len(magic))
    key = F.col("key")
    bad_key = (
        key.isNull() | ~key.rlike(KEY_PATTERN) | F.array_contains(F.split(key, "/"), "..") | key.startswith("/")
    )
    too_big = F.col("size") > max_mb * 1024 * 1024
    checks = {
        "bad_key": bad_key,
        "bad_magic": F.coalesce(head != F.unhex(F.lit(magic.hex())), ~too_big, F.lit(True)),
        "too_big": too_big,
        "too_many_pages": F.coalesce(F.col("page_count") > max_pages, F.lit(False)),
    }
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return (
        objects.withColumn("reasons", reasons)
        .withColumn("ok", F.size("reasons") == 0)
        .drop("content")
    )
