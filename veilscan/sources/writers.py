"""Sinks: findings, audit logs, pins, destination and allowlist tables.

Writes are distributed (one file set per partition); state tables are written
to a new version directory and read back by folding versions, so a retried
job never leaves a half-replaced table behind.
"""

from __future__ import annotations

import gzip
import os
import struct
import zlib
from collections import Counter
from hashlib import blake2b
from urllib.parse import quote

from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.operators.entropy import token_hash
from veilscan.session import is_missing_path, local_folder, remove_folder, ship_package, shuffles_removed
from veilscan.streaming.state import Pointers


def write_findings(findings: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    findings.write.mode(mode).format(fmt).save(path)


def write_tool_docs(docs: DataFrame, path: str, name_col: str = "doc_id", text_col: str = "raw", packed: bool = False) -> None:
    """One file per document into a new folder; its path holds ``<name_col>=<value>``. ``packed`` ones are gzip files.

    In a store that tasks can open, each task fills a ``slice=`` folder by plain
    file calls: Spark's writer makes a folder a document, and its commit moves
    them one by one. A file gets its name when it is whole, and the name follows
    from value and text, so a task that runs twice writes the same files.
    """
    spark = docs.sparkSession
    folder = local_folder(spark, path)
    rows = docs.select(F.col(name_col), F.col(text_col).alias("value"))
    if folder is None:
        (rows.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2)
             .option("compression", "gzip" if packed else "none").partitionBy(name_col).text(path))
        return
    os.makedirs(folder)
    ending = "json.gz" if packed else "json"

    def run(batches):
        import pyarrow as pa
        task, copies = TaskContext.get(), Counter()
        own = f"{folder}/slice={task.partitionId()}"
        os.makedirs(own, exist_ok=True)
        part = f"{own}/.{task.taskAttemptId()}"  # hidden from readers
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name = f"{name_col}={'__null__' if name is None else quote(name, safe='')}"
                text = (text or b"") + b"\n"
                key = blake2b(name.encode() + b"/" + text, digest_size=16).digest()
                with open(part, "wb") as out:
                    out.write(gzip.compress(text, 3, mtime=0) if packed else text)
                os.replace(part, f"{own}/{name}.{key.hex()}.{copies[key]}.{ending}")
                copies[key] += 1
        yield pa.RecordBatch.from_arrays([pa.array([copies.total()], pa.int64())], names=["n"])

    ship_package(spark)
    made = rows.select(F.col(name_col).cast("string"), F.col("value").cast("binary")).mapInArrow(run, "n long")
    made.agg(F.sum("n")).collect()


NULL_NAMES = ["__null__", "__HIVE_DEFAULT_PARTITION__"]  # ours, and that of Spark's writer
MEMBER = 4 << 20  # bytes of text in a gzip member


def gzip_member(text: bytes) -> bytes:
    """A gzip member with its own length in the header, so that a reader finds the next one without unpacking."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -zlib.MAX_WBITS)
    packed = deflate.compress(text) + deflate.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHQ", 12, b"VS", 8, 24 + len(packed) + 8)
    return head + packed + struct.pack("<II", zlib.crc32(text), len(text))


def write_audit_log(log: DataFrame, path: str, session_col: str = "session_id", packed: bool = False, whole: bool = False) -> None:
    """One JSONL file per session, records in chain order; its path holds ``<session_col>=<value>``. ``packed`` ones are gzip files.

    With ``whole`` the log's tasks hold whole sessions in chain order already, as
    ``build_audit_log`` makes them, and no record is moved again. Packed files go
    to a store that tasks can open by plain file calls, into one ``slice=`` folder
    a task: no folder and no checksum file a session. A file is made of members of
    ``MEMBER`` bytes of text, so a task holds no session whole and a long file can
    be read in pieces. It gets its name when it is whole, so a task that runs twice
    writes the same files. Elsewhere Spark writes a folder a session.
    """
    spark = log.sparkSession
    folder = local_folder(spark, path) if packed else None
    if folder is None or not whole:
        log = log.repartition(session_col).sortWithinPartitions(session_col, "n")
    if folder is None:
        (log.select(session_col, F.col("record").alias("value"))
            .write.mode("overwrite").option("compression", "gzip" if packed else "none").partitionBy(session_col).text(path))
        return
    remove_folder(spark, path)
    os.makedirs(folder)

    def run(batches):
        import pyarrow as pa
        task = TaskContext.get()
        own = f"{folder}/slice={task.partitionId()}"
        os.makedirs(own, exist_ok=True)
        part = f"{own}/.{task.taskAttemptId()}"  # hidden from readers
        out, held, size, session, last, count = None, [], 0, None, None, 0

        def flush():
            out.write(gzip_member(b"".join(held)))

        def close():
            flush()
            out.close()
            os.replace(part, f"{own}/{session_col}={NULL_NAMES[0] if session is None else quote(session, safe='')}.jsonl.gz")

        for batch in batches:
            for name, n, text in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or name != session:
                    if out is not None:
                        close()
                    out, held, size, session, last = open(part, "wb"), [], 0, name, None
                if last is not None and n <= last:
                    raise ValueError(f"records of session {name} are not in chain order: {n} after {last}")
                held += text, b"\n"
                size += len(text)
                last = n
                if size > MEMBER:
                    flush()
                    held, size = [], 0
                count += 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], names=["n"])

    ship_package(spark)
    rows = log.select(F.col(session_col).cast("string"), F.col("n").cast("long"), F.col("record").cast("binary"))
    with shuffles_removed(spark):
        rows.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def write_audit_table(log: DataFrame, path: str, session_col: str = "session_id", records_per_file: int = 1_000_000) -> None:
    """Audit records of many sessions a file, sorted by (session, n).

    The number of files follows the number of records, not of sessions, and a long
    session is split over files. The statistics in each file's footer let a reader
    of few sessions skip the others.
    """
    (log.select(session_col, "n", "record").repartitionByRange(session_col, "n").sortWithinPartitions(session_col, "n")
        .write.mode("overwrite").option("maxRecordsPerFile", records_per_file).parquet(path))


def save_pins(pins: DataFrame, root: str, version: int | str) -> str:
    """Write a pins snapshot as a new version and point the lock at it; returns its path.

    The pointer is written last and renamed into place, so a job that dies half
    way leaves the version before as the lock.
    """
    path = f"{root.rstrip('/')}/version={version}"
    pins.write.mode("overwrite").parquet(path)
    pointers = Pointers(pins.sparkSession, f"{root.rstrip('/')}/_commits")
    number = (pointers.numbers() or [-1])[-1] + 1
    pointers.save(number, {"version": str(version)})
    pointers.prune(number)
    return path


def load_pins(spark, root: str, version: int | str | None = None) -> DataFrame | None:
    """Pins of one version (the one that was committed last when omitted); None when no lock exists.

    Only that version's files are listed and read, however many there are. A
    folder without a pointer (written by hand) is read whole: its largest version counts.
    """
    found = Pointers(spark, f"{root.rstrip('/')}/_commits").newest()
    if found:
        return spark.read.parquet(f"{root.rstrip('/')}/version={found['version'] if version is None else version}")
    try:
        df = spark.read.parquet(root)
    except AnalysisException as error:
        if not is_missing_path(error):
            raise
        return None
    if "version" not in df.columns:
        return df
    v = version if version is not None else df.agg(F.max("version")).first()[0]
    return df.where(F.col("version") == v).drop("version")


def save_known_destinations(known: DataFrame, seen: DataFrame, path: str) -> DataFrame:
    """Union of old and newly seen domains, sorted, written as the version ``path`` and read back.

    A version never replaces the table it is made from: a job that dies half way
    must leave the old one whole.
    """
    if any(path.rstrip("/") + "/" in f for f in known.inputFiles()):
        raise ValueError("write the next version of the known destinations to a path of its own")
    nxt = known.select("domain").union(seen.select("domain")).distinct()
    nxt.write.mode("overwrite").parquet(path)
    return known.sparkSession.read.schema("domain STRING").parquet(path).orderBy("domain")


def allow_tokens(allowlist: DataFrame, tokens: DataFrame, token_col: str = "token") -> DataFrame:
    """Add ``sha256:<hex>`` of each token to the allowlist (set union)."""
    new = tokens.select(token_hash(F.col(token_col)).alias("token_hash"))
    return allowlist.select("token_hash").union(new).distinct()


def load_corpus(spark, path: str) -> DataFrame:
    """Labelled cases file ({cases: [...]}) -> one row per case with the document as JSON text."""
    raw = spark.read.text(path, wholetext=True)
    v = F.try_parse_json("value")
    cases = raw.select(F.explode(F.try_variant_get(v, "$.cases", "array<variant>")).alias("c"))
    c = F.col("c")
    return cases.select(
        F.try_variant_get(c, "$.id", "string").alias("id"),
        F.try_variant_get(c, "$.title", "string").alias("title"),
        F.coalesce(F.try_variant_get(c, "$.malicious", "boolean"), F.lit(False)).alias("malicious"),
        F.try_variant_get(c, "$.expect.category", "string").alias("expect_category"),
        F.try_variant_get(c, "$.expect.ruleId", "string").alias("expect_rule_id"),
        F.to_json(F.try_variant_get(c, "$.doc", "variant")).alias("raw"),
        F.to_json(F.try_variant_get(c, "$.pin", "variant")).alias("pin_raw"))
