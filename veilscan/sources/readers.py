"""Sources: tables, text documents, tool documents, traces and audit logs.

All readers return DataFrames and prune columns at the scan. ``balanced``
spreads a coarse input (e.g. one large row group) over the cluster's cores;
on a real data lake the input already has far more splits than cores and the
call is a no-op, so it never adds a shuffle at scale.
"""

from __future__ import annotations

import gzip
import io
import os
import re
from typing import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilscan.session import is_missing_path, local_folder, ship_package


def balanced(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    n = df.rdd.getNumPartitions()
    if n >= target:
        return df
    return df.repartition(target)


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None,
               balance: bool = False, rows_a_task: int | None = None) -> DataFrame:
    """Columns of a table; with ``rows_a_task`` dealt over enough tasks that one task's rows do not grow with the table."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    if rows_a_task is not None:
        # the row count is read from the files' footers
        return balanced(df, max(spark.sparkContext.defaultParallelism, -(-df.count() // rows_a_task)))
    return balanced(df) if balance else df


# ---------------------------------------------------------------------------
# read_texts: prompt / hook payload / document text
# ---------------------------------------------------------------------------

# Hook payload fields, in order of preference.
HOOK_TEXT_FIELDS = ["prompt", "user_prompt", "text", "message", "content"]


def hook_text(payload: Column) -> Column:
    """First present of the hook fields of a JSON payload string; '' if none."""
    fields = [F.get_json_object(payload, f"$.{f}") for f in HOOK_TEXT_FIELDS]
    return F.coalesce(*fields, F.lit(""))


def read_texts(spark: SparkSession, path: str, fmt: str = "parquet", text_col: str = "text",
               hook_json: bool = False) -> DataFrame:
    """Text rows from parquet/json/text; with ``hook_json`` each line is a hook payload."""
    if fmt == "text":
        df = spark.read.text(path).withColumnRenamed("value", text_col)
    elif fmt == "json":
        df = spark.read.json(path)
    else:
        df = spark.read.parquet(path)
    if hook_json:
        df = df.select(hook_text(F.col(text_col)).alias(text_col))
    return df.where(F.col(text_col).isNotNull() & (F.length(text_col) > 0))


# ---------------------------------------------------------------------------
# Tool-definition documents
# ---------------------------------------------------------------------------

def tolerant_parse(raw: Column) -> Column:
    """VARIANT of a JSON document; comments and trailing commas tolerated; NULL if unparsable.

    Strict parse first; only on failure the cleaned text is parsed.
    """
    cleaned = F.regexp_replace(raw, r"/\*[\s\S]*?\*/", "")
    cleaned = F.regexp_replace(cleaned, r"(?m)(^|[^:])//.*$", "$1")
    cleaned = F.regexp_replace(cleaned, r",(\s*[}\]])", "$1")
    return F.coalesce(F.try_parse_json(raw), F.try_parse_json(cleaned))


FILES_A_TASK = 10_000
READ_BATCH = 4 << 20  # bytes of text a batch
_PACKED = r"\.(bz2|deflate|lz4|snappy|zst)$"  # left to Spark's reader


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _list_folder(deep: bool):
    """Entries (path, folder) of folders: files and ``key=value`` folders, or with ``deep`` the files below those."""
    def entries(folder):
        with os.scandir(folder) as found:
            for e in found:
                if _hidden(e.name):
                    continue
                if not e.is_dir():
                    yield e.path, False
                elif "=" in e.name:
                    if deep:
                        yield from entries(e.path)
                    else:
                        yield e.path, True

    def run(batches):
        import pyarrow as pa
        held = []
        for batch in batches:
            for path, is_folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for entry in entries(path) if is_folder else [(path, False)]:
                    held.append(entry)
                    if len(held) >= FILES_A_TASK:
                        yield pa.RecordBatch.from_arrays([pa.array([h[c] for h in held]) for c in (0, 1)], names=["path", "folder"])
                        held = []
        yield pa.RecordBatch.from_arrays([pa.array([h[c] for h in held], t) for c, t in ((0, pa.string()), (1, pa.bool_()))], names=["path", "folder"])
    return run


def _file_uri(path: str) -> str:
    """A path as input_file_name() writes it."""
    return "file://" + re.sub(r"[\x00-\x20\"#%<>?\[\\\]^`{|}\x7f]", lambda m: f"%{ord(m[0]):02X}", path)


def _read_files(batches):
    """Whole files as (path, raw); empty ones are left out, as by Spark's reader."""
    import pyarrow as pa

    def send(held):
        return pa.RecordBatch.from_arrays([pa.array([_file_uri(p) for p, _ in held], pa.string()), pa.array([t for _, t in held], pa.binary())], names=["path", "raw"])

    held, size = [], 0
    for batch in batches:
        for path in batch.column(0).to_pylist():
            with open(path, "rb") as source:
                text = source.read()
            if text:
                text = gzip.decompress(text) if path.endswith(".gz") else text
                held.append((path, text))
                size += len(text)
            if size > READ_BATCH:
                yield send(held)
                held, size = [], 0
    yield send(held)


def _folder_files(spark: SparkSession, path: str) -> DataFrame | None:
    """(path) of the files in a folder and its ``key=value`` folders, listed by tasks; None if tasks cannot open it or it is a pattern."""
    folder = None if re.search(r"[*?\[\]{}\\]", path) else local_folder(spark, path)
    if folder is None or not os.path.isdir(folder):
        return None
    ship_package(spark)
    kind, tasks = "path string, folder boolean", spark.sparkContext.defaultParallelism
    root = spark.range(0, 1, 1, 1).select(F.lit(folder).alias("path"), F.lit(True).alias("folder"))
    top = root.mapInArrow(_list_folder(False), kind).repartition(tasks)
    return top.mapInArrow(_list_folder(True), kind).select("path")


def read_tool_docs(spark: SparkSession, path: str) -> DataFrame:
    """One tool document per file -> (path, raw, doc VARIANT).

    A folder that tasks can open is listed and read by them, a bounded number of
    files a task: the driver holds no file names. Patterns, other stores and
    folders with files packed otherwise than by gzip go through Spark's text reader.
    """
    files = _folder_files(spark, path)
    count, packed = (0, 1) if files is None else files.agg(F.count("*"), F.count_if(F.col("path").rlike(_PACKED))).first()
    if packed:
        df = spark.read.text(path, wholetext=True).select(
            F.input_file_name().alias("path"), F.col("value").alias("raw"))
    else:
        files = files.repartition(max(spark.sparkContext.defaultParallelism, -(-count // FILES_A_TASK)))
        df = files.mapInArrow(_read_files, "path string, raw binary").select("path", F.col("raw").cast("string").alias("raw"))
    return df.withColumn("doc", tolerant_parse(F.col("raw")))


PIECE = 8 << 20  # bytes of a file that one task reads at least, if the file can be cut
_BLANK = b" \t\n\x0b\x0c\r"


def _members(path: str, size: int):
    """Starts of a gzip file's members as far as they tell their length (``writers.gzip_member``)."""
    start = 0
    with open(path, "rb") as source:
        while start < size:
            source.seek(start)
            head = source.read(24)
            length = int.from_bytes(head[16:], "little")
            if head[:4] != b"\x1f\x8b\x08\x04" or head[10:16] != b"\x0c\0VS\x08\0" or length < 32:
                return
            yield start
            start += length


def _cut_logs(piece: int):
    """Pieces (path, start, size, cut, left) of log files; ``left`` ones are plain files that only Spark's reader cuts."""
    def run(batches):
        import pyarrow as pa
        kinds = {"path": pa.string(), "start": pa.int64(), "size": pa.int64(), "cut": pa.bool_(), "left": pa.bool_()}
        for batch in batches:
            pieces = []
            for path in batch.column(0).to_pylist():
                size, starts = os.stat(path).st_size, [0]
                if size > piece and path.endswith(".gz"):
                    for start in _members(path, size):
                        if start - starts[-1] >= piece:
                            starts.append(start)
                left = size > piece and not path.endswith(".gz")
                pieces += [(path, at, end - at, len(starts) > 1, left) for at, end in zip(starts, [*starts[1:], size])]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pieces], t) for k, t in enumerate(kinds.values())], names=list(kinds))
    return run


def _piece_lines(path: str, start: int, size: int, cut: bool):
    """Lists of the lines of a piece that are not blank, cut at the line ends that Spark's reader knows."""
    with open(path, "rb") as source:
        ends = start + size >= os.fstat(source.fileno()).st_size
        if cut:
            source.seek(start)
            source = io.BytesIO(source.read(size))
        if path.endswith(".gz"):
            source = gzip.GzipFile(fileobj=source)
        rest, head = b"", start == 0
        while block := source.read(1 << 20):
            if head:
                block, head = block.removeprefix(b"\xef\xbb\xbf"), False
            lines = (rest + block).splitlines(keepends=True)
            # the last line may go on, also from a return to its newline
            rest = lines.pop() if lines and not lines[-1].endswith(b"\n") else b""
            yield [text for line in lines if (text := line.rstrip(b"\r\n")).strip(_BLANK)]
        if cut and not ends and rest:
            raise ValueError(f"{path}: a gzip member ends within a line, so the file cannot be read in pieces")
        if rest.strip(_BLANK):
            yield [rest.rstrip(b"\r\n")]


def _count_lines(batches):
    import pyarrow as pa
    for batch in batches:
        rows = [(path, start, sum(map(len, _piece_lines(path, start, size, True)))) for path, start, size in zip(*(c.to_pylist() for c in batch.columns))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "start", "n"])


def _read_lines(batches):
    """Lines of pieces (path, start, size, cut, before) as (log_path, raw, pos)."""
    import pyarrow as pa

    def send():
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(raws, pa.binary()), pa.array(places, pa.int64())], names=["log_path", "raw", "pos"])

    paths, raws, places, held = [], [], [], 0
    for batch in batches:
        for path, start, size, cut, pos in zip(*(c.to_pylist() for c in batch.columns)):
            name = _file_uri(path).replace("file://", "file:", 1)  # as _metadata.file_path has it
            for lines in _piece_lines(path, start, size, cut):
                paths += [name] * len(lines)
                raws += lines
                places += range(pos, pos + len(lines))
                pos += len(lines)
                held += sum(map(len, lines)) + len(name) * len(lines)
                if held > READ_BATCH:
                    yield send()
                    paths, raws, places, held = [], [], [], 0
    yield send()


def _folder_lines(spark: SparkSession, path: str) -> DataFrame | None:
    """(log_path, raw, pos) of the logs in a folder, listed, read and numbered by tasks; None where Spark's reader has to do it."""
    files = _folder_files(spark, path)
    if files is None:
        return None
    pieces = files.mapInArrow(_cut_logs(PIECE), "path string, start long, size long, cut boolean, left boolean")
    count, size, cut, left = pieces.agg(F.count("*"), F.sum("size"), F.count_if("cut"), F.count_if(F.col("left") | F.col("path").rlike(_PACKED))).first()
    if left:
        return None
    tasks = max(spark.sparkContext.defaultParallelism, -(-count // FILES_A_TASK), -(-(size or 0) // PIECE))
    pieces = pieces.select("path", "start", "size", "cut").repartition(tasks)
    if cut:
        counted = pieces.where("cut").select("path", "start", "size").mapInArrow(_count_lines, "path string, start long, n long")
        w = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
        before = counted.select("path", "start", F.sum("n").over(w).alias("before"))
        pieces = pieces.join(before, ["path", "start"], "left").select("path", "start", "size", "cut", F.coalesce("before", F.lit(0)).alias("before"))
    else:
        pieces = pieces.withColumn("before", F.lit(0).cast("long"))
    lines = pieces.mapInArrow(_read_lines, "log_path string, raw binary, pos long")
    return lines.select("log_path", F.col("raw").cast("string").alias("raw"), "pos")


def read_audit_log(spark: SparkSession, path: str) -> DataFrame:
    """JSONL audit records -> (log_path, raw, pos); blank lines are dropped before numbering.

    Files are read line by line, so a log of any length is split over tasks. A
    folder that tasks can open is listed and read by them, and each line is
    numbered where it is read: long gzip files are cut between the members of
    ``write_audit_log``, and the lines of their pieces counted first. Long plain
    files, patterns and other stores go through Spark's text reader.
    """
    from veilscan.operators.traces import sequence_within
    lines = _folder_lines(spark, path)
    if lines is not None:
        return lines
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("log_path"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"), F.col("value").alias("raw"))
    lines = lines.where(F.col("raw").rlike(r"\S"))
    return sequence_within(lines, "log_path", ["_block", "_line"], out="pos").select("log_path", "raw", "pos")


def read_audit_table(spark: SparkSession, path: str, sessions: list | None = None, session_col: str = "session_id") -> DataFrame:
    """Records of ``write_audit_table`` -> (log_path, raw, pos), the session id in place of the path; of ``sessions`` only if given."""
    rows = spark.read.parquet(path)
    if sessions is not None:
        rows = rows.where(F.col(session_col).isin(sessions))
    return rows.select(F.col(session_col).alias("log_path"), F.col("record").alias("raw"), F.col("n").alias("pos"))


def read_trace_lines(spark: SparkSession, path: str) -> DataFrame:
    """Span files -> (session_id, block, line_no, line): one session a file, lines in file order by (block, line_no)."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("session_id"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Tool-call events of every span file under ``path``; a file of any length is split over tasks."""
    from veilscan.operators.traces import ingest_spans
    return ingest_spans(read_trace_lines(spark, path), order_col=["block", "line_no"])


def load_string_list(spark: SparkSession, path: str | None, col: str) -> DataFrame:
    """JSON array of strings (allowlist, known destinations). Empty when missing."""
    if path is None:
        return spark.createDataFrame([], f"{col} STRING")
    try:
        df = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if not is_missing_path(error):
            raise
        return spark.createDataFrame([], f"{col} STRING")
    return df.select(F.explode(F.from_json("value", "array<string>")).alias(col)).distinct()


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Registry manifest ({servers: [{name, source, homepage?}]}) -> (name, source, homepage)."""
    raw = spark.read.text(path, wholetext=True)
    servers = raw.select(F.explode(F.try_variant_get(F.try_parse_json("value"), "$.servers", "array<variant>")).alias("s"))
    s = F.col("s")
    return servers.select(F.try_variant_get(s, "$.name", "string").alias("name"),
                          F.try_variant_get(s, "$.source", "string").alias("source"),
                          F.try_variant_get(s, "$.homepage", "string").alias("homepage"))
