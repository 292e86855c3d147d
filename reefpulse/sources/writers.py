"""Writers: clustered tables between stages, and one folder per tag as an export."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reefpulse.operators.joining import LEAST_HOT, SHARES, salted
from reefpulse.sources.readers import index_headers, mounted

# Files that one task writes, and tasks of one export.
FILES_PER_TASK, MOST_TASKS = 64, 20_000

# Rows and bytes of a tag that a task holds before it writes them as a row group.
GROUP_ROWS, GROUP_BYTES = 250_000, 32 << 20

# Rows that Spark hands to a task's Python at a time.
BATCH_ROWS = 1_000

# Types that Arrow hands to Python otherwise than Parquet files hold them, or not at all.
_OWN_TYPES = re.compile(r"interval|variant|void|geo")

# Types of which a value may be as large as many rows.
_WIDE_TYPES = re.compile(r"array|map|struct<.*struct|binary")


@contextmanager
def _batches_by_rows(spark: SparkSession, rows: DataFrame) -> Iterator[None]:
    """Batches of ``rows`` for Python end by number, not by bytes, while a job of plain columns is planned.

    For a limit of bytes Spark adds up all columns of a batch again after each of its rows, which takes longer than
    filling it.
    """
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": 2**31 - 1}
    if _WIDE_TYPES.search(rows.schema.simpleString()):
        settings = {}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, str(value))
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _plan(rows: DataFrame, key: str, size: Column, max_records_per_file: int) -> tuple[int, Column | None]:
    """The number of files and, if a key holds much of the data, the map of its hash to salts
    (as ``hot_groups``), by one pass over ``rows``, each of which becomes ``size`` rows."""
    counts = rows.groupBy(key).agg(F.sum(size).alias("n")).persist()
    try:
        n = F.col("n")
        files, total = counts.agg(F.coalesce(F.sum(F.ceil(n / max_records_per_file)), F.lit(0)), F.coalesce(F.sum(n), F.lit(0))).first()
        share = max(total / SHARES, float(LEAST_HOT))
        hot = dict(counts.filter(n > share).select(F.xxhash64(key), F.ceil(n / share).cast("int")).collect())
    finally:
        counts.unpersist()
    return files, F.create_map(*[F.lit(v).cast(t) for pair in hot.items() for v, t in zip(pair, ("long", "int"))]) if hot else None


def _files_of(root: str, folder: str, run: str, fmt: str, most: int, header: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes a task's rows, ordered by ``folder``, under ``root``/folder=value/ and returns the rows of each task.

    A file gets its name when it is whole. Names follow from the task's place and rows are in a fixed
    order, so a task that runs again writes the same files over those of the run before. All helpers are inside: tasks
    need not import this module.
    """
    group_rows, group_bytes = GROUP_ROWS, GROUP_BYTES

    def named(value: str | None) -> str:
        """A folder's name, escaped as Spark's writer does."""
        if not value:
            return f"{folder}=__HIVE_DEFAULT_PARTITION__"
        return f"{folder}=" + re.sub(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", value)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        place, attempt = task.partitionId(), task.taskAttemptId()
        state = {"value": None, "rows": 0, "out": None, "tmp": None, "held": [], "size": 0, "bytes": 0}
        # Files so far of each folder, so that no file takes the name of another, whatever the order of the rows.
        parts, total = {}, 0

        def begin(schema: pa.Schema) -> None:
            at = f"{root}/{named(state['value'])}"
            os.makedirs(at, exist_ok=True)
            state["tmp"] = f"{at}/.{run}-{attempt}.tmp"
            if fmt == "csv":
                state["out"] = open(state["tmp"], "wb")
                state["out"].write(f"{header}\n".encode())
            else:
                state["out"] = pq.ParquetWriter(state["tmp"], schema, store_schema=False)

        def flush() -> None:
            held, state["held"], state["size"], state["bytes"] = state["held"], [], 0, 0
            if not held:
                return
            if state["out"] is None:
                begin(held[0].schema)
            if fmt == "csv":
                for piece in held:
                    state["out"].write("".join(f"{line}\n" for line in piece.column(0).to_pylist()).encode())
            else:
                state["out"].write_table(pa.Table.from_batches(held).combine_chunks())

        def end() -> None:
            flush()
            if state["out"] is not None:
                state["out"].close()
                at = os.path.dirname(state["tmp"])
                part = parts.get(at, 0)
                os.replace(state["tmp"], f"{at}/part-{place:05d}-{run}.c{part:03d}.{'csv' if fmt == 'csv' else 'snappy.parquet'}")
                parts[at] = part + 1
            state["out"], state["rows"] = None, 0

        def add(piece: pa.RecordBatch) -> None:
            while piece.num_rows:
                now = piece.slice(0, min(piece.num_rows, most - state["rows"]))
                piece = piece.slice(now.num_rows)
                state["held"].append(now)
                state["rows"] += now.num_rows
                state["size"] += now.num_rows
                state["bytes"] += now.nbytes
                if state["rows"] >= most:
                    end()
                elif state["size"] >= group_rows or state["bytes"] >= group_bytes:
                    flush()

        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                runs = pc.run_end_encode(batch.column("__folder"))
                rest, first = batch.drop_columns(["__folder"]), 0
                if fmt != "csv":
                    rest = rest.replace_schema_metadata({"org.apache.spark.version": version})
                for value, last in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                    if value != state["value"]:
                        end()
                        state["value"] = value
                    add(rest.slice(first, last - first))
                    first = last
                total += batch.num_rows
            end()
        finally:
            if state["out"] is not None:
                state["out"].close()
                os.unlink(state["tmp"])
        yield pa.RecordBatch.from_pydict({"n": pa.array([total], pa.int64())})

    # Readers take dates ahead of 1582 from files that name a version as they stand.
    version = "4.0.0"
    return write


def _write_mounted(ordered: DataFrame, path: str, root: str, folder: str, fmt: str, most: int, header: str | None, options: dict) -> None:
    """One folder per value of ``folder`` on a mounted file system, by Arrow in Spark's tasks.

    There, Hadoop's file system starts a process for the mode of every folder, file and checksum, which for
    many small files is most of the time. Spark makes the folder, so that one that exists is an error; the
    mark of a whole export is set last.
    """
    mark = f"{root}/_SUCCESS"
    ordered.limit(0).write.partitionBy(folder).format(fmt).save(path)
    for name in (mark, f"{root}/._SUCCESS.crc"):
        if os.path.exists(name):
            os.unlink(name)
    kept, name = [c for c in ordered.columns if c != folder], F.col(folder).cast("string").alias("__folder")
    if fmt == "csv":
        rows = ordered.select(F.to_csv(F.struct(*kept), options).alias("line"), name)
    else:
        rows = ordered.select(*kept, name)
    run = os.path.basename(root.rstrip("/"))[-32:]
    done = rows.mapInArrow(_files_of(root, folder, run, fmt, most, header), "n long")
    with _batches_by_rows(ordered.sparkSession, rows):
        done.agg(F.sum("n")).first()
    open(mark, "wb").close()


def write_per_key(
    df: DataFrame,
    path: str,
    key: str = "transmitter",
    fmt: str = "parquet",
    mode: str = "errorifexists",
    keep_key: bool = True,
    max_records_per_file: int = 5_000_000,
    expand: Callable[[DataFrame], DataFrame] | None = None,
    size: Column | None = None,
) -> str:
    """Writes ``df`` under ``path/key=value/``.

    The files are planned from counts per key, by a narrow job ahead: about ``FILES_PER_TASK`` of them to
    a task, so that many small keys are written side by side, and keys with much of the data
    are dealt over salts in proportion to their rows. CSV keeps
    the key as a column as well, because those files are read by path, and a manifest of
    the files' header, so that the folder is read in one pass.

    With ``expand``, its result is written. It makes each row into ``size`` rows with the row's ``key``, in their order and
    without a shuffle; rows are then counted, dealt and ordered ahead of it, while they are few.

    New Parquet and CSV exports to a local or mounted folder are written by Arrow inside the tasks: a file appears under its
    name when it is whole, ``_SUCCESS`` when all are. Others go through Spark's writer.
    """
    spark, folder = df.sparkSession, f"by_{key}" if fmt == "csv" and keep_key else key
    files, hot = _plan(df, key, F.lit(1) if size is None else size, max_records_per_file)
    tasks = min(max(-(-files // FILES_PER_TASK), int(spark.conf.get("spark.sql.shuffle.partitions"))), MOST_TASKS)
    plain = [f.name for f in df.schema if "map" not in f.dataType.simpleString()]
    dealt = df.withColumn("__part", F.lit(0)) if hot is None else salted(df, hot, [key], plain, "__part")
    dealt = dealt.repartition(tasks, key, "__part").drop("__part")

    def whole(rows: DataFrame) -> DataFrame:
        made = rows if expand is None else expand(rows)
        return made if folder == key else made.withColumn(folder, F.col(key))

    schema = whole(df).schema
    options = {"header": "true", "nullValue": "NA", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"} if fmt == "csv" else {}
    names = [c for c in schema.names if c != folder]
    header = ",".join(f'"{n}"' if re.search(r'[",\n]', n) else n for n in names) if fmt == "csv" else None
    root = mounted(spark, path)
    if root and names and fmt in ("parquet", "csv") and mode in ("error", "errorifexists") and not _OWN_TYPES.search(schema.simpleString()):
        _write_mounted(whole(dealt.sortWithinPartitions(F.col(key).cast("string"), *plain)), path, root, folder, fmt, max_records_per_file, header, options)
    else:
        whole(dealt).write.mode(mode).option("maxRecordsPerFile", max_records_per_file).partitionBy(folder).options(**options).format(fmt).save(path)
    if fmt == "csv":
        index_headers(spark, path, names, header=header)
    return path


def write_clustered(df: DataFrame, path: str, keys: Sequence[str], mode: str = "errorifexists") -> str:
    """Writes ``df`` as Parquet in ranges of ``keys``, ordered by them within a file.

    The number of files follows the data's size, not the number of tags, and a hot
    tag is cut into ranges by the keys after it. A filter on the keys skips files and
    row groups by their statistics.
    """
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(mode).parquet(path)
    return path
