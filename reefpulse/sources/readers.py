"""Readers for the study's CSV files and for the parquet tables between stages."""

from __future__ import annotations

import csv
import os
import re
import stat
from collections.abc import Callable, Iterable, Iterator, Mapping
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from reefpulse.functions.clock import to_local
from reefpulse.sources import schemas

LOCAL_ZONE = "America/Virgin"


def _parsed(c: Column, dtype: str, fmt: str | None) -> Column:
    """Text as a date or wall clock. A format is applied by the CSV parser, which unlike
    the timestamp functions reads wall clocks without any time zone."""
    if not fmt:
        return c.try_cast(dtype)
    option = "dateFormat" if dtype == "date" else "timestampNTZFormat"
    return F.from_csv(c, f"t {dtype}", {option: fmt, "sep": "\x01"})["t"]


def typed(raw: DataFrame, columns: schemas.Columns, formats: Mapping[str, str] | None = None) -> DataFrame:
    """Text columns to typed, renamed columns; text that does not parse becomes null.

    Columns of ``columns`` missing from ``raw`` are left out.
    """
    formats = formats or {}

    def cast(name: str, dtype: str) -> Column:
        c = F.col(f"`{name}`")
        if dtype == "string":
            return c
        if dtype in ("date", "timestamp_ntz"):
            return _parsed(c, dtype, formats.get(name))
        return c.try_cast(dtype)

    present = set(raw.columns)
    return raw.select(*[cast(f, t).alias(n) for f, t, n in columns if f in present])


def read_text_columns(spark: SparkSession, path: str, na: str = "NA") -> DataFrame:
    """A CSV file or folder with every column as text; ``na`` and blanks are null.

    The header names the columns, so extra columns need no schema change. Files
    read together must agree on it: a differing header fails the read instead of
    shifting columns.
    """
    return _csv_reader(spark, na).csv(path)


def _csv_reader(spark: SparkSession, na: str):
    return (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("enforceSchema", False)
        .option("nullValue", na)
        .option("recursiveFileLookup", True)
    )


HEADERS = "_headers"
_HEADER_SCHEMA = "file string, length long, modified timestamp, header string"


# Files of a folder that Spark's own scan may list, which takes the driver some kilobytes for each. Beyond, on local or
# mounted storage, tasks list and read them.
MOST_LISTED = 10_000

# Bytes of a file that one task reads at a time, beside other pieces of it.
PIECE = 32 << 20

# Names of files that Spark's readers unpack.
_PACKED = r"(?i)\.(gz|gzip|bz2|deflate|snappy|lz4|zst|zstd)$"


def _tree(spark: SparkSession, path: str) -> str | None:
    """The folder's plain name, if ``path`` is a local or mounted folder."""
    root = mounted(spark, path)
    return os.path.normpath(root) if root and os.path.isdir(root) else None


def _name() -> Column:
    """A scanned row's file. Local ones are named with one slash or three, as their folder was given."""
    return F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")


def _listers(root: str) -> tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], ...]:
    """Two steps that list ``root`` inside tasks: the names in it, and the files at and below each of these, as Spark lists them."""
    escaped = re.compile(r"(?![A-Za-z0-9_.!~*'():@&=+$,;/-])[\x00-\x9f\s]")

    def seen(name: str) -> bool:
        hidden = name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)
        return not hidden or name.startswith(("_metadata", "_common_metadata"))

    def uri(name: str) -> str:
        """As ``_name``, where letters of any language stand as they are."""
        return "file:" + escaped.sub(lambda m: quote(m[0], safe=""), name)

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            held: list[str] = []
            with os.scandir(root) as found:
                for entry in found:
                    if seen(entry.name):
                        held.append(entry.name)
                        if len(held) == 5_000:
                            yield pa.RecordBatch.from_pydict({"name": pa.array(held, pa.string())})
                            held = []
            if held:
                yield pa.RecordBatch.from_pydict({"name": pa.array(held, pa.string())})

    def batch(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
        columns = zip(*rows)
        return pa.RecordBatch.from_pydict({n: pa.array(c, t) for (n, t), c in zip((("file", pa.string()), ("length", pa.int64()), ("modified", pa.int64())), columns)})

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            rows: list[tuple[str, int, int]] = []
            todo = [f"{root}/{name}" for name in given.column(0).to_pylist()]
            while todo:
                at = todo.pop()
                try:
                    about = os.stat(at)
                    inside = os.listdir(at) if stat.S_ISDIR(about.st_mode) else None
                except FileNotFoundError:
                    continue
                if inside is not None:
                    todo += [f"{at}/{name}" for name in inside if seen(name)]
                elif about.st_size:
                    rows.append((uri(at), about.st_size, about.st_mtime_ns // 1_000_000))
                if len(rows) == 5_000:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    return names, files


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Path, length and time of every file under ``path`` that is not empty; no content is read.

    A local or mounted folder is listed by tasks: one streams the names in it, which are dealt out to look below them.
    """
    root = _tree(spark, path)
    if root:
        names, files = _listers(root)
        dealt = spark.range(0, 1, 1, 1).mapInArrow(names, "name string").repartition(_tasks(spark), "name")
        listed = dealt.mapInArrow(files, "file string, length long, modified long")
        return listed.select("file", "length", F.timestamp_millis("modified").alias("modified"))
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    about = F.col("_metadata")
    return listed.select(_name().alias("file"), about["file_size"].alias("length"), about["file_modification_time"].alias("modified"))


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _line_reader() -> Callable[[str, int, int], Iterator[list[bytes]]]:
    """Reads lists of lines: those that begin in the bytes from ``start`` to ``end`` of a file, as Spark's readers cut lines.

    Pieces meet at line feeds. A byte order mark is left out. Little is held at once, whatever the file's size.
    """
    step = 1 << 20

    def lines(file: str, start: int, end: int) -> Iterator[list[bytes]]:
        with open(unquote(file.removeprefix("file:"), errors="strict"), "rb") as f:
            if start:
                f.seek(start - 1)
                while (skipped := f.readline(step)) and not skipped.endswith(b"\n"):
                    pass
            elif f.read(3) != b"\xef\xbb\xbf":
                f.seek(0)
            at, rest = f.tell(), b""
            more = at < end
            while more:
                chunk = f.read(min(step, end - at)) if at < end else f.readline(step)
                at += len(chunk)
                more = bool(chunk) and not (at >= end and chunk.endswith(b"\n"))
                chunk = rest + chunk
                # A carriage return at the very end may be half of a line's end.
                cut = max(chunk.rfind(b"\n"), chunk.rfind(b"\r", 0, len(chunk) - 1)) + 1 if more else len(chunk)
                rest = chunk[cut:]
                yield chunk[:cut].splitlines()

    return lines


def _heads(names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The first line of each file that holds all ``names``; a file is read no further than that."""
    lines = _line_reader()

    def head(file: str) -> str | None:
        for some in lines(file, 0, 2**63 - 1):
            for line in some:
                text = line.decode("utf-8", "replace")
                if all(name in text for name in names):
                    return text
        return None

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(file, text) for file in batch.column(0).to_pylist() if (text := head(file)) is not None]
            yield pa.RecordBatch.from_pydict({"file": pa.array([f for f, _ in found], pa.string()), "header": pa.array([h for _, h in found], pa.string())})

    return heads


def _lines_of(headers: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines of pieces of files without their header, each with the header's place in ``headers``.

    If there is but one, each file must begin with it, as in ``read_text_columns``.
    """
    lines, one, blank = _line_reader(), len(headers) < 2, bytes(range(33))
    places = {h: k for k, h in enumerate(headers)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of, size = [], [], 0
        for batch in batches:
            for file, start, end, header in zip(*[c.to_pylist() for c in batch.columns]):
                top = one and start == 0
                for some in lines(file, start, end):
                    if one:
                        kept = [line for line in some if line.strip(blank)]
                        if top and kept:
                            if kept.pop(0).decode("utf-8", "replace") != header:
                                raise ValueError(f"{file} begins with another header than the other files")
                            top = False
                    else:
                        kept = [line for line in some if line and line.decode("utf-8", "replace") != header]
                    held += kept
                    of += [places[header]] * len(kept)
                    size += sum(map(len, kept))
                    if len(held) >= 10_000 or size >= 4 << 20:
                        yield pa.RecordBatch.from_pydict({"value": pa.array(held, pa.binary()), "h": pa.array(of, pa.int32())})
                        held, of, size = [], [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"value": pa.array(held, pa.binary()), "h": pa.array(of, pa.int32())})

    return read


def _found_headers(spark: SparkSession, path: str, names: Iterable[str]) -> DataFrame:
    """file and header, the first line of each file that holds all ``names``: by one narrow scan of the text, or, of a folder
    of too many files to list, by tasks that open each file."""
    names = list(names)
    if _tree(spark, path):
        files = _files(spark, path).select("file")
        n, packed = files.agg(F.count(F.lit(1)), F.max(F.rlike("file", F.lit(_PACKED)))).first()
        if n > MOST_LISTED and not packed:
            return files.repartition(_tasks(spark), "file").mapInArrow(_heads(names), "file string, header string")
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        "value", _name().alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")
    )
    for name in names:
        lines = lines.filter(F.contains("value", F.lit(name)))
    return lines.groupBy("file").agg(F.min_by("value", F.struct("block", "line")).alias("header"))


def index_headers(spark: SparkSession, path: str, names: Iterable[str], header: str | None = None) -> str:
    """Writes a manifest of each file's header beside the files in the folder ``path``.

    ``header``, if given, is known to be that of all files, as after a write; otherwise
    the text is scanned once for them. With the manifest, which readers do not take for data,
    the folder is read in one pass from then on.
    """
    files = _files(spark, path)
    if header is not None:
        known = files.withColumn("header", F.lit(header))
    else:
        known = files.join(_found_headers(spark, path, names), "file")
    # As many files as the manifest's own size asks for, not one for each task that listed the folder.
    known = known.select("file", "length", "modified", "header").hint("rebalance")
    known.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{HEADERS}")
    return path


def _indexed_headers(spark: SparkSession, path: str) -> DataFrame | None:
    """file and header by the manifest, if there is one and it covers every file as it is now."""
    try:
        known = spark.read.schema(_HEADER_SCHEMA).parquet(f"{path.rstrip('/')}/{HEADERS}")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    # By an aggregate: a join might send the whole manifest, which is small while it is packed, through the driver.
    as_is = ["file", "length", "modified"]
    both = _files(spark, path).withColumn("known", F.lit(False)).unionByName(known.select(*as_is, F.lit(True).alias("known")))
    changed = both.groupBy(as_is).agg(F.bool_or("known").alias("known")).filter("NOT known")
    return known.select("file", "header") if changed.isEmpty() else None


def _fields_of(header: str) -> list[str]:
    """Column names of a header line; empty and repeated ones get their place added."""
    names = next(csv.reader([header.removeprefix("\ufeff")]))
    return [f"{n}_c{i}" if not n or n in names[:i] else n for i, n in enumerate(names)]


def _with_headers(files: DataFrame, headers: DataFrame) -> DataFrame:
    """file, length and header of the files that have one; as a join, but never by way of the driver."""
    both = files.select("file", "length").unionByName(headers.select("file", "header"), allowMissingColumns=True)
    return both.groupBy("file").agg(F.max("length").alias("length"), F.max("header").alias("header")).dropna()


def read_mixed_columns(spark: SparkSession, path: str, names: Iterable[str], na: str = "NA") -> DataFrame:
    """As ``read_text_columns`` for a folder whose files differ in columns or their order.

    A file's header is its first line that holds all ``names``. By the folder's manifest (``index_headers``)
    headers are known without reading any text; else they are found by a narrow scan ahead. A folder
    of one header is then one CSV scan. Otherwise the text is scanned once, each line meets
    its file's header by an equi-join, and is parsed by that; there are few distinct headers, and columns
    that one lacks are null. No list of files is gathered: a local or mounted folder of more than ``MOST_LISTED`` files is
    listed by tasks, which read pieces of the files, and so takes the driver no memory for a file.
    """
    headers = _indexed_headers(spark, path)
    headers = _found_headers(spark, path, names) if headers is None else headers
    each = headers.groupBy("header").agg(F.count(F.lit(1)).alias("files"), F.max(F.rlike("file", F.lit(_PACKED))).alias("packed"))
    found = each.orderBy("header").collect()
    distinct = [r.header for r in found]
    many = sum(r.files for r in found) > MOST_LISTED and not any(r.packed for r in found) and _tree(spark, path) is not None
    if len(distinct) < 2 and not many:
        return read_text_columns(spark, path, na)
    if many:
        files = _files(spark, path)
        files = _with_headers(files, headers) if len(distinct) > 1 else files.withColumn("header", F.lit(distinct[0]))
        pieces = files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(PIECE).cast("long"))))
        pieces = pieces.select("file", "start", F.least("length", F.col("start") + PIECE).alias("end"), "header")
        lines = pieces.repartition(_tasks(spark), "file", "start").mapInArrow(_lines_of(distinct), "value binary, h int")
        lines, of = lines.withColumn("value", F.col("value").cast("string")), [F.col("h") == k for k in range(len(distinct))]
    else:
        lines = spark.read.option("recursiveFileLookup", True).text(path).select("value", _name().alias("file"))
        lines = lines.filter("value <> ''").join(headers, "file").filter("value <> header")
        of = [F.col("header") == h for h in distinct]
    if len(distinct) > 1:
        fields = [_fields_of(h) for h in distinct]
    else:
        fields = [_csv_reader(spark, na).option("enforceSchema", True).csv(spark.sparkContext.parallelize(distinct, 1)).columns]
    options = {"nullValue": na, "mode": "PERMISSIVE"}
    parsed = {
        f"__h{k}": F.when(mine, F.from_csv("value", ", ".join(f"`{n.replace('`', '``')}` string" for n in f), options))
        for k, (mine, f) in enumerate(zip(of, fields))
    }
    rows = lines.withColumns(parsed)
    every = list(dict.fromkeys(n for f in fields for n in f))
    return rows.select(*[
        F.coalesce(*[F.col(f"__h{k}")[n] for k, f in enumerate(fields) if n in f]).alias(n) for n in every
    ])


def read_detections(
    spark: SparkSession,
    path: str,
    columns: schemas.Columns = schemas.DETECTIONS,
    formats: Mapping[str, str] | None = None,
) -> DataFrame:
    """One table from a folder of per-tag detection CSVs, each read by its own header.

    The files' own order by time is not kept: order only where it is needed.
    """
    return typed(read_mixed_columns(spark, path, [f for f, _, _ in schemas.DETECTIONS]), columns, formats)


def with_file_tag(df: DataFrame, column: str = "file_tag") -> DataFrame:
    """Adds the name of the source file without ``.csv``. Only directly on a scan."""
    return df.withColumn(column, F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", ""))


def read_stage(spark: SparkSession, path: str, schema: StructType, tags: Iterable[str] | None = None) -> DataFrame:
    """A parquet table between stages, written per tag or clustered by tag. ``tags`` prunes
    the scan to those folders, or to files and row groups that may hold them.

    The schema is given, so opening reads no file and a tag such as ``007`` in a
    folder name stays text.
    """
    df = spark.read.schema(schema).parquet(path)
    return df if tags is None else df.filter(F.col("transmitter").isin(list(tags)))


def mounted(spark: SparkSession, path: str) -> str | None:
    """The folder's plain name, if ``path`` is on this machine's file system or a mount in it."""
    scheme = urlsplit(path).scheme or urlsplit(spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")).scheme
    plain = re.sub(r"^file:/*", "/", path)
    return plain if scheme == "file" and plain.startswith("/") else None


_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def _listed(root: str, key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Values of ``key`` and names of the folders in ``root``, a few thousand at a time."""

    def batch(names: list[str]) -> pa.RecordBatch:
        values = [unquote(n.partition("=")[2], errors="strict") for n in names]
        return pa.RecordBatch.from_pydict({key: pa.array([None if v == none else v for v in values], pa.string()), "folder": pa.array(names, pa.string())})

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            names: list[str] = []
            with os.scandir(root) as found:
                for entry in found:
                    if entry.name.startswith(f"{key}="):
                        names.append(entry.name)
                        if len(names) == 5_000:
                            yield batch(names)
                            names = []
            if names:
                yield batch(names)

    none = _NO_VALUE
    return listed


def stage_folders(spark: SparkSession, path: str, key: str = "transmitter") -> DataFrame:
    """``key`` and ``folder``: one row per folder of a table written by ``write_per_key``, dealt by key. No file is opened, and
    on local or mounted storage one task streams the folders' names and no file is listed.
    """
    root, tasks = mounted(spark, path), int(spark.conf.get("spark.sql.shuffle.partitions"))
    if root:
        return spark.range(0, 1, 1, 1).mapInArrow(_listed(root, key), f"`{key}` string, folder string").repartition(tasks, key)
    folder = F.element_at(F.split("file", "/"), -2)
    folders = _files(spark, path).select(F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B"))).alias("folder")).distinct()
    value = F.url_decode(F.replace(F.substring_index("folder", "=", -1), F.lit("+"), F.lit("%2B")))
    return folders.filter(F.startswith("folder", F.lit(f"{key}="))).select(F.nullif(value, F.lit(_NO_VALUE)).alias(key), "folder")


def _files_in(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The files of each folder, beside the folder's key."""

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], []
            for k, folder in enumerate(batch.column("folder").to_pylist()):
                for name in os.listdir(f"{root}/{folder}"):
                    if not name.startswith(("_", ".")):
                        keys.append(k)
                        found.append(f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(found, pa.string())], names=[batch.schema.names[0], "file"])

    return files


def _rows_of(root: str, key: str, wanted: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows of each file, a row group at a time; columns that a file lacks are null."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with pq.ParquetFile(f"{root}/{name}", coerce_int96_timestamp_unit="us") as file:
                    held = set(file.schema_arrow.names)
                    columns = [f.name for f in wanted if f.name in held and f.name != key]
                    for group in range(file.num_row_groups):
                        for piece in file.read_row_group(group, columns, use_threads=False).to_batches(10_000):
                            made = [
                                pa.repeat(pa.scalar(value).cast(f.type), piece.num_rows) if f.name == key
                                else pa.nulls(piece.num_rows, f.type) if f.name not in held
                                else piece.column(f.name).cast(f.type)
                                for f in wanted
                            ]
                            yield pa.RecordBatch.from_arrays(made, schema=wanted)

    return rows


def read_folders(spark: SparkSession, path: str, schema: StructType, folders: DataFrame, key: str = "transmitter") -> DataFrame:
    """As ``read_stage``, but only the folders in ``folders``, some rows of ``stage_folders``.

    There may be any number of them: on local or mounted storage their files are dealt over tasks by name and read there by Arrow, so
    others are neither listed nor opened and no list is gathered. Elsewhere the whole is scanned and joined.
    """
    whole = StructType([StructField(f.name, f.dataType) for f in schema])
    root = mounted(spark, path)
    if not root:
        return read_stage(spark, path, whole).join(folders.select(F.col(key).cast(whole[key].dataType)), key, "left_semi").select(whole.names)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = folders.select(key, "folder").mapInArrow(_files_in(root), f"`{key}` string, file string")
    return files.repartition(tasks, "file").mapInArrow(_rows_of(root, key, to_arrow_schema(whole)), whole)


def read_dimension(
    spark: SparkSession, path: str, columns: schemas.Columns, formats: Mapping[str, str] | None = None
) -> DataFrame:
    """A station, transmitter, slack-tide or report table.

    Two-digit years: ``yy`` is 2000-based here (75 is 2075).
    """
    return typed(read_text_columns(spark, path), columns, formats)


def parse_moons(raw: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    """Full moons from month abbreviation, day, year and UTC time of day."""
    text = F.concat_ws(" ", "month", "day", "year", "time_utc")
    utc = F.to_timestamp_ntz(text, F.lit("MMM d yyyy HH:mm:ss"))
    return (
        raw.withColumn("datetime_utc", utc)
        .withColumn("datetime_local", to_local("datetime_utc", zone))
        .withColumn("date", F.col("datetime_local").cast("date"))
    )


def read_moons(spark: SparkSession, path: str, zone: str = LOCAL_ZONE) -> DataFrame:
    return parse_moons(read_dimension(spark, path, schemas.MOONS), zone)


def read_currents(spark: SparkSession, path: str, fmt: str = "M/d/yy H:mm") -> DataFrame:
    """Current-profiler export: local time, and direction and speed of all depth bins the file has."""
    raw = read_text_columns(spark, path)
    bins = sum(name.startswith("Direction ") for name in raw.columns)
    return typed(raw, schemas.currents(bins), {schemas.CURRENT_TIME[0]: fmt})


def read_ring(spark: SparkSession, path: str) -> DataFrame:
    """Closed-area outline as one row holding an array<struct<long,lat>> in file order."""
    pts = read_dimension(spark, path, schemas.CLOSED_AREA).withColumn("i", F.monotonically_increasing_id())
    ring = F.array_sort(F.collect_list(F.struct("i", "long", "lat")))
    return pts.agg(F.transform(ring, lambda p: F.struct(p["long"].alias("long"), p["lat"].alias("lat"))).alias("ring"))
