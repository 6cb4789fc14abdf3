"""File sources and sinks: directory scans, archives, JSON results, sharded and incremental parquet."""

from __future__ import annotations

import contextlib
import io
import json
import sqlite3
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from ..functions.text import safe_file_name, stem
from ..operators.ranking import numbered
from ..session import settled, ship

FONT_SUFFIXES = ("ttf", "otf", "woff", "woff2")
ENTRIES, HELD = 1000, 16 << 20  # entries of an archive, and bytes of their contents, that leave a task at once


def scan(spark: SparkSession, folder: str, suffixes: Sequence[str] = FONT_SUFFIXES, recursive: bool = True) -> DataFrame:
    """path, length, modificationTime of the files of these suffixes; contents are pruned from the scan."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(folder).select("path", "length", "modificationTime").orderBy("path")


def register_files(found: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New files, and a count for each status (registered, already_registered)."""
    known = table.select(F.col("file_path").alias("_known"))
    marked = found.join(known.distinct(), F.col("path") == F.col("_known"), "left").withColumn("status", F.when(F.col("_known").isNull(), "registered").otherwise("already_registered"))
    return marked.where("_known IS NULL").drop("_known", "status"), marked.groupBy("status").agg(F.count("*").alias("n"))


def entries_of(archives: Iterator[tuple[str, bytes]], ends: tuple[str, ...], folder: str = "") -> Iterator[pd.DataFrame]:
    """archive, entry, name, content of the entries of archives (path, content), ``ENTRIES`` or some ``HELD`` bytes at a time."""
    columns, rows, size = ["archive", "entry", "name", "content"], [], 0
    for path, content in archives:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for e in sorted(z.namelist()):
                if e.startswith(folder) and e.lower().endswith(ends):
                    rows.append((path, e, e.rsplit("/", 1)[-1], z.read(e)))
                    size += len(rows[-1][3])
                    if len(rows) >= ENTRIES or size >= HELD:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, size = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def zip_entries(spark: SparkSession, glob: str, suffixes: Sequence[str] = FONT_SUFFIXES, folder: str = "") -> DataFrame:
    """archive, entry, name, content of the entries of all archives, opened on the executors."""
    ship(spark)
    ends = tuple(f".{s}" for s in suffixes)
    run = lambda frames: entries_of(((path, content) for f in frames for path, content in zip(f["path"], f["content"], strict=True)), ends, folder)
    rows = spark.read.format("binaryFile").load(glob).select("path", "content").mapInPandas(run, "archive string, entry string, name string, content binary")
    return rows.withColumn("name", safe_file_name(F.col("name")))


def zip_manifest(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """archive and the rows of ``fonts`` in each archive's manifest.json."""
    ship(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    if "manifest.json" in z.namelist():
                        rows.append((path, z.read("manifest.json").decode()))
            yield pd.DataFrame(rows, columns=["archive", "text"])

    text = spark.read.format("binaryFile").load(glob).select("path", "content").mapInPandas(run, "archive string, text string")
    return text.select("archive", F.inline(F.from_json("text", f"STRUCT<fonts: ARRAY<STRUCT<{schema}>>>")["fonts"]))


def import_archives(entries: DataFrame, manifest: DataFrame) -> DataFrame:
    """Entries with what the manifest says of them; else named by their stem and sourced by their folder."""
    m = manifest.select(F.col("archive").alias("_a"), F.col("path").alias("_p"), F.col("name").alias("_n"), F.col("source").alias("_s"))
    folder = F.when(F.size(F.split("entry", "/")) > 2, F.get(F.split("entry", "/"), F.lit(1)))
    return entries.join(m, (F.col("archive") == F.col("_a")) & (F.col("entry") == F.col("_p")), "left").select("archive", "entry", "content", F.coalesce("_n", stem(F.col("entry"))).alias("name"), F.coalesce("_s", folder, F.lit("unknown")).alias("source"))


def write_archive(files: DataFrame, path: str) -> DataFrame:
    """A ZIP file of (source, name, file_name, content) in that order, with a manifest; rows without content are skipped: path, n_files.

    An archive has one writer, so one executor streams the rows into it; it holds one of them.
    """
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, target = pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)
        fs.create_dir(target.rpartition("/")[0], recursive=True)
        draft, listed = f"{target}.{uuid.uuid4().hex}", []
        with fs.open_output_stream(draft) as sink, zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
            for b in batches:
                for source, name, file_name, content in zip(*(b.column(i) for i in range(4)), strict=True):
                    at = f"fonts/{source.as_py()}/{file_name.as_py()}"
                    z.writestr(at, content.as_py())
                    listed.append({"name": name.as_py(), "source": source.as_py(), "path": at})
            z.writestr("manifest.json", json.dumps({"font_count": len(listed), "fonts": listed}))
        fs.move(draft, target)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(listed)], pa.int64())], names=["path", "n_files"])

    rows = files.where(F.col("content").isNotNull()).select("source", "name", "file_name", "content")
    return settled(rows.repartition(1).sortWithinPartitions("source", "name").mapInArrow(run, "path string, n_files long"), "archive")


def save_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def load_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON arrays or of lines."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def catalog_json(items: DataFrame, duplicates: DataFrame, removed: DataFrame) -> DataFrame:
    """One JSON document of three lists; for catalogues of a size to be read whole."""
    parts = [d.agg(F.array_sort(F.collect_list(F.struct(*d.columns))).alias(n)) for d, n in ((items, "fonts"), (duplicates, "duplicates"), (removed, "removed"))]
    return parts[0].join(parts[1], F.lit(True)).join(parts[2], F.lit(True)).select(F.to_json(F.struct("fonts", "duplicates", "removed")).alias("catalog"))


def dense_index(df: DataFrame, order: Sequence[str], name: str = "idx") -> DataFrame:
    """Numbers rows from 0 in the order, range by range."""
    return numbered(df, order[0], name, *order[1:]).withColumn(name, F.col(name) - 1)


def keyed_samples(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows with a dense index and its zero-padded key."""
    return dense_index(df, order).withColumn("key", F.lpad(F.col("idx").cast("string"), 8, "0"))


def write_sharded(df: DataFrame, path: str, rows: int) -> None:
    df.write.option("maxRecordsPerFile", rows).mode("overwrite").parquet(path)


def append_missing(df: DataFrame, key: str, path: str) -> int:
    """Append the rows whose key the dataset lacks; the number written."""
    spark = df.sparkSession
    try:
        fresh = df.join(spark.read.parquet(path).select(key), key, "left_anti")
    except Exception as e:  # the first write
        if "PATH_NOT_FOUND" not in str(e):
            raise
        fresh = df
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n


def packed_index(fonts: DataFrame, chars: DataFrame, n_chars: int) -> DataFrame:
    """Row number of each (font, char) in a fixed-width pack; fonts have ``font_idx``, chars ``char_idx``."""
    if (n := chars.count()) > n_chars:
        raise ValueError(f"{n} characters do not fit into rows of {n_chars}")
    return fonts.join(F.broadcast(chars), F.lit(True)).withColumn("idx", F.col("font_idx") * n_chars + F.col("char_idx"))  # at most n_chars rows


def epoch_runs(paths: DataFrame, least: int = 5) -> DataFrame:
    """run, epochs of training folders whose ``epoch_N`` folders hold images; runs of too few epochs go."""
    p = paths.select(F.regexp_extract("path", r"^(.*?)/(?:tracking/)?epoch_\d+/[^/]*\.png$", 1).alias("run"), F.regexp_extract("path", r"/epoch_(\d+)/[^/]*\.png$", 1).alias("epoch")).where("run != ''")
    return p.groupBy("run").agg(F.count_distinct("epoch").alias("epochs")).where(F.col("epochs") >= least)


def runs_by_time(files: DataFrame) -> DataFrame:
    """run, newest of the runs (folders) of files, the newest first."""
    run = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return files.groupBy(run.alias("run")).agg(F.max("modificationTime").alias("newest")).orderBy(F.desc("newest"), "run")


def extract_new(entries: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries to be written (those whose name is not there yet, the first of each name), and how many names there are in all, written or not."""
    w = Window.partitionBy("name").orderBy("archive", "entry")
    first = entries.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return first.join(existing.select("name"), "name", "left_anti"), first.agg(F.count("*").alias("n"))


def write_samples(df: DataFrame, order: Sequence[str], path: str) -> None:
    """A key/value store of samples: rows by zero-padded key below ``samples``, and their number and columns below ``header``."""
    rows = keyed_samples(df, order)
    rows.write.mode("overwrite").parquet(f"{path}/samples")
    spark = df.sparkSession
    n = spark.read.parquet(f"{path}/samples").count()
    spark.createDataFrame([(n, ",".join(df.columns))], "length long, columns string").coalesce(1).write.mode("overwrite").json(f"{path}/header")


def read_samples(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The samples, and the length that the header says; they must agree."""
    header = spark.read.schema("length long, columns string").json(f"{path}/header").first()
    rows = spark.read.parquet(f"{path}/samples")
    if rows.count() != header["length"]:
        raise ValueError(f"{path} has {rows.count()} samples, its header says {header['length']}")
    return rows, header["length"]


def dictionary(df: DataFrame, value: str, name: str = "code") -> DataFrame:
    """value, code: the distinct values numbered from 0 in order."""
    return dense_index(df.where(F.col(value).isNotNull()).select(value).distinct(), [value], name)


def write_dataset(samples: DataFrame, path: str, characters: str = "char", writers: str = "writer") -> None:
    """Dictionaries of characters and writers, the samples by their codes, and counts: a folder a relation."""
    chars, hands = dictionary(samples, characters, "char_code"), dictionary(samples, writers, "writer_code")
    for name, d in (("characters", chars), ("writers", hands), ("samples", samples.join(chars, characters).join(hands, writers).drop(characters, writers))):
        d.write.mode("overwrite").parquet(f"{path}/{name}")
    samples.agg(F.count("*").alias("samples"), F.count_distinct(characters).alias("characters"), F.count_distinct(writers).alias("writers")).coalesce(1).write.mode("overwrite").json(f"{path}/stats")


def write_pack(df: DataFrame, path: str) -> int:
    """Rows of a fixed-width pack (idx, data) that the pack lacks, in order of idx; the number written. A null ``data`` is an invalid place."""
    return append_missing(df.select("idx", "data", F.col("data").isNotNull().alias("valid")).repartitionByRange("idx").sortWithinPartitions("idx"), "idx", path)


def write_npz(df: DataFrame, path: str, key: str, array: str, rows: int = 1000) -> DataFrame:
    """Compressed numpy archives of ``rows`` arrays (array<double>) each, and their index: file, key, place. Files are numbered by range of the key."""
    ship(df.sparkSession)
    numbered_rows = dense_index(df.select(key, array), [key], "_at").withColumn("_file", F.floor(F.col("_at") / rows).cast("long"))

    def write(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_at")
        fs, root = pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)
        fs.create_dir(root, recursive=True)
        name = f"shard-{int(group['_file'].iloc[0]):06d}.npz"
        out = io.BytesIO()
        np.savez_compressed(out, **{str(k): np.asarray(v, float) for k, v in zip(group[key], group[array])})
        draft = f"{root}/.{name}-{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as sink:
            sink.write(out.getvalue())
        fs.move(draft, f"{root}/{name}")
        return pd.DataFrame({"file": name, key: group[key], "place": range(len(group))})

    kind = df.schema[key].dataType.simpleString()
    return settled(numbered_rows.groupBy("_file").applyInPandas(write, f"file string, {key} {kind}, place int"), "npz-index")


def read_npz(index: DataFrame, path: str, key: str) -> DataFrame:
    """key, values of the arrays that an index names, a file a task."""
    ship(index.sparkSession)

    def read(group: pd.DataFrame) -> pd.DataFrame:
        fs, root = pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)
        with fs.open_input_file(f"{root}/{group['file'].iloc[0]}") as source, np.load(io.BytesIO(source.read())) as z:
            return pd.DataFrame([(k, z[str(k)].tolist()) for k in group[key]], columns=[key, "values"])

    return index.groupBy("file").applyInPandas(read, f"{key} {index.schema[key].dataType.simpleString()}, values array<double>")


class SqliteSource(DataSource):
    """A Python data source of SQLite: options ``path``, ``table`` and ``schema_ddl``; ``pieces`` spans of rowid are read side by side."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        return self.options["schema_ddl"]

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(self.options)


class Span(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


COMPARED = ("=", ">", ">=", "<", "<=")


@contextlib.contextmanager
def opened_sqlite(path: str) -> Iterator[sqlite3.Connection]:
    """A database file for reading: in place, or from a store that pyarrow's file systems know, whole in memory."""
    local = path.removeprefix("file://").removeprefix("file:")
    if "://" in local:
        fs, inner = pyarrow.fs.FileSystem.from_uri(path)
        db = sqlite3.connect(":memory:")
        with fs.open_input_file(inner) as f:
            db.deserialize(f.read())
    else:
        db = sqlite3.connect(f"file:{local}?mode=ro", uri=True)
    try:
        yield db
    finally:
        db.close()


class SqliteReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.table, self.pieces = options["path"], options["table"], int(options.get("pieces", "4"))
        self.columns = [f.strip().split(" ")[0] for f in options["schema_ddl"].split(",")]
        self.where, self.values = [], []
        for column, kind, value in json.loads(options.get("where", "[]")):
            name = '"' + column.replace('"', '""') + '"'
            if kind in COMPARED:
                self.where.append(f"{name} {kind} ?")
                self.values.append(value)
            elif kind == "in":
                self.where.append(f"{name} IN ({', '.join('?' * len(value))})")
                self.values += value
            elif kind in ("is null", "is not null"):
                self.where.append(f"{name} {kind}")
            else:
                raise ValueError(f"unknown comparison {kind}")

    def partitions(self) -> list[InputPartition]:
        with opened_sqlite(self.path) as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return []
        cuts = [low + (high + 1 - low) * i // self.pieces for i in range(self.pieces + 1)]
        return [Span(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]

    def query(self) -> str:
        names = ", ".join(f'"{c}"' for c in self.columns)
        return " AND ".join([f'SELECT {names} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', *self.where])

    def read(self, partition: Span | None) -> Iterator[tuple]:
        if partition is None:  # of an empty table
            return
        with opened_sqlite(self.path) as db:
            yield from db.execute(self.query(), (partition.low, partition.high, *self.values))


def write_sqlite(df: DataFrame, path: str, table: str) -> DataFrame:
    """The rows of a frame as a table of a new database file: path, n_rows. One executor streams them into it, as such a file has one writer."""
    columns, types = df.columns, {"string": "TEXT", "double": "REAL", "float": "REAL", "binary": "BLOB"}
    ddl = ", ".join(f'"{n}" {types.get(k, "INTEGER")}' for n, k in df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as own:  # the file is built in the task's own folder and then copied
            name, n = f"{own}/table.db", 0
            db = sqlite3.connect(name)
            db.execute(f'CREATE TABLE "{table}" ({ddl})')
            for b in batches:
                db.executemany(f'INSERT INTO "{table}" VALUES ({", ".join("?" * len(columns))})', zip(*[c.to_pylist() for c in b.columns], strict=True))
                n += b.num_rows
            db.commit()
            db.close()
            fs, inner = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
            fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
            draft = f"{inner}.{uuid.uuid4().hex}"
            with open(name, "rb") as f, fs.open_output_stream(draft) as to:
                while part := f.read(1 << 20):
                    to.write(part)
            fs.move(draft, inner)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n])], names=["path", "n_rows"])

    ship(df.sparkSession)
    made = settled(df.coalesce(1).mapInArrow(run, "path string, n_rows long"), "written")
    if made.isEmpty():  # a plan without rows runs no task
        made = settled(df.sparkSession.range(1).mapInArrow(lambda _: run(iter(())), "path string, n_rows long"), "written")
    return made


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, pieces: int = 4, where: Sequence[tuple] = ()) -> DataFrame:
    """The rows of a SQLite table; the file must lie where all executors see it.

    ``where`` has conditions (column, ``=`` | ``>`` | ``>=`` | ``<`` | ``<=`` | ``in`` | ``is null`` | ``is not null``, value or None) that
    SQLite evaluates in each span of rows; columns beyond the schema may be named. They are an argument and
    not pushed by the optimizer: Spark 4.1 keeps what one query has pushed into a Python source for other
    queries on the same frame.
    """
    ship(spark)
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").options(path=path, table=table, schema_ddl=schema, pieces=str(pieces), where=json.dumps([list(w) for w in where])).load()
