"""Text, CSV, TSV and log-tree sources and sinks with explicit schemas."""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatchcase as fnmatch

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lathe.shared import durable


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Header CSV, every value text; quotes double, lines may run over."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(", ".join(f"`{c}` string" for c in columns)).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').csv(path)


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    """size, path of lines cut at the first tab; a size that isn't all digits is 0."""
    cut = F.split("value", "\t", 2)
    size = F.when(F.get(cut, 0).rlike("^[0-9]+$"), F.get(cut, 0).try_cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return spark.read.text(path).select(size.alias("size"), F.coalesce(F.get(cut, 1), F.lit("")).alias("path"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that aren't blank or comments."""
    return spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))


def scan_tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path (relative), size and time of every file below a folder that any Hadoop file system holds; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "length", "modificationTime")
    base = root.rstrip("/").split("://")[-1] + "/"
    return files.select(F.substring_index("path", base, -1).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("stamp"))


def numbered_lines(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """file, line_no (from 1), raw of text files below a folder.

    A file is cut into blocks; a line's number is its place in its block plus the lines of the
    blocks before, so that a file of any size is never one row and a block never more than a split.
    """
    lines = spark.read.text(root, recursiveFileLookup=True, pathGlobFilter=glob).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = durable(lines.withColumn("place", F.monotonically_increasing_id()), "lines")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    here = F.row_number().over(Window.partitionBy("file", "block").orderBy("place"))
    return lines.join(blocks, ["file", "block"]).select("file", (here + F.col("before")).cast("int").alias("line_no"), "raw")


def write_logs(df: DataFrame, tag: str, day: str, target: str, line: str, order: str, root: str) -> None:
    """A tree <root>/tag=/year=/month=/day=/target= with one file of lines, in order, for each tag, day (a date) and target."""
    part = lambda name, form: F.date_format(day, form).alias(name)
    by = ["tag", "year", "month", "day", "target"]
    rows = df.select(F.col(tag).alias("tag"), part("year", "yyyy"), part("month", "MM"), part("day", "dd"), F.col(target).alias("target"), F.col(line).alias("value"), F.col(order).alias("_o"))
    rows.repartition(*by).sortWithinPartitions(*by, "_o").drop("_o").write.partitionBy(*by).text(root)


def read_logs(spark: SparkSession, root: str, glob: str = "*.log") -> DataFrame:
    """tag, file_date, target, line_no (from 1), raw of a tree <root>/tag/yyyy/mm/dd/target.log, or of one that ``write_logs`` has made (``*.txt``)."""
    tree = r"/(?:tag=)?([^/]+)/(?:year=)?(\d{4})/(?:month=)?(\d{2})/(?:day=)?(\d{2})/(?:target=([^/]+)/[^/]+|([^/]+)\.log)$"
    part = lambda i: F.regexp_extract("file", tree, i)
    day = F.to_date(F.concat_ws("-", part(2), part(3), part(4)), "yyyy-MM-dd")
    return numbered_lines(spark, root, glob).select(part(1).alias("tag"), day.alias("file_date"), F.concat(part(5), part(6)).alias("target"), "line_no", "raw")


def write_documents(df: DataFrame, name: str, doc: str, path: str) -> None:
    """One folder of documents by name; a null document is no file."""
    df.where(F.col(doc).isNotNull()).select(F.col(name).alias("name"), F.col(doc).cast("string").alias("value")).write.partitionBy("name").text(path)


def json_map(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row ``doc``: a JSON object of key and value, keys in order; a report-sized table."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v"))))
    return df.agg(F.to_json(F.map_from_entries(pairs)).alias("doc"))


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.text(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files that hold one array of records each."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_fixture(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Space-separated columns; blanks, comments and what follows the last column are dropped."""
    parts = F.split(F.trim("value"), r"\s+")
    return read_lines(spark, path).select(*(F.get(parts, i).alias(c) for i, c in enumerate(columns)))


def write_ledger(df: DataFrame, path: str) -> None:
    """Tab-separated (table, n)."""
    df.select("table", "n").write.csv(path, sep="\t")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("table string, n long").csv(path, sep="\t")


def read_telemetry(spark: SparkSession, path: str, event: str) -> DataFrame:
    """(at, one row an event, intact, raw) of lines ``client-event at=<time> batch=<JSON array>``; ``event`` is its record type.

    A line whose body is cut or no JSON array of records is a row without an event, ``intact`` false and the body in ``raw``;
    an empty array gives no row.
    """
    part = lambda i: F.regexp_extract("value", r"client-event at=(\S+) batch=(.*)$", i)
    lines = spark.read.text(path).where(F.col("value").contains("client-event at="))
    whole = part(2).rlike(r"^\s*\[") & F.try_parse_json(part(2)).isNotNull()
    body = F.when(whole, F.from_json(part(2), f"array<struct<{event}>>"))
    rows = lines.select(F.try_to_timestamp(part(1)).alias("at"), part(2).alias("raw"), body.alias("body")).where("body IS NULL OR size(body) > 0")
    rows = rows.select("at", F.explode_outer("body").alias("e"), F.col("body").isNotNull().alias("intact"), "raw")
    return rows.select("at", "e.*", "intact", F.when(~F.col("intact"), F.col("raw")).alias("raw"))


def write_named(docs: DataFrame, folder: str) -> None:
    """Each (name, doc) as a file of its own; a task that is run again replaces its files."""

    def put(rows) -> None:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for r in rows:
            with fs.open_output_stream(f"{root}/{r.name}") as file:
                file.write(r.doc.encode())

    docs.foreachPartition(put)


def list_tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, size) of every file below a folder, empty ones too, which Spark's own readers pass over.

    The driver lists the folder itself, tasks what is below each of its subfolders.
    """
    fs, base = pafs.FileSystem.from_uri(root)
    top = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    start = [(i.base_name, i.size) for i in top if i.type is not pafs.FileType.NotFound]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                infos = [(name, size)] if size is not None else [(i.path[len(base.rstrip("/")) + 1 :], i.size) for i in fs.get_file_info(pafs.FileSelector(f"{base}/{name}", recursive=True)) if i.is_file]
                kept = [(p, n) for p, n in infos if fnmatch(p.rsplit("/", 1)[-1], glob)]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["path", "size"])

    names = spark.createDataFrame(start, "path string, size long")
    return names.repartition(max(1, min(len(start), 200))).mapInArrow(walk, "path string, size long")


def tail_verdicts(spark: SparkSession, root: str, marker: str, glob: str = "*", last: int = 100) -> DataFrame:
    """(path, size, verdict, n_read): ``complete`` if the marker is in a file's last bytes, else ``truncated``, or ``empty``.

    Only the last ``last`` bytes of a file are read, whatever its size.
    """
    wanted, top = marker.encode(), root.rstrip("/")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts, read = [], []
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, name = pafs.FileSystem.from_uri(f"{top}/{path}")
                end = b""
                if size:
                    with fs.open_input_file(name) as file:
                        file.seek(max(0, size - last))
                        end = file.read(last)
                verdicts.append("complete" if wanted in end else "truncated" if size else "empty")
                read.append(len(end))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(verdicts, pa.string()), pa.array(read, pa.int64())], ["path", "size", "verdict", "n_read"])

    return list_tree(spark, root, glob).mapInArrow(look, "path string, size long, verdict string, n_read long")
