"""Readers and writers: blank-line documents, JSON lines, manifests, Wikipedia XML, bins and packed tokens."""

from __future__ import annotations

import io
import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from corpusloom.functions.normalize import strip, unescape_newlines
from corpusloom.plans.storage import Stash

DOCS_PER_FILE, CHUNK_DOCS = 65_536, 25_600
#: The header of a packed token file, and its codes of element types.
PACKED_MAGIC, PACKED_VERSION = b"LITPKDS", 1
PACKED_TYPES = {1: "u1", 2: "i1", 3: "i2", 4: "i4", 5: "i8", 6: "f4", 7: "f8", 8: "u2"}


def read_blank_line_documents(spark: SparkSession, path: str) -> DataFrame:
    """text per run of non-blank lines (each trimmed), blank lines between. The reader cuts files at blank lines, so
    a large file is split over tasks; the last document needs no blank line behind it."""
    rows = spark.read.option("lineSep", "\n\n").text(path)
    pieces = rows.select(F.explode(F.split("value", r"\n\s*\n|^\s*\n")).alias("v"))
    kept = F.filter(F.transform(F.split("v", "\n"), strip), lambda x: x != "")
    return pieces.select(F.array_join(kept, "\n").alias("text")).where("text != ''")


def documents_from_lines(lines: DataFrame, file: str = "file", number: str = "line_no", value: str = "value") -> DataFrame:
    """The same from numbered lines: file, id (non-blank lines up to the document's end), text."""
    from pyspark.sql import Window

    order = Window.partitionBy(file).orderBy(number)
    blank = strip(F.col(value)) == ""
    rows = lines.withColumns({"g": F.sum(blank.cast("int")).over(order), "n": F.sum((~blank).cast("int")).over(order)}).where(~blank)
    listed = F.sort_array(F.collect_list(F.struct(number, strip(F.col(value)).alias("v"))))
    return rows.groupBy(file, "g").agg(F.max("n").alias("id"), F.array_join(F.transform(listed, lambda x: x["v"]), "\n").alias("text")).drop("g")


def read_json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType | str, unescape: bool = False, mode: str = "FAILFAST") -> DataFrame:
    """JSON lines, plain or compressed (gzip, zst, zstd by suffix); with ``unescape`` literal \\n become line feeds."""
    df = spark.read.schema(schema).option("mode", mode).json(path)
    if unescape:
        df = df.withColumns({f.name: unescape_newlines(F.col(f.name)) for f in df.schema if isinstance(f.dataType, T.StringType)})
    return df


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """json, jsonl, csv, tsv or parquet by suffix."""
    kind = path.rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if kind in ("csv", "tsv"):
        return reader.option("header", True).option("sep", "\t" if kind == "tsv" else ",").option("multiLine", True).csv(path)
    if kind in ("json", "jsonl"):
        return reader.option("multiLine", kind == "json").json(path)
    return reader.parquet(path)


def read_indexed(spark: SparkSession, paths: str | list[str], offset: int, n_files: int, schema: T.StructType | str, unescape: bool = True) -> DataFrame:
    """Files offset .. offset + n_files - 1 of a list, or of a pattern with the place of the number, such as
    ``part-{:05d}.jsonl.zst``. JSON lines with literal \\n turned into line feeds; a missing file raises."""
    named = [paths.format(i) for i in range(offset, offset + n_files)] if isinstance(paths, str) else paths[offset : offset + n_files]
    return read_json_lines(spark, named, schema, unescape) if named else spark.createDataFrame([], schema)


def write_pairs(pairs: DataFrame, folder: str, src: str = "src", dst: str = "dst") -> None:
    """Text lines ``a :: b`` of a list of pairs."""
    pairs.select(F.concat_ws(" :: ", F.col(src).cast("string"), F.col(dst).cast("string")).alias("value")).write.text(folder)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """src, dst (strings) of such lines; lines of another form are left out."""
    cut = F.split("value", " :: ", 2)
    return spark.read.text(path).where(F.col("value").contains(" :: ")).select(cut[0].alias("src"), cut[1].alias("dst"))


def recompressed(spark: SparkSession, source: str, folder: str, level: int = 7) -> DataFrame:
    """Rewrite gzip files as zstandard files (name, bytes): streams in pieces, so memory does not grow with a file. The
    sources stay; whoever wants them gone deletes them when all rows have come."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for b in batches:
            for path in b.column(0).to_pylist():
                (store, at), (target, root) = _store(path), _store(folder)
                target.create_dir(root, recursive=True)
                final = f"{root}/{at.rsplit('/', 1)[-1].removesuffix('.gz')}.zst"
                with store.open_input_stream(at, compression="gzip") as f, target.open_output_stream(temp := f"{root}/_{uuid.uuid4().hex}", compression=None) as out:
                    with zstandard.ZstdCompressor(level=level).stream_writer(out, closefd=False) as z:
                        size = 0
                        while piece := f.read(1 << 20):
                            z.write(piece)
                            size += len(piece)
                _into_place(target, temp, final)
                yield pa.RecordBatch.from_arrays([pa.array([final]), pa.array([size])], names=["path", "bytes"])

    return Stash(files.repartition(max(1, files.count()), "path").mapInArrow(run, "path string, bytes long"), "recompressed").df


def verified_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """name, sha256, ok for the files of a folder against a manifest (name, sha256). A file is one row while it is hashed,
    so it may have 2 GB at most; missing files are not ok."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    return manifest.join(files, "name", "left").select("name", "sha256", F.coalesce(F.col("found") == F.lower("sha256"), F.lit(False)).alias("ok"))


def write_json_lines(df: DataFrame, folder: str, compression: str = "gzip", per_file: int = DOCS_PER_FILE) -> None:
    """JSON lines by Spark's writer (nulls left out), a bounded number of records per file."""
    df.write.option("compression", compression).option("maxRecordsPerFile", per_file).json(folder)


def _store(uri: str):
    """The file system of a URI or local path, and the path in it."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")) if uri.startswith(("/", "file:")) else fs.FileSystem.from_uri(uri)


def _into_place(store, temp: str, final: str) -> None:
    """Give a whole file its name. Where a first attempt of the task has done so already, its file goes first: not every
    store replaces a file when another one is moved there."""
    from pyarrow import fs

    if store.get_file_info(final).type != fs.FileType.NotFound:
        store.delete_file(final)
    store.move(temp, final)


def write_zstd_json_lines(df: DataFrame, folder: str, level: int = 7, per_file: int = DOCS_PER_FILE) -> list[str]:
    """JSON lines in zstandard files, which Spark's text writers lack; returns the files' paths.

    Each task streams its partition into files of its own in ``folder`` (a store that executors share) and renames them
    when they are whole.
    """
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        part, done, out, n = TaskContext.get().partitionId(), [], None, 0

        def close() -> None:
            out[0].close()
            out[1].close()
            _into_place(store, out[2], out[3])
            done.append(out[3])

        for b in batches:
            for line in b.column(0).to_pylist():
                if out is None:
                    final = f"{root}/part-{part:06d}-{len(done):04d}.jsonl.zst"
                    raw = store.open_output_stream(temp := f"{root}/_{uuid.uuid4().hex}", compression=None)
                    out, n = (zstandard.ZstdCompressor(level=level).stream_writer(raw, closefd=False), raw, temp, final), 0
                out[0].write(line.encode("utf-8") + b"\n")
                n += 1
                if n >= per_file:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["path"])

    lines = df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "true"}).alias("value"))
    return [r.path for r in lines.mapInArrow(run, "path string").collect()]


def write_bins(df: DataFrame, folder: str, bin_col: str = "chunk", order: str | None = None, per_file: int = CHUNK_DOCS) -> None:
    """One folder per bin, files of at most ``per_file`` documents, sorted within a file."""
    rows = df.repartition(F.col(bin_col), F.pmod(F.xxhash64(*df.columns), F.lit(64)))  # a bin is shared by up to 64 tasks
    rows = rows.sortWithinPartitions(bin_col, *([order] if order else []))
    rows.write.partitionBy(bin_col).option("maxRecordsPerFile", per_file).parquet(folder)


def read_wikipedia_categories(spark: SparkSession, path: str, prefix: str = "[[Category:") -> DataFrame:
    """title, id, category (its category lines, joined without a separator) of the pages that have one."""
    schema = "title string, id long, revision struct<text: string>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    return categories(pages.select("title", "id", F.col("revision.text").alias("text")), prefix)


def categories(pages: DataFrame, prefix: str = "[[Category:") -> DataFrame:
    found = F.filter(F.split("text", "\n"), lambda x: x.startswith(prefix))
    return pages.select("title", "id", found.alias("c")).where(F.size("c") > 0).select("title", "id", F.array_join("c", "").alias("category"))


def pack_tokens(blocks: list[np.ndarray], dtype: str = "u2", size: int = 1024) -> bytes:
    """A packed file: a header of 24 bytes (magic, version, type code, chunk size), then the elements."""
    code = next(k for k, v in PACKED_TYPES.items() if v == dtype)
    out = io.BytesIO()
    out.write(PACKED_MAGIC + struct.pack("<Q", PACKED_VERSION) + struct.pack("<B", code) + struct.pack("<Q", size))
    for b in blocks:
        out.write(np.asarray(b).astype("<" + dtype).tobytes())
    return out.getvalue()


def write_packed_tokens(blocks: DataFrame, folder: str, block: int, dtype: str = "u2", col: str = "ids", blocks_per_file: int = 4096) -> list[str]:
    """Write token blocks (arrays of ``block`` numbers in column ``col``) to packed files; returns their paths.

    A task streams its blocks into files of at most ``blocks_per_file``, each of which gets its name when it is whole.
    """
    code = next(k for k, v in PACKED_TYPES.items() if v == dtype)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        part, done, out, n, temp = TaskContext.get().partitionId(), [], None, 0, ""

        def close() -> None:
            out.close()
            done.append(f"{root}/part-{part:06d}-{len(done):04d}.bin")
            _into_place(store, temp, done[-1])

        for b in batches:
            for ids in b.column(0):
                if out is None:
                    out, n = store.open_output_stream(temp := f"{root}/_{uuid.uuid4().hex}", compression=None), 0
                    out.write(PACKED_MAGIC + struct.pack("<QBQ", PACKED_VERSION, code, block))
                out.write(ids.values.to_numpy(zero_copy_only=False).astype("<" + dtype).tobytes())
                n += 1
                if n >= blocks_per_file:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["path"])

    return [r.path for r in blocks.where(F.size(col) == block).select(col).mapInArrow(run, "path string").collect()]


def unpack_tokens(data: bytes) -> tuple[np.ndarray, int]:
    """Elements and chunk size."""
    if data[:7] != PACKED_MAGIC:
        raise ValueError("not a packed token file")
    (code,), (size,) = struct.unpack("<B", data[15:16]), struct.unpack("<Q", data[16:24])
    return np.frombuffer(data, "<" + PACKED_TYPES[code], offset=24), size


def read_packed_tokens(spark: SparkSession, path: str | list[str], block: int) -> DataFrame:
    """path, block_no, ids of packed files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids, _ = unpack_tokens(data)
                n = len(ids) // block
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(n), pa.int64()), pa.array(list(ids[: n * block].reshape(n, block).astype("i8")), pa.list_(pa.int64()))], names=["path", "block_no", "ids"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, block_no long, ids array<long>")


def to_json_record(*columns: str):
    return F.to_json(F.struct(*columns))


def parse_json_lines(rows: list[str]) -> list[dict]:
    return [json.loads(x) for x in rows if x.strip()]
