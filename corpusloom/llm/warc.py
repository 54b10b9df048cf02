"""WARC archives: a writer, and the normaliser for monolithic gzip files.

Records are first written by Spark's text writer as whole-file gzip streams, as many tools do; such a file can only be
read from its start. The normaliser inflates the stream once, in pieces, finds the records by their Content-Length,
writes each as a gzip member of its own and notes offset, length, type, id and digest in a sidecar index, a JSON line
per record. A reader then seeks to any record. Memory is bounded by one record, not by a file.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.stores import AtomicFile, open_input
from corpusloom.plans.storage import Stash, delete, scratch_path

LEAST_REVISIT, PIECE = 1000, 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "<urn:page:"


def with_decisions(pages: DataFrame, least: int = LEAST_REVISIT, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, record_type, refers_to: of equal payloads of at least ``least`` bytes, the one with the
    largest id is the response and the others revisit it. Rows that repeat that id are responses too; a null id is
    less than any other."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    keyed = rows.withColumn("payload", F.unhex(F.sha2("html", 256)))
    repeated = keyed.where(F.octet_length("html") >= least).groupBy("payload").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = Stash(repeated.select("payload", "first"), "payloads").df
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return keyed.join(groups, "payload", "left").select("page_id", "url", "html", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def record_text(date: str = "1970-01-01T00:00:00Z"):
    """A WARC record as text, without the line end that the text writer adds."""
    size = F.octet_length("html")
    name = lambda c: F.concat(F.lit(_ID), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    revisit = F.col("record_type") == "revisit"
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    maybe = lambda cond, value: F.when(cond, value).otherwise("")
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", name("page_id")), line("WARC-Date", F.lit(date)),
        maybe(F.col("url").isNotNull(), line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1("html"))),
        maybe(revisit, F.concat(line("WARC-Refers-To", name("refers_to")), line("WARC-Profile", F.lit(PROFILE)))),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"), block, F.lit("\r\n"),
    )


def write_monoliths(pages: DataFrame, folder: str, least: int = LEAST_REVISIT, records_per_file: int = 200_000) -> None:
    """Write whole-file gzip archives."""
    rows = with_decisions(pages, least).select(record_text().alias("value"))
    rows.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(folder)


def inflate(read, piece: int = PIECE) -> Iterator[bytes]:
    """The content of a gzip file, one or more members, in bounded pieces."""
    stream, fed = zlib.decompressobj(31), False
    while data := read(piece):
        while data:
            out = stream.decompress(data, piece)
            fed = True
            if out:
                yield out
            data = stream.unconsumed_tail
            if stream.eof:
                data, stream, fed = stream.unused_data, zlib.decompressobj(31), False
    if fed and (not stream.eof):
        raise ValueError("the gzip stream ends early")


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, whole record) of each record of an uncompressed archive."""
    held = bytearray()

    def need(n: int) -> bool:
        while len(held) < n:
            more = next(pieces, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while need(1):
        end, searched = -1, 0
        while (end := held.find(b"\r\n\r\n", max(0, searched - 3))) < 0:
            searched = len(held)
            if not need(len(held) + 1):
                raise ValueError("a record's headers end early")
        first, *lines = bytes(held[:end]).decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = end + 4 + int(headers["content-length"]) + 4
        if not need(size) or held[size - 4 : size] != b"\r\n\r\n":
            raise ValueError("a record is not as long as it says")
        yield headers, bytes(held[:size])
        del held[:size]


def normalise(source: str, target: str, level: int = 6) -> tuple[int, int]:
    """Rewrite the archive ``source`` to ``target`` (and ``target``.idx); returns the numbers of records and bytes."""
    archive, lines = AtomicFile(target), []
    index = AtomicFile(f"{target}.idx")
    n = 0
    with open_input(source) as f:
        for headers, record in records(inflate(f.read)):
            z = zlib.compressobj(level, zlib.DEFLATED, 31)
            member = z.compress(record) + z.flush()
            lines.append(json.dumps({"offset": archive.size, "length": len(member), "type": headers.get("warc-type"), "id": headers.get("warc-record-id"), "uri": headers.get("warc-target-uri"), "digest": headers.get("warc-payload-digest")}))
            archive.write(member)
            n += 1
            if len(lines) >= 1000:
                index.write(("\n".join(lines) + "\n").encode())
                lines = []
    if lines:
        index.write(("\n".join(lines) + "\n").encode())
    archive.commit()
    index.commit()
    return n, archive.size


def read_record(f, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry: headers and block."""
    f.seek(offset)
    headers, record = next(records(iter([zlib.decompress(f.read(length), 31)])))
    return headers, record[record.index(b"\r\n\r\n") + 4 : -4]


def normalise_folder(pages: DataFrame, monoliths: str, folder: str) -> DataFrame:
    """Normalise every archive of a folder; a row per archive: path, n_records, n_bytes."""
    spark = pages.sparkSession
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(monoliths).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                target = f"{folder}/{re.sub(r'[^A-Za-z0-9-]', '_', path.rsplit('/', 1)[-1].split('.')[0])}.warc.gz"
                n, size = normalise(path, target)
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([n]), pa.array([size])], names=["path", "n_records", "n_bytes"])

    done = files.repartition(max(1, files.count()), "path").mapInArrow(run, "path string, n_records long, n_bytes long")
    return Stash(done, "archives", short=True).df


def read_archives(archives: DataFrame) -> DataFrame:
    """By the indexes: page_id, payload_bytes, payload_digest, record_type, refers_to. A response's figures come from
    its payload, those of a revisit (which has none) from its headers."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def number(name: str | None) -> int | None:
        digits = (name or "").removeprefix(_ID).removesuffix(">")
        return int(digits) if digits else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                with open_input(f"{path}.idx") as f:
                    entries = [json.loads(x) for x in f.read().decode().splitlines()]
                with open_input(path) as f:
                    for e in entries:
                        headers, block = read_record(f, e["offset"], e["length"])
                        http, _, payload = block.partition(b"\r\n\r\n")
                        if headers["warc-type"] == "response":
                            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        else:
                            size, digest = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1]), headers["warc-payload-digest"].removeprefix("sha1:")
                        rows.append((number(headers["warc-record-id"]), size, digest, headers["warc-type"], number(headers.get("warc-refers-to"))))
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return archives.select("path").repartition(max(1, archives.count()), "path").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame, folder: str | None = None, least: int = LEAST_REVISIT) -> DataFrame:
    """Write ``pages`` as monolithic archives, normalise them into ``folder`` and read them back by their indexes.

    A null html is an empty payload, a null url leaves its header out, a null id stays null, repeated rows are records
    each. An empty table gives an empty result. Columns other than id, url and html are not looked at.
    """
    spark = pages.sparkSession
    monoliths = scratch_path(spark, "monoliths")
    write_monoliths(pages, monoliths, least)
    archives = normalise_folder(pages, monoliths, folder or scratch_path(spark, "warc"))
    delete(spark, monoliths)
    return read_archives(archives)
