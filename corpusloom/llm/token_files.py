"""Token ids in seekable zstandard files.

A file is a sequence of independent zstandard frames followed by a seek table in a skippable frame (the public
seekable format: per frame its compressed and decompressed size and a checksum, the low 32 bits of the XXH64 of the
content, then the number of frames, a descriptor and a magic number). Each frame holds whole documents: their number,
then a directory of (doc_id, null flag, number of ids), then the ids as unsigned 32-bit little-endian integers.

Before the seek table stands one more skippable frame, the document index: for each frame its least and its greatest
doc_id and whether it holds ids and nulls. A reader fetches the two tables from the end of the file, finds the frames
that a document can be in, and fetches and inflates those alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from corpusloom.llm.batches import rows, table
from corpusloom.llm.keys import text_of
from corpusloom.llm.stores import AtomicFile, open_input
from corpusloom.llm.tokens import encoder
from corpusloom.plans.ordering import range_sorted
from corpusloom.plans.storage import Stash, scratch_path

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, CHECKSUM_FLAG = 0x184D2A5E, 0x8F92EAB1, 0x80
#: The magic number of the document index (any of the sixteen skippable ones may be used).
INDEX_MAGIC = 0x184D2A50
FRAME_BYTES, END = 1 << 18, 2
HAS_IDS, HAS_NULLS = 1, 2
_ENTRY, _DOC = struct.Struct("<III"), np.dtype([("doc", "<i8"), ("null", "u1"), ("n", "<u4")])
_RANGE = np.dtype([("least", "<i8"), ("most", "<i8"), ("holds", "u1")])


class TokenFileWriter:
    """Append documents; ``commit`` writes the seek table and gives the file its name."""

    def __init__(self, uri: str, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.file, self.frame_bytes, self.table, self.ranges = AtomicFile(uri), frame_bytes, [], []
        self.compress = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        self.docs: list[tuple[int, int, int]] = []
        self.ids: list[bytes] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids) // 4))
        self.ids.append(ids)
        self.held += len(ids)
        if self.held >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if not self.docs:
            return
        content = struct.pack("<I", len(self.docs)) + np.array(self.docs, _DOC).tobytes() + b"".join(self.ids)
        frame = self.compress(content)
        self.table.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.file.write(frame)
        known = [d for d, null, _ in self.docs if not null]
        self.ranges.append((min(known, default=0), max(known, default=0), HAS_IDS * bool(known) | HAS_NULLS * (len(known) < len(self.docs))))
        self.docs, self.ids, self.held = [], [], 0

    def commit(self) -> None:
        self.flush()
        index = np.array(self.ranges, _RANGE).tobytes()
        self.file.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        body = b"".join(_ENTRY.pack(*e) for e in self.table) + struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.file.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        self.file.commit()


class TokenFileReader:
    """Reads the tables at once and frames on demand; a damaged table or frame raises ValueError."""

    def __init__(self, uri: str):
        self.file = open_input(uri)
        size, self.frames_read = self.file.size(), 0
        if size < 25:
            raise ValueError("not a seekable file: too short")
        self.file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", self.file.read(9))
        index_at = size - 17 - 12 * n - 8 - n * _RANGE.itemsize
        if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG or index_at < 0:
            raise ValueError("not a seekable file with checksums")
        self.file.seek(index_at)
        tables = self.file.read(size - index_at - 9)
        at = 8 + n * _RANGE.itemsize
        if struct.unpack("<II", tables[:8]) != (INDEX_MAGIC, at - 8) or struct.unpack("<II", tables[at : at + 8]) != (SKIPPABLE_MAGIC, 12 * n + 9):
            raise ValueError("the seek table is damaged")
        self.ranges = np.frombuffer(tables, _RANGE, n, 8)
        self.table = [_ENTRY.unpack_from(tables, at + 8 + 12 * i) for i in range(n)]
        self.starts = np.cumsum([0, *(e[0] for e in self.table)])

    def frames_of(self, doc_id: int | None) -> list[int]:
        """The frames that can hold a document of this id."""
        r = self.ranges
        if doc_id is None:
            return np.flatnonzero(r["holds"] & HAS_NULLS).tolist()
        return np.flatnonzero((r["holds"] & HAS_IDS != 0) & (r["least"] <= doc_id) & (r["most"] >= doc_id)).tolist()

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The token ids of each document of this id (none, one, or more where rows repeat an id), in file order."""
        return [ids for k in self.frames_of(doc_id) for doc, ids in self.frame(k) if doc == doc_id]

    def frame(self, k: int) -> Iterator[tuple[int | None, np.ndarray]]:
        """The documents of frame k: id and token ids."""
        packed, plain, checksum = self.table[k]
        self.frames_read += 1
        self.file.seek(int(self.starts[k]))
        try:
            content = zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=plain)
        except zstandard.ZstdError as e:
            raise ValueError(f"frame {k} is damaged") from e
        if len(content) != plain or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} has another checksum")
        (n,) = struct.unpack_from("<I", content)
        docs = np.frombuffer(content, _DOC, n, 4)
        at = 4 + n * _DOC.itemsize
        for doc, null, size in docs.tolist():
            yield (None if null else doc), np.frombuffer(content, "<u4", size, at)
            at += 4 * size

    def documents(self, frames: Iterable[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.table)) if frames is None else frames:
            yield from self.frame(k)

    def close(self) -> None:
        self.file.close()


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, byte_level: bool = False, id_col: str = "doc_id", text_col: str = "text", end_id: int = END, control_text: bool = False) -> DataFrame:
    """Write one file per partition of the id order; a row per file: part, path, documents, tokens, least, most, nulls.

    Ids ascend within a file and from file to file (nulls first); rows that share an id are in the order of a hash of
    their texts, so a task that runs again writes the same file. A null text is the end id alone; repeated rows are
    written each. The list is written as a table when all files are, so a lost executor costs its own files only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer, documents, tokens = TaskContext.get().partitionId(), None, 0, 0
        least = most = None
        nulls = False
        encode, end = encoder(tokenizer, byte_level, control_text).encode, int(end_id).to_bytes(4, "little")
        path = f"{folder}/part-{part:06d}.tokens.zst"
        for b in batches:
            for doc, text in rows(b, 0, 1):
                writer = writer or TokenFileWriter(path)
                ids = encode(text) + end
                writer.add(doc, ids)
                documents, tokens = documents + 1, tokens + len(ids) // 4
                if doc is None:
                    nulls = True
                else:
                    least, most = doc if least is None else least, doc
        if writer:
            writer.commit()
            yield table([(part, path, documents, tokens, least, most, nulls)], ["part", "path", "documents", "tokens", "least", "most", "nulls"], (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    # The row's own number is the last key, so that many rows of one id and text are shared by tasks; such rows are alike.
    keyed = texts.withColumns({"h": F.xxhash64("text"), "own": F.monotonically_increasing_id()})
    done = range_sorted(keyed, ["doc_id", "h", "own"]).select("doc_id", "text").mapInArrow(run, "part int, path string, documents long, tokens long, least long, most long, nulls boolean")
    return Stash(done, "token_files", short=True).df


def read_token_files(files: DataFrame) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    # A row per file, so the only window over all rows is as long as the list of files.
    starts = files.select("path", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    spread = starts.repartition(max(1, files.count()), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in rows(b, 0, 1):
                reader = TokenFileReader(path)
                for k in range(len(reader.table)):
                    docs, sizes, sums = [], [], []
                    for doc, ids in reader.frame(k):
                        docs.append(doc)
                        sizes.append(len(ids))
                        sums.append(zlib.crc32(ids))
                    ends = start + np.cumsum(sizes)
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ends - sizes), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    start = int(ends[-1])
                reader.close()

    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def requested_documents(files: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, ids of the documents whose ids ``wanted`` lists (nulls too); only frames that can hold them are inflated.

    The list of files is broadcast (a row per file). Ids that no file holds give no row; a repeated wish counts once.
    """
    ask = wanted.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    hit = (ask["doc_id"].between(files["least"], files["most"])) | (ask["doc_id"].isNull() & files["nulls"])
    # By path and id, so that a file of which much is wanted is shared by tasks.
    asked = ask.join(F.broadcast(files.select("path", "least", "most", "nulls")), hit).select("path", "doc_id").repartition("path", F.shiftright("doc_id", 12)).sortWithinPartitions("path", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, at, held = None, None, (None, [])
        for b in batches:
            for path, doc in rows(b, 0, 1):
                if path != at:
                    if reader:
                        reader.close()
                    reader, at, held = TokenFileReader(path), path, (None, [])
                for k in reader.frames_of(doc):
                    if held[0] != k:
                        held = (k, list(reader.frame(k)))
                    found = [ids.astype("i4") for own, ids in held[1] if own == doc]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array([doc] * len(found), pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "ids"])
        if reader:
            reader.close()

    return asked.mapInArrow(run, "doc_id long, ids array<int>")


def token_file_round_trip(docs: DataFrame, tokenizer: str, byte_level: bool = False, id_col: str = "doc_id", text_col: str = "text", control_text: bool = False) -> DataFrame:
    """Write ``docs`` to files in the shared folder and read them back: doc_id, start, n_tokens, ids_crc32.

    Null texts count as empty, null ids come first, repeated rows are documents each, and an empty table gives an empty
    result. Columns other than id and text are not looked at. A control string in a text is what the library's
    ``encode`` makes of it unless ``control_text`` is set.
    """
    return read_token_files(write_token_files(docs, scratch_path(docs.sparkSession, "tokens"), tokenizer, byte_level, id_col, text_col, control_text=control_text))
