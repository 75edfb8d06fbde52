"""WARC archives in Zstandard: a dictionary in a leading skippable frame, each record a frame of its own.

Every file trains its dictionary from a bounded sample of the records it is about to hold, so a reader needs
nothing beside the file. Equal payloads are written once; the others revisit them.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import give_back, release, shared_dir, small, tables_made, written

#: Payloads of fewer bytes are never revisited.
LEAST_REVISIT = 100
#: Magic number of the skippable frame that holds a dictionary. Fixed value.
DICTIONARY_FRAME = 0x184D2A5D
SAMPLE_BYTES, DICTIONARY_BYTES = 2 << 20, 64 << 10
FILE_BYTES = 256 << 20
#: Tasks that read archives back, at most.
MOST_READERS = 1 << 16
LEVEL = 6
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:textloom:page:"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str, copy: str = "") -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP head only. ``copy`` tells records of one page id apart."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{NAME}{'' if page_id is None else page_id}{copy}>",
        f"WARC-Date: {date}", f"WARC-Target-URI: {quote(url or 'about:blank', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{NAME}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def make_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or what the samples begin with where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def dictionary_of(data: bytes) -> zstandard.ZstdCompressionDict:
    trained = data[:4] == struct.pack("<I", 0xEC30A437)
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


class Writer:
    """Writes records to files under a folder; remembers the files that it has closed."""

    def __init__(self, folder: str):
        self.system, self.root = fs.FileSystem.from_uri(folder)
        self.folder, self.closed = folder, []
        self.waiting: list[bytes] = []
        self.held = 0
        self.file = None

    def add(self, data: bytes) -> None:
        if self.file is None:
            self.waiting.append(data)
            self.held += len(data)
            if self.held >= SAMPLE_BYTES:
                self._open()
        else:
            self._write(data)

    def _open(self) -> None:
        self.name, self.records, self.size = f"{uuid.uuid4().hex}.warc.zst", 0, 0
        self.system.create_dir(self.root, recursive=True)
        self.file = self.system.open_output_stream(f"{self.root}/{self.name}", compression=None)
        dictionary = make_dictionary(self.waiting)
        self.file.write(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)
        self.press = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary_of(dictionary), write_content_size=True)
        waiting, self.waiting, self.held = self.waiting, [], 0
        for data in waiting:
            self._write(data)

    def _write(self, data: bytes) -> None:
        frame = self.press.compress(data)
        self.file.write(frame)
        self.records += 1
        self.size += len(frame)
        if self.size >= FILE_BYTES:
            self._close()

    def _close(self) -> None:
        self.file.close()
        self.closed.append((f"{self.folder}/{self.name}", self.records, self.size))
        self.file = None

    def finish(self) -> list[tuple[str, int, int]]:
        if self.waiting:
            self._open()
        if self.file is not None:
            self._close()
        return self.closed


def read_records(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an archive, one after the other."""
    system, own = fs.FileSystem.from_uri(path)
    with system.open_input_stream(own, compression=None) as file:
        magic, size = struct.unpack("<II", file.read(8))
        if magic != DICTIONARY_FRAME:
            raise ValueError(f"{path} has no dictionary in front")
        data = file.read(size)
        if data[:4] == b"\x28\xb5\x2f\xfd":  # other writers may compress it
            data = zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 30)
        with zstandard.ZstdDecompressor(dict_data=dictionary_of(data)).stream_reader(file, read_across_frames=True) as stream:
            rest = b""
            while True:
                while (end := rest.find(b"\r\n\r\n")) < 0:
                    more = stream.read(1 << 16)
                    if not more:
                        if rest:
                            raise ValueError(f"{path} ends within a record")
                        return
                    rest += more
                headers = dict((k.lower(), v.strip()) for k, _, v in (line.partition(":") for line in rest[:end].decode().split("\r\n")[1:]))
                need = end + 4 + int(headers["content-length"]) + 4
                parts, have = [rest], len(rest)
                while have < need:
                    more = stream.read(max(1 << 16, need - have))
                    if not more:
                        raise ValueError(f"{path} ends within a record")
                    parts.append(more)
                    have += len(more)
                rest = b"".join(parts)
                yield headers, rest[end + 4 : need - 4]
                rest = rest[need:]


def planned(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to, repeated): of equal payloads of LEAST_REVISIT bytes or more, rows of
    the smallest id are responses, the others revisit it; ``repeated`` says that other rows have the same id.

    Only ids and digests are grouped. What they tell is written, so that the planner knows its size: payloads are
    shuffled only if it is too large to be sent to them, and then by digests, where adaptive execution splits hot ones."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    keys = written(rows.select("page_id", "digest", (F.octet_length("payload") >= LEAST_REVISIT).alias("long")), "warc-keys")
    first = written(keys.where("long").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "warc-first")
    again = written(keys.groupBy("page_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("page_id").alias("__again"), F.lit(True).alias("__is_again")), "warc-repeated")
    joined = rows.join(first, "digest", "left").join(again, F.col("page_id").eqNullSafe(F.col("__again")), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"), F.coalesce("__is_again", F.lit(False)).alias("repeated"))


def write_archives(plan: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes the planned records; gives (path, records, bytes) of each archive, as a written table.

    Each task attempt writes files of its own names and only finished tasks report theirs, so a lost executor or a
    repeated task leaves no record missing or doubled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Writer(folder)
        for whole in batches:
            for batch in small(whole):
                for page_id, url, payload, digest, refers_to, repeated in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    out.add(record(page_id, url, payload, digest, refers_to, date, f":{uuid.uuid4().hex}" if repeated else ""))
        done = out.finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "records", "bytes"])
        give_back()

    return written(plan.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record of the archives in ``path``: its type, ids, URL, digests and the size of its payload.

    A response's digest and size are taken of the payload as read; a revisit's from its headers. Each archive is a
    partition of its own (up to MOST_READERS), since a manifest's own bytes say nothing of the work behind them."""

    def page(name: str) -> int | None:
        own = name.removeprefix(f"<{NAME}").rstrip(">").partition(":")[0]
        return int(own) if own else None

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, path string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for headers, block in read_records(path):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    if headers["warc-type"] == "response":
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    else:
                        size, digest = int(head.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0]), headers["warc-payload-digest"].removeprefix("sha256:")
                    rows.append((page(headers["warc-record-id"]), size, digest, headers["warc-type"], page(headers.get("warc-refers-to", "")), headers["warc-target-uri"], path))
                    if len(rows) == 5000:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)

    return manifest.select("path").repartition(max(1, min(manifest.count(), MOST_READERS))).mapInArrow(run, schema)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None) -> DataFrame:
    """Writes a record per row and reads the archives back: one row per row of ``pages``.

    A null html is an empty payload, a null url is about:blank; a long html is one record. Rows that repeat the id and
    payload of a response are responses too. A null id stays null. Record ids are unique: rows whose page id repeats
    (or is null) add a random part to it, and a revisit of such a page names what its records' ids begin with. Other columns are left behind; an empty table gives an empty one."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/textloom/warc-{uuid.uuid4().hex}"
    standing = tables_made()
    manifest = write_archives(planned(pages, id_col, url_col, html_col), folder)
    release(pages.sparkSession, standing, manifest)
    return read_archives(manifest)


#: The same rows from the table itself.
SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), q AS (
  SELECT *, CASE WHEN payload_bytes >= {LEAST_REVISIT} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM q
"""
