"""WARC archives with a two-level capture index.

Archives hold one gzip member per record, so any record can be read by its byte range. The index is sorted by
reversed-host URL keys ("com,example,www)/path"): its lines lie in compressed blocks of fixed line count, each
part of the index has a sparse directory of its blocks' first keys, and the parts' first keys are the level
above; a key is followed by the page id at each level. A look-up is a binary search of parts, of a directory and of
one block, then one range read.

Files go to the shared folder through ``pyarrow.fs`` (local and remote stores alike), under a name of their own
for each task attempt; only files that a finished task has reported are ever read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_tables, fresh_path, materialise, slices, small_batches

DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
LINES = 2000
ROLL = 1 << 30
LOOKUPS = 5000  # in a task
PIECE = 200  # index lines that one task reads the records of
OPEN_FILES = 64
DIRECTORIES = 8  # that a reader keeps
BROADCAST_ROWS = 100_000  # revisits, of some 60 bytes each
SALTS = 64  # tasks over which the copies of one payload are dealt
NO_ID = -(1 << 63) - 1  # before all page ids


def surt(url: str | None) -> str:
    """The key of a URL: host labels reversed, then path and query; no scheme, port or fragment. Null: empty."""
    text = (url or "").strip()
    try:
        parts = urlsplit(text if "//" in text else "//" + text)
        host = (parts.hostname or "").lower()
    except ValueError:
        return text.lower()
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + ("?" + parts.query if parts.query else "")


def clean(value: str) -> str:
    """A header value without line breaks."""
    return "".join(c if c >= " " else f"%{ord(c):02X}" for c in value)


def record(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record as a gzip member: a response with the payload, or a revisit of another record without."""
    block = HTTP if refers_to else HTTP + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {clean(url)}")
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of an uncompressed record."""
    head, rest = raw.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.split(b"\r\n\r\n", 1)[1]


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, uncompressed, one at a time."""
    z, out, data = zlib.decompressobj(31), [], b""
    while data or (data := stream.read(size)):
        out.append(z.decompress(data))
        data = z.unused_data if z.eof else b""
        if z.eof:
            yield b"".join(out)
            z, out = zlib.decompressobj(31), []


def _open(uri: str):
    store, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))
    return store, path


def _write(folder: str):
    """Writes a partition's records; returns an index line for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                for piece in slices(batch, "html"):
                    rows = []
                    for page, url, html, refers in zip(*(piece.column(c) for c in ("page_id", "url", "html", "refers_to"))):
                        if out is None or at > ROLL:
                            if out is not None:
                                out.close()
                            name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                            out = store.open_output_stream(f"{base}/{name}", compression=None)
                        payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                        digest = hashlib.sha1(payload).hexdigest()
                        target = f"urn:page:{refers.as_py()}" if refers.is_valid else None
                        z = record(f"urn:page:{page.as_py() if page.is_valid else ''}", url.as_py(), payload, digest, target)
                        out.write(z)
                        rows.append((surt(url.as_py()), page.as_py(), name, at, len(z), target is not None))
                        at += len(z)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()))], ["key", "page_id", "file", "at", "size", "revisit"])
        finally:
            if out is not None:
                out.close()

    return run


def _write_index(folder: str):
    """Writes a sorted partition as one part of the index: blocks, then their directory; returns (first key and page id, name)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        name, directory, at, lines, first = uuid.uuid4().hex, [], 0, [], None

        def flush(out) -> int:
            block = zlib.compress("\n".join(lines).encode(), 6)
            directory.append(f"{lines[0].rsplit(' ', 3)[0]} {at} {len(block)}")
            out.write(block)
            lines.clear()
            return at + len(block)

        with store.open_output_stream(f"{base}/{name}.blocks", compression=None) as out:
            for batch in batches:
                for key, page, file, a, n in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "file", "at", "size"))):
                    key = clean(key).replace(" ", "%20")
                    lines.append(f"{key} {'' if page is None else page} {file} {a} {n}")
                    first = first or lines[0].rsplit(" ", 3)[0]
                    if len(lines) == LINES:
                        at = flush(out)
            if lines:
                at = flush(out)
        with store.open_output_stream(f"{base}/{name}.directory", compression=None) as out:
            out.write("\n".join(directory).encode())
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([name])], ["first", "name"])

    return run


def place(text: str) -> tuple[str, int]:
    """(key, page id) of "key id"."""
    key, page = text.rsplit(" ", 1)
    return key, int(page) if page else NO_ID


class CaptureIndex:
    """Look-ups in an index written by ``write_archives``: (key, page id) to record, by binary searches and range reads."""

    def __init__(self, folder: str, parts: list[tuple[str, str]], archives: str):
        self.folder, self.archives = folder, archives
        parts = sorted((place(first), name) for first, name in parts)
        self.firsts, self.names = [p[0] for p in parts], [p[1] for p in parts]
        self.directories: dict[str, tuple[list[tuple[str, int]], list[tuple[int, int]]]] = {}
        self.block: tuple[tuple, list[tuple]] = ((), [])

    @staticmethod
    def _read(uri: str, at: int = 0, size: int | None = None) -> bytes:
        store, path = _open(uri)
        with store.open_input_file(path) as f:
            f.seek(at)
            return f.read() if size is None else f.read(size)

    def directory(self, name: str) -> tuple[list[tuple[str, int]], list[tuple[int, int]]]:
        """The blocks of a part: their first places, and where they lie."""
        if name not in self.directories:
            while len(self.directories) >= DIRECTORIES:
                self.directories.pop(next(iter(self.directories)))
            lines = [x.rsplit(" ", 2) for x in self._read(f"{self.folder}/{name}.directory").decode().split("\n")]
            self.directories[name] = [place(x[0]) for x in lines], [(int(a), int(n)) for _, a, n in lines]
        return self.directories[name]

    def entries(self, name: str, at: int, size: int) -> list[tuple[str, int, str, int, int]]:
        """(key, page id, file, offset, size) of a block's captures."""
        if self.block[0] != (name, at):
            lines = (x.split(" ") for x in zlib.decompress(self._read(f"{self.folder}/{name}.blocks", at, size)).decode().split("\n"))
            self.block = ((name, at), [(k, int(p) if p else NO_ID, f, int(a), int(n)) for k, p, f, a, n in lines])
        return self.block[1]

    def since(self, wanted: tuple[str, int]) -> Iterator[tuple[str, int, str, int, int]]:
        """All captures from a place on, in index order."""
        i = max(0, bisect_left(self.firsts, wanted) - 1)
        for name in self.names[i:]:
            firsts, blocks = self.directory(name)
            for at, size in blocks[max(0, bisect_left(firsts, wanted) - 1) :]:
                found = self.entries(name, at, size)
                yield from found[bisect_left(found, wanted) :]

    def captures(self, key: str, page_id: int | None = None) -> Iterator[tuple[str, int, str, int, int]]:
        """The captures of a key, or of one page under it."""
        key = clean(key).replace(" ", "%20")
        for x in self.since((key, NO_ID if page_id is None else page_id)):
            if x[0] != key or page_id is not None and x[1] != page_id:
                return
            yield x

    def read(self, key: str, page_id: int) -> tuple[dict[str, str], bytes] | None:
        """Headers and payload of one capture; None if there is none."""
        for _, _, file, at, size in self.captures(key, page_id):
            return parse(zlib.decompress(self._read(f"{self.archives}/{file}", at, size), 31))
        return None

    def responses(self, key: str, page_id: int) -> Iterator[tuple[str, int]]:
        """(digest, payload size) of each response of a page under a key."""
        for _, _, file, at, size in self.captures(key, page_id):
            head, payload = parse(zlib.decompress(self._read(f"{self.archives}/{file}", at, size), 31))
            if head["warc-type"] == "response":
                yield base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex(), len(payload)


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000) -> dict:
    """Writes a record for each row, and the index. Returns folders, the table of index lines and the index parts.

    Of rows with equal payloads of at least ``least`` bytes, the one with the largest id is a response and the
    others revisit it; all others are responses. Null html is an empty payload, null urls have no target
    header and the empty key, rows with a null id get an id-less response. Each row goes by its own payload, also
    where rows of different payloads repeat an id; those that repeat the response's id are responses too. A page of any
    length is one record, held in memory as a whole. Other columns are ignored, whatever their names.
    An empty table gives no files.
    """
    spark = pages.sparkSession
    small_batches(spark)
    pages = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    body = F.coalesce("html", F.lit(""))
    light = pages.select("page_id", F.sha1(body.cast("binary")).alias("sha"), F.octet_length(body).alias("n")).where(F.col("n") >= least)
    light = materialise(light.withColumn("s", F.pmod(F.xxhash64("page_id"), F.lit(SALTS))), "digests")
    # the copies of one payload are counted, and told their response, in parts
    whole = Window.partitionBy("sha", "n")
    chosen = light.groupBy("sha", "n", "s").agg(F.max("page_id").alias("m"), F.count("*").alias("c")).select("sha", "n", "s", F.max("m").over(whole).alias("refers_to"), F.sum("c").over(whole).alias("c")).where("c > 1")
    revisits = light.join(chosen.drop("c"), ["sha", "n", "s"]).where(F.col("page_id") != F.col("refers_to")).select("page_id", "sha", "n", "refers_to").distinct()
    revisits = materialise(revisits, "revisits")
    drop_tables(light)
    folder, index = fresh_path(spark, "warc"), fresh_path(spark, "cdx")
    own = pages.where("page_id is not null").withColumns({"sha": F.sha1(body.cast("binary")), "n": F.octet_length(body)})
    # up to a proven size the list of revisits spares the pages a shuffle; beyond it the join is by sorting, with the same rows
    known = F.broadcast(revisits) if revisits.count() <= BROADCAST_ROWS else revisits
    rows = own.join(known, ["page_id", "sha", "n"], "left").select("page_id", "url", "html", "refers_to").unionByName(pages.where("page_id is null").withColumn("refers_to", F.lit(None).cast("bigint")))
    lines = materialise(rows.select("page_id", "url", "html", "refers_to").mapInArrow(_write(folder), "key string, page_id bigint, file string, at bigint, size bigint, revisit boolean"), "captures")
    ordered = lines.select("key", "page_id", "file", "at", "size").repartitionByRange("key", "page_id", "file", "at").sortWithinPartitions("key", "page_id", "file", "at")
    parts = materialise(ordered.mapInArrow(_write_index(index), "first string, name string"), "parts")
    return {"archives": folder, "index": index, "lines": lines, "parts": parts, "revisits": revisits}


def _pieces(index: str):
    """The lines of the index as (part, block offset and size, from line, to line), a few hundred lines each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows = []
                for x in CaptureIndex._read(f"{index}/{name}.directory").decode().split("\n"):
                    _, at, size = x.rsplit(" ", 2)
                    n = zlib.decompress(CaptureIndex._read(f"{index}/{name}.blocks", int(at), int(size))).count(b"\n") + 1
                    rows += [(name, int(at), int(size), i, min(i + PIECE, n)) for i in range(0, n, PIECE)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), *[pa.int64()] * 4))], ["part", "at", "size", "lo", "hi"])

    return run


def _read_back(index: str, folder: str):
    """Reads the record of each index line by its byte range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        opened: dict[str, pa.NativeFile] = {}
        try:
            for batch in batches:
                for part, at, size, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("part", "at", "size", "lo", "hi"))):
                    rows = []
                    lines = zlib.decompress(CaptureIndex._read(f"{index}/{part}.blocks", at, size)).decode().split("\n")[lo:hi]
                    for page, name, start, n in sorted((x.split(" ")[1:] for x in lines), key=lambda x: (x[1], int(x[2]))):
                        if name not in opened:
                            if len(opened) == OPEN_FILES:
                                opened.pop(next(iter(opened))).close()
                            opened[name] = store.open_input_file(f"{base}/{name}")
                        opened[name].seek(int(start))
                        head, payload = parse(zlib.decompress(opened[name].read(int(n)), 31))
                        if head["warc-record-id"] != f"<urn:page:{page}>":
                            raise ValueError(f"{head['warc-record-id']} at {start} in {name}, where the index has {page or 'no id'}")
                        revisit = head["warc-type"] == "revisit"
                        digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                        if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"digest of {head['warc-record-id']} in {name}")
                        number = lambda h: int(x) if (x := head[h].removeprefix("<urn:page:").removesuffix(">")) else None  # noqa: B023,E731
                        rows.append((number("warc-record-id"), None if revisit else len(payload), digest, head["warc-type"], number("warc-refers-to") if revisit else None))
                    yield _page_rows(rows)
        finally:
            for f in opened.values():
                f.close()

    return run


def _page_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_archives(written: dict) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of each record, read through the index.

    An index with fewer or more lines than records were written, or whose line leads to another record, is an error.
    A revisit's payload size comes from the record it refers to, found through the capture index.
    """
    lines: DataFrame = written["lines"]
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    pieces = materialise(written["parts"].select("name").mapInArrow(_pieces(written["index"]), "part string, at bigint, size bigint, lo bigint, hi bigint"), "pieces")
    listed, records = pieces.agg(F.sum(F.col("hi") - F.col("lo"))).first()[0] or 0, lines.count()
    if listed != records:
        raise ValueError(f"the index lists {listed} of {records} records")
    # as many tasks as archives: pieces are too few bytes for the planner to spread by itself
    tasks = max(1, lines.select("file").distinct().count())
    back = pieces.repartition(tasks).mapInArrow(_read_back(written["index"], written["archives"]), schema)
    targets = written["revisits"].select("refers_to").distinct()
    keys = lines.where("not revisit").join(targets, lines["page_id"] == targets["refers_to"]).select("key", "page_id").distinct()
    spark = lines.sparkSession
    parts = spark.sparkContext.broadcast([tuple(r) for r in written["parts"].collect()])  # one row per index part
    folder, archives = written["index"], written["archives"]

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CaptureIndex(folder, parts.value, archives)
        for batch in batches:
            found = [(p, *x) for k, p in zip(batch.column("key").to_pylist(), batch.column("page_id").to_pylist()) for x in index.responses(k, p)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.string(), pa.int64()))], ["target", "digest", "bytes"])

    ordered = keys.repartitionByRange(max(1, -(-targets.count() // LOOKUPS)), "key", "page_id").sortWithinPartitions("key", "page_id")
    known = ordered.mapInArrow(sizes, "target bigint, digest string, bytes bigint").groupBy("target", "digest").agg(F.max("bytes").alias("bytes"))
    # a response with very many revisits is told to them in parts
    part = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).alias("s")
    asked = written["revisits"].select(F.col("refers_to").alias("target"), F.col("sha").alias("digest"), part).distinct()
    known = asked.join(known, ["target", "digest"])
    back = back.select("*", part)
    out = back.join(known, (back["refers_to"] == known["target"]) & (back["payload_digest"] == known["digest"]) & (back["s"] == known["s"]), "left")
    return out.select("page_id", F.coalesce("payload_bytes", "bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
