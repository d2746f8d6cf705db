"""Web archives in ZIP packages: a writer of WARC records and a reader that takes only the ranges it needs."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_with, mapped, materialize, scratch_root

#: Bytes of records after which a task goes on with a new package.
PACKAGE_BYTES = 1 << 30
#: Bytes of a package whose records are read by one task, in order.
STRETCH = 16 << 20
#: Neighbouring records are read together up to this many bytes.
READ_BYTES = 4 << 20
#: Bytes in which a member without an index is scanned.
SCAN_BYTES = 1 << 20

# Signatures of the ZIP format and the field of sizes beyond 32 bits.
LOCAL, CENTRAL, END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
END64, LOCATOR64 = b"PK\x06\x06", b"PK\x06\x07"
EXTRA64, FULL16, FULL32 = 1, 0xFFFF, 0xFFFFFFFF
ARCHIVES, INDEXES = r"archive/.+\.warc(\.gz)?", r"indexes/.+\.cdxj?(\.gz)?"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = "package string, filename string, offset long, length long, record_type string, record_id string, target_uri string, headers map<string,string>, payload binary, digest string, problem string"


class Damaged(ValueError):
    """A package or a record is not what its format says."""


def open_filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it; any scheme that pyarrow opens."""
    if re.match(r"file:/(?!/)", uri):
        uri = "file://" + uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


# The ZIP directory.


class Member(NamedTuple):
    name: str
    method: int  # 0: stored, 8: deflated
    packed: int
    size: int
    header: int  # where its local header starts


def _at(f, start: int, length: int) -> bytes:
    f.seek(start)
    got = f.read(length)
    if len(got) < length:
        raise Damaged(f"{length} bytes at {start} reach past the end")
    return got


def members(f, size: int) -> list[Member]:
    """The central directory, ZIP64 or not, of a package of ``size`` bytes; what stands before the archive is passed over."""
    start = max(0, size - 22 - FULL16)
    tail = _at(f, start, size - start)
    end = tail.rfind(END)
    while end >= 0 and (len(tail) - end < 22 or struct.unpack_from("<H", tail, end + 20)[0] != len(tail) - end - 22):
        end = tail.rfind(END, 0, end)  # the signature may stand in the comment
    if end < 0:
        raise Damaged("no end of a central directory")
    count, length, offset = struct.unpack_from("<HII", tail, end + 10)
    stop = start + end
    if end >= 20 and tail[end - 20 : end - 16] == LOCATOR64:
        where = struct.unpack_from("<Q", tail, end - 12)[0]
        # Where something stands before the archive the locator's offset is too small; the record ends at the locator.
        for place in (where, start + end - 20 - 56):
            record = _at(f, place, 56) if 0 <= place <= size - 56 else b""
            if record[:4] == END64:
                count, length, offset = struct.unpack_from("<QQQ", record, 32)
                stop = place
                break
        else:
            raise Damaged("no ZIP64 end of the central directory")
    first = stop - length
    before = first - offset
    if first < 0 or before < 0:
        raise Damaged("the central directory doesn't fit")
    directory, out, at = _at(f, first, length), [], 0
    while at < length:
        if directory[at : at + 4] != CENTRAL or length - at < 46:
            raise Damaged(f"entry {len(out)} of the central directory is damaged")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
        header = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        full, packed, header = _wide(extra, full, packed, header)
        out.append(Member(name, method, packed, full, header + before))
        at += 46 + n_name + n_extra + n_comment
    if len(out) != count:
        raise Damaged(f"{len(out)} entries of {count}")
    return out


def _wide(extra: bytes, *numbers: int) -> list[int]:
    """The numbers, those that are full in 32 bits replaced in order by what the ZIP64 field holds."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == EXTRA64:
            held = iter(struct.unpack_from(f"<{length // 8}Q", extra, at + 4))
            try:
                return [next(held) if n == FULL32 else n for n in numbers]
            except StopIteration:
                raise Damaged("a ZIP64 field is too short") from None
        at += 4 + length
    return list(numbers)


def content_start(f, m: Member) -> int:
    """Where a member's bytes start: its local header has lengths of its own."""
    head = _at(f, m.header, 30)
    if head[:4] != LOCAL:
        raise Damaged(f"{m.name} has no local header")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return m.header + 30 + n_name + n_extra


def _index_lines(f, m: Member) -> Iterator[str]:
    """Lines of an index, stored or deflated, with or without gzip; it is taken in pieces."""
    stages = [zlib.decompressobj(-15)] if m.method == 8 else []
    if m.name.endswith(".gz"):
        stages.append(zlib.decompressobj(31))
    start, done, rest = content_start(f, m), 0, b""
    while done < m.packed:
        piece = _at(f, start + done, min(SCAN_BYTES, m.packed - done))
        done += len(piece)
        for i, s in enumerate(stages):
            out = s.decompress(piece)
            while s.eof and s.unused_data:  # a gzip file may have several members
                left = s.unused_data
                s = stages[i] = zlib.decompressobj(31)
                out += s.decompress(left)
            piece = out
        *lines, rest = (rest + piece).split(b"\n")
        yield from (x.decode("utf-8", "replace") for x in lines)
    if rest:
        yield rest.decode("utf-8", "replace")


def _boundaries(f, start: int, length: int, packed: bool) -> Iterator[tuple[int, int]]:
    """(offset in the member, length) of each record of a stored member without an index; read in pieces."""
    at = 0
    if packed:  # every record is a gzip member of its own
        inflate, first, held = zlib.decompressobj(31), 0, b""
        while at < length or held:
            piece = held or _at(f, start + at, min(SCAN_BYTES, length - at))
            at += 0 if held else len(piece)
            held = b""
            inflate.decompress(piece)
            if inflate.eof:
                held = inflate.unused_data
                yield first, at - len(held) - first
                first, inflate = at - len(held), zlib.decompressobj(31)
        if first < at:
            yield first, at - first  # cut off; reading it tells so
        return
    while at < length:
        head, size = b"", 4096
        while b"\r\n\r\n" not in head and len(head) < length - at and len(head) < SCAN_BYTES:
            head = _at(f, start + at, min(size, length - at))
            size *= 4
        found = re.search(rb"(?im)^content-length:[ \t]*(\d+)", head.partition(b"\r\n\r\n")[0])
        if not found:
            yield at, length - at  # reading it tells what is wrong
            return
        n = head.index(b"\r\n\r\n") + 4 + int(found[1]) + 4
        yield at, min(n, length - at)
        at += n


def _located(uri: str) -> Iterator[tuple[str, int, int, str | None]]:
    """(archive, offset in the package, length, problem) of each record of a package, from its indexes or by a scan."""
    fs, path = open_filesystem(uri)
    try:
        with fs.open_input_file(path) as f:
            found = members(f, f.size())
            archives = {m.name.rpartition("/")[2]: m for m in found if re.fullmatch(ARCHIVES, m.name)}
            starts, indexed = {}, set()
            for name, m in archives.items():
                if m.method:
                    yield m.name, m.header, 0, "the archive is compressed in the package"
                else:
                    starts[name] = content_start(f, m)
            for m in found:
                if not re.fullmatch(INDEXES, m.name) or m.method not in (0, 8):
                    continue
                for line in _index_lines(f, m):
                    try:
                        entry = json.loads(line.split(" ", 2)[2])
                        name, offset, length = str(entry["filename"]).rpartition("/")[2], int(entry["offset"]), int(entry["length"])
                    except (ValueError, KeyError, IndexError, TypeError):
                        continue  # a header line, or one of another format
                    if name in starts:
                        indexed.add(name)
                        inside = 0 <= offset and 0 < length and offset + length <= archives[name].size
                        yield archives[name].name, starts[name] + offset, length, None if inside else "the index points outside its archive"
            for name, m in archives.items():
                if name in starts and name not in indexed:
                    for offset, length in _boundaries(f, starts[name], m.size, name.endswith(".gz")):
                        yield m.name, starts[name] + offset, length, None
    except (Damaged, zlib.error, struct.error, OSError) as e:
        yield "", -1, 0, f"{type(e).__name__}: {e}"


# Records.


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _field(value: str) -> str:
    """A header's value on one line: control characters and blanks are percent-encoded."""
    return quote(value, safe="".join(map(chr, range(0x21, 0x7F))))


def record(headers: dict[str, str | None], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block)."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise Damaged("no record header")
    headers: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:  # a folded value goes on
            headers[last] += " " + line.strip()
            continue
        name, _, value = line.partition(":")
        last = name.strip().lower()
        headers[last] = value.strip()
    n = headers.get("content-length", "")
    if not n.isdigit() or len(rest) < int(n):
        raise Damaged("the record is cut off")
    return headers, rest[: int(n)]


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """An HTTP message's body; the whole block of other records."""
    if headers.get("content-type", "").lower().startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def _surt(url: str) -> str:
    try:
        parts = urlsplit(url)
        host = ",".join(reversed((parts.hostname or "").split(".")))
    except ValueError:
        return _field(url)
    return _field(f"{host}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower())


# Writing.


class _Package:
    """One ZIP file: a stored archive of gzip records, then its index; nothing is sought back, so any store will do."""

    def __init__(self, folder: str):
        fs, path = open_filesystem(folder)
        fs.create_dir(path, recursive=True)
        self.name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.wacz"
        self.out = fs.open_output_stream(f"{path}/{self.name}")
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.archive = self.zip.open("archive/data.warc.gz", "w", force_zip64=True)
        self.uri, self.at, self.lines = f"{folder}/{self.name}", 0, []
        self.add(record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": "1970-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"), None, None)

    def add(self, raw: bytes, url: str | None, mime: str | None) -> None:
        held = io.BytesIO()
        with gzip.GzipFile(fileobj=held, mode="wb", compresslevel=4, mtime=0) as g:
            g.write(raw)
        packed = held.getvalue()
        self.archive.write(packed)
        if mime is not None:
            entry = {"url": url, "mime": mime, "filename": "data.warc.gz", "offset": str(self.at), "length": str(len(packed))}
            self.lines.append(f"{_surt(url or '')} 19700101000000 {json.dumps(entry)}\n")
        self.at += len(packed)

    def close(self) -> None:
        self.archive.close()
        with self.zip.open("indexes/index.cdxj", "w", force_zip64=True) as f:
            for line in sorted(self.lines):
                f.write(line.encode())
        self.zip.writestr("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1"}))
        self.zip.close()
        self.out.close()


def write_packages(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """(package, records): a WARC record for each row of ``pages``, in ZIP packages under ``folder`` (default: scratch, deleted with the result).

    The payload is the html in UTF-8, null counting as empty. Of rows with equal payloads (by SHA-256) of at least
    ``least`` bytes the one of the smallest id (null last; of equal ids the one of the smallest url, null last) is a
    response and the others revisit it; smaller payloads are all responses. Of rows equal in all three columns one is the
    response. Control characters and blanks in urls are percent-encoded; a null url or id leaves out its field. An empty
    table gives no package. Other columns aren't read. A record is held whole by its task.

    A package's name is new in each attempt of a task, and only those listed in the result count, so lost executors and
    attempts run twice leave nothing that is read. Payloads are shuffled once, to meet what is the response of their
    group; only the join's key is their digest, and adaptive execution splits it where one is very common.
    """
    root = folder or f"{scratch_root(pages.sparkSession)}/packages-{uuid.uuid4().hex}"
    rows = pages.select(F.col(id_col).alias("_n"), F.col(url_col).alias("_url"), F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    rows = rows.withColumns({"_sha": F.sha2("_html", 256), "_sha1": F.sha1("_html"), "_bytes": F.octet_length("_html").cast("long"), "_copy": F.lit(0).cast("long")})
    order = F.struct(F.col("_n").isNull().alias("a"), "_n", F.col("_url").isNull().alias("b"), "_url")
    long_ = F.col("_bytes") >= least
    repeated = materialize(rows.filter(long_).groupBy("_sha", "_n", "_url").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"))
    if repeated.limit(1).count():  # rows equal in all become one row each before, copies of it without the payload after
        r = repeated.select(F.col("_sha").alias("s"), F.col("_n").alias("n"), F.col("_url").alias("u")).hint("merge")
        same = (F.col("_sha") == F.col("s")) & F.col("_n").eqNullSafe(F.col("n")) & F.col("_url").eqNullSafe(F.col("u"))
        once = rows.join(r, same, "left_semi").groupBy("_n", "_url", "_sha", "_sha1", "_bytes").agg(F.first("_html").alias("_html"), F.count(F.lit(1)).alias("m"))
        copies = once.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
        copies = copies.withColumn("_html", F.when(F.col("_copy") == 0, F.col("_html")))
        rows = rows.join(r, same, "left_anti").unionByName(copies.select(*rows.columns))
    groups = rows.filter(long_).groupBy("_sha").agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("_sha", "_first")
    joined = rows.join(groups.hint("merge"), "_sha", "left")
    revisit = F.col("_first").isNotNull() & long_ & ~(F.col("_first").eqNullSafe(order) & (F.col("_copy") == 0))
    ready = joined.select(F.col("_n").cast("string").alias("id"), F.col("_url").alias("url"), F.when(~revisit, F.col("_html")).alias("html"), "_sha1", F.col("_bytes").cast("string").alias("bytes"), revisit.alias("revisit"), F.col("_first._n").cast("string").alias("first_id"), F.col("_first._url").alias("first_url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, records, done = None, 0, []
        for b in batches:
            for row in b.to_pylist():
                if package is None:
                    package, records = _Package(root), 0
                package.add(_page_record(row), row["url"], "warc/revisit" if row["revisit"] else "text/html")
                records += 1
                if package.at >= package_bytes:
                    package.close()
                    done.append((package.uri, records))
                    package = None
        if package is not None:
            package.close()
            done.append((package.uri, records))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["package", "records"])

    out = materialize(mapped(ready, run, "package string, records long"))
    if folder is None:
        keep_with(out, root)
    return out


def _page_record(row: dict) -> bytes:
    """The WARC record of one row; rows' ids are in fields of their own, named Source-Row here."""
    url = None if row["url"] is None else _field(row["url"])
    head = {
        "WARC-Type": "revisit" if row["revisit"] else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": url,
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(row["_sha1"])).decode(),
        "WARC-Payload-Length": row["bytes"],
        "WARC-Source-Row": None if row["id"] is None else _field(row["id"]),
        "Content-Type": "application/http; msgtype=response",
    }
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n".encode()
    if not row["revisit"]:
        return record(head, http + row["html"].encode())
    head |= {
        "WARC-Profile": REVISIT_PROFILE,
        "WARC-Refers-To-Target-URI": None if row["first_url"] is None else _field(row["first_url"]),
        "WARC-Refers-To-Date": "1970-01-01T00:00:00Z",
        "WARC-Refers-To-Source-Row": None if row["first_id"] is None else _field(row["first_id"]),
    }
    return record(head, http)


# Reading.


def read_packages(packages: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """The records of ZIP packages, given as rows with their URI in ``package``.

    (package, filename, offset, length, record_type, record_id, target_uri, headers, payload, digest, problem): offset and
    length are those of the record's bytes in the package; headers are by lower-case name; payload is the body of an
    HTTP message, else the block; digest is its base32 SHA-1 (null for revisits, whose payload isn't there). A package
    or record that can't be read gives a row with ``problem`` and nulls instead of failing: a broken directory, an
    archive that isn't stored, an index that points outside, a record cut off, or one whose payload has another digest
    than its header says (its columns are given then). Null packages are passed over; one named twice is read once.

    One task a package reads its directory and indexes, and the boundaries of archives that have no index; records are
    then dealt by stretches of ``stretch`` bytes, so a package of any size is read by many tasks, each of which reads
    neighbouring records together. Nothing is extracted to disk, and a task holds one read and its records.
    """

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column("package").to_pylist():
                held: list[tuple] = []
                for x in _located(uri):
                    held.append((uri, *x))
                    if len(held) == 10_000:
                        yield _rows(held)
                        held = []
                if held:
                    yield _rows(held)

    def _rows(held: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], k) for i, k in enumerate(kinds)], ["package", "filename", "offset", "length", "problem"])

    named = packages.select("package").filter("package is not null").distinct()
    found = materialize(mapped(named, locate, "package string, filename string, offset long, length long, problem string"))
    # Rows are small here and what they point at isn't, so the number of tasks is given by the bytes.
    tasks = max(packages.sparkSession.sparkContext.defaultParallelism, -(-(found.agg(F.sum("length")).first()[0] or 0) // stretch))
    dealt = found.withColumn("stretch", F.floor(F.col("offset") / stretch)).repartition(tasks, "package", "stretch").sortWithinPartitions("package", "offset")
    return mapped(dealt.drop("stretch"), _read, RECORDS)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_at, f = None, None
    try:
        for b in batches:
            rows = b.to_pylist()
            at = 0
            while at < len(rows):
                first, to = rows[at], at + 1
                end = first["offset"] + first["length"]
                while to < len(rows) and first["problem"] is None and rows[to]["problem"] is None and rows[to]["package"] == first["package"] and end <= rows[to]["offset"] <= end + 4096 and rows[to]["offset"] + rows[to]["length"] - first["offset"] <= READ_BYTES:
                    end = rows[to]["offset"] + rows[to]["length"]
                    to += 1
                raw, why = b"", first["problem"]
                if why is None:
                    try:
                        if open_at != first["package"]:
                            if f is not None:
                                f.close()
                            fs, path = open_filesystem(first["package"])
                            f, open_at = fs.open_input_file(path), first["package"]
                        raw = _at(f, first["offset"], end - first["offset"])
                    except (Damaged, OSError) as e:
                        why = f"{type(e).__name__}: {e}"
                yield _batch([_parsed(r, raw[r["offset"] - first["offset"] :][: r["length"]], why) for r in rows[at:to]])
                at = to
    finally:
        if f is not None:
            f.close()


def _parsed(row: dict, raw: bytes, why: str | None) -> tuple:
    place = (row["package"], row["filename"], row["offset"], row["length"])
    if why is None:
        try:
            headers, block = parse_record(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)
        except (Damaged, OSError, EOFError, zlib.error) as e:
            why = f"{type(e).__name__}: {e}"
    if why is not None:
        return (*place, None, None, None, None, None, None, why)
    kind = headers.get("warc-type")
    payload = None if kind == "revisit" else payload_of(headers, block)
    own = None if payload is None else digest(payload)
    said = headers.get("warc-payload-digest", "")
    if own and said.startswith("sha1:") and said[5:].upper() != own:
        why = "the payload has another digest than its header says"
    return (*place, kind, headers.get("warc-record-id"), headers.get("warc-target-uri"), list(headers.items()), payload, own, why)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in RECORDS.replace("map<string,string>", "map").split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def page_records(records: DataFrame, id_type: str = "long") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of records that ``write_packages`` wrote."""
    h = lambda k: F.try_element_at("headers", F.lit(k))
    pages = records.filter(F.col("record_type").isin("response", "revisit"))
    return pages.select(
        h("warc-source-row").cast(id_type).alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), h("warc-payload-length").cast("long")).alias("payload_bytes"),
        F.coalesce("digest", F.regexp_replace(h("warc-payload-digest"), "^sha1:", "")).alias("payload_digest"),
        "record_type",
        F.when(F.col("record_type") == "revisit", h("warc-refers-to-source-row").cast(id_type)).alias("refers_to"),
    )
