"""WARC archives: a writer, a monolithic-gzip normaliser with offset index, and an index reader."""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwise.session import ensure_checkpoint_dir, materialize

CHUNK = 1 << 20
#: Uncompressed bytes after which the writer starts the next archive.
ARCHIVE_BYTES = 256 << 20
MIN_REVISIT_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_GZIP = 31  # zlib window bits for a gzip stream


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def archive_root(spark: SparkSession) -> str:
    """A new folder under the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/warc/{uuid.uuid4().hex}"


def plan_records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES, id_col: str = "page_id", url_col: str = "url",
                 html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, refers_to, record_type) for every row of ``pages``.

    Of records with equal payloads of at least ``min_bytes`` bytes, that with
    the smallest page_id is a response and the others revisit it.  Repeated
    rows of that page_id are all responses.  A null page_id is never the
    smallest: it revisits a payload that some page has and is a response
    otherwise.  A null html is an empty payload.  Equal payloads are found by
    SHA-256 and length.  The smallest ids are combined map-side and joined
    back as narrow rows, so a payload that a third of the pages share is split.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        payload.alias("payload"))
    rows = rows.withColumn("same", F.sha2("payload", 256))
    large = F.octet_length("payload") >= min_bytes
    first = rows.where(large).groupBy("same").agg(F.min("page_id").alias("first_id"))
    rows = rows.join(first, "same", "left")
    is_revisit = F.col("first_id").isNotNull() & large & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.select(
        "page_id", "url", "payload",
        F.when(is_revisit, F.col("first_id")).alias("refers_to"),
        F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
    )


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_id(record_id: str | None) -> int | None:
    if record_id is None:
        return None
    name = record_id.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "null" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes, record_type: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP headers and no payload."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}"
            "\r\n\r\n").encode()
    block = http if record_type == "revisit" else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~-._')}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
    ]
    if record_type == "revisit":
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(records: DataFrame, root: str, archive_bytes: int = ARCHIVE_BYTES, level: int = 6) -> DataFrame:
    """Write planned records to monolithic .warc.gz files under ``root``; (path, n_records) per file.

    Each archive is one gzip stream.  Every attempt of a task writes files of
    its own name, and the manifest lists those of the attempts that ended, so
    a lost executor leaves at worst files that nothing refers to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            for row in b.to_pylist():
                if out is None:
                    fs, path = _open(f"{root}/mono/{uuid.uuid4().hex}.warc.gz")
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                    size, count, pack = 0, 0, zlib.compressobj(level, zlib.DEFLATED, _GZIP)
                raw = record(row["page_id"], row["url"], row["payload"], row["record_type"], row["refers_to"])
                out.write(pack.compress(raw))
                size, count = size + len(raw), count + 1
                if size >= archive_bytes:
                    out.write(pack.flush())
                    out.close()
                    out = None
                    yield _manifest(root, path, count)
        if out is not None:
            out.write(pack.flush())
            out.close()
            yield _manifest(root, path, count)

    return materialize(records.mapInArrow(run, "path string, n_records long"), "warc-manifest")


def _manifest(root: str, path: str, count: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"path": [f"{root}/mono/{path.rpartition('/')[2]}"], "n_records": [count]})


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip file, member after member, in bounded pieces."""
    unpack, fed = zlib.decompressobj(_GZIP), False
    while data := stream.read(CHUNK):
        while data:
            fed = True
            yield unpack.decompress(data, CHUNK)
            data = unpack.unconsumed_tail
            if unpack.eof:
                data, unpack, fed = unpack.unused_data, zlib.decompressobj(_GZIP), False
    if fed and not unpack.eof:
        raise ValueError("the gzip stream ends early")


def parse_head(head: bytes) -> dict[str, str]:
    """Header fields of a record, by lower-case name; the version line as ''."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {"": lines[0]}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    if not lines[0].startswith("WARC/") or "content-length" not in fields:
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return fields


def rewrite(pieces: Iterator[bytes], out, level: int = 6) -> Iterator[dict]:
    """Copy each record of an inflated stream to ``out`` as its own gzip member; its index entry.

    Holds one piece and a header at a time, whatever the length of a record.
    """
    held, offset = b"", 0
    more = lambda: next(pieces, None)
    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if (piece := more()) is None:
                if held.strip():
                    raise ValueError("the last record is cut off")
                return
            held += piece
        fields = parse_head(held[:end])
        left = end + 4 + int(fields["content-length"]) + 4
        pack, length = zlib.compressobj(level, zlib.DEFLATED, _GZIP), 0
        while left:
            if not held and (held := more()) is None:
                raise ValueError("the last record is cut off")
            data = pack.compress(held[:left])
            left, held = left - len(held[:left]), held[left:]
            out.write(data)
            length += len(data)
        data = pack.flush()
        out.write(data)
        length += len(data)
        yield {"id": fields.get("warc-record-id"), "type": fields.get("warc-type"), "offset": offset, "length": length}
        offset += length


def normalise(manifest: DataFrame, root: str, level: int = 6) -> DataFrame:
    """Rewrite the archives in ``manifest`` (path) record by record; (path, index_path, n_records).

    Each archive is inflated once as a stream, every record becomes a gzip
    member of its own under ``root``, and a sidecar of JSON lines holds id,
    type, offset and length of each.  A stream that ends early raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source in b.column("path").to_pylist():
                name = f"{root}/members/{uuid.uuid4().hex}"
                fs, path = _open(f"{name}.warc.gz")
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                from_fs, from_path = _open(source)
                count = 0
                with from_fs.open_input_stream(from_path, compression=None) as stream, \
                        fs.open_output_stream(path, compression=None) as out, \
                        fs.open_output_stream(path[: -len(".warc.gz")] + ".idx") as index:
                    for entry in rewrite(inflated(stream), out, level):
                        index.write(json.dumps(entry).encode() + b"\n")
                        count += 1
                yield pa.RecordBatch.from_pydict(
                    {"path": [f"{name}.warc.gz"], "index_path": [f"{name}.idx"], "n_records": [count]})

    paths = manifest.select("path")
    spread = paths.repartition(max(1, paths.count()), "path")
    return materialize(spread.mapInArrow(run, "path string, index_path string, n_records long"), "warc-members")


def read_member(data: bytes) -> dict:
    """A record from the bytes of its gzip member."""
    raw = zlib.decompress(data, _GZIP)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = parse_head(head)
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and (len(payload) != length or payload_digest(payload) != digest):
        raise ValueError(f"the payload of {fields['warc-record-id']} does not match its digest")
    return {"page_id": _page_id(fields["warc-record-id"]), "payload_bytes": length, "payload_digest": digest,
            "record_type": fields["warc-type"], "refers_to": _page_id(fields.get("warc-refers-to")),
            "payload": payload if fields["warc-type"] == "response" else None}


READ = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def read_archives(members: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of normalised archives, each fetched by its offset in the sidecar index.

    page_id, payload_bytes, payload_digest (both of the full payload),
    record_type, refers_to and payload (null for revisits, or if not asked for).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for b in batches:
            for path, index_path in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, at = _open(path)
                index_fs, index_at = _open(index_path)
                rows, held = [], 0
                with fs.open_input_file(at) as data, index_fs.open_input_stream(index_at) as index:
                    for line in io.BufferedReader(index):
                        entry = json.loads(line)
                        data.seek(entry["offset"])
                        row = read_member(data.read(entry["length"]))
                        held += row["payload_bytes"] if payloads else 64
                        rows.append(row if payloads else row | {"payload": None})
                        if held >= CHUNK:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    paths = members.select("path", "index_path")
    return paths.repartition(max(1, paths.count()), "path").mapInArrow(run, READ)


def round_trip(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages as monolithic archives, normalise them and read all records back (no payloads)."""
    root = archive_root(pages.sparkSession)
    manifest = write_archives(plan_records(pages, min_bytes), root, archive_bytes)
    return read_archives(normalise(manifest, root), payloads=False).drop("payload")
