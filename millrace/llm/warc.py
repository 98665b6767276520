"""Web pages as WARC archives whose records can be read one by one.

Archives are often a single gzip stream, which can only be read from its
start. ``write`` makes such archives; ``normalise`` inflates each of them once,
from start to end, writes every record as a gzip member of its own and beside
the archive an index of offsets; ``read`` fetches records by these offsets.

Records with equal payloads are kept once: the one with the smallest page id is
a response, the others are revisits that refer to it. A null page counts as an
empty one. Null ids come after all others. Of repeated rows with the same id
and payload, one is the response. An empty table writes no file. Other columns
are left out.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import as_uri, new_file, new_path, open_input, open_output, pick, stored

#: An archive ends with the record that reaches so many bytes before compression.
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 1 << 20
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
# Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http; msgtype=response"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(fields: dict[str, str], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in fields.items()), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: object, url: str | None, payload: bytes, refers_to: object, revisit: bool, date: str = DATE) -> bytes:
    """A response record, or a revisit record without the payload but with its size and digest."""
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>",
        "WARC-Date": date,
    }
    if url:
        fields["WARC-Target-URI"] = quote(url, safe="!#$%&'()*+,/:;=?@[]~")
    fields |= {"WARC-Payload-Digest": f"sha1:{digest(payload)}", "Content-Type": HTTP_TYPE}
    if page_id is not None:
        fields["Page-ID"] = str(page_id)
    if revisit:
        fields["WARC-Profile"] = REVISIT
        if refers_to is not None:
            fields["Refers-To-Page-ID"] = str(refers_to)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record(fields, head if revisit else head + payload)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, by lower-case name, and block of one whole record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (line.partition(b":") for line in lines)}
    return fields, rest[: int(fields["content-length"])]


_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)")


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records from the inflated bytes of an archive; no more than one of them is held."""
    held = bytearray()
    need = 0
    for chunk in chunks:
        held += chunk
        while True:
            if not need:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                length = _LENGTH.search(held[:end])
                if not length:
                    raise ValueError("a record without Content-Length")
                need = end + 4 + int(length[1]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held:
        raise ValueError("the archive ends within a record")


def inflated(file) -> Iterator[bytes]:
    """The bytes of a gzip file, of one member or several, a piece at a time."""
    inflate = zlib.decompressobj(wbits=31)
    while data := file.read(READ_BYTES):
        while data:
            yield inflate.decompress(data, READ_BYTES)
            data = inflate.unconsumed_tail
            if inflate.eof:
                data, inflate = inflate.unused_data, zlib.decompressobj(wbits=31)


def marked(pages: DataFrame, least: int) -> DataFrame:
    """``(page_id, url, html, refers_to, revisit)``: which records repeat the payload of a response.

    Payloads are compared by SHA-1 and length. Only payloads that occur more
    than once take part in the join; adaptive execution splits a payload that
    holds a large share of the pages.
    """
    rows = stored(pick(pages, "page_id", "url", "html").withColumn("row", F.monotonically_increasing_id()), "pages")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keyed = rows.withColumns({"sha": F.sha1(payload), "bytes": F.length(payload)})
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "row")
    firsts = keyed.filter(F.col("bytes") >= least).groupBy("sha", "bytes").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = stored(firsts.filter("n > 1").select("sha", "bytes", "first"), "firsts")
    revisit = F.coalesce(F.col("first.row") != F.col("row"), F.lit(False))
    joined = keyed.join(firsts, ["sha", "bytes"], "left").withColumn("revisit", revisit)
    return joined.select("page_id", "url", "html", F.when(F.col("revisit"), F.col("first.page_id")).alias("refers_to"), "revisit")


def write(pages: DataFrame, folder: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as archives of one gzip stream each; return ``(path)`` of each.

    Every attempt of a task writes files of its own, and the stored list names
    those of the attempts that succeeded.
    """

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, path, deflate = None, 0, "", None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 1, 3, 4)]
            for i, (page_id, url, refers_to, revisit) in enumerate(zip(*columns, strict=True)):
                if out is None:
                    path, size = new_file(folder, "pages") + ".warc.gz", 0
                    out, deflate = open_output(path), zlib.compressobj(LEVEL, wbits=31)
                data = page_record(page_id, url, (batch.column(2)[i].as_py() or "").encode(), refers_to, revisit)
                out.write(deflate.compress(data))
                size += len(data)
                if size >= archive_bytes:
                    out.write(deflate.flush())
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [path]})
        if out is not None:
            out.write(deflate.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path]})

    return stored(marked(pages, least).mapInArrow(archives, "path string"), "archives")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive of ``archives(path)`` with one gzip member per record.

    Returns ``(path, index, records)``. The index is text, one JSON object per
    record with its offset and length in the file, type, page id and digest.
    """

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                name = new_file(folder, "records")
                path, index, lines, at = f"{name}.warc.gz", f"{name}.jsonl", [], 0
                with open_input(source) as file, open_output(path) as out:
                    for data in records(inflated(file)):
                        deflate = zlib.compressobj(LEVEL, wbits=31)
                        member = deflate.compress(data) + deflate.flush()
                        fields, _ = parse(data)
                        entry = {"offset": at, "length": len(member), "type": fields["warc-type"], "page_id": fields.get("page-id")}
                        lines.append(json.dumps(entry | {"digest": fields.get("warc-payload-digest")}))
                        out.write(member)
                        at += len(member)
                with open_output(index) as out:
                    out.write("\n".join(lines).encode())
                yield pa.RecordBatch.from_pylist([{"path": path, "index": index, "records": len(lines)}])

    spread = archives.repartition(archives.count() or 1)
    return stored(spread.mapInArrow(rewritten, "path string, index string, records bigint"), "normalised")


def read(files: DataFrame, id_type: str) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of every record, fetched by its offset."""

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_input(row["index"]) as file:
                    lines = file.read().decode().split("\n")
                rows = []
                with open_input(row["path"]) as file:
                    for entry in map(json.loads, filter(None, lines)):
                        rows.append(_row(zlib.decompress(file.read_at(entry["length"], entry["offset"]), wbits=31)))
                yield pa.RecordBatch.from_pylist(rows, schema=text)

    text = pa.schema([pa.field(n, pa.string()) for n in ("page_id", "payload_digest", "record_type", "refers_to")] + [pa.field("payload_bytes", pa.int64())])
    schema = "page_id string, payload_digest string, record_type string, refers_to string, payload_bytes bigint"
    found = files.repartition(files.count() or 1).mapInArrow(fetched, schema)
    return found.select(
        F.col("page_id").cast(id_type), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type)
    )


def _row(data: bytes) -> dict[str, object]:
    """What a record says of its page; the payload of a response is measured, not believed."""
    fields, block = parse(data)
    head, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["warc-type"]
    said = fields["warc-payload-digest"].removeprefix("sha1:")
    size = int(_LENGTH.search(head)[1])
    if kind == "response" and (len(payload), digest(payload)) != (size, said):
        raise ValueError(f"page {fields.get('page-id')}: the payload does not have its size and digest")
    return {
        "page_id": fields.get("page-id"), "payload_digest": said, "record_type": kind,
        "refers_to": fields.get("refers-to-page-id"), "payload_bytes": size,
    }


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the pages, make their records readable one by one, and read all of them back."""
    spark = pages.sparkSession
    folder = as_uri(new_path(spark, "warc"))
    archives = write(pages, f"{folder}/whole", least)
    return read(normalise(archives, f"{folder}/records"), pages.schema["page_id"].dataType.simpleString())
