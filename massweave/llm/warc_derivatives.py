"""Operator 5: WARC derivatives of archived responses.

From each response record two records are derived: a metadata record (application/warc-fields) and a
conversion record (text/plain, all visible text). Both name the response in WARC-Refers-To and carry
its URI and date on. The metadata keep the response's status and all its HTTP headers in their order, as
they were, with the payload's digest; digests are those of the new blocks, with the payload's beside
them. Identifiers are name-based (the response's identifier), so a rerun after a lost executor makes the
same records. ``derivatives`` takes any table of WARC records; pages become such records first, as by ``responses``.

Headers in other encodings than UTF-8 are read as Latin-1; names without a value, folded lines and
missing digests are accepted; chunked and compressed payloads are opened for the text; its encoding is
the header's, the page's own or UTF-8.

Names of fields are read in any case; a value may hold several records, plain or as gzip members.

Cases: null html is an empty payload, a null url the empty URI. Records that are no response or
resource have no derivatives, nor do bytes that are no record or a record cut short, which ``unreadable``
counts; the records about them are still read. Pages of one id and equal content have equal identifiers,
repeated rows are repeated. Records are made row by row: memory is that of a slice.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massweave.llm.common import map_rows, table
from massweave.llm.html_density import visible_text

#: The pages table has neither capture dates nor headers: its responses get these.
DATE = "1970-01-01T00:00:00Z"
STATUS = ("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8")
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "https://iipc.github.io/warc-specifications/")
#: Bytes of a gzip member read at a time.
CHUNK = 1 << 16
BETWEEN, HEAD_END, NEXT_RECORD = re.compile(rb"[\r\n]*"), re.compile(rb"\r?\n\r?\n"), re.compile(rb"(?<=\n)WARC/[0-9]")
CHARSET = re.compile(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, *of: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, ' '.join(map(str, (kind, *of))))}>"


def record(kind: str, uri: str, identifier: str, content_type: str, block: bytes, extra: tuple[tuple[str, str], ...] = (), date: str = DATE) -> bytes:
    fields = [("WARC-Type", kind), ("WARC-Record-ID", identifier), ("WARC-Date", date), ("WARC-Target-URI", uri), *extra, ("WARC-Block-Digest", digest(block)), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def one_line(value: str | None) -> str:
    """A header's value: line ends would begin a new header."""
    return " ".join((value or "").split())


def decoded(data: bytes) -> str:
    try:
        return data.decode("utf-8", "surrogatepass")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def headers(data: bytes) -> tuple[str, list[tuple[str, str]]]:
    """The first line and the (name, value) fields of a header block, in order; folded lines are one."""
    lines = decoded(data).replace("\r\n", "\n").split("\n")
    fields: list[tuple[str, str]] = []
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and fields:
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}".strip())
        elif line.strip():
            name, _, value = line.partition(":")
            fields.append((name.strip(), value.strip()))
    return lines[0].strip(), fields


class Fields(dict):
    """Header fields by name; case doesn't matter."""

    def __init__(self, fields: list[tuple[str, str]]) -> None:
        super().__init__((k.lower(), v) for k, v in fields)

    def __getitem__(self, name: str) -> str:
        return super().__getitem__(name.lower())

    def __contains__(self, name: object) -> bool:
        return super().__contains__(str(name).lower())

    def get(self, name: str, default: str | None = None):
        return super().get(name.lower(), default)


def members(data: bytes) -> bytes:
    """The bytes, or what the gzip members at their start hold; a broken member ends them."""
    if data[:2] != b"\x1f\x8b":
        return data
    out, at, view = [], 0, memoryview(data)
    while data[at : at + 2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            while at < len(data) and not member.eof:
                part = view[at : at + CHUNK]
                out.append(member.decompress(part))
                at += len(part) - len(member.unused_data)
        except zlib.error:
            break
    return b"".join(out)


def parse(data: bytes) -> list[tuple[Fields, bytes] | int]:
    """The records of a WARC file's bytes, gzip or plain: header fields and block.

    Line ends between records don't matter. Bytes that are no record, or whose record has no length or ends early, are
    given as their number, and reading goes on at the next line that begins a record.
    """
    data, out, at = members(data), [], 0
    while (m := BETWEEN.match(data, at)) and m.end() < len(data):
        at = m.end()
        head = HEAD_END.search(data, at) if data.startswith(b"WARC/", at) else None
        fields = Fields(headers(data[at : head.start()])[1] if head else [])
        length = fields.get("content-length", "")
        if head and length.isascii() and length.isdigit() and head.end() + int(length) <= len(data):
            out.append((fields, data[head.end() : head.end() + int(length)]))
            at = head.end() + int(length)
            continue
        again = NEXT_RECORD.search(data, at + 1)
        end = again.start() if again else len(data)
        out.append(end - at)
        at = end
    return out


def response(url: str | None, html: str | None, key: object = "", date: str = DATE) -> bytes:
    """The response record of a page."""
    uri, payload = one_line(url), (html or "").encode("utf-8", "surrogatepass")
    block = ("\r\n".join((*STATUS, f"Content-Length: {len(payload)}")) + "\r\n\r\n").encode() + payload
    own = digest(payload)
    return record("response", uri, record_id("response", key, uri, own), "application/http; msgtype=response", block, (("WARC-Payload-Digest", own),), date)


def opened(payload: bytes, fields: dict[str, str]) -> bytes:
    """The payload without its transfer and content codings; what can't be opened stays as it is."""
    if "chunked" in fields.get("transfer-encoding", "").lower():
        out, at = [], 0
        while (end := payload.find(b"\r\n", at)) >= 0:
            try:
                n = int(payload[at:end].split(b";")[0], 16)
            except ValueError:
                break
            if not n:
                payload = b"".join(out)
                break
            out.append(payload[end + 2 : end + 2 + n])
            at = end + 2 + n + 2
    for coding in reversed(fields.get("content-encoding", "").lower().replace(" ", "").split(",")):
        if coding in ("gzip", "x-gzip", "deflate"):
            for bits in (47, -15):
                try:
                    payload = zlib.decompress(payload, bits)
                    break
                except zlib.error:
                    continue
    return payload


def page_text(payload: bytes, content_type: str) -> str:
    """The payload's characters, by the charset of the header, of the page's head, UTF-8 or Latin-1."""
    for found in (CHARSET.search(content_type.encode()), CHARSET.search(payload[:2048])):
        if found:
            try:
                return payload.decode(codecs.lookup(found[1].decode()).name)
            except (LookupError, UnicodeDecodeError):
                continue
    return decoded(payload)


def derive(source: bytes) -> list[tuple[str, bytes]]:
    """(kind, record) of the metadata and conversion records of each response or resource record; of others nothing."""
    return [(kind, record(kind, *parts)) for kind, *parts in derived(source)]


def derived(source: bytes) -> list[tuple]:
    """The arguments of ``record`` for the two records of each response."""
    return [x for one in parse(source) if not isinstance(one, int) for x in derived_of(*one)]


def derived_of(fields: Fields, block: bytes) -> list[tuple]:
    kind = fields.get("warc-type", "").lower()
    if kind not in ("response", "resource"):
        return []
    uri, date = fields.get("warc-target-uri", "").strip("<>"), fields.get("warc-date", DATE)
    refers = fields.get("warc-record-id") or record_id("source", uri, date, digest(block))
    status, own, payload = "", [], block
    if kind == "response" and block.startswith(b"HTTP/"):
        end = HEAD_END.search(block)
        status, own = headers(block[: end.start()] if end else block)
        payload = block[end.end() :] if end else b""
    elif "content-type" in fields:
        own = [("Content-Type", fields["content-type"])]
    first = {k.lower(): v for k, v in reversed(own)}
    paid = fields.get("warc-payload-digest") or digest(payload)
    page = page_text(opened(payload, first), first.get("content-type", ""))
    is_text = first.get("content-type", "").lower().startswith("text/plain")
    text = (page if is_text else visible_text(page)).encode("utf-8", "surrogatepass")
    facts = [("sourceStatus", status), *((f"sourceHeader-{k}", v) for k, v in own), ("sourceDigest", paid), ("sourceLength", str(len(payload))), ("conversionDigest", digest(text)), ("conversionLength", str(len(text)))]
    about = "".join(f"{k}: {v}\r\n" for k, v in facts).encode("utf-8", "surrogatepass")
    extra = (("WARC-Refers-To", refers), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Source-Payload-Digest", paid))
    conversion = record_id("conversion", refers)
    return [
        ("metadata", uri, record_id("metadata", refers), "application/warc-fields", about, (*extra, ("WARC-Concurrent-To", conversion)), date),
        ("conversion", uri, conversion, "text/plain; charset=utf-8", text, extra, date),
    ]


SCHEMA = "page_id long, warc_type string, record_id string, refers_to string, target_uri string, block_digest string, source_digest string, content_length long, record binary"


def page_records(ids: list, urls: list, htmls: list) -> list[bytes]:
    return [response(u, h, "" if k is None else k) for k, u, h in zip(ids, urls, htmls)]


def responses(pages: DataFrame) -> DataFrame:
    """page_id, record: the response record of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return map_rows(rows, lambda: lambda x: {"page_id": x["page_id"], "record": page_records(x["page_id"], x["url"], x["html"])}, "page_id long, record binary")


def derivatives(records: DataFrame) -> DataFrame:
    """Two rows a response, of records (page_id, record) or pages: the derived record's header fields and its bytes.

    ``record`` may hold any number of records, plain or gzip; ``unreadable`` tells what in it is none.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    made = "record" in records.columns
    rows = records.select("page_id", "record") if made else records.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")

    def task():
        def each(x: dict[str, list]) -> dict:
            sources = x["record"] if made else page_records(x["page_id"], x["url"], x["html"])
            out = []
            for page_id, source in zip(x["page_id"], sources):
                for kind, uri, own, content_type, block, extra, date in derived(source or b""):
                    refers, paid = extra[0][1], extra[3][1]
                    out.append((page_id, kind, own, refers, uri, digest(block), paid, len(block), record(kind, uri, own, content_type, block, extra, date)))
            return dict(zip(names, zip(*out) if out else [()] * len(names)))

        return each

    return map_rows(rows, task, SCHEMA)


def unreadable(records: DataFrame) -> DataFrame:
    """page_id, runs, n_bytes: of every value of records (page_id, record), the runs of bytes that are no whole record."""
    rows = records.select("page_id", "record")

    def task():
        def each(x: dict[str, list]) -> dict:
            lost = [[p for p in parse(r or b"") if isinstance(p, int)] for r in x["record"]]
            return {"page_id": x["page_id"], "runs": list(map(len, lost)), "n_bytes": list(map(sum, lost))}

        return each

    return map_rows(rows, task, "page_id long, runs long, n_bytes long")


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(table(spark, sf_dir, "pages")).select(*[x.split()[0] for x in SCHEMA.split(", ")[:-1]], F.sha2("record", 256).alias("record_sha256"))
