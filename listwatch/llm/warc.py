"""WARC archives and the monolithic gzip normaliser (operator 8).

Three jobs over files in a shared folder:

* ``write`` turns pages into WARC records and writes, per task, archives that
  are one gzip stream over the whole file, rolled at ``ROLL_BYTES``. A record
  whose payload equals that of a page with a smaller id is a revisit and
  carries no payload.
* ``normalise`` inflates each such file once as a stream, rewrites every
  record as a gzip member of its own and writes a sidecar index
  (offset, length and identity of each record) beside the new file.
* ``read`` takes the index, seeks to each record and inflates that member
  alone.

Files are opened through ``pyarrow.fs`` so that any shared store it knows
will do. Each attempt of a task writes under names of its own and only the
names that a finished task returns are read later, so a lost executor or a
task that ran twice leaves files that nobody reads. No task holds more than
one record and one read buffer.

Defined cases: a null html is an empty payload; a null url leaves out the
target URI; line ends in a url become %0D and %0A; equal payloads are found by
SHA-1 and length; with repeated rows every row of the smallest page_id is a
response; among equal payloads, rows with a null page_id revisit the
smallest id, and are responses when no row of that payload has an id. Extra
columns are ignored, empty tables give no files and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwatch.llm.common import Scratch

ROLL_BYTES = 32 << 20
LEVEL = 3
READ = 1 << 18
END = b"\r\n\r\n"

MANIFEST = "path string, n_records long"
INDEX = "path string, offset long, length long, record_id string, record_type string, target_uri string"
RECORD = ("page_id string, target_uri string, record_type string, payload_bytes long, payload_digest string, "
          "refers_to string, payload binary")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One WARC/1.1 record, response or revisit, with its two line ends. Ids travel in the record's URN."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", "WARC-Record-ID: <urn:page:%s>" % ("" if page_id is None else page_id)]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END


def headers(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _urn(value: str | None) -> str | None:
    return None if not value else value.removeprefix("<urn:page:").removesuffix(">") or None


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of an uncompressed WARC stream, one at a time."""
    buffer, at = bytearray(), 0
    while True:
        while (end := buffer.find(END, at)) < 0:
            more = stream(READ)
            if not more:
                if bytes(buffer[at:]).strip():
                    raise ValueError("the archive ends inside a record's header")
                return
            del buffer[:at]
            at = 0
            buffer += more
        head = headers(bytes(buffer[at:end]))
        size = end - at + len(END) + int(head["content-length"]) + len(END)
        while len(buffer) - at < size:
            more = stream(READ)
            if not more:
                raise ValueError("the archive ends inside a record")
            buffer += more
        yield head, bytes(buffer[at:at + size])
        at += size
        if at > 8 * READ:
            del buffer[:at]
            at = 0


def inflated(f):
    """A read function over the inflated bytes of a gzip file of one or more members."""
    state = {"z": zlib.decompressobj(31), "rest": b""}

    def read(n: int) -> bytes:
        while True:
            raw = state["rest"] or f.read(n)
            if not raw:
                if not state["z"].eof and state.get("begun"):
                    raise ValueError("the gzip stream is cut off")
                return b""
            if state["z"].eof:
                state["z"] = zlib.decompressobj(31)
            state["begun"] = True
            out = state["z"].decompress(raw, 4 * n)
            state["rest"] = state["z"].unconsumed_tail or state["z"].unused_data
            if out:
                return out

    return read


def revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """(sha, size, first_id) of the payloads that several rows share; small beside the pages."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    return (pages.select(F.col(id_col).alias("id"), F.sha1(payload).alias("sha"), F.length(payload).alias("size"))
            .where(F.col("size") >= min_bytes).groupBy("sha", "size").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
            .where("n > 1").select("sha", "size", "first_id"))


def write(pages: DataFrame, folder: str, scratch: Scratch, id_col: str = "page_id", url_col: str = "url",
          html_col: str = "html", min_bytes: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write ``pages`` as monolithic gzip archives under ``folder``; returns the manifest (path, n_records)."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    known = scratch.save(revisits(pages, id_col, html_col, min_bytes), "revisits")
    # the pages' own rows move only if the revisits are too many to broadcast under Spark's threshold
    rows = (pages.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("_key"), F.col(url_col).cast("string").alias("url"),
                         html.alias("html"), F.sha1(html.cast("binary")).alias("sha"), F.length(html.cast("binary")).alias("size"))
            .join(known, ["sha", "size"], "left")
            .select("id", "url", F.col("html").cast("binary").alias("html"),
                    F.when(~F.col("_key").eqNullSafe(F.col("first_id")), F.col("first_id")).cast("string").alias("refers_to")))

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        state = None

        def close():
            state["f"].write(state["z"].flush())
            state["f"].close()
            return pa.RecordBatch.from_pydict({"path": [state["name"]], "n_records": [state["n"]]})

        for b in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                if state is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    state = {"name": name, "n": 0, "size": 0, "f": store.open_output_stream(f"{base}/{name}", compression=None),
                             "z": zlib.compressobj(LEVEL, zlib.DEFLATED, 31)}
                raw = record(page_id, url, payload, refers_to)
                state["f"].write(state["z"].compress(raw))
                state["n"] += 1
                state["size"] += len(raw)
                if state["size"] >= roll_bytes:
                    yield close()
                    state = None
        if state is not None:
            yield close()

    return scratch.save(rows.mapInArrow(run, MANIFEST), "manifest")


def normalise(manifest: DataFrame, folder: str, out_folder: str, scratch: Scratch) -> DataFrame:
    """Rewrite every archive of ``manifest`` with one gzip member a record, plus ``<name>.idx``; returns the index."""

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        out_store, out_base = fs.FileSystem.from_uri(out_folder)
        out_store.create_dir(out_base, recursive=True)
        for b in batches:
            for name in b.column(0).to_pylist():
                new = f"{uuid.uuid4().hex}-{name}"
                rows, offset = [], 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as f, \
                        out_store.open_output_stream(f"{out_base}/{new}", compression=None) as out, \
                        out_store.open_output_stream(f"{out_base}/{new}.idx", compression=None) as idx:
                    for head, raw in records(inflated(f)):
                        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = z.compress(raw) + z.flush()
                        out.write(member)
                        row = (new, offset, len(member), head["warc-record-id"], head["warc-type"], head.get("warc-target-uri"))
                        idx.write(("\t".join(map(str, (offset, len(member), row[4], row[3], row[5] or "-"))) + "\n").encode())
                        offset += len(member)
                        rows.append(row)
                        if len(rows) >= 4096:
                            yield _index(rows)
                            rows = []
                if rows:
                    yield _index(rows)

    n = max(1, manifest.count())  # files, each at most ROLL_BYTES and one record
    # every file is an item of its own: many tasks, each reading a file at a time
    work = manifest.select("path").repartition(min(n, 10_000), "path")
    return scratch.save(work.mapInArrow(run, INDEX), "index")


def _index(rows: list[tuple]) -> pa.RecordBatch:
    names = ("path", "offset", "length", "record_id", "record_type", "target_uri")
    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def read(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records that ``index`` lists: RECORD columns, ids as text; a revisit's payload is null."""

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        opened, f = None, None
        for b in batches:
            out = []
            for path, offset, length in zip(*(b.column(i).to_pylist() for i in range(3))):
                if path != opened:
                    if f is not None:
                        f.close()
                    opened, f = path, store.open_input_file(f"{base}/{path}")
                f.seek(offset)
                (head, raw), = records(io.BytesIO(zlib.decompress(f.read(length), 31)).read)
                block = raw[raw.index(END) + len(END):-len(END)]
                at = block.index(END) + len(END)
                http, body = headers(block[:at]), block[at:]
                payload = body if head["warc-type"] == "response" else None
                named = head["warc-payload-digest"].removeprefix("sha1:")
                if payload is not None and digest(payload) != named:
                    raise ValueError(f"the payload at {path}:{offset} does not have the digest of its header")
                out.append((_urn(head["warc-record-id"]), head.get("warc-target-uri"), head["warc-type"], int(http["content-length"]),
                            named, _urn(head.get("warc-refers-to")), payload if with_payload else None))
            names = [x.split()[0] for x in RECORD.split(", ")]
            types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return index.select("path", "offset", "length").mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", min_bytes: int = 0) -> DataFrame:
    """Write, normalise and read back ``pages``: one row a page, without payloads."""
    id_type = pages.schema[id_col].dataType
    manifest = write(pages, scratch.path("monolithic"), scratch, id_col, min_bytes=min_bytes)
    index = normalise(manifest, scratch.path("monolithic"), scratch.path("archive"), scratch)
    scratch.drop("monolithic")
    back = read(index, scratch.path("archive"), with_payload=False)
    return back.select(F.col("page_id").cast(id_type).alias(id_col), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").cast(id_type).alias("refers_to"))


#: The round trip over ``pages`` in DuckDB SQL; base32 is read off the digest's bits, five at a time.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, unhex(sha1(coalesce(html, '')))::BIT::VARCHAR AS bits FROM pages),
f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(list_sum(list_transform(range(5), lambda j: CAST(substr(bits, 5 * i + j + 1, 1) AS INTEGER) << (4 - j))) AS INTEGER) + 1, 1)), '')
           AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id OR first_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p JOIN f USING (h)
"""
