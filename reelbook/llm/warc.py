"""WARC archives of pages: written as one gzip stream per file, normalised to a member per record, read through an index."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelbook.llm.common import batches_of, open_input, open_output, prepare, shared_files, unique_file
from reelbook.session import stage

#: Payloads shorter than this are always stored whole.
REVISIT_BYTES = 1000
#: Bytes of records a file holds before the next is begun.
FILE_BYTES = 32 << 20
#: Bytes inflated at once; the compression level of members.
PIECE, LEVEL = 1 << 18, 4
#: Fixed texts of the format.
_VERSION, _REVISIT_PROFILE = "WARC/1.0", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_RECORD = "urn:page:"


def with_revisits(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload, digest (hexadecimal SHA-1), type, refers_to: of equal payloads the one with the largest key is kept whole.

    Only digests are grouped, with partial counts first; payloads stay where they are unless the repeated digests are many.
    """
    body = F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    long = rows.where(F.octet_length("payload") >= REVISIT_BYTES)
    heads = long.groupBy("digest").agg(F.max("page_id").alias("head"), F.count("*").alias("_n")).where(F.col("_n") > 1).select("digest", "head")
    heads = stage(heads, "heads")  # its size is known to the join then
    marked = rows.join(heads, "digest", "left")
    again = F.col("head").isNotNull() & (F.octet_length("payload") >= REVISIT_BYTES) & ~F.col("page_id").eqNullSafe(F.col("head"))
    return marked.select(
        "page_id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("type"), F.when(again, F.col("head")).alias("refers_to")
    )


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One record: headers, an empty line, the payload unless it is a revisit, two empty lines."""
    body = b"" if kind == "revisit" else payload
    head = [
        _VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <{_RECORD}{'' if page_id is None else page_id}>", "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.translate({10: "%0A", 13: "%0D"}))
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{_RECORD}{refers_to}>", f"WARC-Profile: {_REVISIT_PROFILE}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def records_of(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of a stream of uncompressed bytes; holds one record and a piece at a time."""
    held = bytearray()
    ended = False

    def more() -> bool:
        nonlocal ended
        piece = next(chunks, None)
        ended = piece is None
        held.extend(piece or b"")
        return not ended

    while held or more():
        searched = 0
        while (end := held.find(b"\r\n\r\n", searched)) < 0:
            searched = max(0, len(held) - 3)
            if not more():
                if held.strip():
                    raise ValueError("a record's headers do not end")
                return
        size = int(next(v for k, v in headers_of(bytes(held[:end])) if k == "content-length"))
        total = end + 4 + size + 4
        while len(held) < total:
            if not more():
                raise ValueError("a record is cut off")
        yield bytes(held[:total])
        del held[:total]


def headers_of(head: bytes) -> list[tuple[str, str]]:
    """Header names, lowered, with their values."""
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")[1:]
    return [(k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in lines)]


def inflated(source) -> Iterator[bytes]:
    """Uncompressed pieces of a gzip file of one or more members, inflated once from front to end.

    Fails unless the last member ends with its checksum, so a file cut at a flush, in its trailer or to nothing is not taken for whole.
    """
    engine, whole = zlib.decompressobj(31), False
    data = source.read(PIECE)
    while data:
        piece = engine.decompress(data, PIECE)
        if piece:
            yield piece
        data, whole = engine.unconsumed_tail, engine.eof
        if whole:
            data, engine = engine.unused_data, zlib.decompressobj(31)
        data = data or source.read(PIECE)
    if not whole:
        raise ValueError("a gzip stream is cut off")


def write_monoliths(records: DataFrame, folder: str) -> DataFrame:
    """Write records (as :func:`with_revisits` gives them) to files that are one gzip stream each: path, n_records."""
    out = pa.schema([("path", pa.string()), ("n_records", pa.int64())])

    def run(batches):
        def files():
            target = stream = path = None
            held = n = 0
            for batch in batches:
                for row in zip(*[c.to_pylist() for c in batch.columns]):
                    if stream is None:
                        path = unique_file(folder, "pages", ".warc.gz")
                        target = open_output(path)
                        stream, held, n = gzip.GzipFile(fileobj=target, mode="wb", compresslevel=LEVEL, mtime=0), 0, 0
                    text = record(*row)
                    stream.write(text)
                    held, n = held + len(text), n + 1
                    if held >= FILE_BYTES:
                        stream.close()
                        target.close()
                        stream = None
                        yield path, n
            if stream is not None:
                stream.close()
                target.close()
                yield path, n

        yield from batches_of(out, files(), size=1)

    return stage(records.mapInArrow(run, "path string, n_records bigint"), "monoliths")


def normalise(monoliths: DataFrame, folder: str) -> DataFrame:
    """Rewrite files so that every record is a gzip member, with an index beside: path, index, n_records.

    ``monoliths`` has ``path`` and ``n_records``, the records each file should hold or null; a file that holds others fails the job.
    The input stream of a file is inflated once. The index has a line of JSON per record: offset and length of its member,
    type and id. Members and index are written as the records come, so memory holds one record.
    """
    out = pa.schema([("path", pa.string()), ("index", pa.string()), ("n_records", pa.int64())])

    def run(batches):
        def files():
            for batch in batches:
                for source, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    path = unique_file(folder, "members", ".warc.gz")
                    at = n = 0
                    with open_input(source) as data, open_output(path) as target, open_output(path + ".index") as index:
                        for whole in records_of(inflated(data)):
                            member = gzip.compress(whole, LEVEL, mtime=0)
                            told = dict(headers_of(whole[: whole.index(b"\r\n\r\n")]))
                            line = {"offset": at, "length": len(member), "type": told["warc-type"], "id": told["warc-record-id"]}
                            target.write(member)
                            index.write(json.dumps(line).encode() + b"\n")
                            at, n = at + len(member), n + 1
                    if n != (n if wanted is None else wanted):
                        raise ValueError(f"{source}: {n} records, not {wanted}")
                    yield path, path + ".index", n

        yield from batches_of(out, files(), size=1)

    dealt = monoliths.select("path", "n_records").repartition(max(1, monoliths.count()), "path")
    return stage(dealt.mapInArrow(run, "path string, index string, n_records bigint"), "members")


def read_members(files: DataFrame) -> DataFrame:
    """Records read one by one at the offsets of the index: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A record with a payload is checked against its digest.
    """
    out = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    number = lambda uri: int(uri.strip("<>").removeprefix(_RECORD) or -1)

    def run(batches):
        def rows():
            for batch in batches:
                for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    with open_input(index) as listed:
                        lines = listed.read().splitlines()
                    with open_input(path) as data:
                        for line in map(json.loads, lines):
                            data.seek(line["offset"])
                            whole = gzip.decompress(data.read(line["length"]))
                            end = whole.index(b"\r\n\r\n")
                            told = dict(headers_of(whole[:end]))
                            digest = base64.b32decode(told["warc-payload-digest"].removeprefix("sha1:")).hex()
                            size, revisit = int(told["x-payload-length"]), told["warc-type"] == "revisit"
                            payload = whole[end + 4 : len(whole) - 4]
                            if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                                raise ValueError(f"{path}: the record at {line['offset']} is damaged")
                            bare = told["warc-record-id"].strip("<>").removeprefix(_RECORD)
                            yield int(bare) if bare else None, size, digest, told["warc-type"], number(told["warc-refers-to"]) if revisit else None

        yield from batches_of(out, rows())

    dealt = files.repartition(max(1, files.count()), "path").select("path", "index")
    return dealt.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def archive_round_trip(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """All pages written to archives, normalised and read back. A null payload is empty; repeated pages are records of their own."""
    spark = prepare(pages.sparkSession)
    folder = shared_files(spark, "warc")
    monoliths = write_monoliths(with_revisits(pages, key=key, url=url, html=html), folder)
    return read_members(normalise(monoliths, folder)).withColumnRenamed("page_id", key)
