"""WARC archives: writing, the monolithic-gzip normaliser, and reading by offset index.

:func:`write_archives` makes whole-file gzip streams, one or more a partition. :func:`normalise` inflates each stream once, from its start,
writes every record as a gzip member of its own and leaves a sidecar index (offset and length of each member) beside the file.
:func:`read_archives` reads the sidecars and fetches records at their offsets. Streams are copied in pieces, so memory is one record at most.

Files lie in a folder that driver and executors share, opened through ``pyarrow.fs`` by URI. A file's name holds the task's attempt and
is never used again; the next step gets it from the table of what the attempt that counts has written, so files of lost attempts are
never read.

Records have a date, a unique id and an HTTP head before the payload (application/http). A revisit has its target's id, address and date,
the full payload's digest and length, and no payload.

Defined results: a null html is an empty payload. Of records with equal payloads of at least MIN_REVISIT bytes, that with the
smallest id is the response (of several such rows the first in the table) and the others revisit it; with only null ids, all are
responses. Repeated rows are records of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow, cut, freeing, shared_dir

MIN_REVISIT = 100
#: Payload bytes that one archive is meant to hold.
ARCHIVE_BYTES = 16 << 20
#: Digests that are broadcast at most; beyond, salts over which a payload that occurs more than once is dealt.
BROADCAST_ROWS, SALTS, MOST_TASKS = 100_000, 32, 20_000
PIECE, LARGEST = 1 << 18, 1 << 22


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def with_revisits(pages: DataFrame, key: str = "page_id", body: str = "html", salts: int = SALTS) -> DataFrame:
    """(rid, page_id, url, payload, digest, payload_bytes, first): ``first`` (page_id, rid, url) and no payload where it revisits another record.

    First records come from an aggregate by digest, without the payloads. Digests that occur twice are joined back: as a broadcast up
    to BROADCAST_ROWS of them, which are counted, so that payloads aren't shuffled; beyond, dealt over ``salts`` keys each, so that
    a page that is a third of all rows is many tasks' work. ``pages`` must give the same rows in the same partitions twice, as files do.
    """
    payload = F.coalesce(F.col(body), F.lit("")).cast("binary")
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("page_id"), url.alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    one = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "rid", "url"))
    firsts = cut(rows.where(F.col("payload_bytes") >= MIN_REVISIT).groupBy("digest").agg(F.min(one).alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first"))
    if firsts.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(firsts), "digest", "left")
    else:
        salted = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = rows.withColumn("salt", F.pmod("rid", F.lit(salts)).cast("int")).join(salted, ["digest", "salt"], "left").drop("salt")
    joined = joined.withColumn("first", F.when(F.col("first.rid") != F.col("rid"), F.col("first")))
    return joined.withColumn("payload", F.when(F.col("first").isNull(), F.col("payload")))


def _uri(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def _record(row: dict, space, date: str) -> bytes:
    """A WARC/1.1 record. ``space``: the namespace of the archives' record ids."""
    import uuid

    name = lambda rid: f"<urn:uuid:{uuid.uuid5(space, str(rid))}>"
    first, body = row["first"], row["payload"]
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {name(row['rid'])}", f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response"]
    if row["url"] is not None:
        head.append(f"WARC-Target-URI: {_uri(row['url'])}")
    head.append(f"WARC-Payload-Digest: sha256:{row['digest']}")
    head += [f"X-Page-ID: {'null' if row['page_id'] is None else row['page_id']}", f"X-Payload-Length: {row['payload_bytes']}"]
    if first is not None:
        head += [f"WARC-Refers-To: {name(first['rid'])}", f"WARC-Refers-To-Date: {date}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {first['page_id']}"]
        if first["url"] is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_uri(first['url'])}")
        body = b""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode() + body
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Whole-file gzip archives of ``records`` (as :func:`with_revisits` gives them); (path) of each.

    Every partition writes its own, and begins another one after ``archive_bytes`` of records.
    """
    import datetime
    import uuid

    space, date = uuid.uuid4(), datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches):
        import zlib

        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = _opened(folder)
        store.create_dir(f"{root}/raw", recursive=True)
        n, out, size, own = 0, None, 0, uuid.uuid4().hex

        def close():
            out.write(gz.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path = f"{root}/raw/part-{task.partitionId():06d}-{own}-{n:04d}.warc.gz"
                    out, gz, size, n = store.open_output_stream(path, compression=None), zlib.compressobj(4, zlib.DEFLATED, 31), 0, n + 1
                record = _record(row, space, date)
                out.write(gz.compress(record))
                size += len(record)
                if size >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    bound_arrow(records.sparkSession)
    return records.mapInArrow(freeing(run), "path string")


class Stream:
    """A gzip stream inflated once, in pieces; ``line`` and ``take`` read on from where it stands."""

    def __init__(self, source):
        import zlib

        self.source, self.zlib, self.held = source, zlib, bytearray()
        self.inflate, self.rest = zlib.decompressobj(31), b""

    def more(self) -> bool:
        """Some more of the stream, PIECE bytes of the file or LARGEST bytes inflated at most."""
        piece = self.inflate.unconsumed_tail or self.rest or self.source.read(PIECE)
        self.rest = b""
        if not piece:
            return False
        self.held += self.inflate.decompress(piece, LARGEST)
        if self.inflate.eof:
            self.rest, self.inflate = self.inflate.unused_data, self.zlib.decompressobj(31)  # members that follow
        return True

    def head(self) -> dict[str, str] | None:
        """The next record's header lines, raw at key ''; None at the end."""
        while (end := self.held.find(b"\r\n\r\n")) < 0:
            if not self.more():
                if self.held.strip():
                    raise ValueError("truncated WARC header")
                return None
        raw = bytes(self.held[: end + 4])
        del self.held[: end + 4]
        lines = raw.decode().split("\r\n")
        return {"": raw} | dict(x.split(": ", 1) for x in lines[1:] if x)

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise ValueError("truncated WARC record")
        got = bytes(self.held[:n])
        del self.held[:n]
        return got


def normalise(paths: DataFrame, folder: str) -> DataFrame:
    """Each archive again with every record a gzip member, and a sidecar index; (path, index, records): names of both and the number of members."""

    def run(batches):
        import gzip
        import json
        import uuid

        import pyarrow as pa

        store, root = _opened(folder)
        store.create_dir(f"{root}/members", recursive=True)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                final, n, at = f"{root}/members/{path.rpartition('/')[2].removesuffix('.warc.gz')}-{uuid.uuid4().hex}.warc.gz", 0, 0
                with store.open_input_stream(path, compression=None) as source, store.open_output_stream(final, compression=None) as out, store.open_output_stream(f"{final}.idx", compression=None) as index:
                    stream = Stream(source)
                    while (head := stream.head()) is not None:
                        member = gzip.compress(head[""] + stream.take(int(head["Content-Length"]) + 4), 4, mtime=0)
                        out.write(member)
                        index.write(json.dumps({"record": head["WARC-Record-ID"], "offset": at, "length": len(member)}).encode() + b"\n")
                        at, n = at + len(member), n + 1
                yield pa.RecordBatch.from_arrays([pa.array([final]), pa.array([f"{final}.idx"]), pa.array([n], pa.int64())], ["path", "index", "records"])

    return paths.mapInArrow(freeing(run), "path string, index string, records long")


def read_archives(members: DataFrame, folder: str) -> DataFrame:
    """(page_id, record_type, refers_to, payload_bytes, payload_digest, payload) of each record that the sidecars of ``members`` list, read at its offset."""

    def run(batches):
        import gzip
        import hashlib
        import json

        import pyarrow as pa

        store, _ = _opened(folder)
        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        batch_of = lambda rows: pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
        for path, sidecar in ((p, i) for batch in batches for p, i in zip(batch.column("path").to_pylist(), batch.column("index").to_pylist(), strict=True)):
            rows, held = [], 0
            with store.open_input_file(path) as source, store.open_input_stream(sidecar, compression=None) as lines:
                for x in map(json.loads, lines.read().splitlines()):
                    source.seek(x["offset"])
                    head, _, rest = gzip.decompress(source.read(x["length"])).partition(b"\r\n\r\n")
                    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                    if fields["WARC-Record-ID"] != x["record"]:
                        raise ValueError(f"{sidecar} doesn't fit its archive")
                    body = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
                    revisit = fields["WARC-Type"] == "revisit"
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if not revisit and hashlib.sha256(body).hexdigest() != digest:
                        raise ValueError(f"payload of {x['record']} differs from its digest")
                    page = fields["X-Page-ID"]
                    rows.append((None if page == "null" else int(page), fields["WARC-Type"], int(fields["X-Refers-To-Page"]) if revisit else None, int(fields["X-Payload-Length"]) if revisit else len(body), digest, None if revisit else body))
                    held += len(body)
                    if held > PIECE * 16 or len(rows) >= 2_000:
                        yield batch_of(rows)
                        rows, held = [], 0
            if rows:
                yield batch_of(rows)

    kinds = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    return members.mapInArrow(freeing(run), kinds)


def one_task_each(paths: DataFrame) -> DataFrame:
    """A table of few rows dealt over as many tasks, MOST_TASKS at most."""
    return paths.repartition(min(MOST_TASKS, max(1, paths.count())))


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """``pages`` written as monolithic archives, normalised, and read back by the sidecar indexes. Tables between the steps say which files count."""
    folder = folder or shared_dir(pages.sparkSession) + "/warc"
    archives = cut(write_archives(with_revisits(pages), folder))
    members = cut(normalise(one_task_each(archives), folder))
    return read_archives(one_task_each(members), folder)


def op10(pages: DataFrame) -> DataFrame:
    return round_trip(pages.select("page_id", "url", "html")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
