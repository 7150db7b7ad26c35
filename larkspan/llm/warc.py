"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page id into shards whose boundaries depend on the
data alone. A task streams its shards' records into gzip members, rolls a file
by compressed size, and writes under a temporary name of its own attempt. The
list of finished files is a table; only files on it are renamed, and the
manifest, written last, is what a reader goes by. A lost executor leaves at
most files that no list names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm.ranges import MAX_BLOCKS, block_of, range_bounds
from larkspan.session import _delete, discard, materialize

#: Payload bytes for each shard, and least payload that a revisit record stands for.
SHARD_BYTES, REVISIT_BYTES = 32 << 20, 1000
#: Compressed size at which a file rolls: this part of a shard's payload, but at least so much. HTML packs to about a
#: quarter, so a shard makes a few files: of 4 MB for small tables, of 200 MB where 100 TB lie in MAX_BLOCKS shards.
FILE_PART, FILE_BYTES = 16, 4 << 20
#: Compressed bytes that one reading task takes, about.
READ_BYTES = 32 << 20
DATE = "1970-01-01T00:00:00Z"

_FILES = pa.schema([("name", pa.string()), ("temporary", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
_RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _head(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _urn(page_id, digest: str, nth: int = 0) -> str:
    import uuid

    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}:{nth}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, nth: int = 0, date: str = DATE) -> bytes:
    """One WARC record: a response with the payload, or a revisit with the HTTP head alone.

    Lengths and digests are computed here from the payload, never taken over.
    """
    import base64
    import hashlib
    from urllib.parse import quote

    sha = hashlib.sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    b32 = lambda h: "sha1:" + base64.b32encode(h.digest()).decode()
    fields = [("WARC-Type", "revisit" if refers_to is not None else "response"), ("WARC-Record-ID", _urn(page_id, sha.hexdigest(), nth)), ("WARC-Date", date)]
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]-._~")))
    if refers_to is not None:
        fields += [("WARC-Refers-To", _urn(refers_to, sha.hexdigest())), ("Refers-To-Page-ID", str(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("WARC-Payload-Digest", b32(sha)), ("WARC-Block-Digest", b32(hashlib.sha1(block))), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _head(fields) + block + b"\r\n\r\n"


def _member(raw: bytes) -> bytes:
    import zlib

    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


class _File:
    """One archive under its temporary name."""

    def __init__(self, fs, folder: str, attempt: str, name: str):
        import hashlib

        self.name, self.temporary = name, f"_temporary/{attempt}/{name}"
        fs.create_dir(f"{folder}/_temporary/{attempt}", recursive=True)
        self.out, self.sha, self.bytes, self.records = fs.open_output_stream(f"{folder}/{self.temporary}", compression=None), hashlib.sha256(), 0, 0
        body = f"software: larkspan\r\nformat: WARC File Format 1.1\r\nname: {name}\r\n".encode()
        head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _urn("info", name)), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(body)))]
        self.add(_member(_head(head) + body + b"\r\n\r\n"))
        self.records = 0

    def add(self, member: bytes) -> None:
        self.out.write(member)
        self.sha.update(member)
        self.bytes += len(member)
        self.records += 1

    def close(self) -> dict:
        self.out.close()
        return {"name": self.name, "temporary": self.temporary, "records": self.records, "bytes": self.bytes, "sha256": self.sha.hexdigest()}


def _writer(uri: str, file_bytes: int):
    def run(batches):
        from pyarrow import fs as pafs
        from pyspark import TaskContext

        fs, folder = pafs.FileSystem.from_uri(uri)
        context = TaskContext.get()
        attempt = f"{context.stageId()}-{context.taskAttemptId()}"
        file, place, mark, seen = None, (None, 0), None, None
        done: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                own = (row["page_id"], row["digest"])
                if row["kind"] == 0:  # says that the pages of this id and digest, next in order, revisit another
                    mark = (own, row["refers_to"])
                    continue
                refers = mark[1] if mark and mark[0] == own else None
                seen = (own, seen[1] + 1) if seen and seen[0] == own else (own, 0)
                member = _member(record(row["page_id"], row["url"], (row["html"] or "").encode(), refers, seen[1]))
                if file and (row["shard"] != place[0] or file.bytes + len(member) > file_bytes and file.records):
                    done.append(file.close())
                    place, file = (place[0], place[1] + 1), None
                if not file:
                    place = place if row["shard"] == place[0] else (row["shard"], 0)
                    file = _File(fs, folder, attempt, f"part-{place[0]:05d}-{place[1]:05d}.warc.gz")
                file.add(member)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=_FILES)
                done = []
        if file:
            yield pa.RecordBatch.from_pylist([file.close()], schema=_FILES)

    return run


def _renamer(uri: str):
    def run(batches):
        from pyarrow import fs as pafs

        fs, folder = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for row in batch.to_pylist():
                here, there = f"{folder}/{row['temporary']}", f"{folder}/{row['name']}"
                # a task that runs again finds the file where it belongs
                if fs.get_file_info(here).type != pafs.FileType.NotFound or fs.get_file_info(there).type == pafs.FileType.NotFound:
                    fs.move(here, there)
            yield batch

    return run


def _refuse_used(spark: SparkSession, uri: str) -> None:
    """An error where the folder has an archive already: renaming would put new files over old ones."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(where) and any(not x.getPath().getName().startswith("_temporary") for x in fs.listStatus(where)):
        raise FileExistsError(f"{uri} is not empty")


def write_warc(pages: DataFrame, uri: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard_bytes: int = SHARD_BYTES, file_bytes: int | None = None) -> DataFrame:
    """Write one record for each row of pages under `uri` (an empty or new folder, else an error); returns the manifest.

    Shards are ranges of (id, digest), so rows with a null or equal id are cut
    like any others; only rows equal in both stay together.

    Of equal payloads of REVISIT_BYTES or more, rows with the largest id are
    response records and the others revisit it; all other payloads are
    response records. A null html is an empty payload, a null url gives no
    target URI, a null id sorts first and revisits an equal payload that has
    an id. Repeated rows are records of their own. An empty table gives an
    empty manifest. Other columns are not read.
    """
    _refuse_used(pages.sparkSession, uri)
    text = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text.alias("html"))
    source = source.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    narrow = materialize(source.select("page_id", "digest", F.octet_length("html").cast("long").alias("bytes")), "narrow")
    heads = narrow.where(f"bytes >= {REVISIT_BYTES}").groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    marks = narrow.join(heads, "digest").where("page_id is null or page_id < refers_to").select("page_id", "digest", "refers_to").distinct()
    total = narrow.agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).first()
    place = F.struct(F.col("page_id").alias("a"), F.col("digest").alias("b"))
    bounds = range_bounds(narrow, place, min(MAX_BLOCKS, -(-(total.b or 0) // shard_bytes)), "bytes", total.n)

    file_bytes = file_bytes or max(FILE_BYTES, (total.b or 0) // (len(bounds) + 1) // FILE_PART)

    nothing = lambda kind: F.lit(None).cast(kind)
    both = source.select("page_id", "digest", F.lit(1).alias("kind"), "url", "html", nothing("long").alias("refers_to")).unionByName(
        marks.select("page_id", "digest", F.lit(0).alias("kind"), nothing("string").alias("url"), nothing("string").alias("html"), "refers_to")
    )
    both = both.withColumn("shard", block_of(place, bounds))
    ordered = both.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", "kind", "url")
    files = "name string, temporary string, records long, bytes long, sha256 string"
    finished = materialize(ordered.mapInArrow(_writer(uri, file_bytes), files), "finished")
    finished.repartition(64, "name").mapInArrow(_renamer(uri), files).drop("temporary").write.parquet(f"{uri}/_manifest")
    _delete(pages.sparkSession, f"{uri}/_temporary")
    discard(narrow, finished)
    return pages.sparkSession.read.parquet(f"{uri}/_manifest")


def records_of(stream):
    """(fields, block) for each record of an open uncompressed WARC stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        yield fields, stream.read(int(fields["content-length"]))


class _Counted:
    """A raw stream that counts and digests what is read from it."""

    def __init__(self, raw):
        import hashlib

        self.raw, self.bytes, self.sha = raw, 0, hashlib.sha256()

    def read(self, n: int = -1) -> bytes:
        data = self.raw.read(n) if n >= 0 else self.raw.read()
        self.bytes += len(data)
        self.sha.update(data)
        return data


def _reader(uri: str):
    def run(batches):
        import base64
        import gzip
        import hashlib

        from pyarrow import fs as pafs

        fs, folder = pafs.FileSystem.from_uri(uri)
        rows: list[dict] = []
        for batch in batches:
            for listed in batch.to_pylist():
                name, seen = listed["name"], 0
                raw = _Counted(fs.open_input_stream(f"{folder}/{name}", compression=None))
                with gzip.GzipFile(fileobj=raw) as stream:
                    for fields, block in records_of(stream):
                        if fields["warc-type"] == "warcinfo":
                            continue
                        seen += 1
                        head, _, payload = block.partition(b"\r\n\r\n")
                        http = dict(x.lower().split(": ", 1) for x in head.decode().split("\r\n")[1:])
                        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                        if fields["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{name}: payload of {fields['warc-record-id']} does not match its digest")
                        own, other = fields.get("page-id"), fields.get("refers-to-page-id")
                        rows.append({"page_id": own and int(own), "payload_bytes": int(http["content-length"]), "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": other and int(other)})
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)
                            rows = []
                while raw.read(1 << 20):
                    pass
                if (seen, raw.bytes, raw.sha.hexdigest()) != (listed["records"], listed["bytes"], listed["sha256"]):
                    raise ValueError(f"{name}: {seen} records in {raw.bytes} bytes are not what the manifest lists")
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)
                rows = []

    return run


def read_warc(spark: SparkSession, uri: str, read_bytes: int = READ_BYTES) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) for every record on the manifest.

    The payload of each response is digested again and must match its header;
    a file whose records, bytes or digest are not the manifest's, such as one
    cut at the end of a record, is an error. Files are dealt out to as many
    tasks as their bytes ask for.
    """
    manifest = spark.read.parquet(f"{uri}/_manifest")
    total = manifest.agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes")).first()
    tasks = max(1, min(total.files, max(2 * spark.sparkContext.defaultParallelism, -(-(total.bytes or 0) // read_bytes))))
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    # a number given by hand is kept by adaptive execution, which would read a small manifest in one task
    return manifest.select("name", "records", "bytes", "sha256").repartition(tasks, "name").mapInArrow(_reader(uri), schema)
