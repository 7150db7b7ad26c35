"""Archives that roll, archives that are cut, folders that are used, and ids that are alike."""

import glob
import gzip
import hashlib

import pytest

from larkspan.llm.warc import read_warc, write_warc
from larkspan.session import scratch_path

SCHEMA = "page_id long, url string, html string, bytes long, digest string, shard int"


def noise(i, n=3000):
    return "".join(hashlib.sha256(f"{i}:{j}".encode()).hexdigest() for j in range(n // 64))


@pytest.fixture
def pages(spark):
    rows = [(i, f"http://a/{i}", noise(i), 0, "x", 1) for i in range(120)] + [(None, None, noise(i), 0, "x", 1) for i in range(200, 260)]
    rows += [(7, "http://again/", noise(7), 0, "x", 1), (7, "u", None, 0, "x", 1), (300, "long", "é" * 2_000_000, 0, "x", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def test_files_roll_by_compressed_size_and_shards_cut_alike_ids(spark, pages):
    uri = scratch_path(spark, "warc-test")
    manifest = write_warc(pages, uri, shard_bytes=100_000, file_bytes=20_000).collect()
    shards = {}
    for f in manifest:
        shards.setdefault(f.name[5:10], []).append(f.bytes)
    assert max(map(len, shards.values())) > 1 and len(shards) > 3
    assert all(size <= 20_000 for files in shards.values() for size in files)
    got = read_warc(spark, uri).collect()
    assert len(got) == 183 == sum(f.records for f in manifest)
    assert sorted(r.payload_digest for r in got) == sorted(hashlib.sha1((r.html or "").encode()).hexdigest() for r in pages.collect())


def test_the_same_pages_give_the_same_files(spark, pages):
    uris = [scratch_path(spark, "warc-test") for _ in range(2)]
    first, second = (sorted((f.name, f.sha256) for f in write_warc(rows, uri, shard_bytes=100_000).collect()) for rows, uri in zip((pages, pages.repartition(5)), uris, strict=True))
    assert first == second


def test_a_cut_archive_is_an_error(spark, pages):
    uri = scratch_path(spark, "warc-test")
    for f in write_warc(pages, uri).collect():
        raw = open(f"{uri.removeprefix('file://')}/{f.name}", "rb").read()
        assert (len(raw), hashlib.sha256(raw).hexdigest()) == (f.bytes, f.sha256)
        assert gzip.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    path = sorted(glob.glob(f"{uri.removeprefix('file://')}/part-*.warc.gz"))[0]
    raw = open(path, "rb").read()
    for cut in range(len(raw) - 1, 0, -1):  # the last record goes, at the border of two gzip members
        if raw[cut : cut + 3] == b"\x1f\x8b\x08":
            try:
                gzip.decompress(raw[:cut])
                break
            except (EOFError, OSError):
                continue
    with open(path, "wb") as out:
        out.write(raw[:cut])
    with pytest.raises(Exception, match="not what the manifest lists"):
        read_warc(spark, uri).count()


def test_a_used_folder_is_refused_and_an_empty_table_is_empty(spark, pages):
    uri = scratch_path(spark, "warc-test")
    assert write_warc(pages.where("false"), uri).collect() == [] and read_warc(spark, uri).collect() == []
    with pytest.raises(FileExistsError):
        write_warc(pages, uri)
