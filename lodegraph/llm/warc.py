"""WARC archives: a deterministic, sharded writer, and a streaming reader.

1. Payload digests are computed in Spark. Of records with equal payloads of at least `least` bytes the smallest key is the
   response and the others revisit it; only (key, digest) pairs of repeated payloads are joined, never payloads.
2. Records and those pairs are range-partitioned and sorted together by (key, digest): the one shuffle of payloads, in which
   every record finds its revisit target just before it.
3. Each task regenerates headers and digests, compresses each record as a gzip member of its own, rolls files by compressed
   size, and writes under temporary names. Dates, record ids and member headers come from the records alone, so a rerun
   writes the same bytes.
4. The task's result is the manifest of its files; the manifest that Spark commits names one attempt of each task. Files it
   names are renamed to their final names, and a manifest table marks the archive as complete; an archive without manifest
   isn't. Leftovers of lost attempts are deleted then. The number of tasks follows from the payloads' bytes.

Null payloads are empty; null urls are empty targets; equal payloads under one key: the first is the response, the others
revisit it. Null keys sort first and never are revisit targets for others with keys (min ignores nulls). Payloads of any length are written and read
whole, one record in memory. Empty tables give an archive of no files.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, staged, table

LEAST = 100
ROLL = 64 << 20
#: Payload bytes that one sorting task is meant for, and the fewest tasks.
SHARE, FEWEST = 128 << 20, 16
DATE = "2024-01-01T00:00:00Z"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_CRLF = b"\r\n"


def _fs(path: str):
    """(file system, path in it): local, HDFS or an object store, as the URI says."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith(("file:", "hdfs:")) else (fs.LocalFileSystem(), path)


def _uri(path: str) -> str:
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def record(key: int | None, url: str, payload: bytes, digest: str, target: int | None, serial: int = 0) -> bytes:
    """One WARC record, uncompressed; a revisit of `target` if that isn't None. `serial` tells records of equal key, digest and
    type apart."""
    http = _HTTP.format(len(payload)).encode()
    block = http if target is not None else http + payload
    kind = "revisit" if target is not None else "response"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}:{digest}:{kind}' + f':{serial}' * (serial > 0))}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url.replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"X-Page-Key: {'' if key is None else key}",
    ]
    if target is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{target}:{digest}:response')}>", f"X-Refers-To-Key: {target}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + _CRLF * 2


def member(data: bytes, level: int = 6) -> bytes:
    """One gzip member without time or name."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzipped archive, read as a stream: one record in memory."""
    raw, data = zlib.decompressobj(31), bytearray()

    def fill() -> bool:
        nonlocal raw
        while True:
            chunk = raw.unused_data if raw.eof else stream.read(1 << 16)
            if raw.eof:
                raw = zlib.decompressobj(31)
                chunk = chunk or stream.read(1 << 16)
            if not chunk:
                return False
            got = raw.decompress(chunk)
            if got:
                data.extend(got)
                return True

    while True:
        while (end := data.find(b"\r\n\r\n")) < 0:
            if not fill():
                return
        head = bytes(data[:end]).decode("utf-8", "surrogatepass").split("\r\n")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head[1:])
        size = int(headers["Content-Length"])
        while len(data) < end + 4 + size + 4:
            if not fill():
                raise EOFError("an archive ends inside a record")
        block = bytes(data[end + 4 : end + 4 + size])
        if hashlib.sha256(block).hexdigest() != headers["WARC-Block-Digest"].removeprefix("sha256:"):
            raise ValueError("a block's digest differs from its header")
        del data[: end + 8 + size]
        yield headers, block


MANIFEST = "name string, temporary string, records long, bytes long, sha256 string"


def _writer(path: str, roll: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        fs, base = _fs(path)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        out, done, number = None, [], 0
        targets: tuple = (None, None)  # (key, digest) -> target, from the pair just before
        target = None
        state: dict = {}

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((state["name"], state["temporary"], state["n"], state["size"], state["sha"].hexdigest()))
                out = None

        first_done: set = set()
        before, serial = None, 0
        for b in batches:
            for key, url, html, digest, kind, to in zip(b["key"], b["url"], b["html"], b["digest"], b["kind"], b["to"], strict=True):
                key = None if pd.isna(key) else int(key)
                if kind == 0:
                    targets, target = (key, digest), (None if pd.isna(to) else int(to))
                    continue
                payload = (html if isinstance(html, str) else "").encode("utf-8", "surrogatepass")
                digest_now = hashlib.sha256(payload).hexdigest()
                mine = None
                if targets == (key, digest_now) and target is not None:
                    if target != key or first_done == {(key, digest_now)}:
                        mine = target
                    else:
                        first_done = {(key, digest_now)}
                now = (key, digest_now, mine)
                before, serial = now, serial + 1 if now == before else 0
                data = member(record(key, url if isinstance(url, str) else "", payload, digest_now, mine, serial))
                if out is not None and state["size"] + len(data) > roll:
                    close()
                if out is None:
                    name = f"part-{part:06d}-{number:05d}.warc.gz"
                    state = {"name": name, "temporary": f"_temporary-{attempt}-{name}", "n": 0, "size": 0, "sha": hashlib.sha256()}
                    number += 1
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{state['temporary']}", compression=None)
                out.write(data)
                state["sha"].update(data)
                state["n"] += 1
                state["size"] += len(data)
        close()
        yield pd.DataFrame(done, columns=["name", "temporary", "records", "bytes", "sha256"])

    return run


def _renamer(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileType

        fs, base = _fs(path)
        for b in batches:
            for name, temporary in zip(b["name"], b["temporary"], strict=True):
                if fs.get_file_info(f"{base}/{temporary}").type != FileType.NotFound:  # else a lost task has renamed it
                    fs.move(f"{base}/{temporary}", f"{base}/{name}")
            yield b

    return run


def write_warc(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST, roll: int = ROLL, partitions: int | None = None) -> DataFrame:
    """Writes the archive below `path` (in a folder that all executors reach); returns its manifest table."""
    payload = F.coalesce(F.col(html), F.lit(""))
    d = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), payload.alias("html"))
    sizes = staged(d.select("key", F.sha2(F.encode("html", "UTF-8"), 256).alias("digest"), F.octet_length("html").alias("size")), "digests")
    marked = sizes.filter(F.col("size") >= least).select("key", "digest")
    firsts = marked.groupBy("digest").agg(F.min("key").alias("to"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "to")
    pairs = marked.join(firsts, "digest").select("key", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", F.lit(0).alias("kind"), "to")
    rows = d.select("key", "url", "html", F.sha2(F.encode("html", "UTF-8"), 256).alias("digest"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("to"))
    n = partitions or max(FEWEST, -(-(sizes.agg(F.sum("size")).first()[0] or 0) // SHARE))
    dealt = pairs.union(rows).repartitionByRange(n, "key", "digest").sortWithinPartitions("key", "digest", "kind")
    files = staged(dealt.mapInPandas(_writer(_uri(path), roll), MANIFEST), "files")
    done = staged(files.mapInPandas(_renamer(_uri(path)), MANIFEST), "renamed")
    manifest = done.select("name", "records", "bytes", "sha256")
    manifest.write.parquet(f"{path}/manifest")
    _sweep(d.sparkSession, path)
    return d.sparkSession.read.parquet(f"{path}/manifest")


def _sweep(spark: SparkSession, path: str) -> None:
    """Deletes what lost attempts of tasks have left under temporary names."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/_temporary-*")) or []:
        fs.delete(found.getPath(), False)


def read_warc(manifest: DataFrame, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every record of an archive; each file
    must have the digest that its manifest names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _fs(_uri(path))
        for b in batches:
            for name, sha in zip(b["name"], b["sha256"], strict=True):
                seen, rows = hashlib.sha256(), []

                class Counted(io.RawIOBase):
                    def __init__(self, inner) -> None:
                        self.inner = inner

                    def read(self, n: int = -1) -> bytes:
                        got = self.inner.read(n)
                        seen.update(got)  # noqa: B023
                        return got

                size = 0
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for h, block in records(Counted(f)):
                        end = block.find(b"\r\n\r\n")
                        http = block[:end].decode("latin-1").split("\r\n")
                        length = int(next(x for x in http if x.startswith("Content-Length: "))[16:])
                        body = block[end + 4 :]
                        kind, digest = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha256:")
                        if kind == "response" and (len(body) != length or hashlib.sha256(body).hexdigest() != digest):
                            raise ValueError("a payload differs from its headers")
                        k, to = h["X-Page-Key"], h.get("X-Refers-To-Key")
                        rows.append((int(k) if k else None, h["WARC-Target-URI"], length, digest, kind, int(to) if to else None, body))
                        size += len(body)
                        if size > 8 << 20:
                            yield _frame(rows)
                            rows, size = [], 0
                if seen.hexdigest() != sha:
                    raise ValueError(f"{name} differs from its manifest")
                yield _frame(rows)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return manifest.mapInPandas(run, schema)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    d = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
    return d.astype({"page_id": "Int64", "refers_to": "Int64"})


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as an archive, then reads it back."""
    path = new_path(spark, "warc")
    manifest = write_warc(table(spark, sf_dir, "pages"), path)
    read = read_warc(manifest.repartition(max(8, spark.sparkContext.defaultParallelism), "name"), path)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
