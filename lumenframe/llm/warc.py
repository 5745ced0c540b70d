"""Deterministic sharded WARC writer and reader.

Records are ordered by id; a shard is a run of so many ids of
that order as have `shard_bytes` on average, so shards follow from the rows alone, not from how Spark samples or
partitions them. A task writes its shards as files of gzip members, one a record,
and starts the next file when the compressed size has reached `roll_bytes`. Headers,
record ids, dates and digests are made anew from the record, so the same rows give
the same bytes. Files are written under temporary names and renamed when whole; the
files' names, sizes and digests make a manifest, itself written through a temporary
folder and committed with _SUCCESS. Readers take only what a committed manifest
lists, so leftovers of lost tasks do not count, and fail where a file does not hold
what the manifest says.

Of records with equal payloads the one with the largest id is the response, the
others are revisits of it (payloads under `revisit_from` bytes are all responses).

Defined results: ids are whole numbers (others fail where Spark casts them). A null
payload counts as empty; a null URL leaves its header out. Null ids come first, and
are the response only where no equal payload has an id. Rows that repeat an id and a
payload: the first by URL is the response, the others revisit it. An empty table
gives a manifest without files. Columns other than id, URL and payload are not
looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SLICE_BYTES, SLICE_ROWS, bound_batches, cut, named, new_folder, ranked, sliced, table
from ._files import Staged, at

#: The date of every record: archives do not depend on when they are written.
DATE = "2000-01-01T00:00:00Z"
ROLL_BYTES = 256 << 20
#: Payloads of a shard in bytes: a part of all payloads, but no less and no more than this on average.
SHARD_PART, SHARD_BYTES = 256, (4 << 20, 1 << 30)
_SPACE = uuid.UUID("6f1c2d9a-0d1b-5c1e-9a57-2f4f4e1d7c10")


def b32(raw: bytes) -> str:
    return base64.b32encode(raw).decode()


def record_id(key: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{key}/{digest}')}>"


def _record(key: str, url: str | None, payload: bytes, digest: str, refers: str | None) -> bytes:
    """One record, uncompressed. refers: the key of the response that a revisit refers to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {record_id(key, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{b32(hashlib.sha1(block).digest())}"]
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers, digest)}", f"WARC-Refers-To-Key: {refers}"]
    head += [f"WARC-Record-Key: {key}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(raw: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)  # gzip without a time
    return z.compress(raw) + z.flush()


def shard_starts(ids: DataFrame, size: int) -> np.ndarray:
    """The first id of each shard but the first: every size-th of the ids (one column, not null) in their order."""
    rows = ranked(ids, ["id"]).where((F.col("rank") % size == 0) & (F.col("rank") > 0)).select("id").collect()
    return np.unique(np.array([r[0] for r in rows], np.int64))


def write(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", roll_bytes: int = ROLL_BYTES, revisit_from: int = 0, shard_bytes: int | None = None, level: int = 6) -> str:
    """Write df's records under folder; returns the manifest's path."""
    spark = df.sparkSession
    bound_batches(spark)
    payload = F.coalesce(named(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = df.select(named(id_col).cast("long").alias("id"), named(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    # Equal payloads: only ids and digests are grouped, and only groups of two or more come back.
    small = cut(rows.select("id", "sha", F.length("payload").alias("size")))
    n, total = small.agg(F.count("*"), F.coalesce(F.sum(F.col("size").cast("long")), F.lit(0))).first()
    shard_bytes = shard_bytes or min(max(total // SHARD_PART, SHARD_BYTES[0]), SHARD_BYTES[1])
    starts = shard_starts(small.where("id is not null").select("id"), max(1, shard_bytes * n // max(1, total)))
    shards = spark.sparkContext.broadcast(starts)  # eight bytes a shard
    several = small.where(F.col("size") >= revisit_from).groupBy("id", "sha").agg(F.count("*").alias("n"))
    groups = several.groupBy("sha").agg(F.max("id").alias("refers"), F.sum("n").alias("n")).where("n > 1").drop("n")
    refers = several.drop("n").join(groups, "sha")
    none = F.lit(None)
    both = rows.select("id", "sha", F.lit(1).alias("kind"), none.cast("long").alias("refers"), "url", "payload").unionByName(
        refers.select("id", "sha", F.lit(0).alias("kind"), "refers", none.cast("string").alias("url"), none.cast("binary").alias("payload"))
    )

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shards.value, ids.to_numpy(), "right").astype(np.int32))

    order = [F.col("id").asc_nulls_first(), "sha", "kind", F.col("url").asc_nulls_first()]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    both = both.withColumn("shard", shard_of(F.coalesce("id", F.lit(-(1 << 63))))).repartition(parts, "shard").sortWithinPartitions("shard", *order)
    both = both.select("id", "sha", "kind", "refers", "url", "payload", "shard")

    def run(batches):
        attempt = str(TaskContext.get().taskAttemptId())
        out, done, n, size, total, sha, now = None, 0, 0, 0, [], None, None
        rule, first = None, False  # (id, sha, refers) of the group that rows belong to

        def close():
            nonlocal out, n, size
            if out is not None:
                out.commit()
                total.append((out.final.rsplit("/", 1)[1], n, size, sha.hexdigest()))
                out, n, size = None, 0, 0

        try:
            for b in sliced(batches, 5):
                for key, digest, kind, refer, url, body, shard in zip(*(c.to_pylist() for c in b.columns)):
                    if shard != now:
                        close()
                        now, done, rule = shard, 0, None
                    if kind == 0:
                        rule, first = (key, digest, refer), True
                        continue
                    target = None
                    if rule and rule[:2] == (key, digest):
                        if rule[2] != key or not first:
                            target = "" if rule[2] is None else str(rule[2])
                        first = False
                    raw = _member(_record("" if key is None else str(key), url, body, b32(digest), target), level)
                    if out is None:
                        out, sha = Staged(folder, f"part-{shard:06d}-{done:05d}.warc.gz", attempt), hashlib.sha256()
                        done += 1
                    out.write(raw)
                    sha.update(raw)
                    n, size = n + 1, size + len(raw)
                    if size >= roll_bytes:
                        close()
            close()
        except BaseException:
            if out is not None:
                out.abort()
            raise
        cols = list(zip(*total)) if total else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], ["file", "records", "bytes", "sha256"])

    both.mapInArrow(run, "file string, records long, bytes long, sha256 string").write.json(manifest := f"{folder}/_manifest")
    return manifest


class _Counted:
    """A stream that counts and digests what is read from it."""

    def __init__(self, stream) -> None:
        self.stream, self.bytes, self.sha = stream, 0, hashlib.sha256()

    def read(self, n: int) -> bytes:
        raw = self.stream.read(n)
        self.bytes += len(raw)
        self.sha.update(raw)
        return raw


def _members(stream, chunk: int = 1 << 20):
    """The uncompressed gzip members of a stream, one at a time."""
    z, parts, raw, begun = zlib.decompressobj(31), [], b"", False
    while True:
        raw = raw or stream.read(chunk)
        if not raw:
            break
        parts.append(z.decompress(raw))
        raw, begun = z.unused_data, True
        if z.eof:
            yield b"".join(parts)
            z, parts, begun = zlib.decompressobj(31), [], False
    if begun:
        raise ValueError("an archive ends within a record")


def parse(raw: bytes) -> tuple[dict, bytes]:
    """Headers (names in lower case) and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of a committed folder.

    (id, url, type, payload_bytes, payload_digest, refers_to, payload); payload is
    null for revisits. It fails without _SUCCESS, and where a file's records, bytes or
    sha256 are not those of the manifest or a block's or payload's digest does not hold.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_manifest/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        raise ValueError(f"{folder} has no committed manifest")
    files = spark.read.schema("file string, records long, bytes long, sha256 string").json(f"{folder}/_manifest")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = "id long, url string, type string, payload_bytes long, payload_digest string, refers_to long, payload binary"

    def run(batches):
        number = lambda x: int(x) if x else None
        for b in batches:
            for name, records, size_of, sha in zip(*(c.to_pylist() for c in b.columns)):
                store, base = at(folder)
                rows, held, seen = [], 0, 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as opened:
                    stream = _Counted(opened)
                    for raw in _members(stream):
                        h, block = parse(raw)
                        if b32(hashlib.sha1(block).digest()) != h["warc-block-digest"][5:]:
                            raise ValueError(f"{name}: a block's digest does not hold")
                        head, _, body = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
                        digest = h["warc-payload-digest"][5:]
                        whole = h["warc-type"] == "response"
                        if whole and (len(body) != size or b32(hashlib.sha1(body).digest()) != digest):
                            raise ValueError(f"{name}: a payload's digest does not hold")
                        rows.append((number(h["warc-record-key"]), h.get("warc-target-uri"), h["warc-type"], size, digest, number(h.get("warc-refers-to-key")), body if whole else None))
                        held, seen = held + len(body), seen + 1
                        if len(rows) >= SLICE_ROWS or held >= SLICE_BYTES:
                            yield _batch(rows)
                            rows, held = [], 0
                    if (seen, stream.bytes, stream.sha.hexdigest()) != (records, size_of, sha):
                        raise ValueError(f"{name}: its records, bytes or digest are not those of the manifest")
                yield _batch(rows)

    def _batch(rows):
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        cols = list(zip(*rows)) if rows else [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["id", "url", "type", "payload_bytes", "payload_digest", "refers_to", "payload"])

    return files.repartition(n, "file").mapInArrow(run, schema)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages, then read the archives back."""
    folder = new_folder(spark, "warc")
    write(table(spark, sf_dir, "pages"), folder)
    out = read(spark, folder)
    return out.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


QUERIES = {"op7_warc": op7_warc}
ORACLES: dict[str, str] = {}
