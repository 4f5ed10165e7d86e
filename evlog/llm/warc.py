"""A sharded WARC writer whose files are the same at every run, and a reader that checks them.

Records are ordered by an integer key and then by payload digest, and cut into shards by bytes, at bounds that come from
exact byte counts and so do not depend on how Spark deals the rows; a key with more than a shard's bytes is cut by digest, and records that repeat a key
and payload for more than a shard's bytes by their numbers in the order of their URLs, which come from range-sorting and
prefix sums. A partition is a shard, by its number, and one task writes it: it rolls to a new file once a file's compressed size has
reached file_bytes, makes every header and digest anew, writes under a temporary name and renames the finished file. The
manifest, renamed into place last, is the commit; readers see only the files that it names, with their sizes and digests.
A task that runs again, or twice at once, renames the same bytes to the same name.

Defined results: a null payload is empty. Of records with equal payloads of min_bytes or more, the one with the largest key
is the response and the others revisit it; of rows that repeat both key and payload one counts as that record and the rest
revisit it. Records without a key sort first, are revisits if a record with a key has their payload, and else responses.
Line ends in a URL are percent-encoded, a null URL is left out. An empty table gives a manifest without files. Other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Work, batch, join_hot

_MANIFEST = pa.schema([("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()), ("first_key", pa.int64()), ("last_key", pa.int64())])
_MANIFEST_DDL = "name string, records long, bytes long, sha256 string, first_key long, last_key long"
_RECORD = pa.schema([("key", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
_RECORD_DDL = "key long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_OVERHEAD = 512  # what a record's headers take


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key: int | None, digest: str, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'warc:{key}:{digest}:{nth}')}>"


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, nth: int, date: str) -> bytes:
    """One WARC record. A revisit has the HTTP head only; its Content-Length there still tells the payload's size."""
    digest = sha1_base32(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(key, digest, nth)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if key is not None:
        head.append(("X-Record-Key", str(key)))
    if revisit:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to, digest, 0)), ("X-Refers-To-Key", str(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


class _Shard:
    """Writes one shard's files; finish() renames them all."""

    def __init__(self, path: str, shard: int, file_bytes: int, level: int):
        self.fs, self.path = filesystem(path)
        self.shard, self.file_bytes, self.level = shard, file_bytes, level
        self.temporary = f"{self.path}/_temporary/{uuid.uuid4().hex}"
        self.fs.create_dir(self.temporary, recursive=True)
        self.done, self.out = [], None

    def add(self, key: int | None, data: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{len(self.done):04d}.warc.gz"
            self.out, self.sha, self.size, self.keys = self.fs.open_output_stream(f"{self.temporary}/{self.name}", compression=None), hashlib.sha256(), 0, []
            self.first, self.n = key, 0
        squeeze = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        member = squeeze.compress(data) + squeeze.flush()
        self.out.write(member)
        self.sha.update(member)
        self.size, self.last, self.n = self.size + len(member), key, self.n + 1
        if self.size >= self.file_bytes:
            self.roll()

    def roll(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None
            self.done.append((self.name, self.n, self.size, self.sha.hexdigest(), self.first, self.last))

    def finish(self) -> list[tuple]:
        self.roll()
        for name, *_ in self.done:
            self.fs.move(f"{self.temporary}/{name}", f"{self.path}/{name}")
        self.fs.delete_dir(self.temporary)
        return self.done


#: Records without a key have this place in the order.
_FIRST = -(2**63)
#: A digest's place in the order, from its first hexadecimal digits.
_CUT_DIGITS = 15


def _cut() -> F.Column:
    return F.conv(F.substring("digest", 1, _CUT_DIGITS), 16, 10).cast("long")


class Bounds:
    """The shards' first records, by key, cut and, of records that repeat both, number; the first shard begins before all."""

    def __init__(self, firsts: list[tuple[int, int, int]]):
        self.keys, self.cuts, self.turns = (np.array([f[k] for f in firsts], np.int64) for k in (0, 1, 2))
        self.crowded = np.unique(self.keys[(self.cuts > 0) | (self.turns > 0)])

    def __len__(self) -> int:
        return len(self.keys)

    def shard(self, keys: np.ndarray, cuts: np.ndarray, turns: np.ndarray | None = None) -> np.ndarray:
        out = np.searchsorted(self.keys, keys, "right") - 1
        inside = np.flatnonzero(np.isin(keys, self.crowded)) if len(self.crowded) else ()
        for i in inside:
            a, b = np.searchsorted(self.keys, keys[i], "left"), np.searchsorted(self.keys, keys[i], "right")
            c, d = a + np.searchsorted(self.cuts[a:b], cuts[i], "left"), a + np.searchsorted(self.cuts[a:b], cuts[i], "right")
            out[i] = c + np.searchsorted(self.turns[c:d], 0 if turns is None else turns[i], "right") - 1
        return np.maximum(out, 0)


def _dealt(bounds: Bounds):
    """Adds each row's shard."""

    def run(batches):
        for rows in batches:
            keys, cuts, turns = (np.asarray(rows.column(c).fill_null(_FIRST if c == "key" else 0), np.int64) for c in ("key", "cut", "turn"))
            yield pa.RecordBatch.from_arrays([pa.array(bounds.shard(keys, cuts, turns), pa.int32()), *rows.columns], ["shard", *rows.schema.names])

    return run


def _written(path: str, file_bytes: int, level: int, min_bytes: int, date: str):
    """Writes shards, whose rows come in order: of a key and digest first the mark, if there is one, then the records. Records
    that are cut by their numbers bring these, and their mark, along."""

    def run(batches):
        shard, group, keeper, nth = None, None, None, 0
        for rows in batches:
            columns = [rows.column(c).to_pylist() for c in ("shard", "key", "kind", "digest", "keeper", "url", "turn")]
            payloads = rows.column("payload").cast(pa.binary())
            for i, (to, k, kind, digest, refers, url, turn) in enumerate(zip(*columns, strict=True)):
                if shard is None or shard.shard != to:
                    if shard is not None:
                        yield batch(_MANIFEST, *zip(*shard.finish(), strict=True))
                    shard, group = _Shard(path, to, file_bytes, level), None
                if group != (k, digest):
                    group, keeper, nth = (k, digest), None, 0
                if kind == 0:
                    keeper = refers
                    continue
                if turn is not None:
                    keeper, nth = refers, turn
                payload = payloads[i].as_py() or b""
                refers_to = keeper if keeper is not None else k if nth and len(payload) >= min_bytes else None
                shard.add(k, record(k, url, payload, refers_to, refers_to is not None, nth, date))
                nth += 1
        if shard is not None:
            yield batch(_MANIFEST, *zip(*shard.finish(), strict=True))

    return run


def _cells(marks: list[int]):
    """Adds the number of the cell of each row's key, among cells that begin at the marks."""
    begins = np.array(marks, np.int64)

    def run(batches):
        for rows in batches:
            cell = np.maximum(np.searchsorted(begins, np.asarray(rows.column("key"), np.int64), "right") - 1, 0)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), *rows.columns], ["cell", *rows.schema.names])

    return run


def _bounds(slim: DataFrame, shard_bytes: int, cells: int = 4096) -> Bounds:
    """The first records of the shards: byte counts in even cells of keys, cells of over a shard's bytes cut again, keys of over
    a shard's bytes cut by digest, records of one key and payload by their numbers, then all put together in order. What comes
    to the driver are counts by cell, a small multiple of the number of shards."""
    slim = slim.withColumn("key", F.coalesce("key", F.lit(_FIRST)))
    low, high = slim.agg(F.min("key"), F.max("key")).first()
    pieces, crowded, todo = {}, {}, [] if low is None else [(low, high)]
    while todo:
        starts = {m for a, b in todo for m in range(a, b + 1, max(1, -(-(b - a + 1) // cells)))}
        marks = sorted(starts | {b + 1 for _, b in todo if b < 2**63 - 1})
        inside = slim.where(F.col("key").between(marks[0], todo[-1][1])).select("key", "bytes")
        counted = inside.mapInArrow(_cells(marks), "cell long, key long, bytes long").groupBy("cell").agg(F.sum(F.col("bytes") + _OVERHEAD).alias("size"), F.min("key").alias("least"), F.max("key").alias("most"))
        todo, cells = [], 64
        for piece in sorted(counted.collect(), key=lambda r: r.cell):
            if marks[piece.cell] in starts:
                if piece["size"] <= shard_bytes:
                    pieces[piece.least, 0, 0] = piece["size"]
                elif piece.most > piece.least:
                    todo.append((piece.least, piece.most))
                else:
                    crowded[piece.least] = 1 + (1 << 4 * _CUT_DIGITS) // (4 * -(-piece["size"] // shard_bytes))
    if crowded:  # total bytes / shard_bytes keys at most, and as many cuts with more than a shard's bytes
        widths = F.broadcast(slim.sparkSession.createDataFrame(sorted(crowded.items()), "key long, width long"))
        by_cut = slim.join(widths, "key").groupBy("key", "width", _cut().alias("cut")).agg(F.sum(F.col("bytes") + _OVERHEAD).alias("size"), F.count("*").alias("n"), F.max("bytes").alias("bytes"))
        giants = {(r.key, r["cut"]): (r["size"], r.n) for r in by_cut.where(F.col("size") > shard_bytes).collect()}
        # cells end before a giant and begin anew behind it
        edges = F.broadcast(slim.sparkSession.createDataFrame([(k, sorted(c for g, c in giants if g == k)) for k in crowded], "key long, giants array<long>"))
        small = by_cut.where(F.col("size") <= shard_bytes).join(edges, "key")
        behind = F.coalesce(F.array_max(F.filter("giants", lambda g: g < F.col("cut"))) + 1, F.lit(0))
        cells_of = small.groupBy("key", F.greatest(F.col("cut") - F.col("cut") % F.col("width"), behind).alias("cut")).agg(F.sum("size").alias("size"))
        pieces |= {(r.key, r["cut"], 0): r["size"] for r in cells_of.collect()}
        for (k, c), (size, n) in giants.items():
            each = -(-size // n)
            step = max(1, shard_bytes // each)
            pieces |= {(k, c, at): each * min(step, n - at) for at in range(0, n, step)}
    out, held = [(_FIRST, 0, 0)], 0
    for start in sorted(pieces):
        if held and held + pieces[start] > shard_bytes:
            out.append(start)
            held = 0
        held += pieces[start]
    return Bounds(out)


def _numbered(batches):
    """The number of the partition, and each row's number among the partition's rows of its key and digest, which come sorted."""
    from pyspark import TaskContext

    part, at, n = TaskContext.get().partitionId(), None, 0
    for rows in batches:
        numbers = []
        for own in zip(rows.column("key").to_pylist(), rows.column("digest").to_pylist(), strict=True):
            n = n + 1 if own == at else 0
            at = own
            numbers.append(n)
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([part] * len(numbers), pa.int32()), pa.array(numbers, pa.int64())], [*rows.schema.names, "part", "turn"])


def _with_numbers(work: Work, rows: DataFrame, slim: DataFrame, marks: DataFrame, shard_bytes: int) -> tuple[DataFrame, DataFrame]:
    """rows and marks; records that repeat a key and payload for more than a shard's bytes have their numbers, in the order of
    their URLs, and their marks in `turn` and `keeper`."""
    none = F.lit(None).cast("long")
    repeated = slim.groupBy("key", "digest").agg(F.count("*").alias("n"), F.sum(F.col("bytes") + _OVERHEAD).alias("size")).where((F.col("size") > shard_bytes) & (F.col("n") > 1))
    repeated = work.save(repeated.select(F.col("key").alias("_key"), F.col("digest").alias("_digest")), "repeated")  # total bytes / shard_bytes rows at most
    if repeated.isEmpty():
        return rows.withColumn("turn", none), marks
    same = F.col("key").eqNullSafe(F.col("_key")) & (F.col("digest") == F.col("_digest"))
    kept = F.broadcast(work.save(repeated.join(marks, same, "left").select("_key", "_digest", F.col("keeper").alias("_keeper")), "repeated-marks"))
    giant = rows.drop("keeper").join(kept, same).drop("_key", "_digest").withColumnRenamed("_keeper", "keeper")
    order = [F.col("key").asc_nulls_first(), F.col("digest"), F.col("url").asc_nulls_first()]
    # rows that are equal in all are spread by where they stand
    ranged = giant.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(*order, "_at").sortWithinPartitions(*order, "_at").drop("_at")
    columns = ["key", "kind", "digest", "keeper", "url", "payload"]
    staged = work.save(ranged.select(columns).mapInArrow(_numbered, "key long, kind int, digest string, keeper long, url string, payload string, part int, turn long"), "repeats")
    counts = work.save(staged.groupBy("key", "digest", "part").agg((F.max("turn") + 1).alias("n")), "repeat-counts")
    # range-sorted partitions: partitions + groups rows at most
    before, held = [], {}
    for r in sorted(counts.collect(), key=lambda r: r.part):
        before.append((r.key, r.digest, r.part, held.get((r.key, r.digest), 0)))
        held[r.key, r.digest] = before[-1][3] + r.n
    offsets = F.broadcast(work.spark.createDataFrame(before, "_key long, _digest string, _part int, _before long"))
    numbered = staged.join(offsets, same & (F.col("part") == F.col("_part"))).withColumn("turn", F.col("turn") + F.col("_before"))
    others = rows.join(F.broadcast(repeated), same, "left_anti").withColumn("turn", none)
    return others.unionByName(numbered.select(*columns, "turn")), marks.join(F.broadcast(repeated), same, "left_anti")


def write(records: DataFrame, path: str, key: str = "page_id", payload: str = "html", url: str | None = "url", shard_bytes: int = 64 << 20, file_bytes: int = 16 << 20, min_bytes: int = 0, level: int = 6, date: str = "1970-01-01T00:00:00Z") -> str:
    """Write the records as WARC files below path; returns the manifest's path."""
    spark = records.sparkSession
    work = Work(spark, "warc")
    given = records.select(F.col(key).cast("long").alias("key"), F.col(payload).alias("payload"), (F.col(url) if url else F.lit(None).cast("string")).alias("url"))
    text = F.coalesce("payload", F.lit(""))
    slim = work.save(given.select("key", F.sha1(text.cast("binary")).alias("digest"), F.octet_length(text).cast("long").alias("bytes")), "slim")
    bounds = _bounds(slim, shard_bytes)
    long = slim.where(F.col("bytes") >= min_bytes)
    copies = work.save(long.groupBy("digest").agg(F.max("key").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null"), "copies")
    marks = join_hot(long, copies, "digest", "n", slim.count()).where("not key <=> keeper").select("key", "digest", "keeper").distinct()
    rows = given.withColumn("digest", F.sha1(text.cast("binary"))).select("key", F.lit(1).alias("kind"), "digest", F.lit(None).cast("long").alias("keeper"), "url", "payload")
    rows, marks = _with_numbers(work, rows, slim, marks, shard_bytes)
    none = lambda kind: F.lit(None).cast(kind)
    both = rows.unionByName(marks.select("key", F.lit(0).alias("kind"), "digest", "keeper", none("string").alias("url"), none("string").alias("payload"), none("long").alias("turn"))).withColumn("cut", _cut())
    ddl = "shard int, key long, kind int, digest string, keeper long, url string, payload string, turn long, cut long"
    dealt = both.mapInArrow(_dealt(bounds), ddl).drop("cut").repartitionById(len(bounds), "shard").sortWithinPartitions("shard", F.col("key").asc_nulls_first(), "digest", "kind", "turn", "url")
    files = work.save(dealt.mapInArrow(_written(path, file_bytes, level, min_bytes, date), _MANIFEST_DDL), "files")
    system, where = filesystem(path)
    system.create_dir(where, recursive=True)
    temporary, manifest = f"{where}/_temporary-manifest-{uuid.uuid4().hex}", f"{where}/manifest.json"
    with system.open_output_stream(temporary, compression=None) as out:
        for row in files.orderBy("name").toLocalIterator():  # a row a file, never all at once
            out.write((json.dumps(row.asDict(), sort_keys=True) + "\n").encode())
    system.move(temporary, manifest)
    work.close()
    if system.get_file_info(f"{where}/_temporary").type == fs.FileType.Directory:
        system.delete_dir(f"{where}/_temporary")
    return f"{path}/manifest.json"


def members(stream, sha) -> bytes:
    """The uncompressed gzip members of a stream, one by one."""
    inflate, held = zlib.decompressobj(31), []
    data = b""
    while data or (data := stream.read(1 << 20)):
        held.append(inflate.decompress(data))
        if inflate.eof:
            sha.update(data[: len(data) - len(inflate.unused_data)])
            yield b"".join(held)
            data, inflate, held = inflate.unused_data, zlib.decompressobj(31), []
        else:
            sha.update(data)
            data = b""
    if held:
        raise ValueError("a WARC file ends within a record")


def parse(data: bytes) -> tuple:
    """The columns of a record, after its digests have been checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != f"sha1:{sha1_base32(block)}":
        raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(http.rpartition(b"Content-Length: ")[2])
    whole = fields["WARC-Type"] == "response"
    if whole and (len(payload) != size or sha1_base32(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']}")
    number = lambda name: int(fields[name]) if name in fields else None
    return number("X-Record-Key"), fields.get("WARC-Target-URI"), fields["WARC-Type"], size, digest, number("X-Refers-To-Key"), payload if whole else None


def _read(path: str, payloads: bool, most: int = 16 << 20):
    def run(batches):
        system, where = filesystem(path)
        for rows in batches:
            for name, sha256 in zip(rows.column("name").to_pylist(), rows.column("sha256").to_pylist(), strict=True):
                sha, out, held = hashlib.sha256(), [], 0
                with system.open_input_stream(f"{where}/{name}", compression=None) as stream:
                    for member in members(stream, sha):
                        row = parse(member)
                        held += len(member)
                        out.append(row if payloads else (*row[:-1], None))
                        if held >= most:
                            yield batch(_RECORD, *zip(*out, strict=True))
                            out, held = [], 0
                if sha.hexdigest() != sha256:
                    raise ValueError(f"{name} is not the file of the manifest")
                if out:
                    yield batch(_RECORD, *zip(*out, strict=True))

    return run


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the files that the manifest below path names."""
    files = spark.read.schema(_MANIFEST_DDL).json(f"{path}/manifest.json")
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    return files.repartition(max(1, min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), size >> 26)).mapInArrow(_read(path, payloads), _RECORD_DDL)
