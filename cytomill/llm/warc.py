"""Deterministic sharded WARC writer and reader.

Records are sorted by page id and dealt to shards by ranges of ids that hold about equal bytes. The
ranges come from counts: cells of ids are counted and those that hold too much are cut again, down to single
ids, which are dealt by their digests; so the ranges depend on the data alone, wherever its ids lie. Each shard's
task writes gzip members one record each, rolls to a new file when the compressed size reaches the
limit, and generates all headers and digests anew. Files get names of their attempt first and are reported
in a written table; when all tasks have ended, tasks rename the reported files, and the manifest, a table
of JSON lines committed by Spark, is written last. A lost executor's files are never named in it, and two
runs over the same rows give the same bytes.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .words import mix

SHARD_BYTES, FILE_BYTES, LEVEL = 16 << 20, 64 << 20, 6
#: Cells that a round of counting cuts the ids into, and parts that a shard's bytes are counted in.
CELLS, PARTS = 4096, 4
MANIFEST = "file string, shard long, seq long, bytes long, records long, sha256 string"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SOFTWARE, DATE = "cytomill", "2000-01-01T00:00:00Z"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: int | None, sha1: str, again: str = "") -> str:
    """Of a page's record; ``again`` tells further records of the same page and payload apart."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page}/{sha1}{again}'.encode()).digest())}>"


def member(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"WARC-Block-Digest: sha1:{digest(block)}\r\nContent-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def uri(url: str | None, page: int | None) -> str:
    """The url with blanks, control and other characters outside ASCII escaped; a page without one gets a urn."""
    if not url:
        return f"urn:page:{page}"
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url)


def page_record(page: int | None, url: str | None, payload: bytes, sha1_hex: str, refers_to: int | None, again: str = "") -> bytes:
    sha = base64.b32encode(bytes.fromhex(sha1_hex)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    fields: list[tuple[str, object]] = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page, sha, again)), ("WARC-Target-URI", uri(url, page)), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{sha}")]
    if page is not None:
        fields.append(("X-Page-ID", page))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, sha)), ("X-Refers-To-Page-ID", refers_to)]
    return member([*fields, ("Content-Type", "application/http; msgtype=response")], http + (payload if refers_to is None else b""))


def _writer(out: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base = filesystem(out)
        attempt = uuid.uuid4().hex
        done: list[tuple] = []
        shard = seq = size = count = 0
        file = name = sha = None
        known: tuple = (None, None, None)
        last, nth = None, 0

        def close() -> None:
            nonlocal file
            if file is not None:
                file.close()
                done.append((shard, seq, name, size, count, sha.hexdigest()))
                file = None

        def put(data: bytes) -> None:
            nonlocal size
            file.write(data)
            sha.update(data)
            size += len(data)

        for batch in batches:
            for s, kind, page, sha1, refers, url, first, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:  # what the next record with this id and digest refers to
                    known = (page, sha1, refers)
                    continue
                if file is None or s != shard or size >= limit:
                    close()
                    seq = seq + 1 if s == shard and done else 0
                    shard, size, count, sha = s, 0, 0, hashlib.sha256()
                    name = f"{s:06d}-{seq:05d}-{attempt}.warc.gz"
                    file = at.open_output_stream(f"{base}/_temporary/{name}", compression=None)
                    put(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, f"{s}/{seq}")), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], f"software: {SOFTWARE}\r\nformat: WARC File Format 1.1\r\n".encode()))
                nth = nth + 1 if (s, page, sha1) == last else 0
                last = (s, page, sha1)
                put(page_record(page, url, html, sha1, known[2] if known[:2] == (page, sha1) else None, f"/{s}/{nth}" if nth or s != first else ""))
                count += 1
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["shard", "seq", "name", "bytes", "records", "sha256"])

    return run


@dataclass
class Ranges:
    """Ascending lower ends ``low`` of ranges of ids, the null ids in a range of their own before them; from the
    part ``first[i]`` on, range i has ``parts[i]`` parts by digest, and ``shard`` has each part's shard. Rows of an id and
    digest (its first 48 bits) in ``span`` are so many that they are dealt to that number of shards by row number."""

    low: np.ndarray
    first: np.ndarray
    parts: np.ndarray
    shard: np.ndarray
    span: dict[tuple[int | None, int], int]

    def of(self, ids: pa.Array, shas: pa.Array, rows: pa.Array | None = None) -> np.ndarray:
        """The shards of rows; without row numbers the first that rows of such an id and digest are in."""
        null = np.array(ids.is_null())
        key = ids.fill_null(0).to_numpy()
        i = np.searchsorted(self.low, key, side="right")
        i[null] = 0
        part = np.zeros(len(i), np.int64)
        many = np.flatnonzero(self.parts[i] > 1)
        h = np.zeros(len(i), np.int64)
        if len(many) or self.span:
            h[:] = [int(x[:12], 16) for x in shas.to_pylist()]
            part[many] = h[many] * self.parts[i[many]] >> 48
        out = self.shard[self.first[i] + part]
        if rows is not None:
            number = mix(rows.to_numpy().astype(np.uint64))
            for (k, sha), n in self.span.items():
                own = (h == sha) & (null if k is None else ~null & (key == k))
                out[own] += (number[own] % np.uint64(n)).astype(np.int64)
        return out


def _tally(low: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            null = np.array(batch.column(0).is_null())
            i = np.searchsorted(low, batch.column(0).fill_null(0).to_numpy(), side="right")
            i[null] = 0
            n = np.bincount(i, batch.column(1).to_numpy())
            for k in np.flatnonzero(n).tolist():
                total[k] = total.get(k, 0) + int(n[k])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["k", "n"])

    return run


def ranges(ids: DataFrame, shard_bytes: int) -> Ranges:
    """Ranges of (``id``, ``sha``, ``n`` bytes) whose parts hold about ``shard_bytes`` / PARTS, and shards of consecutive parts of
    about ``shard_bytes``. A round counts the cells and cuts those that hold more, evenly over their ids; ids of 64 bits
    are single after six rounds or so. The driver holds a few numbers for each shard, which it schedules as a task anyway."""
    lo, hi = ids.agg(F.min("id"), F.max("id")).first()
    most = max(1, shard_bytes // PARTS)
    cells = [] if lo is None else [(lo, hi)]  # ascending, without gaps
    while True:
        low = np.array([a for a, _ in cells], np.int64)
        held = dict(ids.select("id", "n").mapInArrow(_tally(low), "k long, n long").groupBy("k").agg(F.sum("n")).collect())  # a row a cell
        sizes = [held.get(k, 0) for k in range(len(cells) + 1)]
        wide = sum(n > most and b > a for (a, b), n in zip(cells, sizes[1:], strict=True))
        if not wide:
            break
        fan = max(8, CELLS // wide)
        finer: list[tuple[int, int]] = []
        empty = False  # whether the last cell is
        for (a, b), n in zip(cells, sizes[1:], strict=True):
            if n > most and b > a:
                step = -(-(b - a + 1) // fan)
                finer += [(x, min(x + step - 1, b)) for x in range(a, b + 1, step)]
            elif empty and not n:
                finer[-1] = (finer[-1][0], b)
            else:
                finer.append((a, b))
            empty = not n
        cells = finer
    heavy = ids.groupBy("id", "sha").agg(F.sum("n").alias("n"), F.count("*").alias("c")).where(F.col("n") > 2 * shard_bytes).collect()  # fewer than shards
    same = {(k, int(sha[:12], 16)): (n, min(-(-n // shard_bytes), max(1, c // 64))) for k, sha, n, c in heavy}
    single = [k == 0 or cells[k - 1][0] == cells[k - 1][1] for k in range(len(sizes))]
    place = {key: 0 if key[0] is None else int(np.searchsorted(low, key[0], side="right")) for key in same}
    rest = list(sizes)
    for key, (n, _) in same.items():
        rest[place[key]] -= n
    parts = [max(1, -(-n // most)) if one else 1 for n, one in zip(rest, single, strict=True)]
    first = np.cumsum(parts) - np.array(parts)
    extra = {int(first[i]) + (key[1] * parts[i] >> 48): same[key] for key, i in place.items()}
    shard, at, size, k = [], 0, 0, 0
    for n, p in zip(rest, parts, strict=True):
        for _ in range(p):
            if size and (k in extra or size + n // p > shard_bytes):
                at, size = at + 1, 0
            shard.append(at)
            size += n // p
            if k in extra:  # its shards are followed by a new one
                at, size = at + extra[k][1], 0
            k += 1
    return Ranges(low, first, np.array(parts), np.array(shard), {key: n for key, (_, n) in same.items() if n > 1})


def write(pages: DataFrame, out: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` as WARC files under ``out`` and return the manifest: ``file``, ``shard``, ``seq``, ``bytes``,
    ``records``, ``sha256``.

    Of records with equal payloads of at least ``min_bytes``, that with the largest key is the
    response and the others revisit it. Repeated rows of the largest key are responses alike, with record ids of
    their own; a row with a null key revisits the largest key of its payload, or is a response when there is none. A
    null payload is empty, a null url becomes a urn. Keys are whole numbers; another type raises. Further columns
    are ignored. An empty table gives a manifest without files.
    """
    spark = pages.sparkSession
    store.bound_batches(spark)
    if pages.schema[key].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{key} has to be a whole number, not {pages.schema[key].dataType.simpleString()}")
    tables = store.Tables(spark)
    html = F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8")
    p = pages.select(F.col(key).cast("long").alias("id"), F.col(url).alias("url"), html.alias("html")).withColumns({"sha": F.sha1("html"), "n": F.length("html").cast("long")})
    narrow = tables.cut(p.select("id", "sha", "n"), "narrow")
    weight = F.col("n") + 512  # headers count too
    dealt_to = ranges(narrow.select("id", "sha", weight.alias("n")), shard_bytes)
    shards = int(dealt_to.shard[-1]) + max([1, *dealt_to.span.values()])
    found = spark.sparkContext.broadcast(dealt_to)

    @F.arrow_udf("int")
    def shard(ids: pa.Array, shas: pa.Array, rows: pa.Array) -> pa.Array:
        return pa.array(found.value.of(ids, shas, rows), pa.int32())

    @F.arrow_udf("int")
    def first(ids: pa.Array, shas: pa.Array) -> pa.Array:
        return pa.array(found.value.of(ids, shas), pa.int32())

    last = narrow.where(F.col("n") >= min_bytes).groupBy("sha").agg(F.max("id").alias("last"), F.count("*").alias("c")).where("c > 1 AND last IS NOT NULL")
    last = tables.cut(last, "last")
    hints = store.with_value(narrow, last, ["sha"], "c", narrow.count()).where(~F.col("id").eqNullSafe(F.col("last"))).select("id", "sha", "last").distinct()
    # what a record refers to comes before it; of rows that are dealt to several shards, to each of them
    span = F.create_map(*[x for (k, sha), n in dealt_to.span.items() for x in (F.lit(f"{k}/{sha:012x}"), F.lit(n))]) if dealt_to.span else None
    copies = F.lit(1) if span is None else F.coalesce(F.try_element_at(span, F.concat_ws("/", F.coalesce(F.col("id").cast("string"), F.lit("None")), F.substring("sha", 1, 12))), F.lit(1))
    hints = hints.withColumn("shard", first("id", "sha")).withColumn("shard", F.explode(F.sequence("shard", F.col("shard") + copies - 1)))
    p = p.withColumn("row", F.monotonically_increasing_id()).withColumn("shard", shard("id", "sha", "row"))
    rows = p.select("shard", F.lit(1).alias("kind"), "id", "sha", F.lit(None).cast("long").alias("last"), "url", (first("id", "sha") if dealt_to.span else F.col("shard")).alias("first"), "html").unionByName(
        hints.select("shard", F.lit(0).alias("kind"), "id", "sha", "last", F.lit(None).cast("string").alias("url"), F.col("shard").alias("first"), F.lit(b"").alias("html"))
    )
    at, base = filesystem(out)
    at.create_dir(f"{base}/_temporary", recursive=True)
    dealt = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "id", "sha", "kind", "url")
    dealt = dealt.select("shard", "kind", "id", "sha", "last", "url", "first", "html")
    files = tables.cut(dealt.mapInArrow(_writer(out, file_bytes), "shard long, seq long, name string, bytes long, records long, sha256 string"), "files")
    named = files.withColumn("file", F.concat(F.lpad(F.col("shard").cast("string"), 6, "0"), F.lit("-"), F.lpad(F.col("seq").cast("string"), 5, "0"), F.lit(".warc.gz")))
    named.select("name", "file").repartition(_tasks(spark, files.count())).mapInArrow(_renamer(out), "file string").count()
    at.delete_dir(f"{base}/_temporary")
    named.select("file", "shard", "seq", "bytes", "records", "sha256").write.mode("overwrite").json(f"{out}/manifest")
    tables.drop_all_but()
    return manifest(spark, out)


def _tasks(spark: SparkSession, files: int) -> int:
    """Tasks for so many files: one a file at most, and several files a task when there are very many."""
    return max(1, min(files, 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _renamer(out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Give reported files their final names; a repeated task finds some of them renamed."""
        at, base = filesystem(out)
        for batch in batches:
            for name, final in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at.get_file_info(f"{base}/_temporary/{name}").type != fs.FileType.NotFound:
                    at.move(f"{base}/_temporary/{name}", f"{base}/{final}")
                elif at.get_file_info(f"{base}/{final}").type == fs.FileType.NotFound:
                    raise FileNotFoundError(f"{name} was reported but is not there")
            yield pa.RecordBatch.from_arrays([batch.column(1)], names=["file"])

    return run


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """The files of a finished run; a folder without the commit mark raises."""
    at, base = filesystem(out)
    if at.get_file_info(f"{base}/manifest/_SUCCESS").type == fs.FileType.NotFound:
        raise FileNotFoundError(f"{out} has no finished manifest")
    return spark.read.schema(MANIFEST).json(f"{out}/manifest")


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one at a time."""
    z, parts, data = zlib.decompressobj(31), [], b""
    while True:
        data = data or stream.read(chunk)
        if not data:
            break
        parts.append(z.decompress(data))
        data = z.unused_data
        if z.eof:
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []
    if parts and any(parts):
        raise ValueError("a gzip member is cut off")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *fields = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    named = {k.lower(): v.strip() for k, _, v in (f.partition(":") for f in fields)}
    return named, rest[: int(named["content-length"])]


READ_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, file string"


def read(spark: SparkSession, out: str, payload: bool = True) -> DataFrame:
    """All page records of the files in the manifest, in tasks of whole files; with ``payload`` the
    bytes of responses too. Block and payload digests are verified; a mismatch raises. For a revisit,
    ``payload_bytes`` and ``payload_digest`` are those of the full payload it refers to."""
    files = manifest(spark, out).select("file")
    schema = READ_SCHEMA + (", payload binary" if payload else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base = filesystem(out)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                size = 0
                with at.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for record in members(stream):
                        f, block = parse(record)
                        if f["warc-block-digest"] != f"sha1:{digest(block)}":
                            raise ValueError(f"{name}: a block does not match its digest")
                        if f["warc-type"] not in ("response", "revisit"):
                            continue
                        http, _, body = block.partition(b"\r\n\r\n")
                        length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        sha = f["warc-payload-digest"].removeprefix("sha1:")
                        if f["warc-type"] == "response" and (sha != digest(body) or length != len(body)):
                            raise ValueError(f"{name}: a payload does not match its digest")
                        number = [int(f[k]) if k in f else None for k in ("x-page-id", "x-refers-to-page-id")]
                        rows.append((number[0], f["warc-target-uri"], f["warc-type"], number[1], sha, length, name, *([body if f["warc-type"] == "response" else None] if payload else [])))
                        size += len(body)
                        if len(rows) >= 2000 or size > store.BATCH_BYTES:
                            yield _batch(rows, payload)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows, payload)

    return files.repartition(_tasks(spark, files.count())).mapInArrow(run, schema)


def _batch(rows: list[tuple], payload: bool) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), *([pa.binary()] if payload else [])]
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "file", *(["payload"] if payload else [])]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
