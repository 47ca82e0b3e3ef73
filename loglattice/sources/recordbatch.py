"""Binary record batches (magic 2): an encoder, a decoder, and a Spark reader of segment files.

Layout, big-endian: base offset i64, length i32, leader epoch i32, magic i8, CRC-32C u32 over all behind it, attributes
i16, last offset delta i32, base timestamp i64, max timestamp i64, producer id i64, producer epoch i16, base sequence
i32, record count i32, then length-prefixed records of zig-zag integers.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loglattice.functions.binary import crc32c, unzigzag, zigzag
from loglattice.operators.stateful import replayed

_HEAD = struct.Struct(">qiibI")
_BODY = struct.Struct(">hiqqqhii")
HEADER = _HEAD.size + _BODY.size
# fixed values of the format: attribute bits, and the id of the zstd codec
CODEC, CONTROL, TRANSACTIONAL, ZSTD = 0x07, 0x08, 0x10, 2


def _bytes(value: bytes | None) -> bytes:
    return zigzag(-1) if value is None else zigzag(len(value)) + value


def _zstd(frame: bytes) -> bytes:
    """A bare zstd frame, which holds its content size; ValueError if it does not or is damaged."""
    import zstandard

    try:
        size = zstandard.frame_content_size(frame)
        if size < 0:
            raise ValueError("zstd frame without content size")
        return zstandard.ZstdDecompressor().decompress(frame, max_output_size=size) if size else b""
    except zstandard.ZstdError as error:
        raise ValueError(f"zstd: {error}") from error


def encode(base_offset: int, records: list[tuple], leader_epoch: int = 0, producer: tuple[int, int, int] = (-1, -1, -1), flags: int = 0, zstd: bool = False) -> bytes:
    """records: (ts, key, value, headers); compressed only where that is smaller."""
    first = records[0][0] if records else 0
    parts = []
    for delta, (ts, key, value, headers) in enumerate(records):
        body = b"\0" + zigzag(ts - first) + zigzag(delta) + _bytes(key) + _bytes(value) + zigzag(len(headers)) + b"".join(_bytes(k) + _bytes(v) for k, v in headers)
        parts.append(zigzag(len(body)) + body)
    section = b"".join(parts)
    if zstd:
        import zstandard

        packed = zstandard.ZstdCompressor(level=3, write_content_size=True).compress(section)
        if len(packed) < len(section):
            section, flags = packed, flags | ZSTD
    tail = _BODY.pack(flags, max(0, len(records) - 1), first, max((r[0] for r in records), default=first), *producer, len(records)) + section
    return _HEAD.pack(base_offset, HEADER - 12 + len(section), leader_epoch, 2, crc32c(tail)) + tail


def decode(data: bytes, at: int = 0) -> tuple[list[dict], int] | None:
    """(records, next place) of the batch at ``at``; None where the rest is a partial batch; ValueError if damaged."""
    if len(data) - at < HEADER:
        return None
    base, length, epoch, magic, crc = _HEAD.unpack_from(data, at)
    end = at + 12 + length
    if length < HEADER - 12:
        raise ValueError("batch length")
    if end > len(data):
        return None
    if magic != 2:
        raise ValueError(f"magic {magic}")
    tail = data[at + _HEAD.size : end]
    if crc32c(tail) != crc:
        raise ValueError("checksum")
    flags, _, first, _, producer, producer_epoch, sequence, count = _BODY.unpack_from(tail)
    section = tail[_BODY.size :]
    if flags & CODEC == ZSTD:
        section = _zstd(section)
    elif flags & CODEC:
        raise ValueError(f"codec {flags & CODEC}")
    rows, place = [], 0

    def blob(place: int) -> tuple[bytes | None, int]:
        size, place = unzigzag(section, place)
        return (None, place) if size < 0 else (section[place : place + size], place + size)

    for _ in range(count):
        _, place = unzigzag(section, place)
        ts, place = unzigzag(section, place + 1)
        delta, place = unzigzag(section, place)
        key, place = blob(place)
        value, place = blob(place)
        many, place = unzigzag(section, place)
        headers = []
        for _ in range(many):
            name, place = blob(place)
            content, place = blob(place)
            headers.append({"key": name, "value": content})
        rows.append({"off": base + delta, "ts_ms": first + ts, "key": key, "value": value, "headers": headers, "base_offset": base, "leader_epoch": epoch, "producer_id": producer, "producer_epoch": producer_epoch, "base_sequence": sequence, "is_transactional": bool(flags & TRANSACTIONAL), "is_control": bool(flags & CONTROL)})
    return rows, end


def encoded(log: DataFrame, size: int, zstd: bool = False) -> DataFrame:
    """log(part, off, ts_ms, key, value) with binary keys and values as batches of ``size`` offsets: (part, base_off, data).

    A batch starts at its first row's offset; rows that compaction took away leave gaps, which a batch cannot hold, so
    ``log`` has dense offsets.
    """
    return encoded_batches(log.withColumn("batch", (F.col("off") / size).cast("long")), zstd)


def encoded_batches(log: DataFrame, zstd: bool = False) -> DataFrame:
    """encoded() of rows that name their ``batch`` within the part, and may have a producer ``pid`` and ``is_control``.

    Rows of a producer make a transactional batch, a control row a batch of its own, which is never compressed.
    """
    extra = {"pid": F.lit(0).cast("long"), "is_control": F.lit(False)}
    rows = log.withColumns({c: value for c, value in extra.items() if c not in log.columns})
    rows = rows.select(F.col("part").cast("long").alias("part"), "batch", "off", "ts_ms", "key", "value", "pid", "is_control")

    def sealed(found):
        own = list(found)
        base, _, _, _, pid, control = own[0]
        pid, control = pid or 0, bool(control)
        flags = CONTROL if control else TRANSACTIONAL if pid > 0 else 0
        records = [(ts, key, value, []) for _, ts, key, value, _, _ in own]
        yield base, encode(base, records, producer=(pid, 0, 0) if pid > 0 else (-1, -1, -1), flags=flags, zstd=zstd and not control)

    return replayed(rows, ["part", "batch"], ["off"], rows.columns[2:], sealed, "base_off long, data binary").drop("batch")


def decoded(batches: DataFrame) -> DataFrame:
    """Rows of batches(part, data): part, off, ts_ms, key, value, base_off, producer_id (0: none), is_control.

    A damaged or partial batch raises.
    """
    kind = "part long, off long, ts_ms long, key binary, value binary, base_off long, producer_id long, is_control boolean"
    schema = to_arrow_schema(StructType.fromDDL(kind))

    def run(tables):
        rows: list[dict] = []
        for table in tables:
            for part, data in zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True):
                found = decode(data)
                if found is None:
                    raise ValueError("partial batch")
                rows += [{"part": part, "base_off": r["base_offset"], "producer_id": max(0, r["producer_id"])} | {c: r[c] for c in ("off", "ts_ms", "key", "value", "is_control")} for r in found[0]]
                if len(rows) >= 8_192:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return batches.select("part", "data").mapInArrow(run, kind)


def verify_batches(batches: DataFrame) -> DataFrame:
    """Of each part of batches(part, base_off, data): segments (1), batches, records, next offset, and the first problem.

    Batches behind the first problem do not count.
    """
    kind = "part long, base_off long, records long, stop long, problem string"
    schema = to_arrow_schema(StructType.fromDDL(kind))

    def run(tables):
        for table in tables:
            rows = []
            for part, base, data in zip(*(table.column(c).to_pylist() for c in ("part", "base_off", "data")), strict=True):
                records, problem = [], None
                try:
                    found = decode(data)
                    problem = "partial trailing frame" if found is None else None
                    records = found[0] if found else []
                except ValueError as error:
                    problem = str(error)
                rows.append({"part": part, "base_off": base, "records": len(records), "stop": records[-1]["off"] + 1 if records else None, "problem": problem})
            yield pa.RecordBatch.from_pylist(rows, schema)

    found = batches.select("part", "base_off", "data").mapInArrow(run, kind)
    counts = found.groupBy("part").agg(
        F.min_by(F.struct("base_off", "problem"), F.when(F.col("problem").isNotNull(), F.col("base_off"))).alias("first"),
    )
    whole = found.join(counts, "part").where("first is null or base_off < first.base_off")
    sums = whole.groupBy("part").agg(F.count("*").alias("batches"), F.sum("records").alias("records"), F.max("stop").alias("next_off"))
    out = counts.join(sums, "part", "left")
    zero = F.lit(0).cast("long")
    return out.select("part", F.lit(1).cast("long").alias("segments"), *(F.coalesce(c, zero).alias(c) for c in ("batches", "records", "next_off")), F.col("first.problem").alias("problem"))


def verify_segments(spark: SparkSession, path: str) -> DataFrame:
    """For each folder of .log files: segments, batches, records, next offset, and the first problem with its place.

    Files of a folder are read in the order of their names and none behind the first problem; a file is one row of a task,
    and only its counts leave the task.
    """
    kind = "folder string, file string, batches long, records long, end long, problem string"
    schema = to_arrow_schema(StructType.fromDDL(kind))

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, count, records, end, problem = 0, 0, 0, None, None
                while at < len(data) and problem is None:
                    try:
                        found = decode(data, at)
                    except ValueError as error:
                        problem = f"{name.rsplit('/', 1)[1]} position {at}: {error}"
                        break
                    if found is None:
                        problem = f"{name.rsplit('/', 1)[1]} position {at}: partial trailing frame ({len(data) - at} bytes)"
                        break
                    count, records, at = count + 1, records + len(found[0]), found[1]
                    end = found[0][-1]["off"] + 1 if found[0] else end
                folder, file = name.rsplit("/", 1)
                yield pa.RecordBatch.from_pylist([{"folder": folder.rsplit("/", 1)[1], "file": file, "batches": count, "records": records, "end": end, "problem": problem}], schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").option("recursiveFileLookup", "true").load(path)
    found = files.select("path", "content").mapInArrow(run, kind)
    first = found.groupBy("folder").agg(F.min(F.when(F.col("problem").isNotNull(), F.col("file"))).alias("first"))
    read = found.join(first, "folder").where("first is null or file <= first")
    counts = read.groupBy("folder").agg(F.count("*").alias("segments"), F.sum("batches").alias("batches"), F.sum("records").alias("records"), F.coalesce(F.max_by("end", F.when(F.col("end").isNotNull(), F.col("file"))), F.lit(0).cast("long")).alias("next_off"), F.max("problem").alias("problem"))
    return counts


SCHEMA = "path string, off long, ts_ms long, key binary, value binary, headers array<struct<key:binary,value:binary>>, base_offset long, leader_epoch int, producer_id long, producer_epoch int, base_sequence int, is_transactional boolean, is_control boolean"


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Records of all .log files under a path.

    A torn tail, that is a last batch which is cut off or fails its checksum, ends its file quietly; anything else that
    cannot be read (a damaged batch before the last, an unknown codec or magic) raises with the file and place.  Files come
    through Spark's own binary reader, so any store it reads will do; one file is one task's row.
    """

    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, rows = 0, []
                while True:
                    try:
                        found = decode(data, at)
                    except ValueError as error:
                        if str(error) == "checksum" and at + 12 + int.from_bytes(data[at + 8 : at + 12], "big") == len(data):
                            break
                        raise ValueError(f"{name} at {at}: {error}") from error
                    if found is None:
                        break
                    rows += [{"path": name} | r for r in found[0]]
                    at = found[1]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, SCHEMA)
