"""Token ids in interleaved static rANS files: one shared frequency table, independent blocks, checkpoints, checksums.

File layout (little-endian)::

    b"LLRA" u32 version u32 blocks u64 tokens u64 documents
    per block   u64 tokens, u32 lanes, u32 words, u32 checkpoint step, u32 checkpoints,
                u32 crc32 of the payload, u32 crc32 of the block's ids as u32
    documents   deflated (doc_id, n_tokens) table, preceded by its u64 length
    payloads    per block: final states u64 x lanes, checkpoints (u64 word position, u64 x lanes states) ..., u32 words

A block decodes without any other.  Lane i of a block carries its ids i, i+lanes, i+2*lanes ...; within a step, lanes
read renormalisation words in lane order, so every step is one vector operation.  A checkpoint holds all lanes' states
and the word position before a step, so a block can also be entered in its middle.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglattice.llm._blobs import pack_table, unpack_table
from loglattice.llm._store import drop, get, new_path, put, shuffle_partitions, stored
from loglattice.llm._tokens import token_batches

SCALE = 20  # frequencies sum to 2**SCALE
LOW = 1 << 31  # states stay in [LOW, LOW << 32)
LANES = 1024
BLOCK = 1 << 18
CHECKPOINT_STEPS = 128
SEGMENT_TOKENS = 1 << 21
MAGIC, VERSION = b"LLRA", 1
END_ID = 2
NO_ID = -(1 << 63)  # stands for a null doc_id in files


def quantised(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE, at least 1 for every id that occurs."""
    counts = counts.astype(np.float64)
    total, goal = counts.sum(), 1 << SCALE
    if not total:
        return np.zeros(len(counts), np.uint64)
    out = np.where(counts > 0, np.maximum(1, np.floor(counts / total * goal)), 0).astype(np.int64)
    order = np.argsort(-out, kind="stable")
    over = int(out.sum()) - goal
    if over < 0:
        out[order[0]] -= over
    while over > 0:
        for i in order:
            take = min(over, int(out[i]) - 1, max(1, int(out[i]) >> 4))
            if take <= 0:
                break
            out[i] -= take
            over -= take
            if not over:
                break
    return out.astype(np.uint64)


class Table:
    def __init__(self, frequencies: np.ndarray):
        self.freq = frequencies.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))


def encode_block(ids: np.ndarray, table: Table) -> tuple[tuple, bytes]:
    n = len(ids)
    lanes = int(min(LANES, max(1, n // 256)))
    steps = -(-n // lanes)
    state = np.full(lanes, LOW, np.uint64)
    shift, scale = np.uint64(32), np.uint64(SCALE)
    freqs, starts = table.freq[ids], table.start[ids]
    limits = freqs << np.uint64(63 - SCALE)  # (LOW >> SCALE) << 32 times the frequency
    chunks, marks = [], []
    for step in range(steps - 1, -1, -1):
        at, end = step * lanes, min(n, (step + 1) * lanes)
        x, f = state[: end - at], freqs[at:end]
        full = x >= limits[at:end]
        chunks.append(x[full].astype(np.uint32))
        x = np.where(full, x >> shift, x)
        q = x // f
        state[: end - at] = (q << scale) + (x - q * f) + starts[at:end]
        if step and step % CHECKPOINT_STEPS == 0:
            marks.append((len(chunks), state.copy()))
    words = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, np.uint32)
    after = np.cumsum([0, *map(len, chunks)])
    points = b"".join(struct.pack("<Q", len(words) - int(after[k])) + s.astype("<u8").tobytes() for k, s in reversed(marks))
    payload = state.astype("<u8").tobytes() + points + words.astype("<u4").tobytes()
    head = (n, lanes, len(words), CHECKPOINT_STEPS, len(marks), zlib.crc32(payload), zlib.crc32(ids.astype("<u4").tobytes()))
    return head, payload


def decode_block(head: tuple, payload: bytes, table: Table, first_checkpoint: int = 0) -> np.ndarray:
    """The block's ids, or from its k-th checkpoint on those behind it; raises ValueError where a checksum differs."""
    n, lanes, count, every, points, crc, ids_crc = head
    if zlib.crc32(payload) != crc:
        raise ValueError("a block's payload is damaged")
    states = np.frombuffer(payload, "<u8", lanes).astype(np.uint64)
    size = 8 * (lanes + 1)
    words = np.frombuffer(payload, "<u4", count, 8 * lanes + points * size).astype(np.uint64)
    at, first = 0, first_checkpoint * every
    if first_checkpoint:
        place = 8 * lanes + (first_checkpoint - 1) * size
        at = struct.unpack_from("<Q", payload, place)[0]
        states = np.frombuffer(payload, "<u8", lanes, place + 8).astype(np.uint64)
    mask, scale, shift, low = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32), np.uint64(LOW)
    out = np.empty(n - first * lanes, np.uint32)
    state = states.copy()
    for step in range(first, -(-n // lanes)):
        end = min(lanes, n - step * lanes)
        x = state[:end]
        slot = x & mask
        symbol = table.symbol[slot]
        out[(step - first) * lanes : (step - first) * lanes + end] = symbol
        x = table.freq[symbol] * (x >> scale) + slot - table.start[symbol]
        need = np.flatnonzero(x < low)
        x[need] = (x[need] << shift) | words[at : at + len(need)]
        at += len(need)
        state[:end] = x
    if not first and zlib.crc32(out.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("a block's ids are damaged")
    return out


def encode_file(docs: np.ndarray, lengths: np.ndarray, ids: np.ndarray, table: Table) -> bytes:
    blocks = [encode_block(ids[at : at + BLOCK], table) for at in range(0, len(ids), BLOCK)]
    index = pack_table(docs, lengths)
    head = MAGIC + struct.pack("<IIQQ", VERSION, len(blocks), len(ids), len(docs))
    return head + b"".join(struct.pack("<Q6I", *h) for h, _ in blocks) + struct.pack("<Q", len(index)) + index + b"".join(p for _, p in blocks)


def decode_file(data: bytes, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, lengths, ids) of a whole file."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    version, count, tokens, documents = struct.unpack_from("<IIQQ", data, 4)
    if version != VERSION:
        raise ValueError(f"token file version {version}")
    at, heads = 28, []
    for _ in range(count):
        heads.append(struct.unpack_from("<Q6I", data, at))
        at += 32
    size = struct.unpack_from("<Q", data, at)[0]
    docs, lengths = unpack_table(data[at + 8 : at + 8 + size], 2)
    at += 8 + size
    parts = []
    for head in heads:
        size = 8 * head[1] + head[4] * 8 * (head[1] + 1) + 4 * head[2]
        parts.append(decode_block(head, data[at : at + size], table))
        at += size
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    if len(ids) != tokens or len(docs) != documents:
        raise ValueError("a token file's counts differ")
    return docs, lengths, ids


def _segments(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Rows of consecutive documents in ascending doc_id order: about SEGMENT_TOKENS ids each, as deflated ids."""
    n = shuffle_partitions(docs.sparkSession)

    def run(batches):
        task, at, number = TaskContext.get().partitionId(), 0, 0
        ids, parts, wide = [], [], None

        def flush():
            nonlocal ids, parts, at, number
            lengths = np.array([len(p) for p in parts], np.int64)
            flat = np.concatenate(parts)
            row = [[task], [number], [len(flat)], [pack_table(np.array(ids, np.int64), lengths)], [np.bincount(flat).astype("<u4").tobytes()], [pa.compress(flat.astype(wide).tobytes(), "zstd", asbytes=True)], [wide.itemsize]]
            ids, parts, at, number = [], [], 0, number + 1
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds, strict=True)], ["part", "number", "tokens", "docs", "counts", "ids", "width"])

        for batch in batches:
            for values, tokens in token_batches(tokenizer_path, batch.column(0), batch.column(1)):
                for doc, own in zip(values, tokens, strict=True):
                    wide = own.dtype
                    ids.append(NO_ID if doc is None else doc)
                    parts.append(np.append(own, wide.type(end_id)))
                    at += len(own) + 1
                    if at >= SEGMENT_TOKENS:
                        yield flush()
        if ids:
            yield flush()

    # rows that repeat a doc_id divide by where they were read
    placed = docs.select("doc_id", "text", F.spark_partition_id().alias("read"))
    ordered = placed.repartitionByRange(n, "doc_id", "read").sortWithinPartitions("doc_id").select("doc_id", "text")
    return ordered.mapInArrow(run, "part int, number int, tokens long, docs binary, counts binary, ids binary, width int")


def _shared_table(segments: DataFrame) -> Table:
    """Counts of every id over all segments; the vocabulary bounds what reaches the driver."""

    def count(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for own in batch.column(0).to_pylist():
                own = np.frombuffer(own, "<u4")
                if len(own) > len(total):
                    total = np.pad(total, (0, len(own) - len(total)))
                total[: len(own)] += own
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    rows = segments.select("counts").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, np.int64)
    counts[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return Table(quantised(counts))


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID) -> tuple[DataFrame, Table]:
    """Encode all documents to files in ``folder``; returns the manifest (part, number, tokens, path) and the table.

    Files in (part, number) order hold documents in ascending doc_id order; rows that repeat a doc_id are documents of
    their own side by side, null doc_ids come first; null and empty texts are the end id alone; an empty table gives no files.  The table is also
    written to ``folder``/frequencies.
    """
    segments = stored(_segments(docs, tokenizer_path, end_id), "segments", "uncompressed")
    table = _shared_table(segments)
    put(f"{folder}/frequencies", table.freq.astype("<u8").tobytes())

    def write(batches):
        for batch in batches:
            for row in batch.to_pylist():
                wide = np.dtype("<u2" if row["width"] == 2 else "<u4")
                ids = np.frombuffer(pa.decompress(row["ids"], row["tokens"] * wide.itemsize, "zstd", asbytes=True), wide)
                path = f"{folder}/tokens-{row['part']:06d}-{row['number']:06d}.rans"
                put(path, encode_file(*unpack_table(row["docs"], 2), ids, table))
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]], pa.int32()), pa.array([row["number"]], pa.int32()), pa.array([row["tokens"]], pa.int64()), pa.array([path])], ["part", "number", "tokens", "path"])

    manifest = stored(segments.drop("counts").mapInArrow(write, "part int, number int, tokens long, path string"), "manifest")
    drop(segments)
    return manifest, table


def read_tokens(manifest: DataFrame, table: Table) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, file) of every document, from the files; files are decoded side by side."""
    totals = {r["part"]: (r["n"], r["files"]) for r in manifest.groupBy("part").agg(F.sum("tokens").alias("n"), F.count("*").alias("files")).collect()}  # one row a partition
    bases, at = {}, 0
    for part in sorted(totals):
        bases[part], at = at, at + totals[part][0]
    before = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long")))
    # dealt out by number, which adaptive execution does not join into one task
    files = files.repartition(max(1, min(sum(n for _, n in totals.values()), 16_384)))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                docs, lengths, ids = decode_file(get(row["path"]), table)
                ends = np.cumsum(lengths)
                raw, starts = memoryview(ids.astype("<u4").tobytes()), ends - lengths
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64(), mask=docs == NO_ID), pa.array(starts + bases[row["part"]] + row["before"], pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64()), pa.array([row["path"].rsplit("/", 1)[1]] * len(docs))],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "file"],
                )

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """write_tokens() to ``folder`` (a new one in the shared folder if None), then read_tokens()."""
    folder = folder or new_path(docs.sparkSession, "rans")
    return read_tokens(*write_tokens(docs, tokenizer_path, folder, end_id))
