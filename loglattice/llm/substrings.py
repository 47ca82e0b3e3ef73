"""Exact removal of repeated token windows by Rabin-Karp hashes.

Every window of ``width`` consecutive words is hashed.  A task keeps the first occurrence of each hash in its block of
documents and sends it to the hash's bucket with the place it stands at; a bucket counts occurrences over all blocks
and answers each block with the occurrences that are not the first of all.  Blocks merge the answers, with their own
repeats, into maximal removal intervals of their documents.

Hashes have 93 bits, of two Rabin-Karp polynomials modulo 2**61 - 1, so that among the 1.5e13 windows of 100 TB an
unequal pair meets with a chance of about one in a hundred.  They travel as sorted byte-plane runs (about 13 bytes an
occurrence), and a block sends a window once, however often it holds it, so a passage in a third of all documents costs
one entry a block.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm._blobs import bucket_edges, pack_ints, pack_run, pack_table, unpack_ints, unpack_run, unpack_table
from loglattice.llm._store import bucket_keys, sifted, stored, text_bytes
from loglattice.llm._words import blocks, runs, word_hashes

BLOCK_BYTES = 6 << 20
_RUNS = "key long, share long, block string, run binary, wide boolean, docs binary, own binary"


def _bits(flags: np.ndarray) -> bytes:
    return pack_ints(np.packbits(np.pad(flags, (0, -len(flags) % 64))).view("<u8"))


def _unbits(data: bytes, n: int) -> np.ndarray:
    words, _ = unpack_ints(memoryview(data), -(-n // 64))
    return np.unpackbits(words.astype("<u8").view(np.uint8))[:n].astype(bool)


def _sorted(hashes: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, same): places by hash, ties as they were, and whether each is equal to the one before."""
    order = np.argsort(hashes, kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = hashes[order[1:]] == hashes[order[:-1]]
    differ = same.copy()
    differ[1:] &= check[order[1:]] != check[order[:-1]]
    if differ.any():  # two windows share the first hash only
        order = np.lexsort((check, hashes))
        same[1:] = (hashes[order[1:]] == hashes[order[:-1]]) & (check[order[1:]] == check[order[:-1]])
    return order, same


def _window_runs(docs: DataFrame, width: int, keys: list[int], shares: int) -> DataFrame:
    """Per block and bucket: the first occurrences of its hashes.  One bucket of each block also carries the block's
    documents and its own repeats along; the others get the documents too where that is shorter than naming the
    document and offset of every window."""
    buckets = len(keys) * shares

    def run(batches):
        for batch in batches:
            order = np.lexsort((batch.column("text_hash").to_numpy(), batch.column("doc_id").to_numpy()))
            batch = batch.take(pa.array(order))
            ids, marks = batch.column("doc_id").to_numpy(), batch.column("text_hash").to_numpy()
            fresh = np.ones(len(ids), bool)  # a repeated row is the same document
            fresh[1:] = (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])
            batch = batch.filter(pa.array(fresh))
            ids, marks = ids[fresh], marks[fresh]
            for at, offsets, data in blocks(batch.column("text"), BLOCK_BYTES):
                words, first = word_hashes(offsets, data)
                places, hashes, check = runs(words, first, width, 2)
                if not len(hashes):
                    continue
                check >>= np.uint64(32)
                order, same = _sorted(hashes, check)
                repeats = np.zeros(len(words), bool)
                repeats[places[order[same]]] = True
                order = order[~same]
                hashes, check, places = hashes[order], check[order], places[order]
                end = at + len(offsets) - 1
                name = uuid.uuid5(uuid.NAMESPACE_OID, f"{ids[at]} {marks[at]} {len(data)} {hashes[0]} {hashes[-1]}").hex
                table, rest = pack_table(ids[at:end], first[:-1]), pack_table(marks[at:end], np.diff(first))
                own = len(rest).to_bytes(8, "little") + rest + _bits(repeats)
                columns = [check, places.astype(np.uint64)]
                if wide := buckets * len(table) > 4 * len(hashes):
                    row = np.searchsorted(first, places, "right") - 1
                    columns += [ids[at:end][row].astype(np.uint64), (places - first[row]).astype(np.uint64)]
                cuts = bucket_edges(hashes, buckets)
                home, out = int(name[:8], 16) % buckets, []
                for k in np.union1d(np.flatnonzero(np.diff(cuts)), [home]).tolist():
                    a, b = cuts[k], cuts[k + 1]
                    sent = pack_run(hashes[a:b], *(c[a:b] for c in columns))
                    out.append((keys[k // shares], k % shares, name, sent, wide, None if wide and k != home else table, own if k == home else None))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.bool_(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["key", "share", "block", "run", "wide", "docs", "own"])

    source = docs.select("doc_id", F.col("text"), F.xxhash64("text").alias("text_hash"))
    return source.mapInArrow(run, _RUNS)


def _answer(table: pa.Table) -> pa.Table:
    """One bucket: for each block, the places of its occurrences that stand behind an equal window."""
    parts = []
    for i, (run, wide, directory) in enumerate(zip(*(table.column(c).to_pylist() for c in ("run", "wide", "docs")), strict=True)):
        hashes, check, place, *named = unpack_run(run, 4 if wide else 2)
        place = place.astype(np.int64)
        if wide:
            doc, offset = (c.astype(np.int64) for c in named)
        else:
            ids, first = unpack_table(directory, 2)
            row = np.searchsorted(first, place, "right") - 1
            doc, offset = ids[row], place - first[row]
        parts.append((hashes, check, doc, offset, place, np.full(len(hashes), i, np.int32)))
    hashes, check, doc, offset, place, block = (np.concatenate(c) for c in zip(*parts, strict=True))
    del parts
    order, same = _sorted(hashes, check)
    several = same.copy()
    several[:-1] |= same[1:]
    order, group = order[several], np.cumsum(~same[several])
    doc, offset = doc[order], offset[order]
    inner = np.lexsort((offset, doc, group))
    order, group, doc, offset = order[inner], group[inner], doc[inner], offset[inner]
    begins = np.ones(len(order), bool)
    begins[1:] = group[1:] != group[:-1]
    head = np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0)) if len(order) else order
    gone = order[(doc != doc[head]) | (offset != offset[head])]
    gone = gone[np.lexsort((place[gone], block[gone]))]
    cuts, answers = np.searchsorted(block[gone], np.arange(len(table) + 1)), []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        answers.append(int(b - a).to_bytes(8, "little") + pack_ints(np.diff(place[gone[a:b]], prepend=0).astype(np.uint64)))
    own = table.column("own")
    keep = pa.array([d if o is not None else None for d, o in zip(table.column("docs").to_pylist(), own.to_pylist(), strict=True)], pa.binary())
    told = pa.table({"block": table.column("block"), "gone": pa.array(answers, pa.binary()), "docs": keep, "own": own})
    return told.filter(pa.array((np.diff(cuts) > 0) | own.is_valid().to_numpy(zero_copy_only=False)))


def _intervals(width: int):
    """One block: its documents' removal intervals, as pairs of word numbers."""

    def run(table: pa.Table) -> pa.Table:
        at = next(i for i, o in enumerate(table.column("own").is_valid().to_pylist()) if o)
        ids, first = unpack_table(table.column("docs")[at].as_py(), 2)
        own = table.column("own")[at].as_py()
        size = int.from_bytes(own[:8], "little")
        marks, lengths = unpack_table(own[8 : 8 + size], 2)
        total = int(first[-1] + lengths[-1])
        starts = _unbits(own[8 + size :], total)
        for data in table.column("gone").to_pylist():
            view = memoryview(data)
            places, _ = unpack_ints(view[8:], int.from_bytes(view[:8], "little"))
            starts[np.cumsum(places.astype(np.int64))] = True
        step = np.zeros(total + width + 1, np.int32)
        hits = np.flatnonzero(starts)
        np.add.at(step, hits, 1)
        np.add.at(step, hits + width, -1)
        covered = np.cumsum(step[:total]) > 0
        edge = np.diff(covered.astype(np.int8), prepend=0, append=0)
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        row = np.searchsorted(first, a, "right") - 1
        cut = np.flatnonzero(np.searchsorted(first, b - 1, "right") - 1 != row)
        for k in cut[::-1]:  # an interval that runs on into the next documents
            inner = first[(first > a[k]) & (first < b[k])]
            a, b = np.concatenate([a[:k], [a[k]], inner, a[k + 1 :]]), np.concatenate([b[:k], inner, [b[k]], b[k + 1 :]])
        row = np.searchsorted(first, a, "right") - 1
        keep = b > a
        a, b, row = a[keep], b[keep], row[keep]
        rows, begin = np.unique(row, return_index=True)
        pairs = np.stack([a - first[row], b - first[row]], 1).astype("<i8") if len(a) else np.zeros((0, 2), "<i8")
        parts = [p.tobytes() for p in np.split(pairs, begin[1:])] if len(rows) else []
        return pa.table({"doc_id": pa.array(ids[rows], pa.int64()), "text_hash": pa.array(marks[rows], pa.int64()), "removed": pa.array(parts, pa.binary())})

    return run


def removal_intervals(docs: DataFrame, width: int = 20) -> DataFrame:
    """(doc_id, text_hash, removed): documents with repeated windows, and the word intervals to remove."""
    keys, shares = bucket_keys(docs.sparkSession, text_bytes(docs))
    sent = _window_runs(docs, width, keys, shares).repartition(len(keys), "key")
    answers = sent.groupBy("key", "share").applyInArrow(_answer, "block string, gone binary, docs binary, own binary")
    return answers.groupBy("block").applyInArrow(_intervals(width), "doc_id long, text_hash long, removed binary")


def remove_repeats(docs: DataFrame, width: int = 20, with_text: bool = False) -> DataFrame:
    """Each document without the words of windows that start earlier too.

    docs(doc_id, text, ...): earlier is a smaller doc_id, or in one document an earlier start; all windows are judged on
    the input.  A null or empty text, and one with fewer than ``width`` words, loses nothing but to nobody.  Rows that
    repeat a doc_id and its text are one document and get the same result each; rows with one doc_id and different
    texts are judged apart, and equal windows at the same place of them count as one occurrence.  A null doc_id's text is
    kept whole.  Words and texts of any length are taken whole; other columns are ignored; an empty table gives no rows.
    Returns doc_id, n_words, n_removed, kept_sha256, removed (the intervals as text), and kept_text with ``with_text``.
    """
    source = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    judged = stored(removal_intervals(docs.where("doc_id is not null and text is not null"), width), "intervals")
    may, cannot = sifted(source, judged, "doc_id")
    joined = may.join(judged, ["doc_id", "text_hash"], "left").select("doc_id", "text", "removed")
    joined = joined.unionByName(cannot.select("doc_id", "text", F.lit(None).cast("binary").alias("removed")))

    def run(batches):
        for batch in batches:
            ids, removed = batch.column(0), batch.column(2).to_pylist()
            counts, gone, digests, spans, texts = [], [], [], [], []
            for text, pairs in zip(batch.column(1).cast(pa.large_binary()).to_pylist(), removed, strict=True):
                words = (text or b"").split()
                counts.append(len(words))
                n, said = 0, []
                if pairs:
                    kept, at = [], 0
                    for a, b in np.frombuffer(pairs, "<i8").reshape(-1, 2).tolist():
                        kept += words[at:a]
                        n, at = n + b - a, b
                        said.append(f"{a}:{b}")
                    words = kept + words[at:]
                whole = b" ".join(words)
                gone.append(n)
                digests.append(hashlib.sha256(whole).hexdigest())
                spans.append(",".join(said))
                if with_text:
                    texts.append(whole.decode())
            columns = [ids, pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests), pa.array(spans), *([pa.array(texts)] if with_text else [])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256", "removed", *(["kept_text"] if with_text else [])])

    kind = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed string" + ", kept_text string" * with_text
    return joined.mapInArrow(run, kind)
