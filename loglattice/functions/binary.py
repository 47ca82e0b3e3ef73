"""Scalar functions over bytes that Spark lacks: CRC-32C and zig-zag variable-length integers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_POLYNOMIAL = 0x82F63B78  # Castagnoli, reflected


def _table() -> list[int]:
    out = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (_POLYNOMIAL if value & 1 else 0)
        out.append(value)
    return out


_TABLE = _table()


_LANE = 64


def _shifted() -> list[list[int]]:
    """Four tables that carry a state over ``_LANE`` zero bytes, one for each of its bytes."""
    out = []
    for place in range(4):
        column = []
        for byte in range(256):
            value = byte << 8 * place
            for _ in range(_LANE):
                value = _TABLE[value & 0xFF] ^ value >> 8
            column.append(value)
        out.append(column)
    return out


_SHIFTED = _shifted()
_LANES = np.array(_TABLE, np.uint32)


def crc32c_many(values: list[bytes]) -> list[int]:
    """CRC-32C of each value: its pieces of ``_LANE`` bytes side by side, a value's states then joined in order."""
    sizes = np.array([len(v) for v in values], np.int64)
    pieces = -(-sizes // _LANE)
    total, firsts = int(pieces.sum()), np.cumsum(pieces) - pieces
    if not total:
        return [0] * len(values)
    lanes = np.zeros((total, _LANE), np.uint8)
    flat = np.frombuffer(b"".join(values), np.uint8)
    pad = pieces * _LANE - sizes  # zeros in front, which leave a state of zero as it is
    where = np.arange(len(flat)) + np.repeat(firsts * _LANE + pad - (np.cumsum(sizes) - sizes), sizes)
    lanes.reshape(-1)[where] = flat
    begins: dict[int, np.ndarray] = {}
    full = np.flatnonzero(pieces)
    for column in np.unique(pad[full]).tolist():
        begins[column] = firsts[full[pad[full] == column]]
    state = np.zeros(total, np.uint32)
    for column in range(_LANE):
        if column in begins:
            state[begins[column]] ^= np.uint32(0xFFFFFFFF)
        state = _LANES[(state ^ lanes[:, column]) & np.uint32(0xFF)] ^ (state >> np.uint32(8))
    t0, t1, t2, t3 = _SHIFTED
    states, out = state.tolist(), []
    for first, count in zip(firsts.tolist(), pieces.tolist(), strict=True):
        value = states[first] if count else 0xFFFFFFFF
        for more in states[first + 1 : first + count]:
            value = t0[value & 0xFF] ^ t1[value >> 8 & 0xFF] ^ t2[value >> 16 & 0xFF] ^ t3[value >> 24] ^ more
        out.append(value ^ 0xFFFFFFFF)
    return out


def crc32c(data: bytes) -> int:
    if len(data) > 4_096:  # below, the bytes one by one are faster than lanes
        return crc32c_many([data])[0]
    value = 0xFFFFFFFF
    for byte in data:
        value = _TABLE[(value ^ byte) & 0xFF] ^ value >> 8
    return value ^ 0xFFFFFFFF


def crc32c_column(column):
    """CRC-32C of a binary column, in Arrow batches; null stays null."""

    @F.pandas_udf("long")
    def run(values: pd.Series) -> pd.Series:
        sums = crc32c_many([v or b"" for v in values])
        return pd.Series([None if v is None else n for v, n in zip(values, sums, strict=True)], index=values.index, dtype="Int64")

    return run(column)


def zigzag(value: int) -> bytes:
    value = value << 1 ^ value >> 63
    value &= (1 << 64) - 1
    out = bytearray()
    while value >= 0x80:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def unzigzag(data: bytes, at: int) -> tuple[int, int]:
    """(value, next place); raises ValueError on a cut-off or overlong integer."""
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("variable-length integer is cut off")
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value >> 1 ^ -(value & 1), at
        shift += 7


def big_endian(number: Column, size: int) -> Column:
    """The last ``size`` bytes of a 64-bit integer, as columns of the JVM."""
    return F.unhex(F.right(F.lpad(F.hex(number.cast("long")), 16, "0"), F.lit(2 * size)))


def counted_text(text: Column) -> Column:
    """Two bytes of length, then UTF-8; for texts without NUL and of the basic plane up to 65,535 bytes."""
    data = F.encode(text, "UTF-8")
    return F.concat(big_endian(F.octet_length(data), 2), data)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value computed once a row; without it, its whole expression stands wherever body names it."""
    return F.transform(F.array(value), body)[0]


def unsigned_at(data: Column, at: Column | int, size: int) -> Column:
    """The big-endian integer of ``size`` bytes at a 1-based place, signed only with 8; the bytes have to be there."""
    return F.conv(F.hex(F.substring(data, at, size)), 16, -10).cast("long")


def integer_at(data: Column, at: Column | int, size: int) -> Column:
    """The signed big-endian integer of ``size`` bytes at a 1-based place; null where the bytes end before."""
    value, shift = unsigned_at(data, at, size), 64 - 8 * size
    at = F.lit(at) if isinstance(at, int) else at
    return F.when(F.octet_length(data) >= at + (size - 1), F.shiftright(F.shiftleft(value, shift), shift) if shift else value)


def behind_text(data: Column, at: Column | int) -> Column:
    """The place behind the counted text at a place; null where its length ends before."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.when(F.octet_length(data) > at, at + 2 + unsigned_at(data, at, 2).cast("int"))


def text_at(data: Column, at: Column | int, end: Column) -> Column:
    """The counted text between a place and the one behind it; null where the bytes end before."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.when(F.octet_length(data) >= end - 1, F.decode(F.substring(data, at + 2, end - at - 2), "UTF-8"))


OFFSET_KEY, GROUP_KEY = 1, 2


def offset_key(group: Column, topic: Column, part: Column) -> Column:
    return F.concat(big_endian(F.lit(OFFSET_KEY), 1), counted_text(group), counted_text(topic), big_endian(part, 4))


def offset_value(offset: Column, epoch: Column, metadata: Column, at_ms: Column) -> Column:
    return F.concat(big_endian(offset, 8), big_endian(epoch, 4), counted_text(F.coalesce(metadata, F.lit(""))), big_endian(at_ms, 8))


def read_offset_key(key: Column) -> Column:
    """struct(grp, topic, part); null for keys of another type and cut-off ones."""

    def read(key: Column, topic_at: Column, part_at: Column) -> Column:
        fields = text_at(key, 2, topic_at).alias("grp"), text_at(key, topic_at, part_at).alias("topic"), integer_at(key, part_at, 4).alias("part")
        return F.when((integer_at(key, 1, 1) == OFFSET_KEY) & (F.octet_length(key) >= part_at + 3), F.struct(*fields))

    return bound(key, lambda k: bound(behind_text(k, 2), lambda t: bound(behind_text(k, t), lambda p: read(k, t, p))))


def read_offset_value(value: Column) -> Column:
    """struct(committed, epoch, metadata, at_ms); null for cut-off values."""

    def read(value: Column, place: Column) -> Column:
        fields = integer_at(value, 1, 8).alias("committed"), integer_at(value, 9, 4).alias("epoch"), text_at(value, 13, place).alias("metadata"), integer_at(value, place, 8).alias("at_ms")
        return F.when(F.octet_length(value) >= place + 7, F.struct(*fields))

    return bound(value, lambda v: bound(behind_text(v, 13), lambda p: read(v, p)))


def transaction_value(pid: Column, epoch: Column, state: Column, timeout_ms: Column, at_ms: Column, partitions: Column) -> Column:
    """Value of the transaction topic; state is its code, partitions an array of struct(topic, part)."""
    parts = F.transform(partitions, lambda p: F.concat(counted_text(p["topic"]), big_endian(p["part"], 4)))
    head = F.concat(big_endian(pid, 8), big_endian(epoch, 4), big_endian(state, 1), big_endian(timeout_ms, 4), big_endian(at_ms, 8), big_endian(F.size(partitions), 4))
    return F.aggregate(parts, head, lambda a, p: F.concat(a, p))


def read_transaction_head(value: Column) -> Column:
    """struct(pid, epoch, state, timeout_ms, at_ms, n): all but the n partitions behind it; null where it is cut off."""
    fields = {"pid": (1, 8), "epoch": (9, 4), "state": (13, 1), "timeout_ms": (14, 4), "at_ms": (18, 8), "n": (26, 4)}
    return bound(value, lambda v: F.when(F.octet_length(v) >= 29, F.struct(*[integer_at(v, *place).alias(name) for name, place in fields.items()])))


def read_transaction_partitions(value: Column) -> Column:
    """array(struct(topic, part)) behind the head; null where the bytes cannot hold as many."""
    empty = F.array().cast("array<struct<topic:string,part:bigint>>")

    def entries(value: Column, n: Column) -> Column:
        def one(read: Column, _: Column) -> Column:
            def entry(at: Column) -> Column:
                found = F.struct(text_at(value, read["at"], at).alias("topic"), integer_at(value, at, 4).alias("part"))
                return F.struct((at + 4).alias("at"), F.concat(read["parts"], F.array(found)).alias("parts"))

            return bound(behind_text(value, read["at"]), entry)

        turns = F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
        read = F.aggregate(turns, F.struct(F.lit(30).alias("at"), empty.alias("parts")), one)
        whole = bound(read, lambda r: F.when(r["at"] == F.octet_length(value) + 1, r["parts"]))
        return F.when((n >= 0) & (6 * n + 29 <= F.octet_length(value)), whole)

    return bound(value, lambda v: bound(integer_at(v, 26, 4), lambda n: entries(v, n)))


def zigzag_column(value: Column) -> Column:
    """The zig-zag form of a 64-bit integer, itself signed 64 bits."""
    return F.shiftleft(value, 1).bitwiseXOR(F.shiftright(value, 63))


def varint_size(value: Column) -> Column:
    """Bytes of the variable-length form of a 64-bit integer."""
    bits = F.length(F.bin(zigzag_column(value)))
    return F.ceil(bits / 7).cast("long")


def flag_bits(attributes: Column) -> list[Column]:
    """Columns control (bit 3), transactional (bit 4) and codec (bits 0 to 2) of a batch's attributes."""
    return [(attributes.bitwiseAND(8) > 0).alias("control"), (attributes.bitwiseAND(16) > 0).alias("transactional"), attributes.bitwiseAND(7).alias("codec")]
