"""Codecs that need raw bits or another library: small numpy steps on Arrow batches, a chunk at a time.

The chunks and their columns are those of `quarry.functions.codecs`.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.errors import InvalidData
from quarry.functions.codecs import CHUNK, LANE_ORDER

LANES = 16
#: Chunks that are held as Python values at a time.
AT_ONCE = 16


def each_chunk(df: DataFrame, step: Callable[..., dict], fields: str) -> DataFrame:
    """``chunk`` and what step makes of a chunk's other columns, given by name as Python values."""

    def run(batches):
        # a batch may have thousands of chunks; only a few at a time become Python values
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                rows = batch.slice(start, AT_ONCE).to_pylist()
                yield pa.RecordBatch.from_pylist([{"chunk": r.pop("chunk"), **step(**r)} for r in rows], schema)

    spark = df.sparkSession
    schema = spark.createDataFrame([], f"chunk bigint, {fields}").toArrow().schema
    return df.mapInArrow(run, f"chunk bigint, {fields}")


def _kept(vals: list) -> list:
    return [v for v in vals if v is not None]


def _spread(values, valid: list) -> list:
    values = iter(values)
    return [next(values) if ok else None for ok in valid]


# plain bytes


def primitive_encode(chunks: DataFrame, dtype: str) -> DataFrame:
    """Little-endian words, zero at nulls, and a bit for each that is valid."""

    def step(n, vals):
        data = np.array([0 if v is None else v for v in vals], dtype).astype(np.dtype(dtype).newbyteorder("<"))
        return {"n": n, "data": data.tobytes(), "valid": np.packbits([v is not None for v in vals], bitorder="little").tobytes()}

    return each_chunk(chunks, step, "n int, data binary, valid binary")


def primitive_decode(coded: DataFrame, dtype: str, kind: str) -> DataFrame:
    def step(n, data, valid):
        if len(data) != n * np.dtype(dtype).itemsize:
            raise InvalidData("a buffer of the wrong length")
        words = np.frombuffer(data, np.dtype(dtype).newbyteorder("<")).tolist()
        bits = np.unpackbits(np.frombuffer(valid, np.uint8), count=n, bitorder="little")
        return {"vals": [w if ok else None for w, ok in zip(words, bits, strict=True)]}

    return each_chunk(coded, step, f"vals array<{kind}>")


def bool_encode(chunks: DataFrame, offset: int = 0) -> DataFrame:
    return each_chunk(chunks, lambda n, vals: {"n": n, "offset": offset, "bits": np.packbits([0] * offset + [bool(v) for v in vals], bitorder="little").tobytes()}, "n int, offset int, bits binary")


def bool_decode(coded: DataFrame) -> DataFrame:
    def step(n, offset, bits):
        if not 0 <= offset < 8 or len(bits) * 8 < n + offset:
            raise InvalidData("a bitmap of the wrong length")
        return {"vals": np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")[offset : offset + n].astype(bool).tolist()}

    return each_chunk(coded, step, "vals array<boolean>")


def bytebool_encode(chunks: DataFrame) -> DataFrame:
    return each_chunk(chunks, lambda n, vals: {"n": n, "data": bytes(map(int, vals))}, "n int, data binary")


def bytebool_decode(coded: DataFrame) -> DataFrame:
    def step(n, data):
        if len(data) != n or max(data, default=0) > 1:
            raise InvalidData("a byte that is neither 0 nor 1")
        return {"vals": [b == 1 for b in data]}

    return each_chunk(coded, step, "vals array<boolean>")


def decimal_encode(chunks: DataFrame, width: int) -> DataFrame:
    """Unscaled values as signed little-endian integers of so many bytes."""
    return each_chunk(chunks, lambda n, vals: {"n": n, "data": b"".join(int(v.scaleb(-v.as_tuple().exponent)).to_bytes(width, "little", signed=True) for v in vals)}, "n int, data binary")


def decimal_decode(coded: DataFrame, width: int, precision: int, scale: int) -> DataFrame:
    from decimal import Context, Decimal

    exact = Context(prec=80)

    def step(n, data):
        ints = [int.from_bytes(data[i : i + width], "little", signed=True) for i in range(0, len(data), width)]
        if len(ints) != n or any(abs(i) >= 10**precision for i in ints):
            raise InvalidData("an integer of more digits than the type has")
        return {"vals": [Decimal(i).scaleb(-scale, exact) for i in ints]}

    return each_chunk(coded, step, f"vals array<decimal({precision},{scale})>")


# packed bits


def _places() -> tuple[np.ndarray, np.ndarray]:
    """Lane and row of every position in a block of 1024 64-bit values."""
    p = np.arange(CHUNK)
    stripe = p // 128
    return p % LANES, np.array(LANE_ORDER)[(p % 128) // LANES] * 8 + stripe


def bitpack(values: np.ndarray, width: int) -> np.ndarray:
    """1024 unsigned values in width bits each: words of 16 lanes, side by side."""
    lane, row = _places()
    out = np.zeros((width + 1, LANES), np.uint64)
    bit = row * width
    word, shift = bit // 64, (bit % 64).astype(np.uint64)
    np.bitwise_or.at(out, (word, lane), values << shift)
    over = shift.astype(int) + width > 64
    np.bitwise_or.at(out, (word[over] + 1, lane[over]), values[over] >> (np.uint64(64) - shift[over]))
    return out[:width].reshape(-1)


def bitunpack(words: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(CHUNK, np.uint64)
    lane, row = _places()
    words = np.concatenate([words.reshape(width, LANES), np.zeros((1, LANES), np.uint64)])
    bit = row * width
    word, shift = bit // 64, (bit % 64).astype(np.uint64)
    out = words[word, lane] >> shift
    over = shift.astype(int) + width > 64
    out[over] |= words[word[over] + 1, lane[over]] << (np.uint64(64) - shift[over])
    return out if width == 64 else out & np.uint64((1 << width) - 1)


def bitpacked_encode(chunks: DataFrame, width: int) -> DataFrame:
    """Values of up to width bits; larger ones are patches, and nulls have a mask of their own."""

    def step(n, vals):
        v = np.zeros(CHUNK, np.uint64)
        v[:n] = [x or 0 for x in vals]
        large = np.flatnonzero(v >> np.uint64(width)) if width < 64 else np.zeros(0, int)
        patches = v[large].astype(np.int64).tolist()
        v[large] = 0
        return {"n": n, "words": bitpack(v, width).tobytes(), "indices": large.tolist(), "patches": patches, "valid": [x is not None for x in vals]}

    return each_chunk(chunks, step, "n int, words binary, indices array<int>, patches array<bigint>, valid array<boolean>")


def bitpacked_decode(coded: DataFrame, width: int) -> DataFrame:
    """Unpacked, then patched, then masked."""

    def step(n, words, indices, patches, valid):
        if len(words) != width * 128 or sorted(set(indices)) != indices:
            raise InvalidData("packed bits of the wrong length, or patches out of order")
        v = bitunpack(np.frombuffer(words, np.uint64), width).astype(np.int64)
        v[indices] = patches
        return {"vals": [x if ok else None for x, ok in zip(v[:n].tolist(), valid, strict=True)]}

    return each_chunk(coded, step, "vals array<bigint>")


# floats by their bits


def alprd_encode(chunks: DataFrame, right_bits: int = 48) -> DataFrame:
    """The left bits of doubles by a dictionary of the eight most frequent, the right ones as they are."""

    def step(n, vals):
        bits = np.array([0.0 if v is None else v for v in vals], np.float64).view(np.uint64)
        left = bits >> np.uint64(right_bits)
        seen, count = np.unique(left, return_counts=True)
        known = seen[np.argsort(-count, kind="stable")[:8]]
        code = np.array([int(np.flatnonzero(known == x)[0]) if x in known else -1 for x in left], int)
        missed = np.flatnonzero(code < 0)
        return {
            "n": n, "known": known.astype(np.int64).tolist(), "left": [None if v is None else max(0, int(c)) for v, c in zip(vals, code, strict=True)],
            "right": (bits & np.uint64((1 << right_bits) - 1)).astype(np.int64).tolist(), "indices": missed.tolist(), "patches": left[missed].astype(np.int64).tolist(),
        }

    return each_chunk(chunks, step, "n int, known array<bigint>, left array<int>, right array<bigint>, indices array<int>, patches array<bigint>")


def alprd_decode(coded: DataFrame, right_bits: int = 48) -> DataFrame:
    def step(n, known, left, right, indices, patches):
        high = np.array(known, np.uint64)[[c or 0 for c in left]] if n else np.zeros(0, np.uint64)
        high[indices] = patches
        out = (high << np.uint64(right_bits) | np.array(right, np.uint64)).view(np.float64)
        return {"vals": [x if c is not None else None for x, c in zip(out.tolist(), left, strict=True)]}

    return each_chunk(coded, step, "vals array<double>")


# strings


def views_encode(chunks: DataFrame) -> DataFrame:
    """16 bytes a value: length, then up to 12 bytes inline, or a prefix of four, buffer and offset."""

    def step(n, vals):
        views, data = [], bytearray()
        for v in vals:
            raw = (v or "").encode()
            size = len(raw).to_bytes(4, "little")
            if len(raw) <= 12:
                views.append(size + raw.ljust(12, b"\0"))
            else:
                views.append(size + raw[:4] + (0).to_bytes(4, "little") + len(data).to_bytes(4, "little"))
                data += raw
        return {"n": n, "views": b"".join(views), "data": bytes(data), "valid": [v is not None for v in vals]}

    return each_chunk(chunks, step, "n int, views binary, data binary, valid array<boolean>")


def views_decode(coded: DataFrame) -> DataFrame:
    def step(n, views, data, valid):
        out = []
        for i, ok in zip(range(n), valid, strict=True):
            v = views[16 * i : 16 * i + 16]
            size, at = int.from_bytes(v[:4], "little"), int.from_bytes(v[12:], "little")
            raw = v[4 : 4 + size] if size <= 12 else data[at : at + size]
            if ok and (len(raw) != size or raw[:4] != v[4 : 4 + min(size, 4)]):
                raise InvalidData("a view that does not fit its data")
            out.append(raw.decode() if ok else None)
        return {"vals": out}

    return each_chunk(coded, step, "vals array<string>")


ESCAPE = 255


def symbols_encode(chunks: DataFrame) -> DataFrame:
    """A table of up to 255 symbols of up to eight bytes, taken where the chunk repeats them most; other bytes are escaped."""

    def step(n, vals):
        rows = [(v or "").encode() for v in vals]
        seen: dict[bytes, int] = {}
        for r in rows[::8]:
            for size in range(1, 9):
                for i in range(len(r) - size + 1):
                    s = r[i : i + size]
                    seen[s] = seen.get(s, 0) + size
        table = sorted(seen, key=lambda s: (-seen[s], s))[:ESCAPE]
        code = {s: i for i, s in enumerate(table)}
        out = []
        for r in rows:
            made, i = bytearray(), 0
            while i < len(r):
                s = next((r[i : i + k] for k in range(8, 0, -1) if r[i : i + k] in code), None)
                made += bytes([code[s]]) if s else bytes([ESCAPE, r[i]])
                i += len(s) if s else 1
            out.append(bytes(made))
        return {"n": n, "symbols": table, "codes": out, "lengths": [len(r) for r in rows], "valid": [v is not None for v in vals]}

    return each_chunk(chunks, step, "n int, symbols array<binary>, codes array<binary>, lengths array<int>, valid array<boolean>")


def symbols_decode(coded: DataFrame) -> DataFrame:
    """The lengths that were stored must come out."""

    def step(n, symbols, codes, lengths, valid):
        out = []
        for c, size, ok in zip(codes, lengths, valid, strict=True):
            text, i = bytearray(), 0
            while ok and i < len(c):
                literal = c[i] == ESCAPE
                if (c[i] >= len(symbols) and not literal) or (literal and i + 1 == len(c)):
                    raise InvalidData("a code without a symbol")
                text += c[i + 1 : i + 2] if literal else symbols[c[i]]
                i += 1 + literal
            if ok and len(text) != size:
                raise InvalidData("a value of another length than stored")
            out.append(text.decode() if ok else None)
        return {"vals": out}

    return each_chunk(coded, step, "vals array<string>")


def zstd_encode(chunks: DataFrame, per_frame: int = 256) -> DataFrame:
    """Frames of valid values only, each value after its length."""

    def step(n, vals):
        import zstandard

        kept = [v.encode() for v in _kept(vals)]
        parts = [kept[i : i + per_frame] for i in range(0, len(kept), per_frame)]
        frames = [zstandard.ZstdCompressor().compress(b"".join(len(v).to_bytes(4, "little") + v for v in p)) for p in parts]
        return {"n": n, "frames": frames, "counts": [len(p) for p in parts], "valid": [v is not None for v in vals]}

    return each_chunk(chunks, step, "n int, frames array<binary>, counts array<int>, valid array<boolean>")


def zstd_decode(coded: DataFrame) -> DataFrame:
    """A count of 0 means that the frame does not say how many values it has."""

    def step(n, frames, counts, valid):
        import zstandard

        values = []
        for frame, count in zip(frames, counts, strict=True):
            raw, at, before = zstandard.ZstdDecompressor().decompress(frame), 0, len(values)
            while at < len(raw):
                size = int.from_bytes(raw[at : at + 4], "little")
                values.append(raw[at + 4 : at + 4 + size].decode())
                at += 4 + size
            if count and len(values) - before != count:
                raise InvalidData("a frame with another number of values")
        if len(values) != sum(valid):
            raise InvalidData("more or fewer values than are valid")
        return {"vals": _spread(values, valid)}

    return each_chunk(coded, step, "vals array<string>")
