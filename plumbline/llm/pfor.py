"""Patched frame-of-reference blocks of unsigned 32-bit integers.

A block of up to ``BLOCK`` numbers stores its smallest one and the differences to it, packed in as many bits as
most of them need; those that need more are listed with their places.

Layout, all little-endian.  A block: count ``uint16``, width in bits ``uint8``, exceptions ``uint16``, smallest
``uint32``; the packed bits, lowest first, padded to a byte; places ``uint16`` and differences ``uint32`` of the
exceptions.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 1024
HEAD = struct.Struct("<HBHI")


def widths(differences: np.ndarray, percentile: float) -> np.ndarray:
    """For each row the bits that ``percentile`` of its numbers fit into."""
    bits = np.frexp(differences.astype(np.float64))[1].astype(np.uint8)
    at = max(0, int(np.ceil(percentile * bits.shape[1])) - 1)
    return np.partition(bits, at, axis=1)[:, at]


def pack(values: np.ndarray, percentile: float = 0.9) -> list[bytes]:
    """The blocks of ``values``, in order."""
    values = np.ascontiguousarray(values, dtype=np.uint32)
    whole = len(values) // BLOCK * BLOCK
    found = []
    for start in range(0, whole, BLOCK * 256):
        found += packed(values[start : min(whole, start + BLOCK * 256)].reshape(-1, BLOCK), percentile)
    if whole < len(values):
        found += packed(values[whole:].reshape(1, -1), percentile)
    return found


def packed(rows: np.ndarray, percentile: float) -> list[bytes]:
    low = rows.min(axis=1)
    differences = rows - low[:, None]
    width = widths(differences, percentile)
    out: list[bytes] = [b""] * len(rows)
    for w in np.unique(width):
        chosen = np.nonzero(width == w)[0]
        part = differences[chosen]
        over = part >= np.uint64(1) << np.uint64(w)
        kept = np.where(over, np.uint32(0), part)
        bits = (kept[:, :, None] >> np.arange(w, dtype=np.uint32)).astype(np.uint8) & 1
        body = np.packbits(bits.reshape(len(chosen), -1), axis=1, bitorder="little")
        for k, i in enumerate(chosen):
            places = np.nonzero(over[k])[0]
            head = HEAD.pack(rows.shape[1], int(w), len(places), int(low[i]))
            out[i] = b"".join(
                [head, body[k].tobytes(), places.astype("<u2").tobytes(), part[k, places].astype("<u4").tobytes()]
            )
    return out


def unpack(blocks: memoryview | bytes, starts: np.ndarray) -> np.ndarray:
    """The numbers of the blocks that begin at ``starts``, one after the other."""
    blocks = memoryview(blocks)
    heads = [HEAD.unpack_from(blocks, s) for s in starts]
    counts = np.array([h[0] for h in heads], dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(int(bounds[-1]), dtype=np.uint32)
    alike: dict[tuple[int, int], list[int]] = {}
    for i, (count, width, _, _) in enumerate(heads):
        alike.setdefault((count, width), []).append(i)
    for (count, width), group in alike.items():
        size = -(-count * width // 8)
        for part in (group[k : k + 256] for k in range(0, len(group), 256)):
            raw = b"".join(bytes(blocks[starts[i] + HEAD.size : starts[i] + HEAD.size + size]) for i in part)
            bits = np.zeros((len(part), count, 32), dtype=np.uint8)
            if width:
                stored = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(part), size), axis=1, bitorder="little")
                bits[:, :, :width] = stored[:, : count * width].reshape(len(part), count, width)
            values = np.packbits(bits.reshape(-1), bitorder="little").view("<u4").reshape(len(part), count)
            for k, i in enumerate(part):
                _, _, exceptions, low = heads[i]
                row = values[k].copy()
                at = starts[i] + HEAD.size + size
                places = np.frombuffer(blocks, "<u2", exceptions, at)
                row[places] = np.frombuffer(blocks, "<u4", exceptions, at + 2 * exceptions)
                out[bounds[i] : bounds[i + 1]] = row + np.uint32(low)
    return out
