"""Encodings over numpy arrays: what runs inside a chunk's task."""

from __future__ import annotations

import numpy as np

from ..schema import INT32_MAX, N_BLOCK, PACK_CODES


def base_codes(order: str) -> np.ndarray:
    """256 entries: byte -> 0..3, N -> A's code, 255 for what is no base."""
    table = np.full(256, 255, np.uint8)
    for k, b in enumerate(PACK_CODES[order]):
        table[ord(b)] = table[ord(b.lower())] = k
    table[ord("N")] = table[ord("n")] = table[ord("A")]
    return table


def first_bad_base(bases: bytes) -> int:
    """The position of the first byte that is no base or N, or -1."""
    bad = np.flatnonzero(base_codes("acgt")[np.frombuffer(bases, np.uint8)] == 255)
    return int(bad[0]) if len(bad) else -1


def pack(bases: bytes, order: str = "tgca") -> bytes:
    """Four bases a byte, the first in the lowest bits; the last byte is padded with 0."""
    codes = base_codes(order)[np.frombuffer(bases, np.uint8)]
    if (codes == 255).any():
        raise ValueError(f"non-ACGTN basecall at offset {first_bad_base(bases)}")
    four = np.concatenate([codes, np.zeros(-len(codes) % 4, np.uint8)]).reshape(-1, 4)
    return (four << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8).tobytes()


def unpack(packed: bytes, n: int, order: str = "tgca") -> np.ndarray:
    """The n bases of a packed stream, as bytes."""
    if len(packed) != -(-n // 4):
        raise ValueError("packed basecalls have the wrong size")
    codes = (np.frombuffer(packed, np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3
    return np.frombuffer(PACK_CODES[order].encode(), np.uint8)[codes.ravel()[:n]]


def n_mask(bases: bytes, block: int = N_BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """N's in each block, and their places in the block as differences (the first as it is)."""
    x = np.frombuffer(bases, np.uint8)
    at = np.flatnonzero((x == ord("N")) | (x == ord("n")))
    blocks, places = at // block, at % block
    deltas = np.diff(places, prepend=0)
    first = np.flatnonzero(np.diff(blocks, prepend=-1))
    deltas[first] = places[first]
    return np.bincount(blocks, minlength=-(-len(x) // block)).astype(np.int64), deltas.astype(np.int64)


def put_n(bases: np.ndarray, counts: np.ndarray, deltas: np.ndarray, block: int = N_BLOCK) -> np.ndarray:
    """bases with N where n_mask() found them."""
    if counts.sum() != len(deltas) or len(counts) != -(-len(bases) // block):
        raise ValueError("N mask has the wrong size")
    out, ends = bases.copy(), np.cumsum(counts)
    total = np.cumsum(deltas)
    before = np.concatenate(([0], total))[np.concatenate(([0], ends[:-1]))] if len(ends) else np.zeros(0, np.int64)
    places = total - np.repeat(before, counts)
    if len(places) and (places.min() < 0 or places.max() >= block):
        raise ValueError("N position outside its block")
    at = places + np.repeat(np.arange(len(counts)) * block, counts)
    if len(at) and at.max() >= len(out):
        raise ValueError("N position outside the stream")
    out[at] = ord("N")
    return out


def delta(v: np.ndarray) -> np.ndarray:
    """v0, then differences, in 32 bits that wrap."""
    return np.diff(v.astype(np.int64), prepend=0).astype(np.int32)


def undelta(d: np.ndarray) -> np.ndarray:
    v = np.cumsum(d.astype(np.int64))
    if len(v) and (v.max() > INT32_MAX or v.min() < -INT32_MAX - 1):
        raise ValueError("delta decoding overflows int32")
    return v.astype(np.int32)


def zigzag(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.int64)
    return ((v << 1) ^ (v >> 63)) & 0xFFFFFFFF


def unzigzag(z: np.ndarray) -> np.ndarray:
    z = z.astype(np.int64)
    return ((z >> 1) ^ -(z & 1)).astype(np.int32)


def varint(z: np.ndarray) -> bytes:
    """Seven bits a byte, the low ones first; 0x80: more follow."""
    z = z.astype(np.int64)
    size = 1 + (z >= 1 << 7).astype(int) + (z >= 1 << 14) + (z >= 1 << 21) + (z >= 1 << 28)
    start = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(int(start[-1]), np.uint8)
    for k in range(5):
        some = size > k
        out[start[:-1][some] + k] = ((z[some] >> (7 * k)) & 127) | np.where(size[some] > k + 1, 128, 0)
    return out.tobytes()


def unvarint(data: bytes, n: int) -> np.ndarray:
    x = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(x < 128)
    if len(x) and (not len(ends) or ends[-1] != len(x) - 1):
        raise ValueError("varint stream ends in a value")
    if len(ends) != n:
        raise ValueError(f"{len(ends)} varints where {n} are expected")
    starts = np.concatenate(([0], ends[:-1] + 1)) if n else ends
    if n and (ends - starts).max() > 4:
        raise ValueError("varint of more than five bytes")
    out = np.zeros(n, np.int64)
    for k in range(5):
        some = ends - starts >= k
        out[some] |= (x[starts[some] + k].astype(np.int64) & 127) << (7 * k)
    return out


def transpose(quality: bytes, n: int, width: int) -> bytes:
    """n rows of `width` scores -> the scores of each cycle together."""
    if len(quality) != n * width:
        raise ValueError("quality stream does not have n rows of one width")
    return np.frombuffer(quality, np.uint8).reshape(n, width).T.tobytes()


def untranspose(quality: bytes, n: int, width: int) -> bytes:
    if len(quality) != n * width:
        raise ValueError("quality stream does not have n rows of one width")
    return np.frombuffer(quality, np.uint8).reshape(width, n).T.tobytes()


def cut(data: bytes, lengths: np.ndarray) -> list[bytes]:
    """data in parts of the given lengths, which must add up to it."""
    ends = np.cumsum(lengths)
    if (int(ends[-1]) if len(ends) else 0) != len(data):
        raise ValueError("stream size does not match its lengths")
    return [data[e - n : e] for e, n in zip(ends.tolist(), np.asarray(lengths).tolist(), strict=True)]
