"""A chunk's reads as encoded streams, and back: the engine's main path.

A chunk is one group of a single exchange on chunk_id, coded by numpy and stored as rows
(chunk, stream, col, slice). Chunks are bounded by bytes or records, so no group grows with
the data; each is coded alone and its streams are self-describing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import codecs, kernels
from ..schema import PACK_ORDERS, SLICE_BYTES, STREAMS
from . import encode, validate
from .identifiers import chunk_layout


@dataclass(frozen=True)
class Options:
    quality_codec: str = "bwt"
    base_codec: str = "zstd"
    codec: str = "zstd"
    pack_order: str = "tgca"
    transpose: bool = False
    keep_case: bool = True
    slice_bytes: int = SLICE_BYTES

    def __post_init__(self) -> None:
        for c in (self.quality_codec, self.base_codec, self.codec):
            if c not in codecs.NAMES:
                raise ValueError(f"unknown codec {c!r}; there are {', '.join(codecs.NAMES)}")
        if self.pack_order not in PACK_ORDERS:
            raise ValueError(f"unknown pack order {self.pack_order!r}")
        if self.slice_bytes < 1:
            raise ValueError("slice_bytes must be positive")


def best_encoding(values: list[int], codec: str) -> tuple[str, bytes]:
    """The smallest after compression of plain, delta and varint deltas: an int column's encoding and bytes.

    Varints win only if smaller than both others; else deltas if smaller than plain.
    """
    v = np.array(values, np.int64)
    d = kernels.delta(v)
    every = {"plain": v.astype("<i4").tobytes(), "delta": d.astype("<i4").tobytes(), "delta_varint": kernels.varint(kernels.zigzag(d))}
    size = {k: len(codecs.compress(x, codec)) for k, x in every.items()}
    if size["delta_varint"] < min(size["plain"], size["delta"]):
        name = "delta_varint"
    else:
        name = "delta" if size["delta"] < size["plain"] else "plain"
    return name, every[name]


def decoded_ints(data: bytes, encoding: str, n: int) -> np.ndarray:
    if encoding == "delta_varint":
        return kernels.undelta(kernels.unzigzag(kernels.unvarint(data, n)))
    v = np.frombuffer(data, "<i4")
    if len(v) != n:
        raise ValueError("an int column has the wrong size")
    return kernels.undelta(v) if encoding == "delta" else v


def coded(chunk: int, t: pa.Table, options: tuple[Options, ...]) -> Iterator[list[tuple]]:
    """Rows of STREAMS of a chunk's reads, for each of the options.

    Options of one call differ in quality_codec and transpose only: what these do not touch is
    made once, by the first.
    """
    o = options[0]
    if any(replace(v, quality_codec=o.quality_codec, transpose=o.transpose) != o for v in options):
        raise ValueError("options of one call may differ in quality_codec and transpose only")
    ids, quality = t["identifier"].to_pylist(), t["quality"].to_pylist()
    bases, scores = encode.stream(t, "basecalls"), encode.stream(t, "quality")
    lengths = np.array([len((x or "").encode()) for x in quality], np.int64)
    rows: list[tuple] = []

    def put(stream: str, data: bytes, codec: str, n: int, col: int = -1, kind: str = "", encoding: str = "plain", text: int = 0) -> None:
        for k, part in enumerate([data] if stream == "about" else codecs.slices(data, o.slice_bytes) or [b""]):
            packed = codecs.compress(part, codec)
            rows.append((chunk, stream, col, k, kind, encoding, codec, n, 0 if k else text, len(part), len(packed), packed))

    sep: list[str] = []
    if (found := chunk_layout(ids)) is not None:
        sep, kinds, cols = found
        for c, (kind, values) in enumerate(zip(kinds, cols, strict=True)):
            if kind == "int32":
                encoding, data = best_encoding([int(v) for v in values], o.codec)
                put("id_values", data, o.codec, len(values), c, kind, encoding, sum(map(len, values)))
            else:
                data = "".join(values).encode()
                put("id_values", data, o.codec, len(values), c, kind, text=len(data))
                put("id_lengths", np.array([len(v.encode()) for v in values], "<u4").tobytes(), o.codec, len(values), c)
    else:
        data = "".join(ids).encode()
        put("id_flat", data, o.codec, len(ids), text=len(data))
    counts, deltas = kernels.n_mask(bases)
    put("bases", kernels.pack(bases, o.pack_order), o.base_codec, len(bases), text=len(bases))
    put("n_counts", counts.astype("<u2").tobytes(), o.codec, len(counts))
    if len(deltas):
        put("n_positions", deltas.astype("<u2").tobytes(), o.codec, len(deltas))
    low = np.frombuffer(bases, np.uint8) >= ord("a")
    if o.keep_case and low.any():
        put("case", np.packbits(low).tobytes(), o.codec, len(bases))
    fixed = bool(len(lengths)) and int(lengths.min()) == int(lengths.max())
    id_lengths = np.array([len(x.encode()) for x in ids], np.int64)
    plus = np.array(t["plus_kind"].to_pylist(), np.uint8)
    index = np.stack([id_lengths + 2, lengths + 1, np.where(plus == 1, id_lengths + 2, 2), lengths + 1], 1).ravel()
    put("line_lengths", np.concatenate(([0], index)).astype("<u4").tobytes(), o.codec, len(index) + 1, text=4 * (len(index) + 1))
    put("plus", plus.tobytes(), o.codec, len(plus))
    rec = t["rec"].to_numpy()
    if len(rec) and int(rec[-1]) - int(rec[0]) + 1 != len(rec):  # records were left out
        put("rec", rec.astype("<i8").tobytes(), o.codec, len(rec))
    shared = rows
    for v in options:
        rows = []
        turned = v.transpose and fixed and int(lengths[0]) > 0
        put("quality", kernels.transpose(scores, len(lengths), int(lengths[0])) if turned else scores, v.quality_codec, len(scores), text=len(scores))
        about = {"records": len(ids), "first_rec": t["rec"][0].as_py(), "columnar": found is not None, "separators": sep, "order": o.pack_order, "layout": "fixed" if fixed else "variable", "fixed_len": int(lengths[0]) if fixed else 0, "transposed": turned, "case_loss": 0 if o.keep_case else int(low.sum())}
        put("about", json.dumps(about).encode(), "none", 1, text=len(ids) * sum(len(x.encode()) for x in sep))
        yield shared + rows


READ_IN = ("chunk_id", "rec", "identifier", "basecalls", "plus_kind", "quality")


def encoded(reads: DataFrame, options: Options | None = None) -> DataFrame:
    """STREAMS of reads (chunk_id, rec, identifier, basecalls, plus_kind, quality).

    text_bytes: what a stream stands for in the records, before any encoding (on its first
    slice; of "about" the separators between an identifier's tokens).
    """
    o = options or Options()

    def make(key, t: pa.Table) -> dict:
        (rows,) = coded(key[0], t, (o,))
        return dict(zip(encode.arrow(STREAMS).names, zip(*rows, strict=True), strict=True))

    return encode.by_chunk(reads.select(*READ_IN), ["chunk_id"], STREAMS, make)


READ_BACK = "chunk_id int, rec long, identifier string, basecalls string, plus_kind int, quality string"


def decoded(streams: DataFrame) -> DataFrame:
    """READ_BACK from STREAMS. What does not add up fails the task."""

    def run(key, t):
        parts: dict[tuple[str, int], list] = {}
        for r in sorted(t.to_pylist(), key=lambda r: (r["stream"], r["col"], r["slice"])):
            parts.setdefault((r["stream"], r["col"]), []).append(r)
        data = {k: b"".join(codecs.decompress(r["payload"], r["codec"], r["raw_bytes"]) for r in rs) for k, rs in parts.items()}
        n_of = {k: rs[0]["n"] for k, rs in parts.items()}
        about = json.loads(data["about", -1])
        n = about["records"]
        index = np.frombuffer(data["line_lengths", -1], "<u4").astype(np.int64)
        offsets = np.cumsum(index)
        if bad := validate.check_index(offsets, int(offsets[-1]) if len(offsets) else 0, n):
            raise ValueError(f"{bad}: the line index does not fit the records")
        four = index[1:].reshape(n, 4)
        lengths, id_lengths = four[:, 1] - 1, four[:, 0] - 2
        if about["columnar"]:
            cols = []
            for c in range(len(about["separators"]) + 1):
                head = parts["id_values", c][0]
                if head["kind"] == "int32":
                    cols.append([str(v) for v in decoded_ints(data["id_values", c], head["encoding"], n).tolist()])
                else:
                    cols.append([p.decode() for p in kernels.cut(data["id_values", c], np.frombuffer(data["id_lengths", c], "<u4").astype(np.int64))])
            seps = [*about["separators"], ""]
            ids = ["".join(t + s for t, s in zip(row, seps, strict=True)) for row in zip(*cols, strict=True)]
        else:
            ids = [p.decode() for p in kernels.cut(data["id_flat", -1], id_lengths)]
        total = n_of["bases", -1]
        counts = np.frombuffer(data["n_counts", -1], "<u2").astype(np.int64)
        deltas = np.frombuffer(data.get(("n_positions", -1), b""), "<u2").astype(np.int64)
        bases = kernels.put_n(kernels.unpack(data["bases", -1], total, about["order"]), counts, deltas)
        if ("case", -1) in data:
            bases = bases | (np.unpackbits(np.frombuffer(data["case", -1], np.uint8))[:total] << 5)
        scores = data["quality", -1]
        if about["transposed"]:
            scores = kernels.untranspose(scores, n, about["fixed_len"])
        plus = np.frombuffer(data["plus", -1], np.uint8)
        own = np.array([len(x.encode()) for x in ids], np.int64) if n else np.zeros(0, np.int64)
        if bad := validate.check_records(offsets, np.stack([own + 1, lengths, np.where(plus == 1, own + 1, 1), lengths], 1)):
            raise ValueError(f"{bad}: a record's lines do not follow one another in the index")
        rec = np.frombuffer(data["rec", -1], "<i8") if ("rec", -1) in data else about["first_rec"] + np.arange(n)
        text = lambda b, k: [p.decode() for p in kernels.cut(b, k)]
        return pa.table({"chunk_id": [key[0].as_py()] * n, "rec": rec.tolist(), "identifier": ids, "basecalls": text(bases.astype(np.uint8).tobytes(), lengths), "plus_kind": plus.tolist(), "quality": text(scores, lengths)}, schema=encode.arrow(READ_BACK))

    return streams.groupBy("chunk_id").applyInArrow(run, READ_BACK)


def options_json(o: Options) -> str:
    return json.dumps(asdict(o))
