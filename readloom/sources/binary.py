"""The binary layout of containers that other tools write: header and, chunk after chunk, fields, tables and payloads.

Everything but the payloads is read, whose codecs are not available here: of each its place,
size and parts. Payloads are passed over, so memory follows a chunk's tables. A chunk is found
only by reading the one before, so a file is one task's work, and files are read in parallel.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..schema import COLUMN_ENCODINGS, COLUMN_KINDS, ID_MODES, MAGIC, PACK_ORDERS, QUALITY_CODECS, QUALITY_LAYOUTS, VERSION, VERSIONS
from . import fastq

# Little-endian fields of a chunk, in order, with the version that brought them.
HEADER, HEADER_BYTES = "<II", 8
FIELDS = (
    "Q records", "Q line_offsets",
    "B id_mode", "Q id_original", "Q id_separators", "Q id_kinds", "Q id_columns", "Q id_flat_original", "Q id_flat_payload", "Q id_flat_chunks",
    "Q base_original", "I n_block", "B base_codec", "B pack_order 17", "Q packed_original", "Q packed_payload", "Q packed_chunks", "Q unpacked_chunks",
    "Q n_counts_original", "Q n_counts_payload", "Q n_positions_original", "Q n_positions_payload", "Q n_position_chunks",
    "B quality_codec", "B quality_layout", "I quality_fixed_len", "B quality_transposed", "Q quality_original", "Q quality_payload", "Q quality_chunks",
    "Q line_original", "Q line_payload", "Q line_chunks", "Q plus_kinds 18",
)


def fields_of(version: int) -> list[tuple[str, str]]:
    return [(f[0], f[1]) for f in map(str.split, FIELDS) if len(f) < 3 or int(f[2]) <= version]


def pack_header(version: int = VERSION) -> bytes:
    return struct.pack(HEADER, MAGIC, version)


def unpack_header(data: bytes) -> int:
    """The version; fails on another magic number, an unknown version or too few bytes."""
    if len(data) < HEADER_BYTES:
        raise ValueError("the header is cut short")
    magic, version = struct.unpack_from(HEADER, data)
    if magic != MAGIC:
        raise ValueError("not a container")
    if version not in VERSIONS:
        raise ValueError(f"container version {version} is not supported")
    return version


def pack_fields(values: dict[str, int], version: int = VERSION) -> bytes:
    own = fields_of(version)
    return struct.pack("<" + "".join(k for k, _ in own), *[values.get(n, 0) for _, n in own])


def unpack_fields(data: bytes, version: int = VERSION) -> dict[str, int] | None:
    """A chunk's fixed fields; None at a clean end, an error within a chunk."""
    own = fields_of(version)
    kind = struct.Struct("<" + "".join(k for k, _ in own))
    if not data:
        return None
    if len(data) < kind.size:
        raise ValueError("a chunk's fields are cut short")
    return dict(zip([n for _, n in own], kind.unpack_from(data), strict=True))


# The fields of an identifier column, and what follows the fields of a chunk: payloads' names and sizes, and tables of parts' sizes.
COLUMN = ("B kind", "B encoding", "Q text", "Q original", "Q payload", "Q parts", "Q lengths_original", "Q lengths_payload", "Q lengths_parts")
PAYLOADS = (("packed", "packed_payload", "packed_chunks"), ("n_counts", "n_counts_payload", None), ("n_positions", "n_positions_payload", "n_position_chunks"), ("quality", "quality_payload", "quality_chunks"), ("line_lengths", "line_payload", "line_chunks"))
TABLES = ("packed_chunks", "unpacked_chunks", "n_position_chunks", "quality_chunks", "quality_chunks", "line_chunks")


class Bytes:
    """Reads on from a file's place; fewer bytes than asked for are an error."""

    def __init__(self, raw) -> None:
        self.raw, self.at = raw, 0

    def take(self, n: int, none: bool = False) -> bytes:
        data = self.raw.read(n)
        self.at += len(data)
        if len(data) != n and not (none and not data):
            raise ValueError("a chunk is cut short")
        return bytes(data)

    def numbers(self, kind: str, n: int) -> list[int]:
        return list(struct.unpack(f"<{n}{kind}", self.take(n * struct.calcsize(f"<{kind}"))))

    def text(self) -> str:
        return self.take(self.numbers("Q", 1)[0]).decode("utf-8", "replace")

    def skip(self, n: int, size: int) -> int:
        """Pass over n bytes of a file of this size; where they began."""
        began, self.at = self.at, self.at + n
        if self.at > size:
            raise ValueError("a payload is cut short")
        self.raw.seek(self.at)
        return began


def chunk(f: Bytes, version: int, size: int) -> dict | None:
    """The next chunk: its fields, separators, kinds, columns, plus kinds (a count of each) and streams; None at a clean end."""
    own = unpack_fields(f.take(struct.calcsize("<" + "".join(k for k, _ in fields_of(version))), none=True), version)
    if own is None:
        return None
    out: dict = dict(own) | {"separators": [f.text() for _ in range(own["id_separators"])], "kinds": f.numbers("B", own["id_kinds"])}
    flat, columns = f.numbers("Q", own["id_flat_chunks"]), []
    for _ in range(own["id_columns"]):
        c = dict(zip([x.split()[1] for x in COLUMN], struct.unpack("<" + "".join(x[0] for x in COLUMN), f.take(struct.calcsize("<" + "".join(x[0] for x in COLUMN)))), strict=True))
        columns.append(c | {"values_of": f.numbers("Q", c["parts"]), "lengths_of": f.numbers("Q", c["lengths_parts"])})
    tables = [f.numbers("Q", own[n]) for n in TABLES]
    parts = {"packed_chunks": tables[0], "n_position_chunks": tables[2], "quality_chunks": tables[3], "line_chunks": tables[5]}
    plus = f.take(own.get("plus_kinds", 0))
    streams = [("id_flat", own["id_flat_payload"], flat)]
    for k, c in enumerate(columns):
        streams += [(f"id_values {k}", c["payload"], c["values_of"]), (f"id_lengths {k}", c["lengths_payload"], c["lengths_of"])]
    streams += [(name, own[n], parts[t] if t else [own[n]] * bool(own[n])) for name, n, t in PAYLOADS]
    out["streams"] = []
    for name, n, of in streams:
        if sum(of) != n:
            raise ValueError(f"{name}: the parts do not add up to the payload")
        out["streams"].append({"name": name, "at": f.skip(n, size), "bytes": n, "parts": of})
    if len(plus) not in (0, own["records"]):
        raise ValueError("plus kinds do not fit the records")
    bare = own["records"] if not plus else plus.count(0)
    return out | {"columns": columns, "bare_plus": bare, "copied_plus": own["records"] - bare}


def pack_chunk(values: dict, version: int = VERSION) -> bytes:
    """The bytes of a chunk as chunk() reads it: fields by name, separators, kinds, columns, plus (bytes), tables (six lists) and payloads (list of bytes)."""
    flat, tables, columns, payloads = values.get("flat_parts", []), values["tables"], values.get("columns", []), values["payloads"]
    own = dict(values["fields"]) | {"id_separators": len(values.get("separators", [])), "id_kinds": len(values.get("kinds", [])), "id_columns": len(columns), "id_flat_chunks": len(flat), "plus_kinds": len(values.get("plus", b""))}
    own |= {n: len(t) for n, t in zip(TABLES, tables, strict=True)}
    numbers = lambda of: struct.pack(f"<{len(of)}Q", *of)
    out = [pack_fields(own, version)]
    out += [struct.pack("<Q", len(s.encode())) + s.encode() for s in values.get("separators", [])]
    out += [bytes(values.get("kinds", [])), numbers(flat)]
    for c in columns:
        out += [struct.pack("<" + "".join(x[0] for x in COLUMN), *[c[x.split()[1]] for x in COLUMN]), numbers(c["values_of"]), numbers(c["lengths_of"])]
    return b"".join([*out, *map(numbers, tables), values.get("plus", b"") if version >= 18 else b"", *payloads])


def name_of(names: dict[str, int], code: int) -> str:
    return next((k for k, v in names.items() if v == code), f"unknown {code}")


ROWS = "path string, version int, chunk int, records long, id_mode string, separators array<string>, kinds array<string>, columns array<struct<kind:string,encoding:string,text:long,payload:long,lengths_payload:long>>, base_codec int, pack_order string, quality_codec string, quality_layout string, quality_fixed_len long, transposed boolean, bare_plus long, copied_plus long, streams array<struct<name:string,at:long,bytes:long,parts:array<long>>>"


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """ROWS: a row a chunk of the binary containers in a file or folder. What is cut short fails the task."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(ROWS))

    def run(batches):
        for b in batches:
            for p, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                with fastq.opened(path)[0].open_input_file(p) as raw:
                    f = Bytes(raw)
                    version, k = unpack_header(f.take(HEADER_BYTES)), 0
                    while (c := chunk(f, version, size)) is not None:
                        columns = [{"kind": name_of(COLUMN_KINDS, x["kind"]), "encoding": name_of(COLUMN_ENCODINGS, x["encoding"]), "text": x["text"], "payload": x["payload"], "lengths_payload": x["lengths_payload"]} for x in c["columns"]]
                        rows.append({"path": p, "version": version, "chunk": k, "records": c["records"], "id_mode": name_of(ID_MODES, c["id_mode"]), "separators": c["separators"], "kinds": [name_of(COLUMN_KINDS, x) for x in c["kinds"]], "columns": columns, "base_codec": c["base_codec"], "pack_order": name_of(PACK_ORDERS, c.get("pack_order", PACK_ORDERS["tgca"])), "quality_codec": name_of(QUALITY_CODECS, c["quality_codec"]), "quality_layout": name_of(QUALITY_LAYOUTS, c["quality_layout"]), "quality_fixed_len": c["quality_fixed_len"], "transposed": bool(c["quality_transposed"]), "bare_plus": c["bare_plus"], "copied_plus": c["copied_plus"], "streams": c["streams"]})
                        k += 1
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    found = fastq.files(path)
    files = spark.createDataFrame(found, "path string, size long").repartition(max(1, min(len(found), 10_000)))
    return files.mapInArrow(run, ROWS)
