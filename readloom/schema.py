"""Names, codes and limits of the data model."""

from __future__ import annotations

#: Numeric codes and sizes of the container format.
MAGIC, VERSION, VERSIONS = 0x5A514647, 18, (16, 17, 18)
ID_MODES = {"flat": 0, "columnar": 1}
COLUMN_KINDS = {"string": 0, "int32": 1}
COLUMN_ENCODINGS = {"plain": 0, "delta": 1, "delta_varint": 2}
QUALITY_LAYOUTS = {"variable": 0, "fixed": 1}
QUALITY_CODECS = {"bwt": 0, "zstd": 1}
PACK_ORDERS = {"acgt": 0, "tgca": 1}
N_BLOCK, SAMPLE, SLICE_BYTES = 8192, 100, 16 << 20

#: Base -> 2-bit code, for each order; N has the code of A.
PACK_CODES = {"acgt": "ACGT", "tgca": "TGCA"}

READS = "rec long, chunk_id int, off long, identifier string, basecalls string, plus_kind int, quality string, file string"
STREAMS = "chunk_id int, stream string, col int, slice int, kind string, encoding string, codec string, n long, text_bytes long, raw_bytes long, comp_bytes long, payload binary"

#: Streams that every chunk has, and those that are a container's own.
ALWAYS, OWN = ("about", "bases", "line_lengths", "n_counts", "plus", "quality"), ("about", "case", "rec")
INT32_MAX = 2147483647
UINT32_MAX = 4294967295
