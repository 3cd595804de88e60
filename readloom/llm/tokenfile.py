"""Token-ID output: Arrow IPC files of fixed-size-list batches (method 10).

Documents in ascending doc_id are encoded, an end id is appended to each, and
the ids of a partition are laid end to end and cut into rows of `seq_len` ids
with a mask (false: padding after the last document of a file). Every row has
the same width and the batches are not compressed, so row r of a file is found
by arithmetic and read from a memory map without a copy. Beside each
`NAME.arrow` lies `NAME.docs.arrow`: doc_id, offset and n_tokens.

Order: one range exchange on doc_id and, for rows of one doc_id, the beginning of
the text. File names follow from the partition; each attempt of a task writes files
of its own and renames them at its end, so a repeated task leaves one whole file.

Edge cases: null doc_id sorts first; null text is an empty text (only the end
id); a repeated doc_id keeps all its rows, ordered by text; an empty table gives
no files; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEQ_LEN, BATCH_ROWS = 2048, 256
#: Entries of one generation of a worker's memory; of two the older one is then forgotten. Speed only.
REMEMBERED, LONGEST = 400_000, 64
#: Bytes of text that are encoded together (one text at least).
SLICE_BYTES = 8 << 20

# The normaliser and the splitting whose result white space cuts into independent parts.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, BYTES]}

#: Below this, a text is its own NFC, classes are settled, and a letter's lower case is one letter or has an ODD one.
PLAIN = 0x250
ODD = re.compile(f"[\x00-\x1f{chr(PLAIN)}-\U0010ffff]")


def members(major: str) -> str:
    return "".join(re.escape(chr(i)) for i in range(PLAIN) if unicodedata.category(chr(i))[0] == major)


#: SPLIT for text without ODD characters, after lower-casing.
PIECES = re.compile(SPLIT.replace(r"\s", r"\x20\x85\xa0").replace(r"\p{L}", members("L")).replace(r"\p{N}", members("N")))


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if visible Latin-1, else the next from U+0100."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(others)) for b in range(256)]


class Memory:
    """A dict in two generations."""

    def __init__(self) -> None:
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def found(self, keys: list[str], make) -> list[bytes]:
        """The value of each of the distinct keys; make(keys) gives those that are not known."""
        if len(self.new) > REMEMBERED:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        got = list(map(new.get, keys))
        missing = []
        for i, v in enumerate(got):
            if v is None:
                if (v := old.get(keys[i])) is None:
                    missing.append(i)
                else:
                    got[i] = new[keys[i]] = v
        for i, v in zip(missing, make([keys[i] for i in missing]), strict=True):
            got[i] = v
            if len(keys[i]) <= LONGEST:
                new[keys[i]] = v
        return got


class WordCache:
    """Ids of texts under a tokenizer.

    Where the tokenizer's own settings are those above, white space separates texts into chunks
    whose ids follow one another. A slice's distinct chunks are found by Arrow, those without an
    ODD character, in lower case too, are lower-cased and split as the tokenizer would, and only pieces that were not
    met before reach its BPE model. A chunk with an ODD character, or with an added token's text
    in any case, is given to the tokenizer as it is. With other settings whole texts are.
    """

    def __init__(self, path: str, dtype: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tok, self.dtype, self.width = Tokenizer.from_file(path), dtype, np.dtype(dtype).itemsize
        said = json.loads(self.tok.to_str())
        m = said["model"]
        self.by_chunk = said["normalizer"] == NORMALIZER and said["pre_tokenizer"] == PRE_TOKENIZER and m["type"] == "BPE" and not m["dropout"] and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in said["added_tokens"])
        #: What the tokenizer finds in raw text only.
        self.added = [t["content"].lower() for t in said["added_tokens"]]
        self.chunks, self.pieces, self.letters = Memory(), Memory(), byte_letters()

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def of_pieces(self, pieces: list[str]) -> list[bytes]:
        tokenize, letters = self.tok.model.tokenize, self.letters
        shown = [p if p.isascii() and "\x7f" not in p else "".join([letters[b] for b in p.encode()]) for p in pieces]
        return [np.array([t.id for t in tokenize(p)], self.dtype).tobytes() for p in shown]

    def of_chunks(self, chunks: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(chunks)
        raw, cut = [], []
        for i, c in enumerate(chunks):
            low = c.lower()
            if ODD.search(c) or ODD.search(low) or any(t in low for t in self.added):
                raw.append(i)
            else:
                cut.append((i, PIECES.findall(low)))
        some = list({p for _, ps in cut for p in ps})
        code = dict(zip(some, self.pieces.found(some, self.of_pieces), strict=True))
        for i, ps in cut:
            out[i] = b"".join([code[p] for p in ps])
        for i, v in zip(raw, self.whole([chunks[i] for i in raw]), strict=True):
            out[i] = v
        return out

    def ids(self, text: str) -> list[int]:
        """The tokenizer's own ids of one text."""
        return self.tok.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, counts = self.laid(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []

    def laid(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has."""
        texts = pc.fill_null(texts, "")
        if not self.by_chunk:
            ids = self.whole(texts.to_pylist())
            return np.frombuffer(b"".join(ids), self.dtype), np.array([len(x) // self.width for x in ids], np.int64)
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        every = self.chunks.found(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.of_chunks)
        size = np.fromiter(map(len, every), np.int64, len(every)) // self.width
        start, code = np.cumsum(size) - size, coded.indices.to_numpy()
        of = size[code]
        upto = np.concatenate(([0], np.cumsum(of)))
        at = np.repeat(start[code] - upto[:-1], of)
        at += np.arange(len(at))
        edges = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
        return np.frombuffer(b"".join(every), self.dtype)[at], np.diff(upto[edges])


CACHES: dict[tuple[str, str], WordCache] = {}


def cache_of(path: str, dtype: str) -> WordCache:
    """One a worker process, for all its tasks."""
    if (path, dtype) not in CACHES:
        CACHES.clear()
        CACHES[path, dtype] = WordCache(path, dtype)
    return CACHES[path, dtype]


def cut_by_bytes(b: pa.RecordBatch, column: int, most: int = SLICE_BYTES):
    """b in runs of rows whose texts have `most` bytes at most, or one row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at, before = 0, 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(size, before + most, side="right")))
        yield b.slice(at, to - at)
        at, before = to, int(size[to - 1])


def id_type(vocab: int) -> str:
    return "<u2" if vocab <= 1 << 16 else "<u4"


class Writer:
    """Rows of seq_len ids and masks into one Arrow IPC file."""

    def __init__(self, fs: pafs.FileSystem, path: str, dtype: str, seq_len: int) -> None:
        kind = pa.uint16() if dtype == "<u2" else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.path, self.dtype, self.kind, self.seq_len = path, np.dtype(dtype), kind, seq_len
        self.sink = fs.open_output_stream(path)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.pending: list[bytes] = []
        self.size = 0

    def add(self, ids: np.ndarray) -> None:
        self.pending.append(ids.tobytes())
        self.size += ids.nbytes
        if self.size >= self.seq_len * BATCH_ROWS * self.dtype.itemsize:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.pending), self.dtype)
        n = len(ids) if last else len(ids) // self.seq_len * self.seq_len
        rows = -(-n // self.seq_len)
        for at in range(0, rows, BATCH_ROWS):
            here = min(BATCH_ROWS, rows - at)
            part, mask = np.zeros(here * self.seq_len, self.dtype), np.zeros(here * self.seq_len, bool)
            some = ids[at * self.seq_len : min(n, (at + here) * self.seq_len)]
            part[: len(some)], mask[: len(some)] = some, True
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x, k), self.seq_len) for x, k in ((part, self.kind), (mask, pa.bool_()))]
            self.out.write_batch(pa.record_batch(lists, schema=self.schema))
        self.pending, self.size = [ids[n:].tobytes()], (len(ids) - n) * self.dtype.itemsize

    def close(self) -> None:
        self.flush(True)
        self.out.close()
        self.sink.close()


def renamed(fs: pafs.FileSystem, path: str, to: str) -> None:
    """Give a finished file its name; another attempt of the task may have done so with the same bytes."""
    try:
        fs.move(path, to)
    except OSError:
        if fs.get_file_info(to).type != pafs.FileType.File:
            raise
        fs.delete_file(path)


#: Characters of a text by which rows of one doc_id are dealt to tasks; the order within is that of whole texts.
RANGE_CHARS = 64
DOCS = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64())])


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, seq_len: int = SEQ_LEN) -> list[tuple[str, int, int, int]]:
    """Write the files; (name, first id's place among all ids, documents, ids) of each file, in order."""
    from tokenizers import Tokenizer

    dtype = id_type(max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1))

    def task(batches):
        fs, top = opened(folder)
        fs.create_dir(top, recursive=True)
        context = TaskContext.get()
        part = context.partitionId()
        name, own = f"part-{part:06d}", f"_{part:06d}-{context.taskAttemptId()}"
        writer, index, sink, total, rows = None, None, None, 0, 0
        cache = cache_of(tokenizer, dtype)
        for whole in batches:
            for b in cut_by_bytes(whole, 1):
                if writer is None:
                    writer = Writer(fs, f"{top}/{own}.arrow", dtype, seq_len)
                    sink = fs.open_output_stream(f"{top}/{own}.docs.arrow")
                    index = pa.ipc.new_file(sink, DOCS)
                ids, counts = cache.laid(b.column(1))
                counts = counts + 1
                ends = np.cumsum(counts)
                out = np.full(int(ends[-1]), end_id, dtype)
                plain = np.ones(len(out), bool)
                plain[ends - 1] = False
                out[plain] = ids
                writer.add(out)
                index.write_batch(pa.record_batch([b.column(0), pa.array(total + ends - counts, pa.int64()), pa.array(counts, pa.int64())], schema=DOCS))
                total += len(out)
                rows += b.num_rows
        if writer is not None:
            writer.close()
            index.close()
            sink.close()
            for kind in ("arrow", "docs.arrow"):
                renamed(fs, f"{top}/{own}.{kind}", f"{top}/{name}.{kind}")
            yield pa.record_batch({"part": pa.array([part], pa.int64()), "rows": pa.array([rows], pa.int64()), "ids": pa.array([total], pa.int64())})

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the beginning of the text, so that rows of one doc_id (or of none) are dealt out, in the order in which they are sorted
    ordered = rows.repartitionByRange(common.parts(spark), "doc_id", F.substring("text", 1, RANGE_CHARS)).sortWithinPartitions("doc_id", "text")
    made, start = [], 0
    for part, rows, ids in sorted(map(tuple, ordered.mapInArrow(task, "part long, rows long, ids long").collect())):  # a row a file
        made.append((f"part-{part:06d}", start, rows, ids))
        start += ids
    return made


def sequences(folder: str, name: str) -> pa.ipc.RecordBatchFileReader:
    """The rows of one file, memory-mapped if it is local: get_batch(r // BATCH_ROWS) holds row r."""
    fs, top = opened(folder)
    path = f"{top}/{name}.arrow"
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path))


def documents(spark, folder: str, made: list[tuple[str, int, int, int]]) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens and the crc32 of the ids as little-endian uint32."""

    def task(batches):
        fs, top = opened(folder)
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{top}/{name}.docs.arrow") as f:
                    index = pa.ipc.open_file(f).read_all()
                ids = runs(sequences(folder, name))
                counts = index["n_tokens"].to_numpy()
                crc = [zlib.crc32(ids(int(n)).astype("<u4")) for n in counts]
                yield pa.record_batch({"doc_id": index["doc_id"].combine_chunks(), "start": pa.array(index["offset"].to_numpy() + start), "n_tokens": pa.array(counts), "ids_crc32": pa.array(crc, pa.int64())})

    files = spark.createDataFrame([(n, s) for n, s, _, _ in made], "name string, start long").repartition(max(1, len(made)))
    return files.mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def runs(reader: pa.ipc.RecordBatchFileReader):
    """A function that returns the next n ids (those with a true mask) at each call."""
    state = {"k": 0, "left": np.zeros(0, np.uint16)}

    def take(n: int) -> np.ndarray:
        got, need = [], n
        while need:
            if not len(state["left"]):
                b = reader.get_batch(state["k"])
                ids, mask = b.column(0).flatten().to_numpy(), b.column(1).flatten()
                state["k"] += 1
                state["left"] = ids if mask.false_count == 0 else ids[: mask.true_count]  # padding is at the end
            some, state["left"] = state["left"][:need], state["left"][need:]
            got.append(some)
            need -= len(some)
        return got[0] if len(got) == 1 else np.concatenate(got) if got else np.zeros(0, np.uint16)

    return take


def op10(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = common.shared_dir(spark, "tokens")
    made = write(common.table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return documents(spark, folder, made)
