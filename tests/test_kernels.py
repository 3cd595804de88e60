import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from readloom.functions import codecs, kernels

BASES = st.text("ACGTN", max_size=400).map(str.encode)
INTS = st.lists(st.integers(-(1 << 31), (1 << 31) - 1), max_size=60)


@settings(deadline=None, max_examples=60)
@given(BASES, st.sampled_from(["tgca", "acgt"]), st.sampled_from([1, 7, 64]))
def test_bases_round_trip(s, order, block):
    counts, deltas = kernels.n_mask(s, block)
    assert len(counts) == -(-len(s) // block)
    back = kernels.put_n(kernels.unpack(kernels.pack(s, order), len(s), order), counts, deltas, block)
    assert back.tobytes() == s


def test_pack_is_low_bits_first_and_padded():
    assert kernels.pack(b"ACGTA", "acgt") == bytes([0 | 1 << 2 | 2 << 4 | 3 << 6, 0])
    assert kernels.pack(b"TGCAN", "tgca") == bytes([0 | 1 << 2 | 2 << 4 | 3 << 6, 3])
    assert kernels.pack(b"") == b""


def test_lower_case_packs_as_upper_case():
    assert kernels.pack(b"acgtn") == kernels.pack(b"ACGTN")


def test_a_bad_base_is_named_by_its_first_place():
    assert kernels.first_bad_base(b"ACXGY") == 2
    with pytest.raises(ValueError, match="offset 2"):
        kernels.pack(b"ACXGY")


def test_n_at_block_borders():
    s = bytearray(b"A" * 20000)
    for i in (0, 8191, 8192, 16383, 16384):
        s[i] = ord("N")
    counts, deltas = kernels.n_mask(bytes(s))
    assert counts.tolist() == [2, 2, 1]
    assert deltas.tolist() == [0, 8191, 0, 8191, 0]
    assert kernels.n_mask(b"N" * 8193)[0].tolist() == [8192, 1]


@settings(deadline=None, max_examples=60)
@given(INTS)
def test_delta_zigzag_varint_round_trip(v):
    a = np.array(v, np.int64)
    d = kernels.delta(a)
    z = kernels.zigzag(d)
    data = kernels.varint(z)
    assert (kernels.unvarint(data, len(v)) == z).all()
    assert (kernels.unzigzag(z) == d).all()
    # a wrapped difference is not restored but reported
    if all(-(1 << 31) <= y - x < 1 << 31 for x, y in zip([0, *v], v, strict=False)):
        assert kernels.undelta(d).tolist() == v


@pytest.mark.parametrize(("v", "size"), [(63, 1), (64, 2), (-64, 1), (-65, 2), (8191, 2), (8192, 3), ((1 << 31) - 1, 5)])
def test_varint_borders(v, size):
    assert len(kernels.varint(kernels.zigzag(np.array([v])))) == size


def test_varint_errors():
    for data, n in ((b"\x80", 1), (b"\x01\x01", 1), (b"\x80\x80\x80\x80\x80\x01", 1), (b"", 1)):
        with pytest.raises(ValueError):
            kernels.unvarint(data, n)


def test_delta_overflow():
    with pytest.raises(ValueError):
        kernels.undelta(np.array([(1 << 31) - 1, 1]))


@given(st.integers(0, 9), st.integers(1, 9))
def test_transpose_round_trip(n, width):
    q = bytes(range(n * width))
    assert kernels.untranspose(kernels.transpose(q, n, width), n, width) == q
    with pytest.raises(ValueError):
        kernels.transpose(q + b"x", n, width)


@pytest.mark.parametrize("codec", codecs.NAMES)
@pytest.mark.parametrize("data", [b"", b"x", b"ACGT" * 5000])
def test_codecs_round_trip(codec, data):
    assert codecs.decompress(codecs.compress(data, codec), codec, len(data)) == data
    if data:
        with pytest.raises(Exception):  # noqa: B017
            codecs.decompress(codecs.compress(data, codec), codec, len(data) + 1)


def test_slices_and_cut():
    assert codecs.slices(b"abcde", 2) == [b"ab", b"cd", b"e"]
    assert kernels.cut(b"abcde", np.array([2, 0, 3])) == [b"ab", b"", b"cde"]
    with pytest.raises(ValueError):
        kernels.cut(b"abc", np.array([2]))
    with pytest.raises(ValueError):
        codecs.compress(b"x", "lzma")


def test_compressed_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(bytearray(b"aaaa" * 100),), (None,)], "b binary")
    c = df.withColumn("c", codecs.compressed(F.col("b"), "zstd"))
    back = c.withColumn("d", codecs.decompressed(F.col("c"), F.coalesce(F.octet_length("b"), F.lit(0)), "zstd"))
    assert back.where("d <=> b").count() == 2
    assert c.where("length(c) < 400").count() == 1


def test_shared_folders_are_cleared(spark):
    import os

    from readloom import storage

    path = storage.shared_dir(spark, "x")
    spark.range(3).write.parquet(path)
    assert os.path.isdir(path)
    storage.clear(spark)
    assert not os.path.isdir(path)
