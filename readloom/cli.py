"""python -m readloom.cli compress|decompress|roundtrip IN OUT [options]"""

from __future__ import annotations

import argparse
import json
import os
import sys

from .functions.codecs import NAMES
from .operators.chunks import Options
from .schema import PACK_ORDERS


def positive(text: str) -> int:
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError("must be positive")
    return n


def setting(name: str, default: str) -> str:
    """A flag's default: the environment's READLOOM_<name>, or the given one."""
    return os.environ.get(f"READLOOM_{name}", default)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="readloom")
    p.add_argument("command", choices=("compress", "decompress", "roundtrip"))
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("--quality-codec", choices=NAMES, default=setting("QUALITY_CODEC", "bwt"))
    p.add_argument("--base-codec", choices=NAMES, default=setting("BASE_CODEC", "zstd"))
    p.add_argument("--base-pack-order", choices=sorted(PACK_ORDERS), default=setting("BASE_PACK_ORDER", "tgca"))
    p.add_argument("--transpose", action="store_true")
    p.add_argument("--mode", choices=("strict", "permissive"), default="strict")
    p.add_argument("--chunk-bytes", type=positive, default=setting("CHUNK_BYTES", str(8 << 20)))
    p.add_argument("--stat", action="store_true", help="print totals and seconds")
    p.add_argument("--log-stat", metavar="FILE", help="append them to a file")
    return p


def main(args: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(args)
    for name, value, known in (("QUALITY_CODEC", a.quality_codec, NAMES), ("BASE_CODEC", a.base_codec, NAMES), ("BASE_PACK_ORDER", a.base_pack_order, PACK_ORDERS)):
        if value not in known:  # argparse does not check defaults
            print(f"error: READLOOM_{name} is {value!r}; there are {', '.join(sorted(known))}", file=sys.stderr)
            return 2
    from pyspark.sql import SparkSession

    from .plans import workflow

    spark = spark or SparkSession.builder.appName("readloom").getOrCreate()
    options = Options(quality_codec=a.quality_codec, base_codec=a.base_codec, pack_order=a.base_pack_order, transpose=a.transpose)
    try:
        if a.command == "compress":
            got = workflow.compress(spark, a.source, a.target, options, a.mode, a.chunk_bytes)
        elif a.command == "decompress":
            workflow.decompress(spark, a.source, a.target)
            got = {}
        else:
            got = workflow.roundtrip(spark, a.source, a.target, options)
            print("FAILED" if got["differences"] else "PASSED")
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if a.stat:
        print(json.dumps(got), file=sys.stderr)
    if a.log_stat:
        with open(a.log_stat, "a") as f:
            f.write(json.dumps({"command": a.command, "source": a.source} | got) + "\n")
    return int(bool(got.get("differences")))


if __name__ == "__main__":
    sys.exit(main())
