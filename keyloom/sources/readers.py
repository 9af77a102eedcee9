"""Batch sources and sinks: Parquet logs and tables, command lines, configuration."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_log(spark: SparkSession, path: str, since: int | None = None) -> DataFrame:
    """A Parquet effect log; ``since`` prunes whole segments by their partition column."""
    log = spark.read.parquet(path)
    return log if since is None else log.filter(F.col("offset") >= since)


def append_log(effects: DataFrame, path: str, segment: int) -> None:
    """Append records to a segment directory; readers see whole files only."""
    effects.withColumn("segment", F.lit(segment)).write.mode("append").partitionBy("segment").parquet(path)


_WORD = re.compile(r'"((?:[^"\\]|\\.)*)"|\'((?:[^\'\\]|\\\')*)\'|([^ \t\n\v\f\r]+)')
_SPACE = " \t\n\v\f\r"
#: Escapes in double quotes.
ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "a": "\a"}


def parse_inline(line: str | bytes) -> list[bytes]:
    """A command line with quoting: ``\\xHH`` and letter escapes in double quotes. Words are bytes as they stand."""
    out, at = [], 0
    # One character a byte, so that an escape is a byte and only ASCII spaces part words.
    line = (line.encode() if isinstance(line, str) else line).decode("latin-1").rstrip("\r\n")
    while at < len(line):
        if line[at] in _SPACE:
            at += 1
            continue
        m = _WORD.match(line, at)
        if line[at] in "\"'" and m[3] is not None:
            raise ValueError("unbalanced quotes in request")
        if m[1] is not None:
            word = re.sub(r"\\(?:x([0-9a-fA-F]{2})|(.))", lambda e: chr(int(e[1], 16)) if e[1] else ESCAPES.get(e[2], e[2]), m[1])
            out.append(word.encode("latin-1"))
        elif m[2] is not None:
            out.append(m[2].replace("\\'", "'").encode("latin-1"))
        else:
            out.append(m[3].encode("latin-1"))
        at = m.end()
        if at < len(line) and not line[at] in _SPACE:
            raise ValueError("unbalanced quotes in request")
    return out


def load_config(path: str | None = None, prefix: str = "KEYLOOM_", flags: dict[str, str] | None = None) -> dict[str, str]:
    """Directives of a file, then of the environment, then flags; later ones win."""
    out: dict[str, str] = {}
    if path:
        with open(path) as f:
            for line in f:
                words = parse_inline(line.split("#", 1)[0])
                if words:
                    out[words[0].decode().lower()] = b" ".join(words[1:]).decode()
    out |= {k[len(prefix) :].lower().replace("_", "-"): v for k, v in os.environ.items() if k.startswith(prefix)}
    return out | (flags or {})


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], schema.struct(ddl))
