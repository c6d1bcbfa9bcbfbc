"""Shared pieces of the training-data operators."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

#: Folder of the public tokenizers' vocabulary files.
TOKENIZERS = "/opt/tokenizers"

#: Split pattern of the byte-level BPE vocabularies, in Java's notation.
PRETOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"

# What may be one pre-token with a character that Java's Unicode tables lack: the runs of one class on both sides of it.
_RUN = r"(?:\p{L}+|\p{N}+|[^\p{IsWhite_Space}\p{L}\p{N}\p{Cn}]+)"
UNASSIGNED = rf" ?{_RUN}?(?:\p{{Cn}}+(?:{_RUN}(?:(?<=')\p{{L}}+)?)?)+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_ranks(folder: str, name: str) -> dict[bytes, int]:
    """Byte strings of a .tiktoken vocabulary with their ids."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def byte_encoder(folder: str, name: str):
    """The byte-level BPE encoder of a vocabulary; loaded once per process."""
    import importlib.util

    import tiktoken

    spec = importlib.util.spec_from_file_location("_tokenizer_files", os.path.join(folder, "__init__.py"))
    files = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(files)
    return tiktoken.Encoding(name, pat_str=files.PATTERN, mergeable_ranks=read_ranks(folder, name), special_tokens={})
