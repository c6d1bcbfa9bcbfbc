"""Spark types of the canonical record and helpers to build it."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the wire format.
SCHEMA_TAG = "tl-corpus-v1"
IGNORE_INDEX = -100
PAD, UNK, BOS, EOS, SPACE, NEWLINE, TAB = "<pad>", "<unk>", "<bos>", "<eos>", "<space>", "<newline>", "<tab>"
SPECIAL_TOKENS = (PAD, UNK, BOS, EOS, SPACE, NEWLINE, TAB)
ROLES = ("system", "user", "assistant", "text")
ROLE_LABELS = {"system": "System", "user": "User", "assistant": "Assistant"}
ROLE_ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant"}
DIALOG_ROLE_ALIASES = {"usr": "user", "sys": "assistant"}
TASK_SYNONYMS = {
    "lm": ("lm", "pretrain", "pretraining", "text"),
    "sft": ("sft", "chat", "instruction"),
    "preference": ("preference", "pref", "dpo", "orpo", "rlhf"),
}

SEGMENT = T.StructType(
    [
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("train", T.BooleanType()),
    ]
)
SEGMENTS = T.ArrayType(SEGMENT)
SEGMENTS_DDL = "array<struct<role:string,content:string,train:boolean>>"

RECORD = T.StructType(
    [
        T.StructField("schema", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("task", T.StringType()),
        T.StructField("segments", SEGMENTS),
        T.StructField("rejected_segments", SEGMENTS),
        T.StructField("meta", T.StringType()),
    ]
)
