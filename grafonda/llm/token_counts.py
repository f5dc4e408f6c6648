"""Token counts of sections: whole documents are encoded once, token spans are joined to section spans.

Token lengths in bytes give the byte span of every token; a running count of
character starts turns them into character spans.  Sections are intervals that
cover the text without gaps, so the interval join is a binary search in the
sections' ends.  A token that crosses a boundary is allocated by rule: "majority"
gives it to the section that holds most of its characters (the earlier one on a
tie), "start" to the section of its first character.

Without a sections column the sections are the lines of the text, each with its line
feed.  Nulls and edges: a null or empty text has one section, number 0, without
characters or tokens; sections that a token skips entirely count 0; a null id stays
null; repeated rows give repeated results; texts of any length are encoded whole; an
empty table gives an empty result; columns other than the named ones are not read,
whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafonda.llm import textkit as T
from grafonda.llm.common import in_arrow, read, require, tokenizer_path


@lru_cache(maxsize=2)
def _encoding(path: str):  # noqa: ANN202
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def attribute(text: str, ends: np.ndarray, ids: np.ndarray, lengths: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section; `ends` are the sections' ends in characters, in order."""
    none = np.zeros(len(ends), np.int64)
    if not len(ids):
        return none, none
    raw = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1  # character that each byte belongs to
    stop = np.cumsum(lengths[ids])
    first, last = char[stop - lengths[ids]], char[stop - 1]
    a, b = (np.searchsorted(ends, x, side="right") for x in (first, last))
    home = a.copy()
    crossing = a != b
    if rule == "majority":
        for i in np.flatnonzero(crossing).tolist():
            cut = np.clip(np.concatenate([[first[i]], ends[a[i] : b[i]], [last[i] + 1]]), first[i], last[i] + 1)
            home[i] = a[i] + int(np.argmax(np.diff(cut)))
    return np.bincount(home, minlength=len(ends)), np.bincount(home[crossing], minlength=len(ends))


def _line_ends(text: str) -> np.ndarray:
    points = np.array([i for i, c in enumerate(text) if c == "\n"], np.int64) if "\n" in text else np.zeros(0, np.int64)
    ends = points + 1
    return ends if len(ends) and ends[-1] == len(text) else np.append(ends, len(text))


def section_tokens(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ends_col: str | None = None, ranks: str | None = None, rule: str = "majority"
) -> DataFrame:
    """(id, section, start, end, n_tokens, n_crossing): one row for each section of each document.

    `ends_col` names an array of section ends in characters, ascending; the last
    section is extended to the end of the text.
    """
    if rule not in ("majority", "start"):
        raise ValueError("rule is majority or start")
    spark = docs.sparkSession
    path = ranks or tokenizer_path("byte_bpe_50k.tiktoken")
    names = ["id", "section", "start", "end", "n_tokens", "n_crossing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = _encoding(path)
        for whole in batches:
            for part in T.slices(whole, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                given = part.column("ends").to_pylist() if ends_col else [None] * len(texts)
                columns: list[list[np.ndarray]] = [[] for _ in names[2:]]
                for text, own in zip(texts, given, strict=True):
                    ends = _line_ends(text)
                    if own is not None:
                        inner = sorted({e for e in own if e is not None and 0 < e < len(text)})
                        ends = np.array([*inner, len(text)], np.int64)
                    ids = encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
                    starts = np.concatenate([[0], ends[:-1]])
                    for column, value in zip(columns, (starts, ends, *attribute(text, ends, ids, lengths, rule)), strict=True):
                        column.append(value)
                counts = np.array([len(x) for x in columns[0]])
                rows = np.repeat(np.arange(len(texts)), counts)
                section = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
                flat = [pa.array(np.concatenate(c).astype(np.int64)) for c in columns]
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(rows)), pa.array(section), *flat], names=names)

    rows = require(docs, id_col, text_col, *([ends_col] if ends_col else []))
    rows = rows.toDF("id", "text", *(["ends"] if ends_col else [])).withColumn("id", F.col("id").cast("long"))
    return in_arrow(rows, run, "id long, section long, start long, end long, n_tokens long, n_crossing long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: tokens of every line of every document."""
    return section_tokens(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
