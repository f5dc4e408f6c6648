"""MinHash fingerprints of documents, and near duplicates through their signature bands.

A fingerprint is the MinHash signature of the text's distinct five-word shingles
(A-Z lower-cased; fewer words: the whole sequence), 128 universal hash permutations
computed in numpy over a batch of texts at a time, 16 bits each, as lowercase hex.
The likeness of two fingerprints is the share of equal slots, an estimate of the
sets' Jaccard similarity.  `near_duplicates` joins signature bands in Spark and
verifies the Jaccard similarity of full shingle sets.

Comparing each document with the one after it in an order needs no window over the
whole table: the order is cut at quantiles into ranges, each range is sorted in one
task, and the first row of a range is also sent to the end of the range before it.

Nulls and edges: a null text is empty; all texts without words share one
fingerprint and are alike to the degree 1; null ids come after all others in
descending order; rows with equal ids are ordered by a hash of the text, then by the
text (rows equal in both are interchangeable and lie in one range); the only row of a
table is its own next one; an empty table gives an empty result.  Texts of any length
are read whole; columns other than the named ones are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafonda.llm import textkit as T
from grafonda.llm.common import in_arrow, read, require
from grafonda.llm.near_dedup import near_duplicate_classes

SLOTS, WORDS = 128, 5


def signatures(texts: pa.Array, hasher: T.MinHash, words: int = WORDS) -> np.ndarray:
    """uint16 matrix of the texts' signatures."""
    values, first = T.shingle_sets(texts, words)
    return (hasher.sign(values, first) >> 16).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots, row by row."""
    return (a == b).mean(axis=1) if len(a) else np.zeros(0)


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, slots: int = SLOTS) -> DataFrame:
    """(id, fingerprint) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = T.MinHash(slots)
        for whole in batches:
            for part in T.slices(whole, "text"):
                sig = signatures(part.column("text"), hasher, words)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([row.tobytes().hex() for row in sig], pa.string())], names=["id", "fingerprint"])

    rows = require(docs, id_col, text_col).toDF("id", "text").withColumn("id", F.col("id").cast("long"))
    return in_arrow(rows, run, "id long, fingerprint string")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, pct: int = 80, bands: int = 40, rows: int = 5) -> DataFrame:
    """(id, n_shingles, component_id): signature bands are joined, Jaccard similarity is verified on full sets."""
    return near_duplicate_classes(docs, id_col=id_col, text_col=text_col, words=words, pct=pct, bands=bands, rows=rows)


def edited(text: str, following: str) -> str:
    """text with its last third (code points, rounded down) replaced by the start of the following text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


class Ranges:
    """Cuts an order by (key, tie) into ranges of about `per_range` rows; range 0 comes first in descending order.

    Keys are cut at quantiles, found in two steps so that neither holds more than
    COARSE of them at a time.  A key that several quantiles fall on has rows for
    several ranges: those rows are dealt on by `tie`, a hash of the text.  What is
    kept is one bound for `per_range` rows.
    """

    COARSE = 4096

    def __init__(self, rows: DataFrame, per_range: int) -> None:
        count = max(1, rows.count() // per_range)
        coarse = min(count, self.COARSE)
        bounds = self._quantiles(rows, [], coarse)[0] if count > 1 else []
        fine = -(-count // coarse)
        if fine > 1:
            inner = self._quantiles(rows, sorted(set(bounds)), fine)
            bounds = sorted([*bounds, *(x for xs in inner for x in xs)])
        self.keys, self.slots = np.unique(np.array(bounds, np.int64), return_counts=True)
        self.first = np.concatenate([[0], np.cumsum(self.slots)])

    @staticmethod
    def _quantiles(rows: DataFrame, bounds: list[int], count: int) -> list[list[int]]:
        """For each stretch between bounds, the keys that cut its rows into `count` parts."""
        shares, known = [i / count for i in range(1, count)], np.array(bounds, np.int64)

        def spot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.searchsorted(known, np.asarray(batch.column("key"))))], names=["key", "stretch"])

        placed = in_arrow(rows.select("key"), spot, "key long, stretch long")
        return [r["q"] for r in placed.groupBy("stretch").agg(F.percentile_approx("key", shares, 20_000).alias("q")).collect()]

    def of(self, key: np.ndarray, tie: np.ndarray) -> np.ndarray:
        """The range of each row, counted from the end of the order."""
        at = np.searchsorted(self.keys, key)
        out = self.first[at]
        same = np.flatnonzero(at < len(self.keys))
        same = same[self.keys[at[same]] == key[same]]
        share = (tie[same].view(np.uint64) >> np.uint64(11)).astype(np.float64) / 2**53
        out[same] += (share * self.slots[at[same]]).astype(np.int64)
        return out


def with_next(docs: DataFrame, apply, schema: str, per_range: int = 4000) -> DataFrame:  # noqa: ANN001
    """apply(ids, texts, next_texts) -> RecordBatch over consecutive rows (id, text) in descending order of id.

    The row after the last is the first.  Ranges are sorted in one task each; the
    first row of a range, which is known by its key, tie and text, is also sent to the
    end of the range before it.
    """
    least = -(2**63)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("id", text.alias("text"), F.coalesce("id", F.lit(least)).alias("key"), F.xxhash64(text).alias("tie"))
    ranges = Ranges(rows.select("key"), per_range)
    flip = np.int64(least)  # an unsigned order of ties

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, tie = (np.asarray(batch.column(c)) for c in ("key", "tie"))
            yield pa.RecordBatch.from_arrays([pa.array(ranges.of(key, tie)), batch.column("key"), pa.array(tie ^ flip)], names=["range", "key", "tie"])

    found = in_arrow(rows.select("key", "tie"), placed, "range long, key long, tie long").groupBy("range").agg(F.max(F.struct("key", "tie")).alias("head"))
    heads = sorted(((r["range"], r["head"]["key"], r["head"]["tie"]) for r in found.collect()), reverse=True)
    #: ranges in the order of processing; the rows of a head's key and tie are copied to the range before it
    before = {(key, tie): (heads[i - 1][0], at) for i, (at, key, tie) in enumerate(heads)}
    head_keys = np.array(sorted({key for key, _ in before}), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "text", "key", "tie", "range", "guard"]
        for batch in batches:
            key, tie = (np.asarray(batch.column(c)) for c in ("key", "tie"))
            own, order = ranges.of(key, tie), tie ^ flip
            columns = [*(batch.column(c) for c in ("id", "text", "key")), pa.array(order)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(own), pa.array(np.zeros(len(key), bool))], names=names)
            near = [i for i in np.flatnonzero(np.isin(key, head_keys)).tolist() if (int(key[i]), int(order[i])) in before]
            if near:
                copies, to = pa.RecordBatch.from_arrays(columns, names=names[:4]).take(pa.array(near)), [before[int(key[i]), int(order[i])][0] for i in near]
                yield pa.RecordBatch.from_arrays([*copies.columns, pa.array(to, pa.int64()), pa.array(np.ones(len(near), bool))], names=names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row, which still waits for its next one
        for whole in batches:
            for part in T.slices(whole, "text"):
                ids, texts, ranges, guards = (part.column(c).to_pylist() for c in ("id", "text", "range", "guard"))
                rows = [] if held is None else [held]
                rows += zip(ids, texts, ranges, guards, strict=True)
                held = None
                done = [(a[0], a[1], b[1]) for a, b in zip(rows[:-1], rows[1:], strict=True) if not a[3] and a[2] == b[2]]
                if not rows[-1][3]:
                    held = rows[-1]
                if done:
                    yield apply(*(list(x) for x in zip(*done, strict=True)))

    dealt = in_arrow(rows, deal, "id long, text string, key long, tie long, range long, guard boolean")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(heads) // 4, 1)
    ordered = dealt.repartition(parts, "range").sortWithinPartitions("range", "guard", F.desc("key"), F.desc("tie"), "text")
    return in_arrow(ordered.select("id", "text", "range", "guard"), walk, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: fingerprints of every document and of its edited text, and their likeness."""
    docs = require(read(spark, sf_dir, "documents"), "doc_id", "text").toDF("id", "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def apply(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
        hasher = T.MinHash(SLOTS)
        changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
        # neighbours follow each other: the next row's signature is computed once
        sig = signatures(pa.array([*texts, following[-1]], pa.string()), hasher)
        breaks = [i for i in range(len(texts) - 1) if texts[i + 1] is not following[i] and texts[i + 1] != following[i]]
        after = sig[1:].copy()
        if breaks:
            after[breaks] = signatures(pa.array([following[i] for i in breaks], pa.string()), hasher)
        mine, other = sig[:-1], signatures(pa.array(changed, pa.string()), hasher)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                pa.array([row.tobytes().hex() for row in mine]),
                pa.array([row.tobytes().hex() for row in other]),
                pa.array(likeness(mine, other)),
                pa.array(likeness(mine, after)),
            ],
            names=names,
        )

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, apply, schema)
