"""Best-fit packing of tokenised documents into sequences of bounded length.

Each partition packs its pieces online into a fixed number of open bins.  The open
bins are kept by free space, with one bit per free space that occurs: the tightest
bin that still takes a piece is the lowest set bit at or above the piece's length.
When a piece fits nowhere and all places are taken, the fullest bin closes.  The pieces
of bins still open at the end of a partition are packed again in the same way, in a
second round over few partitions, so the waste does not grow with the number of
partitions.  The second round takes them in the order of a hash: sorted by length they
would fill a bounded number of bins much worse.

Nulls and edges: a null text is empty and packs as the end mark alone; a null id
stays null; equal rows are separate documents; pieces of equal length fill the bin
opened last among those of equal room; an empty table gives an empty result.  Texts of
any length are encoded whole and cut into pieces of the size; columns other than the
named ones are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafonda.llm import textkit as T
from grafonda.llm.chunks import ChunkCache, WordPieces, numbers, split_chunks
from grafonda.llm.common import in_arrow, read, require, tokenizer_path
from grafonda.plans.scratch import cut


class OpenBins:
    """At most `places` open bins of `size`; `put` gives (bin, offset) and lists the bins that it closed."""

    def __init__(self, size: int, places: int) -> None:
        self.size, self.places = size, places
        self.bits = 0
        self.at: dict[int, list[int]] = {}
        self.count = self.made = 0

    def _take(self, free: int) -> int:
        names = self.at[free]
        name = names.pop()
        if not names:
            del self.at[free]
            self.bits &= ~(1 << free)
        return name

    def put(self, length: int) -> tuple[int, int]:
        """Place a piece of 1 to `size` tokens."""
        fit = self.bits >> length
        if fit:
            free = length + (fit & -fit).bit_length() - 1
            name = self._take(free)
        else:
            if self.count == self.places:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.count -= 1
            free, name = self.size, self.made
            self.made += 1
            self.count += 1
        left = free - length
        if left:
            self.at.setdefault(left, []).append(name)
            self.bits |= 1 << left
        else:
            self.count -= 1
        return name, self.size - free

    def open(self) -> dict[int, int]:
        """Free space of each bin that is still open."""
        return {name: free for free, names in self.at.items() for name in names}


@lru_cache(maxsize=2)
def _cache(path: str) -> ChunkCache:
    return ChunkCache(WordPieces(path))


def _pieces(docs: DataFrame, path: str, end_id: int, size: int, places: int, keep_cache: bool) -> DataFrame:
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "is_open"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cache, bins = _cache(path), OpenBins(size, places)
        base = TaskContext.get().partitionId() << 33
        end = end_id.to_bytes(4, "little")
        rows: list[tuple] = []
        held: dict[int, list[tuple]] = {}  # rows of bins that may still be open

        def flush(rows: list[tuple], is_open: bool) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([is_open] * len(rows))], names=names)

        for whole in batches:
            for part in T.slices(whole, "text"):
                chunks = [split_chunks(text or "") for text in part.column("text").to_pylist()]
                for doc, own in zip(part.column("id").to_pylist(), cache.texts(chunks), strict=True):
                    ids = numbers(own + end)
                    for piece, start in enumerate(range(0, len(ids), size)):
                        chunk = ids[start : start + size]
                        name, offset = bins.put(len(chunk))
                        held.setdefault(name, []).append((doc, piece, start, len(chunk), zlib.crc32(chunk.tobytes()), base + name, offset))
            still = bins.open()
            for name in [n for n in held if n not in still]:
                rows += held.pop(name)
            if len(rows) >= 4096:
                yield flush(rows, False)
                rows = []
        still = bins.open()
        rows += [r for n, rs in held.items() if n not in still for r in rs]
        if rows:
            yield flush(rows, False)
        rest = [r for n in still for r in held[n]]
        if rest:
            yield flush(rest, True)
        if not keep_cache:
            del cache
            _cache.cache_clear()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, is_open boolean"
    return in_arrow(docs, run, schema)


def _repack(pieces: DataFrame, size: int, places: int) -> DataFrame:
    """The pieces of bins that stayed open, in their order, with new bins and offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = OpenBins(size, places)
        base = -((TaskContext.get().partitionId() + 1) << 33)  # negative: apart from the first round's numbers
        for batch in batches:
            placed = [packer.put(x) for x in batch.column("length").to_pylist()]
            for column, values in (("bin", [p[0] + base for p in placed]), ("offset", [p[1] for p in placed])):
                at = batch.schema.get_field_index(column)
                batch = batch.set_column(at, column, pa.array(values, pa.int64()))  # noqa: PLW2901
            yield batch

    return in_arrow(pieces, run, pieces.schema)


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 1,
    size: int = 4096,
    places: int = 512,
    pieces_per_task: int = 200_000,
    keep_cache: bool = True,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): where each piece of each document lies.

    `places` bounds the open bins of a task in both rounds, `pieces_per_task` what one
    task of the second round packs.  Workers keep the cache of encoded words for their next
    task unless `keep_cache` is false, which saves memory for other work.
    """
    spark = docs.sparkSession
    rows = require(docs, id_col, text_col).toDF("id", "text").withColumn("id", F.col("id").cast("long"))
    pieces = cut(_pieces(rows, tokenizer or tokenizer_path("word_bpe_49k.json"), end_id, size, places, keep_cache))
    left = pieces.where("is_open")
    tasks = max(1, -(-left.count() // pieces_per_task))
    order = left.repartition(tasks, "bin").sortWithinPartitions(F.xxhash64("doc_id", "piece", "ids_crc32"), "doc_id", "piece", "ids_crc32")
    out = _repack(order, size, places).withColumnRenamed("bin", "sequence_id")
    closed = pieces.where("not is_open").withColumnRenamed("bin", "sequence_id")
    keep = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return closed.select(*keep).union(out.select(*keep))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the packing of all documents into sequences of 4096 tokens."""
    return pack(read(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: what is left is packed; nulls, empty tables, long texts and extra columns as for `pack`."""
    return pack(docs, keep_cache=False)
