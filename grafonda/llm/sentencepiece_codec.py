"""SentencePiece encoding and decoding on the tokenizers library.

The model file is a protobuf; `parse_model` reads its wire format directly.  From
it `build` makes the equivalent tokenizers pipeline: normaliser (precompiled map,
white-space rules, metaspace marker), a Unigram model with the pieces' scores or a
BPE model whose merges are ordered by the merged piece's score, byte fallback, and
the matching decoder.

No piece crosses a marker from its left or holds a line feed in models of the usual
kind; `Codec` checks this on the pieces and then encodes chunks that begin at marker
runs and line feeds, each distinct chunk once, in multithreaded batches.  Texts of
other models are encoded whole, also in batches.  The ids are those of the rebuilt
pipeline in every case.  Parity is verified: every new chunk, or whole text, is also
encoded by the sentencepiece library, and each row says on how many of its chunks, or
whether on its text, the two differ.

Nulls and edges: null and empty texts have no tokens and decode to the empty text; a
null id stays null; repeated rows and texts give repeated results; an empty table gives
an empty result.  Texts of any length are encoded whole; columns other than the named
ones are not read, whatever their names.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafonda.llm import textkit as T
from grafonda.llm.chunks import ChunkCache, cut_after, numbers
from grafonda.llm.common import in_arrow, read, require, tokenizer_path

MARK = "▁"
#: Kinds of pieces and of models in the model file (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) pairs of one protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = buf[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(buf):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            value = buf[at : at + size]
            at += size
        yield key >> 3, value


def parse_model(data: bytes) -> dict:
    """Pieces (text, score, kind) and the settings that encoding needs."""
    model = {"pieces": [], "type": UNIGRAM, "byte_fallback": False, "charsmap": b"", "dummy_prefix": True, "squeeze": True}
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            model["pieces"].append((piece[1].decode(), score, piece.get(3, NORMAL)))
        elif number == 2:
            spec = dict(_fields(value))
            model["type"] = spec.get(3, UNIGRAM)
            model["byte_fallback"] = bool(spec.get(35, 0))
        elif number == 3:
            spec = dict(_fields(value))
            model["charsmap"] = spec.get(2, b"")
            model["dummy_prefix"] = bool(spec.get(3, 1))
            model["squeeze"] = bool(spec.get(4, 1))
    return model


def _merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Pairs of pieces that join to a piece, best score first; pairs of one piece by their parts' ids."""
    ids = {text: i for i, (text, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED)}
    found = []
    for text, i in ids.items():
        for k in range(1, len(text)):
            a, b = text[:k], text[k:]
            if a in ids and b in ids:
                found.append((-pieces[i][1], i, ids[a], ids[b]))
    return [(pieces[a][0], pieces[b][0]) for _, _, a, b in sorted(found)]


def build(model: dict, prefix: bool = True):  # noqa: ANN201
    """The tokenizers pipeline of a parsed model; without `prefix` no marker is put before the text."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    pieces = model["pieces"]
    unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), None)
    if model["type"] == UNIGRAM:
        core = models.Unigram([(t, s) for t, s, _ in pieces], unk_id=unknown, byte_fallback=model["byte_fallback"])
    elif model["type"] == BPE:
        vocab = {t: i for i, (t, _, _) in enumerate(pieces)}
        core = models.BPE(vocab, _merges(pieces), unk_token=pieces[unknown][0], fuse_unk=True, byte_fallback=model["byte_fallback"])
    else:
        raise ValueError("word and character models are not supported")
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model["charsmap"])] if model["charsmap"] else []
    if model["squeeze"]:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if prefix and model["dummy_prefix"]:
        steps.append(normalizers.Prepend(MARK))
    out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    undo = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    out.decoder = decoders.Sequence([*undo, decoders.Strip(" ", 1, 0)] if model["dummy_prefix"] else undo)
    return out


class Codec:
    """Encodes and decodes whole texts.

    `unequal` holds the chunks on which the two libraries disagree, `broken` those that
    the rebuilt decoder does not give back.
    """

    def __init__(self, path: str, threads: int = 2) -> None:
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        with open(path, "rb") as f:
            self.model = parse_model(f.read())
        self.pieces = self.model["pieces"]
        self.whole = build(self.model)
        self.native = sentencepiece.SentencePieceProcessor(model_file=path)
        inner = any(MARK in t.lstrip(MARK) or "\n" in t for t, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))
        plain = not self.model["charsmap"] and not self.model["squeeze"] and self.model["byte_fallback"]
        self.by_chunk = plain and not inner
        self.chunk = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
        self.tail = build(self.model, prefix=False)
        if self.by_chunk:
            self.tail.normalizer = None  # chunks are marked already
            self.tail.decoder = build(self.model | {"dummy_prefix": False}).decoder  # and keep their blanks
        self.unequal: set[str] = set()
        self.broken: set[str] = set()
        #: pairs of neighbouring characters inside pieces: no merge crosses any other pair
        self.joins = {t[i : i + 2] for t, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED) for i in range(len(t) - 1)}
        self.feed = next((i for i, p in enumerate(self.pieces) if p[0] == "<0x0A>"), -1)
        self.parts = ChunkCache(self._encode_new)
        self.cache = ChunkCache(self._encode_chunks)

    def _encode_new(self, chunks: list[str], many: int = 64) -> list[bytes]:
        """Ids of new chunks, joined by line feeds, which no piece crosses, by both libraries, and decoded again."""
        feed, skip = self.feed, 1 + self.model["dummy_prefix"]
        groups = [chunks[i : i + many] for i in range(0, len(chunks), many)]
        ours = self.tail.encode_batch_fast(["\n".join(g) + "\n" for g in groups], add_special_tokens=False)
        theirs = self.native.encode(["\n" + "\n".join(g).replace(MARK, " ") + "\n" for g in groups], num_threads=1)
        again = self.tail.decode_batch([e.ids for e in ours], skip_special_tokens=False)
        out: list[bytes] = []
        for group, a, b, text in zip(groups, ours, theirs, again, strict=True):
            own = np.array(a.ids, "<u4")
            ends = np.flatnonzero(own == feed)
            if a.ids == b[skip:] and len(ends) == len(group) and "\n" not in group and text == "\n".join(group).replace(MARK, " ") + "\n":
                out += cut_after(own.tobytes(), ends, drop=1)
                continue
            for c in group:
                alone = self.tail.encode(c, add_special_tokens=False).ids
                if self.native.encode("\n" + c.replace(MARK, " "))[skip:] != alone:
                    self.unequal.add(c)
                if self.tail.decode(alone, skip_special_tokens=False) != c.replace(MARK, " "):
                    self.broken.add(c)
                out.append(np.array(alone, "<u4").tobytes())
        return out

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of new chunks."""
        return self.parts.texts([self._split(c) for c in chunks])

    def _split(self, chunk: str) -> list[str]:
        """The chunk, less a last character that no piece joins to the one before it, which is looked up alone."""
        return [chunk] if len(chunk) < 3 or chunk[-2:] in self.joins else [chunk[:-1], chunk[-1]]

    def encode_all(self, texts: list[str]) -> tuple[list[np.ndarray], list[int], list[bool]]:
        """For each text its ids, the number of its chunks (or 1 for the whole text) on which the libraries differ, and whether decoding gives it back."""
        if not self.by_chunk:
            ours = [e.ids if t else [] for t, e in zip(texts, self.whole.encode_batch_fast(texts, add_special_tokens=False), strict=True)]
            theirs = self.native.encode(texts)
            ids = [np.array(x, "<u4") for x in ours]
            again = [x == t.replace(MARK, " ") for x, t in zip(self.decode_all(ids), texts, strict=True)]
            return ids, [int(x != y) for x, y in zip(ours, theirs, strict=True)], again
        front = MARK if self.model["dummy_prefix"] else ""
        chunks = [self.chunk.findall(front + t.replace(" ", MARK)) if t else [] for t in texts]
        ids = [numbers(raw) for raw in self.cache.texts(chunks)]
        unequal, broken = ([sum(not bad.isdisjoint(self._split(c)) for c in own) if bad else 0 for own in chunks] for bad in (self.unequal, self.broken))
        return ids, unequal, [not n for n in broken]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0][0]

    def decode_all(self, ids: list[np.ndarray]) -> list[str]:
        """The texts of ids, by the rebuilt decoder."""
        return self.whole.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_all([ids])[0]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, with_ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids_crc32, n_byte_tokens, round_trip, n_different[, ids]) of every text.

    round_trip: decoding gives the text back, blanks for markers.  n_different: chunks
    that the sentencepiece library encodes otherwise, 0 where the two agree.
    """
    spark = docs.sparkSession
    path = model or tokenizer_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        is_byte = np.array([kind == BYTE for _, _, kind in c.pieces])
        for whole in batches:
            for part in T.slices(whole, "text", 1 << 20):
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids, different, again = c.encode_all(texts)
                columns = [
                    part.column("id"),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                    pa.array([int(is_byte[x].sum()) for x in ids], pa.int64()),
                    pa.array(again, pa.bool_()),
                    pa.array(different, pa.int64()),
                ]
                names = ["id", "n_tokens", "ids_crc32", "n_byte_tokens", "round_trip", "n_different"]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = require(docs, id_col, text_col).toDF("id", "text").withColumn("id", F.col("id").cast("long"))
    schema = "id long, n_tokens long, ids_crc32 long, n_byte_tokens long, round_trip boolean, n_different long" + ", ids array<int>" * with_ids
    return in_arrow(rows, run, schema)


def decode(rows: DataFrame, *, id_col: str = "id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """(id, text) of every row of ids; null and empty ids give the empty text."""
    path = model or tokenizer_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            ids = [np.array(x or [], np.uint32) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(c.decode_all(ids), pa.string())], names=["id", "text"])

    given = require(rows, id_col, ids_col).toDF("id", "ids").select(F.col("id").cast("long").alias("id"), F.col("ids").cast("array<int>").alias("ids"))
    return in_arrow(given, run, "id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: token counts, checksums of the ids and round trips of all documents."""
    return encode(read(spark, sf_dir, "documents"), with_ids=False).withColumnRenamed("id", "doc_id")
