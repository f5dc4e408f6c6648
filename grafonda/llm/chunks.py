"""Token ids of texts through a cache of white-space-free chunks.

For a vocabulary whose pieces never cross white space, the ids of a text are the
ids of its chunks one after another, so that each distinct chunk is encoded once
per worker.  The cache has two generations of bounded size: when the young one is
full it becomes the old one, and what is still in use moves back on its next hit.
Ids are kept as the bytes of little-endian unsigned 32-bit numbers.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from itertools import chain

import numpy as np

#: Stands for a line feed among ids.
FEED = b"\xff\xff\xff\xff"


#: Python takes these for white space, the vocabulary's normaliser does not.
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
NOT_SPACE = re.compile(r"[\S\x1c-\x1f]+")


def split_chunks(text: str) -> list[str]:
    """The chunks between white space as the vocabulary's normaliser knows it."""
    return NOT_SPACE.findall(text) if any(c in text for c in SEPARATORS) else text.split()


class ChunkCache:
    """Maps chunks to their ids; `encode` gets the list of chunks that are not known."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int = 300_000) -> None:
        self.encode, self.most = encode, most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def look_up(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk; one pass over the chunks, a second one over those not known."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        got: list = list(map(young.get, chunks))
        holes = [i for i, ids in enumerate(got) if ids is None]
        if holes:
            new = []
            for c in {chunks[i] for i in holes}:
                ids = old.get(c)
                if ids is None:
                    new.append(c)
                else:
                    young[c] = ids
            if new:
                young.update(zip(new, self.encode(new), strict=True))
            for i in holes:
                got[i] = young[chunks[i]]
        return got

    def texts(self, chunks: list[list[str]]) -> list[bytes]:
        """Ids of each list of chunks."""
        got = self.look_up(list(chain.from_iterable(chunks)))
        out, at = [], 0
        for c in chunks:
            out.append(b"".join(got[at : at + len(c)]))
            at += len(c)
        return out


def numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4")


def cut_after(raw: bytes, ends: np.ndarray, drop: int = 0) -> list[bytes]:
    """The ids up to and with each position in `ends`, less the last `drop` of them."""
    stops = ((ends + 1) * 4).tolist()
    return [raw[a : b - 4 * drop] for a, b in zip([0, *stops[:-1]], stops, strict=True)]


class WordPieces:
    """Chunk encoder for a lower-casing vocabulary with word-end marks.

    Chunks are split into the words and symbols that the vocabulary's own pattern
    finds, so that `word`, `Word` and `word,` share one entry of a second cache; the
    new ones are encoded many at a time, and word-end marks tell where each ends.
    Chunks with letters whose lower case depends on context, with a special token's
    string, not in normal form or with characters that Python's tables do not know
    (the pattern library's are newer) go to the library as they are.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\n"
    ODD = ("İ", "Σ", "<|")

    def __init__(self, path: str, many: int = 256) -> None:
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer, self.many = Tokenizer.from_file(path), many
        with open(path) as f:
            model = json.load(f)["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: the same model for words that are already normal, lower-case and split; new words do not repeat, so it keeps no cache
        self.bare = Tokenizer(models.BPE(model["vocab"], merges, cache_capacity=0, end_of_word_suffix=model["end_of_word_suffix"]))
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.find = regex.compile(self.PATTERN).findall
        vocab = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.is_end[i] = token.endswith("</w>")
        self.words = ChunkCache(self._encode_words, most=150_000)

    def _plain(self, texts: list[str]) -> list[bytes]:
        return self._raw(self.tokenizer, texts)

    @staticmethod
    def _raw(tokenizer, texts: list[str]) -> list[bytes]:  # noqa: ANN001
        return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        groups = [words[i : i + self.many] for i in range(0, len(words), self.many)]
        for group, raw in zip(groups, self._raw(self.bare, [" ".join(g) for g in groups]), strict=True):
            ends = np.flatnonzero(self.is_end[numbers(raw)])
            whole = len(ends) == len(group) and 4 * (ends[-1] + 1) == len(raw) and "\n" not in group
            out += cut_after(raw, ends) if whole else [FEED if w == "\n" else self._plain([w])[0] for w in group]
        return out

    def _is_odd(self, text: str) -> bool:
        if any(x in text for x in self.ODD):
            return True
        return not text.isascii() and (not unicodedata.is_normalized("NFC", text) or any(unicodedata.category(c) == "Cn" for c in set(text)))

    def __call__(self, chunks: list[str]) -> list[bytes]:
        joined = "\n".join(chunks)
        if self._is_odd(joined):
            odd = {c: raw for c in chunks if self._is_odd(c) for raw in self._plain([c])}
            if odd or len(chunks) == 1:
                rest = [c for c in chunks if c not in odd]
                odd |= dict(zip(rest, self(rest), strict=True)) if rest else {}
                return [odd[c] for c in chunks]
        found = self.find(joined.lower() + "\n")
        raw = b"".join(self.words.look_up(found))
        return cut_after(raw, np.flatnonzero(numbers(raw) == 0xFFFFFFFF), drop=1)
