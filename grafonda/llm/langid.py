"""Language identification with interpolated Kneser-Ney character models.

One model per language predicts each letter of a word, and the word's end, from up to
four characters before it in the word.  All n-grams that any language has seen are
stored once per order in one sorted array of 64-bit hashes, with a column of
interpolated log probabilities for each language, and contexts likewise with their
back-off weights; scoring is binary search over whole batches of words.  The
language with the lowest cross-entropy per symbol wins.  A document whose best
cross-entropy is nearer to that of shuffled letters than to that of held-back training
documents of that language, given its length, is rejected: it is text of no learned
language.

Training takes a bounded sample: about `docs_per_lang` whole texts of each language,
chosen by a hash of the id (an accepted bound; everything is scored).  Three quarters
of the sample fit the counts, the rest calibrates the rejection.

Nulls and edges: a null text, or one without letters, is `und` with score 0 and is
rejected; a null language or id is never trained on; ids do not influence a
prediction; without any training row (an empty table, or one without labels) every
text is `und` with score 0.  Of languages that score alike, the first in the order of
their names wins.  Texts of any length are scored whole, some MB of them at a time;
equal rows get equal results; columns other than the named ones are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grafonda.llm import textkit as T
from grafonda.llm.common import in_arrow, read

LETTERS = re.compile(r"[^\W\d_]+")
BEGIN, END = "\x02", "\x03"
ORDER, DOCS_PER_LANG = 5, 300
#: Where rejection begins, as a share of the way from texts of a language to the same texts with shuffled letters.
REJECT_AT = 0.6
#: Size of the alphabet that an unseen character is shared out over.
ALPHABET = 1000
_U = np.uint64


def _keys(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """keys[n][i]: hash of the n characters that end at i (n from 1)."""
    keys = [np.zeros(0, _U), T.mix(codes)]
    with np.errstate(over="ignore"):
        for n in range(2, order + 1):
            nxt = keys[-1].copy()
            nxt[n - 1 :] = T.mix(keys[-1][n - 1 :] * _U(0x9E3779B97F4A7C15) + codes[: len(codes) - n + 1])
            keys.append(nxt)
    return keys


def _key_of(grams: list[str]) -> np.ndarray:
    """The hash of each string of one length, as `_keys` has it."""
    n = len(grams[0])
    codes = np.array([[ord(c) for c in g] for g in grams], _U)
    with np.errstate(over="ignore"):
        out = T.mix(codes[:, n - 1])
        for j in range(n - 2, -1, -1):
            out = T.mix(out * _U(0x9E3779B97F4A7C15) + codes[:, j])
    return out


class _Counts:
    """Kneser-Ney counts of one language."""

    def __init__(self, words: Counter, order: int) -> None:
        raw: list[Counter] = [Counter() for _ in range(order + 1)]
        for word, times in words.items():
            s = BEGIN + word + END
            for i in range(1, len(s)):
                for n in range(1, min(order, i + 1) + 1):
                    raw[n][s[i - n + 1 : i + 1]] += times
        self.count = raw[:]
        for n in range(1, order):
            kept = Counter({g: c for g, c in raw[n].items() if g[0] == BEGIN})
            kept.update(Counter(g[1:] for g in raw[n + 1]))
            self.count[n] = kept
        self.total: list[Counter] = [Counter() for _ in range(order + 1)]
        self.types: list[Counter] = [Counter() for _ in range(order + 1)]
        self.discount = [0.0] * (order + 1)
        for n in range(1, order + 1):
            for g, c in self.count[n].items():
                self.total[n][g[:-1]] += c
                self.types[n][g[:-1]] += 1
            of = Counter(self.count[n].values())
            self.discount[n] = of[1] / (of[1] + 2 * of[2]) if of[1] else 0.5

    def weight(self, context: str) -> float:
        """Share of the probability after a context that goes to the shorter context."""
        n = len(context) + 1
        total = self.total[n].get(context, 0)
        return self.discount[n] * self.types[n][context] / total if total else 1.0

    def prob(self, gram: str, memo: dict[str, float]) -> float:
        if gram in memo:
            return memo[gram]
        n, context = len(gram), gram[:-1]
        lower = self.prob(gram[1:], memo) if n > 1 else 1.0 / ALPHABET
        total = self.total[n].get(context, 0)
        p = lower
        if total:
            p = max(self.count[n].get(gram, 0) - self.discount[n], 0.0) / total + self.weight(context) * lower
        memo[gram] = p
        return p


@dataclass
class Model:
    """Sorted hash arrays: grams[n] and contexts[n] are (keys, matrix with a column per language)."""

    langs: list[str]
    order: int = ORDER
    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    contexts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    unseen: np.ndarray | None = None
    mean: np.ndarray | None = None  # cross-entropy per symbol of held-back documents
    shuffled: np.ndarray | None = None  # the same documents with their letters shuffled
    noise: np.ndarray | None = None  # its deviation per symbol within documents

    def limit(self, best: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Cross-entropy above which a document of so many symbols is rejected."""
        gap = np.maximum(self.shuffled[best] - self.mean[best], 0.5)
        return self.mean[best] + REJECT_AT * gap + 6 * self.noise[best] / np.sqrt(np.maximum(symbols, 1))

    def score(self, words: list[str]) -> np.ndarray:
        """Negative log likelihood of each word under each language."""
        if not words:
            return np.zeros((0, len(self.langs)))
        text = "".join([BEGIN + w + END for w in words])
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
        lens = np.array([len(w) + 2 for w in words])
        first = np.cumsum(lens) - lens
        place = np.arange(len(codes)) - np.repeat(first, lens)
        keys = _keys(codes, self.order)
        out = np.zeros((len(codes), len(self.langs)))
        left = np.flatnonzero(place > 0)
        for n in range(self.order, 0, -1):
            fits = place[left] >= n - 1
            now, later = left[fits], left[~fits]
            at, hit = _find(self.grams[n][0], keys[n][now])
            out[now[hit]] += self.grams[n][1][at[hit]]
            now = now[~hit]
            if n > 1 and len(now):
                at, hit = _find(self.contexts[n][0], keys[n - 1][now - 1])
                out[now[hit]] += self.contexts[n][1][at[hit]]
            elif n == 1:
                out[now] += self.unseen
            left = np.concatenate([now, later])
        return -np.add.reduceat(out, first, axis=0)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
    return at, (table[at] == keys) if len(table) else np.zeros(len(keys), bool)


def _table(grams: list[str], columns: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
    keys = _key_of(grams)
    order = np.argsort(keys)
    return keys[order], np.log(np.array(columns).T)[order]


def fit(samples: dict[str, list[str]], order: int = ORDER) -> Model:
    """Models from whole texts of each language; every fourth text calibrates the rejection.  Without texts, a model of no language."""
    langs = sorted(samples)
    if not langs:
        return Model([], order)
    kept = {lang: [t for i, t in enumerate(samples[lang]) if i % 4 != 3] for lang in langs}
    counts = [_Counts(Counter(w for t in kept[lang] for w in LETTERS.findall(t.lower())), order) for lang in langs]
    model = Model(langs, order)
    memos: list[dict[str, float]] = [{} for _ in langs]
    model.grams, model.contexts = [(np.zeros(0, _U), np.zeros((0, len(langs))))], [(np.zeros(0, _U), np.zeros((0, len(langs))))]
    for n in range(1, order + 1):
        union = sorted(set().union(*[c.count[n] for c in counts])) or ["?" * n]
        model.grams.append(_table(union, [[c.prob(g, m) for g in union] for c, m in zip(counts, memos, strict=True)]))
        if n > 1:
            union = sorted(set().union(*[c.total[n] for c in counts])) or ["?" * (n - 1)]
            model.contexts.append(_table(union, [[c.weight(h) for h in union] for c in counts]))
        else:
            model.contexts.append(model.contexts[0])
    model.unseen = np.log(np.array([c.weight("") / ALPHABET for c in counts]))
    mean, shuffled, noise = [], [], []
    shuffle = np.random.default_rng(5)
    for column, lang in enumerate(langs):
        back = [LETTERS.findall(t.lower()) for i, t in enumerate(samples[lang]) if i % 4 == 3] or [LETTERS.findall(t.lower()) for t in samples[lang]]
        back = [w for w in back if w]
        sizes = [np.array([len(x) + 1 for x in w]) for w in back]
        costs = [model.score(w)[:, column] for w in back]
        h = [float(c.sum() / n.sum()) for c, n in zip(costs, sizes, strict=True)]
        each = [(c - n * x) / np.sqrt(n) for c, n, x in zip(costs, sizes, h, strict=True)]
        mixed = []
        for w, n in zip(back, sizes, strict=True):
            letters = "".join(shuffle.permutation(list("".join(w))))
            cuts = np.cumsum(n - 1)
            mixed.append(float(model.score([letters[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]).sum(0).min() / n.sum()))
        mean.append(float(np.median(h)) if h else 0.0)
        shuffled.append(float(np.median(mixed)) if mixed else math.log(ALPHABET))
        noise.append(max(float(np.concatenate(each).std()), 0.5) if each else 1.0)
    model.mean, model.shuffled, model.noise = np.array(mean), np.array(shuffled), np.array(noise)
    return model


class Scorer:
    """Cross-entropies of texts, with a two-generation cache of scored tokens."""

    def __init__(self, model: Model, most: int = 200_000) -> None:
        self.model, self.most = model, most
        self.young: dict[int, bytes] = {}
        self.old: dict[int, bytes] = {}

    def _rows(self, keys: list[int], tokens: list[str]) -> np.ndarray:
        """(symbols, letters, negative log likelihood per language) of each distinct token."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new = []
        for i, k in enumerate(keys):
            if k not in young:
                if k in old:
                    young[k] = old[k]
                else:
                    new.append(i)
        if new:
            parts = [LETTERS.findall(tokens[i].lower()) for i in new]
            counts = np.array([len(p) for p in parts])
            cost = self.model.score([w for p in parts for w in p])
            rows = np.zeros((len(new), 2 + len(self.model.langs)), np.float32)
            rows[:, 1] = [sum(map(len, p)) for p in parts]
            rows[:, 0] = rows[:, 1] + counts
            some = np.flatnonzero(counts)
            if len(some):
                rows[some, 2:] = np.add.reduceat(cost, (np.cumsum(counts) - counts)[some], axis=0)
            raw, width = rows.tobytes(), rows.shape[1] * 4
            young.update(zip([keys[i] for i in new], [raw[k * width : (k + 1) * width] for k in range(len(new))], strict=True))
        return np.frombuffer(b"".join([young[k] for k in keys]), np.float32).reshape(len(keys), -1).astype(np.float64)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, letters, summed negative log likelihood per language) of each text."""
        data, offsets = T.utf8(column)
        starts, ends, first = T.words(data, offsets)
        wide = len(self.model.langs)
        if not len(starts):
            zero = np.zeros(len(offsets) - 1)
            return zero, zero, np.zeros((len(zero), wide))
        hashes = T.word_hashes(data, starts, ends)
        keys, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        raw = data.tobytes()
        tokens = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
        rows = self._rows(keys.tolist(), tokens)
        total = np.zeros((len(offsets) - 1, 2 + wide))
        full = np.flatnonzero(np.diff(first) > 0)
        total[full] = np.add.reduceat(rows[back], first[full], axis=0)
        return total[:, 0], total[:, 1], total[:, 2:]

    def decide(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected) of each text."""
        if not self.model.langs:
            n = len(column)
            return ["und"] * n, np.zeros(n), np.ones(n, bool)
        symbols, letters, cost = self(column)
        h = cost / np.maximum(symbols, 1)[:, None]
        best = h.argmin(1)
        low = h[np.arange(len(h)), best]
        odds = np.exp(-(h - low[:, None]) * np.minimum(symbols, 64)[:, None])
        none = letters == 0
        score = np.where(none, 0.0, 1.0 / odds.sum(1))
        rejected = none | (low > self.model.limit(best, symbols))
        return ["und" if z else self.model.langs[i] for z, i in zip(none.tolist(), best.tolist(), strict=True)], score, rejected


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, usable: Column, docs_per_lang: int) -> dict[str, list[str]]:
    """About docs_per_lang texts of each language (all of them, where there are fewer), by a hash of the id."""
    labelled = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = labelled.groupBy(lang_col).count().collect()
    spot = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000))
    chosen = F.lit(False)
    for row in counts:
        share = min(1_000_000, math.ceil(1_000_000 * docs_per_lang / row["count"]))
        chosen = chosen | ((F.col(lang_col) == row[lang_col]) & (spot < share))
    out = defaultdict(list)
    rows = labelled.where(chosen).select(id_col, lang_col, text_col).collect()
    for row in sorted(rows, key=lambda r: (r[1], r[0], r[2])):
        out[row[1]].append(row[2])
    return dict(out)


def trainable(id_col: str) -> Column:
    """Rows that may be learned from: crc32 of the id as text is not 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2, F.lit(False))


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for whole in batches:
            for part in T.slices(whole, "text", 1 << 20):
                lang, score, rejected = scorer.decide(part.column("text"))
                arrays = [part.column("id"), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return in_arrow(rows, run, f"id {kind}, lang_pred string, score double, rejected boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: language of every document, learned from the documents that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(sample(docs, "doc_id", "text", "lang", trainable("doc_id"), DOCS_PER_LANG))
    found = identify(docs.select("doc_id", "text"), model)
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return found.select(F.col("id").alias("doc_id"), held.alias("held_out"), "lang_pred", "score", "rejected")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents of no learned language go; where there is no text to learn from, all stay.

    Null and letterless texts go (they are of no language); other nulls, repeats and
    extra columns pass through unchanged; an empty table stays empty.
    """
    model = fit(sample(docs, "doc_id", "text", "lang", trainable("doc_id"), DOCS_PER_LANG))
    if not model.langs:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for whole in batches:
            for part in T.slices(whole, "text", 1 << 20):
                _, _, rejected = scorer.decide(part.column("text"))
                yield part.filter(pa.array(~rejected))

    return in_arrow(docs, run, docs.schema)
