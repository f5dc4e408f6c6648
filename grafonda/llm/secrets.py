"""Secret scan: fixed patterns, and novelty against compression dictionaries.

Base spans come from three patterns.  The method adds spans of kind `novel`: long
strings of key characters near a word that announces a secret are compressed with
zstandard, once together with the text around them and once without them, primed
with a dictionary of identifiers and of that text.  Further copies of the string, or
of a key inside it, are first taken out of that text, so that a repeated secret does
not explain itself.  The marginal compressed bytes say how much of the string the
surroundings and the dictionary do not explain; words and paths cost little, random
keys cost nearly their entropy, which the size of their alphabet gives.

Spans are in code points, ends exclusive.  Nulls and edges: a null text is empty and
has no spans; each row is scanned on its own, so ties and repeats do not matter; spans
that begin at one place stand in the order of KINDS; texts of any length are scanned
whole; an empty table gives an empty result; columns other than the named ones are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafonda.llm import textkit as T
from grafonda.llm.common import in_arrow, read, require

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Order of kinds where spans begin at the same place.
KINDS = ("assign", "access", "hex", "novel")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

#: A candidate is a run of key characters of this length or more that mixes digits and letters.
LEAST_KEY = 20
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=.~-]{{{LEAST_KEY},}}")
#: Words that announce a secret within CONTEXT characters before the candidate (fixed values).
SENSITIVE = re.compile(
    r"pass(?:word|wd|phrase)?|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential|client[_-]?id|signature|session|cookie|AKIA",
    re.IGNORECASE | re.ASCII,
)
CONTEXT, AROUND = 48, 512
#: Marginal compressed bytes per character from which a candidate over 64 symbols is reported; smaller alphabets in proportion to their bits.
NOVELTY = 0.62

#: Words of code and configuration that a key is not made of (fixed values).
IDENTIFIERS = (
    "username password passphrase database connection string hostname localhost address server client session cookie request response "
    "authorization bearer credential private public certificate signature algorithm encryption configuration environment variable "
    "production development staging default example placeholder changeme your_api_key_here your-secret-token access_key_id secret_access_key "
    "client_id client_secret refresh_token access_token api_key apikey auth_token oauth_token function return import class static void "
    "const string integer boolean undefined null true false https://www.example.com/path/to/resource index.html application/json "
    "text/plain charset=utf-8 /usr/local/lib/python/site-packages /var/log/application.log abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 com.example.project.module.ClassName node_modules package.json docker-compose.yml"
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, in order."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


class Novelty:
    """Marginal compressed size of a string given its surroundings."""

    def __init__(self, level: int = 3) -> None:
        import zstandard

        self.z, self.level = zstandard, level
        self.identifiers = IDENTIFIERS.encode()

    def __call__(self, before: str, candidate: str, after: str) -> float:
        """Compressed bytes per character that the candidate adds."""
        around = (before + after).encode()
        primed = self.z.ZstdCompressionDict(self.identifiers + b" " + around, dict_type=self.z.DICT_TYPE_RAWCONTENT)
        options = self.z.ZstdCompressor(level=self.level, dict_data=primed, write_checksum=False, write_content_size=False)
        return (len(options.compress(candidate.encode() + around)) - len(options.compress(around))) / len(candidate)


def mixes(s: str) -> bool:
    return any(c.isdigit() for c in s) and any(c.isalpha() for c in s)


def without_copies(around: str, candidate: str) -> str:
    """around less the stretches that it shares with the candidate and that would be keys themselves."""
    n = LEAST_KEY
    own = {around[i : i + n] for i in range(len(around) - n + 1)}
    shared = {g for i in range(len(candidate) - n + 1) if (g := candidate[i : i + n]) in own}
    if not shared:
        return around
    out, at, i = [], 0, 0
    while i <= len(around) - n:
        stop = i
        while around[stop : stop + n] in shared:
            stop += 1
        if stop > i and mixes(around[i : stop + n - 1]):
            out += [around[at:i], " "]
            at = stop + n - 1
        i = max(stop, i + 1, at)
    return "".join(out) + around[at:]


def alphabet(candidate: str) -> int:
    """Symbols that the candidate is drawn from: those it has, if it is long enough to show all, else those of its classes."""
    seen = set(candidate)
    if len(candidate) >= 4 * len(seen):
        return max(4, len(seen))  # under 4, padding would count as a key
    digits, symbols = any(c.isdigit() for c in seen), sum(not c.isalnum() for c in seen)
    cases = [x for x in ({c for c in seen if c.islower()}, {c for c in seen if c.isupper()}) if x]
    return 10 * digits + symbols + sum(6 if x <= set("abcdefABCDEF") else 26 for x in cases)


def novel_spans(text: str, novelty: Novelty, least: float = NOVELTY) -> list[tuple[int, int, int]]:
    """Spans of incompressible strings in sensitive context."""
    found = []
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if not mixes(s):
            continue
        if not SENSITIVE.search(text, max(0, m.start() - CONTEXT), m.start() + 4):
            continue
        wide = AROUND + min(len(s), AROUND)  # copies across the edge are seen whole
        before = without_copies(text[max(0, m.start() - wide) : m.start()], s)[-AROUND:]
        after = without_copies(text[m.end() : m.end() + wide], s)[:AROUND]
        if novelty(before, s, after) >= least * min(1, math.log2(alphabet(s)) / 6):
            found.append((m.start(), 3, m.end()))
    return found


def _told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", novelty: float = NOVELTY) -> DataFrame:
    """(id, spans, base, n_assign, n_access, n_hex): spans and base list kind:start:end in order, comma-joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Novelty()
        for whole in batches:
            for part in T.slices(whole, "text", 1 << 20):
                texts = [t or "" for t in part.column("text").to_pylist()]
                base = [base_spans(t) for t in texts]
                spans = [b + novel_spans(t, measure, novelty) for b, t in zip(base, texts, strict=True)]
                counts = [pa.array([sum(s[1] == k for s in b) for b in base], pa.int64()) for k in range(3)]
                told = [pa.array([_told(x) for x in xs], pa.string()) for xs in (spans, base)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *told, *counts], names=["id", "spans", "base", "n_assign", "n_access", "n_hex"])

    rows = require(docs, id_col, text_col).toDF("id", "text").withColumn("id", F.col("id").cast("long"))
    return in_arrow(rows, run, "id long, spans string, base string, n_assign long, n_access long, n_hex long")


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """text with each maximal stretch of overlapping spans replaced by one mark."""
    out, at, stop = [], 0, -1
    for a, _, b in sorted(spans):
        if a >= stop:
            out += [text[at:a], mark]
        stop = max(stop, b)
        at = stop
    return "".join(out) + text[at:]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: secrets of every document."""
    found = scan(read(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("base"), 256).alias("base_sha256")
    return found.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", digest, "spans")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: secrets are replaced by a mark, n_chars follows; every document stays.

    Null texts stay null (their n_chars becomes null); repeated rows stay repeated;
    other columns pass through; an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Novelty()
        for whole in batches:
            at = whole.schema.get_field_index("text")
            for part in T.slices(whole, "text", 1 << 20):
                out = []
                for t in part.column("text").to_pylist():
                    spans = base_spans(t) + novel_spans(t, measure) if t else []
                    out.append(redact(t, spans) if spans else t)
                yield part.set_column(at, whole.schema.field(at), pa.array(out, whole.schema.field(at).type))

    clean = in_arrow(docs, run, docs.schema)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def digest_of(text: str) -> str:
    """base_sha256 of one text, for tests."""
    return hashlib.sha256(_told(base_spans(text)).encode()).hexdigest()
