"""Document quality rules as one projection of native column expressions.

`THRESHOLDS` is the rule table: each row names a measure, the side on which a
document fails, the limit and the fewest words from which the rule speaks.  It is
compiled into one boolean expression; nothing leaves the JVM.

Repeated five-word windows are found in time near-linear in the text: windows are
hashed to 64 bits, a text whose hashes are all different is done, and only the others
sort (hash, position) pairs and add up what the repeated windows cover.

Nulls and edges: a null or blank text has no words, every count is 0 and it fails the
base rule (fewer than 10 words).  Ratios of texts without words or lines are 0.
Repeated rows give repeated results; a null id stays null; columns other than the named
ones are not read, whatever their names.  Texts of any length are measured whole; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grafonda.llm.common import read, require

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Marks that may follow a stop word.
MARKS = ".,;:!?"
#: Words of a window, and the share of words in repeated windows (percent) above which the base rule fails.
WINDOW, REPEAT_PCT, LEAST_WORDS = 5, 20, 10

#: Frequent function words of English, German, French and Spanish (fixed values).
STOP_WORDS = (
    "the of and to in a is that for it with as was on by be this are or from at an have not "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine auch es werden aus er hat dass sie nach wird bei einer um am sind "
    "le la les de et en un une du dans que qui pour pas sur au avec ce il est par plus ou elle "
    "el los las del y por con no para se lo como más su al"
).split()

#: (measure, failing side, limit, fewest words): the documents that clean text never comes near.
THRESHOLDS = [
    ("symbols_per_word", ">", 0.25, 10),
    ("exclamations_per_word", ">", 0.25, 10),
    ("stop_word_ratio", "<", 0.10, 80),
    ("mean_word_length", ">", 25.0, 10),
    ("dup_line_ratio", ">", 0.50, 10),
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, ""))


def _window_hashes(words: Column) -> Column:
    n = F.size(words)
    at = F.sequence(F.lit(0), n - WINDOW)
    hashed = F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)]))
    return F.when(n > WINDOW, hashed).otherwise(F.array().cast("array<bigint>"))


def _covered(hashes: Column) -> Column:
    """Words under windows whose hash occurs twice or more."""

    def positions(pairs: Column) -> Column:
        def same(x: Column, j: Column) -> Column:
            return F.coalesce(F.get(pairs, j)["h"] == x["h"], F.lit(False))

        twins = F.filter(pairs, lambda x, j: same(x, j - 1) | same(x, j + 1))
        return F.sort_array(F.transform(twins, lambda x: x["i"]))

    def total(at: Column) -> Column:
        gaps = F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda acc, x: acc + x)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(pairs, positions), total)


def measures(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds the counts and ratios that the rules read, as columns q_*."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumns(
        {
            "q_text": text,
            "q_words": F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""),
            "q_lines": F.filter(F.split(text, "\n"), lambda x: _without(x, BLANKS) > 0),
        }
    )
    out = out.withColumns({"q_hashes": _window_hashes(F.col("q_words")), "q_n": F.size("q_words").cast("bigint")})
    some, chars = F.greatest(F.col("q_n"), F.lit(1)), F.char_length("q_text")
    out = out.withColumns(
        {
            "q_word_chars": _without(F.col("q_text"), BLANKS).cast("bigint"),
            "q_symbols": (chars - _without(F.col("q_text"), SYMBOLS)).cast("bigint"),
            "q_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("bigint"),
            "q_repeat": F.when(F.size(F.array_distinct("q_hashes")) < F.size("q_hashes"), _covered(F.col("q_hashes"))).otherwise(F.lit(0).cast("bigint")),
        }
    )
    stops = F.filter("q_words", lambda w: F.lower(F.rtrim(w, F.lit(MARKS))).isin(STOP_WORDS))
    return out.withColumns(
        {
            "symbols_per_word": F.col("q_symbols") / some,
            "exclamations_per_word": (chars - _without(F.col("q_text"), "!")) / some,
            "stop_word_ratio": F.size(stops) / some,
            "mean_word_length": F.col("q_word_chars") / some,
            "dup_line_ratio": F.col("q_dup_lines") / F.greatest(F.size("q_lines"), F.lit(1)),
        }
    )


def compiled(thresholds: list[tuple[str, str, float, int]]) -> Column:
    """True where some rule of the table fails."""
    fails = F.lit(False)
    for name, side, limit, least in thresholds:
        over = F.col(name) > limit if side == ">" else F.col(name) < limit
        fails = fails | (over & (F.col("q_n") >= least))
    return fails


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", thresholds: list[tuple[str, str, float, int]] = THRESHOLDS) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ratios, base_failed, kept) of every row."""
    m = measures(require(docs, id_col, text_col), text_col)
    base = (F.col("q_n") < LEAST_WORDS) | (100 * F.col("q_repeat") > REPEAT_PCT * F.col("q_n"))
    return m.select(
        F.col(id_col),
        F.col("q_n").alias("n_words"),
        F.col("q_word_chars").alias("word_chars"),
        F.col("q_symbols").alias("n_symbols"),
        F.col("q_dup_lines").alias("n_dup_lines"),
        F.col("q_repeat").alias("n_repeat_words"),
        *[t[0] for t in thresholds],
        base.alias("base_failed"),
        (~base & ~compiled(thresholds)).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: counts and verdict of every document."""
    found = quality(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents that the rules reject go.

    Null, empty and very short texts are rejected; long texts are measured whole; all
    columns of the rows that stay pass through unchanged, whatever their names; repeated
    rows stay or go together; an empty table stays empty.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].alias("text"))
    m = measures(rows, "text")
    base = (F.col("q_n") < LEAST_WORDS) | (100 * F.col("q_repeat") > REPEAT_PCT * F.col("q_n"))
    # through a generator: a filter on plain columns would be moved to the scan with every measure copied into it
    judged = m.select("row", F.explode_outer(F.array(~base & ~compiled(THRESHOLDS))).alias("q_kept"))
    return judged.where("q_kept").select("row.*")


def _sql() -> str:
    stops = ", ".join("'" + w + "'" for w in STOP_WORDS)
    blanks = "' \t\n' || chr(11) || chr(12) || chr(13)"
    rules = " OR ".join(f"({name} {side} {limit} AND n_words >= {least})" for name, side, limit, least in THRESHOLDS)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (
  SELECT doc_id, x, list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda s: s <> '') AS ws,
    list_filter(string_split(x, chr(10)), lambda s: length(translate(s, {blanks}, '')) > 0) AS ls
  FROM t),
g AS (
  SELECT doc_id, unnest(range(1, len(ws) - {WINDOW - 2})) AS i, ws FROM w WHERE len(ws) > {WINDOW}),
h AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS k FROM g),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM h) WHERE c > 1),
p AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM r, range(0, {WINDOW}) AS o(j) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws) AS n_words, length(translate(x, {blanks}, '')) AS word_chars,
    length(x) - length(translate(x, '{SYMBOLS}', '')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    greatest(len(ws), 1) AS denom, length(x) - length(translate(x, '!', '')) AS bangs, len(ls) AS n_lines,
    len(list_filter(ws, lambda s: lower(rtrim(s, '{MARKS}')) IN ({stops}))) AS n_stops
  FROM w LEFT JOIN p ON p.doc_id = w.doc_id),
q AS (
  SELECT *, n_symbols / denom AS symbols_per_word, bangs / denom AS exclamations_per_word, n_stops / denom AS stop_word_ratio,
    word_chars / denom AS mean_word_length, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio,
    n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PCT} * n_words AS base_failed
  FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT ({rules}) AS kept
FROM q"""


ORACLE_SQL = _sql()
