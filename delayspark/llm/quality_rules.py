"""Quality rules: line-first cleaning with Spark functions only.

Every line with a word is judged by three rules (punctuation, navigation, boilerplate).  Failing
lines are removed; a document is rejected when the base figures fail or when the removed lines hold
more than ``MAX_LOST`` percent of its words.  Everything is computed inside the row: no shuffle, and
one hot source or a very long text changes nothing but that row's time.

Defined results: null text counts as empty (all figures 0, base_failed because n_words < 10); lines
without a word are kept and never judged; a text of one line is a text of one line; repeated rows
give repeated results; extra columns are ignored by :func:`score` and passed through by
:func:`clean`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh, let, words_of

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20   # words in repeated 5-word windows, of all words
WINDOW = 5
MAX_LOST = 50             # percent of the words that removed lines may hold
SYMBOLS = "#*$%&|<>"
SYMBOL = r"[#*$%&|<>]"

# --- fixed values: line rules (Java and RE2 syntax alike) --------------------------------------
# Prose: somewhere in the line a sentence or clause is closed, and its words are not marked by symbols.
CLOSED = r"[.!?:;…。！？][\"'”’»)\]]*([\x20\x09-\x0D]|$)"
NOISE = r"[#*$%&|<>!]"
NOISE_SHARE = 4
# Navigation: items separated by bars, bullets or arrows.
SEPARATOR = r"[|•·»›→]"
MIN_SEPARATORS = 2
MARK = r"[#*$%&|<>!•·»›→]"  # either of the two
# Boilerplate phrases of pages, not of prose (compared in lower case).
BOILERPLATE = [
    "lorem ipsum", "enable javascript", "javascript is disabled", "javascript is required", "cookie policy",
    "cookie settings", "uses cookies", "use cookies", "accept all cookies", "privacy policy", "terms of use",
    "terms of service", "all rights reserved", "copyright ©", "click here", "read more", "sign in to", "log in to",
    "subscribe to", "skip to content", "skip to main content", "follow us on", "back to top", "page not found",
]
HAS_WORD = r"[^\x20\x09-\x0D]"


def _any_phrase(text: Column) -> Column:
    found = F.lit(False)
    for phrase in BOILERPLATE:
        found = found | F.contains(text, F.lit(phrase))
    return found


def line_fails(line: Column) -> Column:
    """True when a line with a word fails one of the three rules."""
    noise = F.regexp_count(line, F.lit(NOISE))
    marked = F.regexp_like(line, F.lit(MARK)) & (
        ((noise > 2) & (noise * NOISE_SHARE > F.regexp_count(line, F.lit(WORD))))
        | (F.regexp_count(line, F.lit(SEPARATOR)) >= MIN_SEPARATORS))
    return F.regexp_like(line, F.lit(HAS_WORD)) & (
        ~F.regexp_like(line, F.lit(CLOSED)) | marked | let(F.lower(line), _any_phrase))


def cleaned_text(text: Column) -> Column:
    """The text without its failing lines."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.array_join(F.filter(lines, lambda line: ~line_fails(line)), "\n")


def repeat_words(words: Column) -> Column:
    """Words covered by ``WINDOW``-word windows that occur at least twice in the array.

    Windows are named by a 64-bit hash of their words' hashes; equal names are found by sorting
    (name, position), and the covered words are summed over consecutive marked positions.
    """
    def covered(marked: Column) -> Column:
        steps = F.transform(marked, lambda p, i: F.least(
            F.lit(WINDOW), F.coalesce(F.get(marked, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def marked(names: Column) -> Column:
        pairs = F.sort_array(F.transform(names, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(pairs, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                     | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))),
            lambda x: x["i"])))

    def of_names(names: Column) -> Column:
        return F.when(F.size(F.array_distinct(names)) == F.size(names), F.lit(0).cast("long")).otherwise(
            let(marked(names), covered))

    def of_hashes(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW),
                              lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
        return F.when(F.size(h) < WINDOW + 1, F.lit(0).cast("long")).otherwise(let(windows, of_names))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1),
                     lambda line: F.regexp_like(line, F.lit(HAS_WORD)))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def _figures(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return let(words_of(text), lambda words: F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.when(F.regexp_like(text, F.lit(SYMBOL)), F.length(text) - F.length(F.translate(text, SYMBOLS, "")))
        .otherwise(0).cast("long").alias("n_symbols"),
        dup_lines(text).cast("long").alias("n_dup_lines"),
        repeat_words(words).alias("n_repeat_words"),
    ))


def _judged(docs: DataFrame, text_col: str) -> tuple[DataFrame, str, str]:
    """``docs`` with a struct of the figures and the cleaned text, under unused names."""
    fig, clean = fresh(docs, "__figures"), fresh(docs, "__clean")
    df = docs.withColumns({fig: _figures(F.col(text_col)), clean: cleaned_text(F.col(text_col))})
    return df, fig, clean


def _verdict(fig: Column, text: Column, clean: Column) -> tuple[Column, Column, Column]:
    base_failed = (fig["n_words"] < MIN_WORDS) | (
        fig["n_repeat_words"] * 100 > fig["n_words"] * MAX_REPEAT_PERCENT)
    lost = F.when(clean == text, F.lit(0)).otherwise(fig["n_words"] - F.size(words_of(clean))).cast("long")
    kept = ~base_failed & (lost * 100 <= fig["n_words"] * MAX_LOST)
    return base_failed, lost, kept


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Figures and verdict of every document: the id, the base figures, ``base_failed``,
    ``lost_words`` (words in failing lines) and ``kept``."""
    df, fig, clean = _judged(docs.select(id_col, text_col), text_col)
    base_failed, lost, kept = _verdict(F.col(fig), F.col(text_col), F.col(clean))
    return df.select(id_col, F.col(f"{fig}.*"), base_failed.alias("base_failed"),
                     lost.alias("lost_words"), kept.alias("kept"))


def clean(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """Accepted documents with their failing lines removed, in the columns of ``docs``
    (``chars_col``, where there is one, is the new length).

    The cleaned text of an accepted document is the one element of an exploded array, so figures and
    lines are judged once (a filter on them would be moved down and judge them again)."""
    text = F.col(text_col)

    def accepted(judged: Column) -> Column:
        return F.filter(F.array(judged), lambda j: _verdict(j["figures"], text, j["clean"])[2])

    judged = F.struct(_figures(text).alias("figures"), cleaned_text(text).alias("clean"))
    row = fresh(docs, "__judged")
    df = docs.withColumn(row, F.explode(let(judged, accepted)))
    cleaned = F.col(row)["clean"]
    new = {text_col: cleaned}
    if chars_col and chars_col in docs.columns:
        new[chars_col] = F.length(cleaned).cast(docs.schema[chars_col].dataType)
    return df.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
