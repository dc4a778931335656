"""Line-first cleaning: rules on each line, then a verdict on what is left of the document. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import all_of, let, quoted, SPACE, SPACE_CHARS, without, words

# Marks that may end a sentence.
TERMINAL = [".", "!", "?", "…", ":", ";", '"', "'", "”", "’", "»", ")", "]", "。", "！", "？"]
# Phrases of page furniture and licence notices, in lower case.
BOILERPLATE = [
    "lorem ipsum", "javascript", "cookie", "privacy policy", "terms of use", "terms of service", "terms and conditions",
    "all rights reserved", "licensed under the", "sign up", "log in", "skip to content", "back to top", "click here", "read more",
    "leave a comment", "share this", "subscribe to our", "newsletter", "powered by", "page not found", "add to cart",
    "datenschutz", "impressum", "alle rechte vorbehalten", "zum inhalt springen", "mentions légales", "tous droits réservés",
    "politique de confidentialité", "aller au contenu", "todos los derechos reservados", "política de privacidad", "aviso legal", "saltar al contenido",
]
# Marks that part the links of a menu or of a path of pages.
SEPARATORS = "|»›•·→"


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of the verdict."""

    min_separators: int = 2  # of a menu line, whose links are shorter than ``max_link_chars`` on average
    max_link_chars: int = 25
    max_mark_share: float = 0.05  # marks such as | # ! in a line, against its characters
    max_lost_share: float = 0.5  # characters of removed lines, against those of all lines with a word
    min_words: int = 10
    max_repeat_pct: int = 20
    window: int = 5


def _repeat_words(tokens: Column, k: int) -> Column:
    """Words that lie in a ``k``-word window found twice or more in the text.

    Windows are compared by a 64-bit hash inside one document. A text whose windows all differ is done after one pass;
    otherwise equal windows become neighbours by sorting, and the spans at their positions are measured.
    """

    def spans(found: Column) -> Column:
        return F.when(F.size(found) == 0, F.lit(0)).otherwise(
            F.aggregate(
                F.sequence(F.lit(1), F.size(found)),
                F.lit(0),
                lambda acc, i: acc + F.when(i == 1, F.lit(k)).otherwise(F.least(F.lit(k), F.get(found, i - 1) - F.get(found, i - 2))),
            )
        )

    def repeated(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return let(
            pairs,
            lambda s: let(
                F.sort_array(
                    F.transform(
                        F.filter(
                            F.transform(
                                s,
                                lambda x, i: F.struct(
                                    x["p"].alias("p"),
                                    (
                                        (F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
                                        | ((i > 0) & F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)))
                                    ).alias("twice"),
                                ),
                            ),
                            lambda x: x["twice"],
                        ),
                        lambda x: x["p"],
                    )
                ),
                spans,
            ),
        )

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))

    return F.when(F.size(tokens) < k + 1, F.lit(0)).otherwise(
        let(
            F.transform(tokens, lambda w: F.xxhash64(w)),
            lambda h: let(windows(h), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(repeated(g))),
        )
    )


def _line_fails(line: Column, rules: LineRules) -> Column:
    """True for a line that looks like navigation, markup, a cut sentence or boilerplate."""
    marks = F.length(F.regexp_replace(line, r"[^#*$%&|<>{}!~^=_]+", ""))
    low = F.lower(line)
    cut = ~F.right(F.rtrim(line, F.lit(SPACE_CHARS)), F.lit(1)).isin(TERMINAL)
    phrase = F.lit(False)
    for p in BOILERPLATE:
        phrase = phrase | F.contains(low, F.lit(p))
    parts = F.length(F.regexp_replace(line, f"[^{SEPARATORS}]+", ""))
    menu = (parts >= rules.min_separators) & (F.length(line) < (parts + 1) * rules.max_link_chars)
    return cut | (marks > F.length(line) * rules.max_mark_share) | menu | phrase


def clean_lines(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """Statistics, cleaned text and verdict for each row of ``docs``, which needs a ``text`` column.

    Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long), ``base_failed`` and ``kept`` (boolean),
    ``n_bad_lines, chars_total, chars_lost`` (long) and ``clean_text`` (string); input columns of these names are replaced, all
    others pass through. One row comes out for each row that goes in, repeated rows included.

    A null text counts as empty: no words, ``base_failed``, an empty ``clean_text``. Lines without a word are dropped from the
    cleaned text and count for nothing. A document fails when it is too short or repeats itself, or when the failing lines hold
    more than ``max_lost_share`` of its characters; at exactly that share it is kept.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_bad_lines", "chars_total", "chars_lost", "clean_text"]
    docs = without(docs, added)
    text = F.coalesce(F.col("text"), F.lit(""))
    by_word = let(
        words(F.col("text")),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w, rules.window).cast("long").alias("n_repeat_words"),
        ),
    )
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x, F.lit(SPACE_CHARS))) > 0)
    by_line = let(
        lines,
        lambda all_lines: let(
            F.filter(all_lines, lambda x: ~_line_fails(x, rules)),
            lambda good: F.struct(
                (F.size(all_lines) - F.size(F.array_distinct(all_lines))).cast("long").alias("n_dup_lines"),
                (F.size(all_lines) - F.size(good)).cast("long").alias("n_bad_lines"),
                F.length(F.array_join(all_lines, "")).cast("long").alias("chars_total"),
                F.length(F.array_join(good, "")).cast("long").alias("chars_good"),
                F.array_join(good, "\n").alias("clean_text"),
            ),
        ),
    )
    out = docs.select("*", by_word.alias("__w"), by_line.alias("__l"), F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"))
    base_failed = (F.col("__w.n_words") < rules.min_words) | (100 * F.col("__w.n_repeat_words") > rules.max_repeat_pct * F.col("__w.n_words"))
    lost = F.col("__l.chars_total") - F.col("__l.chars_good")
    return out.select(
        *all_of(docs),
        F.col("__w.n_words").alias("n_words"), F.col("__w.word_chars").alias("word_chars"), "n_symbols",
        F.col("__l.n_dup_lines").alias("n_dup_lines"), F.col("__w.n_repeat_words").alias("n_repeat_words"),
        base_failed.alias("base_failed"),
        (~base_failed & (lost <= F.col("__l.chars_total") * rules.max_lost_share)).alias("kept"),
        F.col("__l.n_bad_lines").alias("n_bad_lines"), F.col("__l.chars_total").alias("chars_total"), lost.alias("chars_lost"),
        F.col("__l.clean_text").alias("clean_text"),
    )


def keep_clean(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The kept documents, with failing lines gone from ``text`` and ``n_chars`` (if there is one) counted anew."""
    judged = clean_lines(docs, rules).filter("kept")
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return judged.select(*[new[c].alias(c) if c in new else F.col(quoted(c)) for c in docs.columns])
