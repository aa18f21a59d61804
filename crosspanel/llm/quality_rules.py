"""Line-first quality rules, in DataFrame operations only.

A text is cut into lines, after a line without a mark at its end is joined to a next one that begins in lower case, as
wrapped prose does. Each line must pass every line rule, or it is removed. A document is rejected when the lines that stay
hold too little of its word characters. Rules (all are parameters of ``LineRules``):

* punctuation: the line ends in a sentence mark, or is cut off in prose that has one every forty words at least; and words that end in two or more such marks are no large share of it;
* navigation: it does not hold two or more separators, and symbols are no large share of it;
* boilerplate: it repeats no earlier line, and phrases of the boilerplate list are no large share of its characters.

Defined results: null text counts as empty (no words, base_failed, not kept); a text without line breaks is one line;
repeated rows give repeated results; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, words

SPACES = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class LineRules:
    wrapped: str = r"([^.!?:;…\"'”’)\]\x20\x09-\x0D])[\x20\x09]*\n([a-zß-ÿ])"
    #: What must be in a text for any of its lines to be wrapped.
    wrapped_next: str = r"\n[a-zß-ÿ]"
    ends: str = ".!?:;…\"'”’)]。．！？：；」』）｡।॥؟۔።؛"
    mark: str = r"[.!?…][\x20\x09-\x0D]|[。．！？｡।॥؟۔።។။]"
    max_words_a_mark: int = 40
    doubled: str = "!?"
    max_doubled_share: float = 0.2
    symbols: str = "#*$%&|<>"
    max_symbol_share: float = 0.1
    separators: str = "|"
    max_separators: int = 1
    # in English, French, Spanish and German
    boilerplate: tuple[str, ...] = (
        "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie", "javascript", "lorem ipsum", "click here", "subscribe",
        "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "cliquez ici", "mentions légales", "abonnez-vous",
        "todos los derechos reservados", "términos de uso", "política de privacidad", "haga clic aquí", "aviso legal", "suscríbete",
        "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "hier klicken", "impressum", "newsletter abonnieren",
    )
    max_boilerplate_share: float = 0.2
    min_kept_share: float = 0.5


def has_any(text: Column, parts: Iterable[str]) -> Column:
    return reduce(lambda a, p: a | F.contains(text, F.lit(p)), parts, F.lit(False))


def without(text: Column, chars: str) -> Column:
    """The text without these characters: one search for each, which copies a text only where it holds one."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), chars, text)


def line_passes(line: Column, rules: LineRules = LineRules(), phrases: Column | None = None, doubled: Column | None = None, symbols: Column | None = None) -> Column:
    """Whether one line passes every rule.

    ``phrases``, ``doubled`` and ``symbols`` tell of its whole text whether any line can have a boilerplate phrase, marks in a row, or
    symbols or separators: most texts have none of them, and their lines need no pattern or count for it.
    """
    chars = F.greatest(F.length(without(line, SPACES)), F.lit(1))
    n_symbols = F.length(line) - F.length(without(line, rules.symbols))
    n_separators = F.length(line) - F.length(without(line, rules.separators))
    n_words = F.regexp_count(line, F.lit(WORD))
    last = F.right(F.rtrim(line, F.lit(SPACES)), F.lit(1))
    n_doubled = F.regexp_count(line, F.lit(f"[{re.escape(rules.doubled)}]{{2,}}"))
    n_phrases = F.length(line) - F.length(F.regexp_replace(F.lower(line), "|".join(map(re.escape, rules.boilerplate)), ""))
    phrases = has_any(F.lower(line), rules.boilerplate) if phrases is None else phrases
    doubled = has_any(line, pairs_of(rules.doubled)) if doubled is None else doubled
    symbols = has_any(line, rules.symbols + rules.separators) if symbols is None else symbols
    # the cheap test of each rule comes first, its counts only where that test does not settle it
    return (
        (~symbols | ((n_separators <= rules.max_separators) & ((n_symbols == 0) | (n_symbols <= F.lit(rules.max_symbol_share) * chars))))
        & (((last != "") & F.contains(F.lit(rules.ends), last)) | (F.regexp_count(line, F.lit(rules.mark)) * rules.max_words_a_mark >= n_words))
        & (~doubled | (n_doubled <= F.lit(rules.max_doubled_share) * n_words))
        & (~phrases | (n_phrases <= F.lit(rules.max_boilerplate_share) * F.length(line)))
    )


def pairs_of(marks: str) -> list[str]:
    return [a + b for a in marks for b in marks]


def repeated_words(tokens: Column, n: int = 3) -> Column:
    """Words inside n-word windows that occur twice or more in the list.

    Windows are compared by a 64-bit hash. Where all of them differ, as in most texts, that is all. Else sorting (hash, position)
    brings equal windows together; the positions that have an equal neighbour are sorted again, and each adds the words up to
    the next one, n at most.
    """

    def count(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        twice = lambda s: F.filter(
            s, lambda x, i: (F.get(s, i + 1)["h"].eqNullSafe(x["h"])) | ((i > 0) & F.get(s, i - 1)["h"].eqNullSafe(x["h"]))
        )
        places = let(pairs, lambda s: F.sort_array(F.transform(twice(s), lambda x: x["p"])))
        steps = let(places, lambda p: F.transform(p, lambda x, i: F.least(F.lit(n), F.coalesce(F.get(p, i + 1) - x, F.lit(n)))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(count(h)))

    return let(tokens, lambda w: F.when(F.size(w) >= n, of(w)).otherwise(F.lit(0))).cast("long")


def clean_lines(text: Column, rules: LineRules = LineRules()) -> Column:
    """The distinct lines of a text that pass, in order."""
    whole = F.when(text.rlike(rules.wrapped_next), F.regexp_replace(text, rules.wrapped, "$1 $2")).otherwise(text)

    def passing(w: Column) -> Column:
        phrases = let(F.lower(w), lambda x: has_any(x, rules.boilerplate))
        told = F.struct(phrases.alias("phrases"), has_any(w, pairs_of(rules.doubled)).alias("doubled"), has_any(w, dict.fromkeys(rules.symbols + rules.separators)).alias("symbols"))
        return let(told, lambda t: F.filter(F.array_distinct(F.split(w, "\n")), lambda x: line_passes(x, rules, t["phrases"], t["doubled"], t["symbols"])))

    return let(whole, passing)


def quality(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its measures, base_failed and the verdict."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    cut = base.select("doc_id", "t", words(F.col("t")).alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"))
    measured = cut.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(without(F.col("t"), "#*$%&|<>"))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        F.length(without(F.array_join(clean_lines(F.col("t"), rules), ""), SPACES)).cast("long").alias("kept_chars"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stays = F.col("kept_chars") >= F.lit(rules.min_kept_share) * F.col("word_chars")
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & stays).alias("kept"), "kept_chars",
    )


def clean_documents(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept documents with their cleaned text; all other columns stay."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = F.array_join(clean_lines(text, rules), "\n")
    chars = lambda c: F.length(without(c, SPACES))
    return docs.where(chars(kept) >= F.lit(rules.min_kept_share) * chars(text)).withColumn(text_col, kept)
