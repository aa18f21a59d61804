"""Token counts of every prefix against the library, and the query's cut."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from crosspanel.llm import bpe, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
R = random.Random(11)
TEXTS = [
    "", " \n ", " \u3000", "  Don't   we'LL they're 'really' 'r 're", "unbelievable straightforward 2024!!! ?!'s", "A" * 70 + "the" * 40, "".join(R.choice("abcdefgh") for _ in range(200)),
    "caf\u00e9 cafe\u0301 s\u0301\u0307 '\u0301 q\u0307x \u0130stanbul", "\u4e2d\u6587\u6587\u672c " * 9, "\U0001f642\U0001f642 \u1112\u1161\u11ab\ud55c x", "\u03a3\u03af\u03c3 \u03a3\u0391\u03a3 \ufb01n",
    "\u0928\u092e\u0938\u094d\u0924\u0947 \u0e2a\u0e27\u0e31\u0e2a\u0e14\u0e35 y\u3000z\x1c q \x85", *["".join(R.choice("abe\u00e9hinorst'tS .\n0") for _ in range(60)) for _ in range(20)],
]


@pytest.fixture(scope="module")
def library():
    lib = Tokenizer.from_file(PATH)
    return lambda text: len(lib.encode(text, add_special_tokens=False).ids)


def test_every_prefix_has_the_count_of_the_text_cut_there(library):
    for text in TEXTS:
        counts, starts, ends = bpe.word_bpe(PATH).text_prefixes(text)
        assert len(counts) == len(starts) == len(ends)
        assert all(a < b for a, b in zip(starts, ends, strict=True)) and all(a <= b for a, b in zip(ends[:-1], starts[1:], strict=True))
        for n, end in zip(counts, ends, strict=True):
            assert n == library(text[:end]), (text, end)
        covered = {p for a, b in zip(starts, ends, strict=True) for p in range(a, b)}
        assert all(c.isspace() for p, c in enumerate(text) if p not in covered)


def test_a_long_word_is_one_entry_a_character():
    counts, _, ends = bpe.word_bpe(PATH).text_prefixes("\u4e2d" * 500 + " " + "ab" * 500)
    assert ends.tolist() == [*range(1, 501), *range(502, 1502)]
    assert counts[-1] > 100


def test_special_tokens_are_one_entry(library):
    text = "one <|endoftext|> two"
    counts, _, ends = bpe.word_bpe(PATH).text_prefixes(text)
    assert ends.tolist() == [1, 2, 3, 17, 19, 20, 21]
    assert counts.tolist() == [library(text[:e]) for e in ends]


def test_the_query_cuts_at_the_longest_prefix_within_the_limit(spark, library):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for limit in (0, 1, 7, 20):
        rows = {r.doc_id: r for r in tokens.count_tokens(d, PATH, limit=limit).collect()}
        fit = {r.doc_id: r for r in tokens.prefix_tables(d, PATH).select("doc_id", tokens.fitting(limit).alias("fit"), tokens.tokens_within(5).alias("five")).collect()}
        for i, text in enumerate(TEXTS):
            ends = bpe.word_bpe(PATH).text_prefixes(text)[2].tolist()
            within = [e for e in ends if library(text[:e]) <= limit]
            after = [e for e in ends if e > max(within, default=0)]
            assert fit[i].fit == max(within, default=0)
            assert fit[i].five == library(text[: max([e for e in ends if e <= 5], default=0)])
            assert rows[i].over_limit == (library(text) > limit)
            assert library(text[: rows[i].cut_chars]) <= limit
            assert rows[i].cut_chars == len(text) if not after else max(within, default=0) <= rows[i].cut_chars < after[0]
            if text.isascii():
                assert rows[i].cut_chars == max(p for p in range(len(text) + 1) if library(text[:p]) <= limit)
