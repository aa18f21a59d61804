"""Spelling variants against all edits of all words, and against a plain count of runs."""

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from crosspanel.llm import spelling
from crosspanel.llm.bi_index import LEFT, RIGHT, BiIndex


def edits(word: str, letters: set[str]) -> set[str]:
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    for i in range(len(word) + 1):
        out |= {word[:i] + c + word[i:] for c in letters} | {word[:i] + c + word[i + 1 :] for c in letters if i < len(word)}
    return out - {word}


def expected(rows: list[tuple], least: int = 5, ratio: int = 5) -> list[tuple]:
    counts: Counter[str] = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 6
    words = {w: n for w, n in counts.items() if n >= least}
    letters = set("".join(words))
    near = {w: sorted(edits(w, letters) & words.keys()) for w in words}
    best = {w: min(near[w], key=lambda x: (-words[x], x)) for w in words if near[w]}
    form = {w: f for w, f in best.items() if words[f] >= ratio * words[w]}

    def root(w: str) -> str:
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w, ""), root(w), n, len(near[w]), words.get(form.get(w), 0)) for w, n in words.items())


def found(df) -> list[tuple]:
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


@pytest.mark.parametrize("letters", ["a", "ab", "abé", "abcdefÿ"])
def test_schemes_meet_each_near_word_once(letters):
    r = random.Random(len(letters))
    for _ in range(60):
        words = sorted({"".join(r.choice(letters) for _ in range(r.randrange(6, 12))).encode("latin-1") for _ in range(r.randrange(1, 60))})
        shard, got = spelling.Shard(words), []
        for side in (RIGHT, LEFT):
            a, b = shard.near(np.arange(len(words)), side)
            got += [(words[x], words[y]) for x, y in zip(a, b, strict=True)]
        assert len(got) == len(set(got))
        every = {w.decode("latin-1") for w in words}
        assert set(got) == {(w.encode("latin-1"), x.encode("latin-1")) for w in every for x in edits(w, set(letters)) & every}


def test_intervals_are_those_of_all_suffixes():
    r = np.random.default_rng(2)
    text = np.concatenate([[0], r.integers(0, 4, 300), [0]])
    index, reverse = BiIndex(text, 4, 20), text[::-1]
    rank = [sorted(range(len(t)), key=lambda i, t=t: t[i:].tolist()) for t in (text, reverse)]
    for _ in range(200):
        pattern, state, last = [1], index.of_symbol(1, 1), LEFT
        for _ in range(6):
            side, c = int(r.integers(0, 2)), int(r.integers(1, 4))
            pattern = [*pattern, c] if side == RIGHT else [c, *pattern]
            state = index.grow(side, state if side == last else (state[2], state[1], state[0]), np.array([c]))
            last = side
            starts = [[i for i, s in enumerate(rank[k]) if t[s : s + len(p)].tolist() == p] for k, (t, p) in enumerate(((text, pattern), (reverse, pattern[::-1])))]
            if not starts[0]:
                assert state[1][0] == 0
                break
            assert (state[0][0], state[1][0], state[2][0]) == (starts[side][0], len(starts[side]), starts[1 - side][0])


def corpus() -> list[tuple]:
    r = random.Random(8)
    stems = ["colour", "color", "centre", "center", "naïveté", "naivete", "organise", "organize", "organizes", "aaaaaaa", "aaaaaa", "aaaaaaaa", "ÀLAMODE", "alamode", "x" * 3000, "x" * 3001]
    weights = [60, 3, 20, 2, 8, 40, 3, 90, 700, 9, 5, 60, 7, 7, 1, 1]
    rows = [(i, " ".join(r.choices(stems, weights, k=r.randrange(1, 40)))) for i in range(150)]
    made = ["".join(r.choice("abcé") for _ in range(r.randrange(6, 9))) for _ in range(150)]
    rows += [(200 + i, " ".join(r.choices(made, k=60)).title()) for i in range(40)]
    return [*rows, rows[3], rows[3], (None, "Colour colour-centre_CENTRE"), (None, "colour"), (77, None), (78, ""), (79, "—“…” 12345 日本語 short"), (80, "x" * 3000 + " 😀" * 2000 + "x" * 3001)]


@pytest.mark.parametrize("shards", [60_000, 40])
def test_equals_all_edits(spark, monkeypatch, shards):
    monkeypatch.setattr(spelling, "SHARD_WORDS", shards)
    monkeypatch.setattr(spelling, "BLOCK", 17)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 n", "'x' word", "2 side", "3 shard").repartition(5)
    result = found(spelling.variants(docs))
    assert result == expected(rows)
    assert any(f and r != f for _, f, r, *_ in result)  # a chain of forms


def test_no_words(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(docs).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "some few words"), (None, None)], "doc_id long, text string")).count() == 0
