"""The whole pipeline against plain Python: profiles, links, windows, mix and tokens worked out again."""

import hashlib
import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

SPACE = "[\x20\x09-\x0d]+"


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def grams(text):
    """Most frequent n-grams of one to three letters; a space stands at either end of a word, and inside of none."""
    code = " " + "".join(c.lower()[0] if c.isalpha() else " " for c in text) + " "
    code = re.sub(" +", " ", code)
    number = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    found = Counter(c for c in code if c != " ")
    found.update(code[i : i + 2] for i in range(len(code) - 1))
    found.update(code[i : i + 3] for i in range(len(code) - 2) if code[i + 1] != " ")
    return found, number


def ranks(found, number, size=300):
    return sorted(found, key=lambda g: (-found[g], number(g)))[:size]


def identified(rows):
    profiles = {}
    for lang in sorted({r[2] for r in rows if r[2] is not None}):
        total, seen = Counter(), set()
        for i, text, of, *_ in rows:
            if of == lang and text is not None and zlib.crc32(str(i).encode()) % 5 and (i, text) not in seen:
                seen.add((i, text))
                if any(c.isalpha() for c in text):
                    found, number = grams(text)
                    total += found
        if total:
            profiles[lang] = {g: k for k, g in enumerate(ranks(total, number))}

    def score(text):
        if not text or not any(c.isalpha() for c in text):
            return 0.0
        mine = ranks(*grams(text))
        return max(1 - sum(abs(p[g] - k) if g in p else 300 for k, g in enumerate(mine)) / (300 * len(mine)) for p in profiles.values())

    return [r for r in rows if score(r[1]) >= 0.2]


def deduplicated(rows):
    def shingles(text):
        w = split("".join(c.lower() if c.isascii() else c for c in text or ""))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            alike = rows[a][:2] == rows[b][:2] or (sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
            if alike and root[a] != root[b]:
                old, new = sorted((root[a], root[b]), reverse=True)
                root = [new if x == old else x for x in root]
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(root[k], []).append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0])) for g in groups.values()]


def without_repeats(rows, k=35):
    words = [split(r[1]) for r in rows]
    starts = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for r, w in zip(rows, words, strict=True):
        gone = {i + j for i in range(len(w) - k + 1) if starts[tuple(w[i : i + k])] > 1 for j in range(k)}
        out.append((r[0], " ".join(x for i, x in enumerate(w) if i not in gone) if gone else r[1], *r[2:]))
    return out


def mixed(rows):
    size = Counter()
    for r in rows:
        size[r[3]] += len(split(r[1]))
    names = sorted((s for s in size if s is not None), key=lambda x: x.encode()) + [s for s in size if s is None]
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    budget, full = 1.5 * sum(size.values()), set()
    while True:
        free = [s for s in names if s not in full]
        left = budget - sum(2.0 * size[s] for s in full)
        target = {s: 2.0 * size[s] if s in full else left * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] >= 2.0 * size[s]}
        if not over:
            break
        full |= over
    out = []
    for s in names:
        mine = sorted((r for r in rows if r[3] == s), key=lambda r: hashlib.md5(f"17:{'null' if r[0] is None else r[0]}:{r[1] or ''}".encode()).hexdigest())
        whole = int(target[s] // size[s]) if size[s] else 0
        rest, so_far = target[s] - whole * size[s], 0
        for r in mine:
            n = len(split(r[1]))
            out += [r] * (whole + (so_far + n / 2 <= rest))
            so_far += n
    return out


def corpus():
    r = random.Random(31)
    letters = {"en": "the of and house with three river stone under", "fr": "élan très où château les des une pour être", "de": "über straße nicht schön und der die das ein"}
    vocabulary = {lang: [w + x for w in words.split() for x in ("", "s", "en", "er", "ing")] for lang, words in letters.items()}
    passage = " ".join(r.choices(vocabulary["en"], k=40))
    rows = []
    for i in range(90):
        lang = list(vocabulary)[i % 3]
        text = " ".join(r.choices(vocabulary[lang], k=r.randrange(20, 90)))
        if i % 9 == 4:
            text = f"{text} {passage}\n{text[:30]}"
        rows.append((i, text, lang if i % 4 else None, [None, "x", "y", "z"][i % 4], len(text)))
    rows += [(200, rows[5][1], "en", "x", 1), (3, rows[8][1] + " more words", None, "y", 1), (201, None, "en", "x", None), (202, "12 34 !!", "en", "y", 8), (203, "", None, "z", 0)]
    rows += [(None, rows[10][1], "fr", "x", 1), (204, "zxqvwk jjqxz qqkzv " * 12, None, "x", 228), (205, "Ünïcode 日本 text “quoted” <|endoftext|> und der die das " * 3, "de", "x", 1)]
    return rows


def test_pipeline_equals_plain_python(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = []
    stages = [identified(rows)]
    for f in (deduplicated, without_repeats, mixed):
        stages.append(f(stages[-1]))
    assert len(rows) > len(stages[0]) > len(stages[1]) == len(stages[2]) and stages[1] != stages[2]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for i, text, *_ in stages[-1]:
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected.append((-1 if i is None else i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    found = [(-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted(expected)
