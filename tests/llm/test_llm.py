"""The training-data operators against brute force, on texts with every edge case."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crosspanel.llm import bpe, jaccard_join, language, mixing, neighbours, quality_rules, sharding, substring_dedup, token_store, tokens

R = random.Random(7)
VOCAB = ["the", "of", "and", "a", "straße", "élan", "don't", "we'LL", "x.", "foo,", "12", "中文", "🙂", "naïve", "INTO", "ab-c", "<|endoftext|>"] + [f"w{i}" for i in range(300)]


def prose(n: int) -> str:
    return " ".join(R.choice(VOCAB) for _ in range(n))


BASE = prose(120)
PASSAGE = prose(45)


def edited(text: str, every: int) -> str:
    return " ".join(f"e{i}" if i % every == 0 else w for i, w in enumerate(text.split(" ")))


TEXTS: list[str | None] = [
    None, "", " \n\t ", "one", "a b c d", "a b c d", BASE, BASE, BASE.upper(), edited(BASE, 97), edited(BASE, 60), edited(BASE, 11),
    prose(30) + " " + PASSAGE + " " + prose(30), PASSAGE + "\n" + prose(50), prose(3) + "  " + prose(4) + " ", "x y　z \x1c q  \x85",
    "?!... --- ###", "1234 5678", "same words here " * 40, "line one.\nline one.\n" * 12 + "nav | a | b | c\n", prose(4000), "Ω≈ Σίσυφος ΣΑΣ İstanbul", " ".join(f"u{i}" for i in range(9)),
    " ".join(f"u{i}" for i in range(10)), " ".join(f"v{i}" for i in range(16)), " ".join(f"v{i}" for i in range(17)),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Clashing names of further columns: n, key, words, size."""
    rows = [(i, t, ["en", None, "fr"][i % 3], [None, "s1", "s2", "é"][i % 4], 1, "k", "w", 2.0) for i, t in enumerate(TEXTS)]
    rows.append(rows[6])  # a repeated row
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n int, key string, words string, size double")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def one(rows):
    return {r.doc_id: r for r in rows}


def test_sharding(docs, empty):
    out = sharding.shard_documents(docs).collect()
    assert len(out) == len(TEXTS) + 1
    for s in range(8):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 8) for r in out)
    assert all(r.size == len((TEXTS[r.doc_id] or "").encode()) + 1 for r in out)
    assert all(r.text_crc32 == zlib.crc32((TEXTS[r.doc_id] or "").encode()) for r in out)
    assert sharding.shard_documents(empty).count() == 0


def test_sharding_is_even_and_moves_only_into_the_new_shard(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    out = sharding.shard_documents(rows).groupBy("shard", "grown_shard").count().collect()
    assert all(r.grown_shard in (r.shard, 8) for r in out)
    size = Counter()
    for r in out:
        size[r.shard] += r["count"]
    assert max(size.values()) < 1.15 * min(size.values())


def test_counts_and_round_trip(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    counted, trip = one(tokens.count_tokens(docs, path, limit=20).collect()), one(tokens.round_trip(docs, path).collect())
    tables = one(tokens.prefix_tables(docs, path).select("*", tokens.fitting(20).alias("fit"), tokens.tokens_within(10).alias("within")).collect())
    decoded = one(tokens.decode_ids(tokens.encode_ids(docs, path), path).collect())
    for i, t in enumerate(TEXTS):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        assert (counted[i].n_tokens, counted[i].n_bytes, counted[i].over_limit) == (len(ids), len((t or "").encode()), len(ids) > 20)
        assert trip[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert trip[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert decoded[i].text == text
        assert (tables[i].counts or [0])[-1] == len(ids)
        assert tables[i].counts == sorted(tables[i].counts)
        assert sum(c <= 20 for c in tables[i].counts) == (tables[i].ends.index(tables[i].fit) + 1 if tables[i].fit else 0)
    assert tokens.count_tokens(empty, path).count() == tokens.round_trip(empty, path).count() == 0


def test_backtracking_equals_the_library_on_random_words():
    path = public_tokenizers.path("word_bpe_49k.json")
    ours, lib = bpe.word_bpe(path), Tokenizer.from_file(path)
    for _ in range(3000):
        text = "".join(R.choice("abeéhinorst'tS .\n0") for _ in range(R.randrange(40)))
        ids = lib.encode(text, add_special_tokens=False).ids
        assert ours.text_ids(text).tolist() == ids
        assert ours.text_count(text) == len(ids)
    for word in ("a" * 200, "the" * 50, "ab" * 77):
        counts = ours.prefix_counts(ours.word_symbols(word))
        for k in (1, 5, 33, len(word) - 1):
            assert counts[k] == len(ours.encode(ours.word_symbols(word)[:k]))


def test_language(spark, empty):
    words = {"en": ["the", "house", "with", "three"], "fr": ["élan", "château", "très", "où"], "de": ["über", "straße", "nicht", "schön"]}
    rows = [(i, " ".join(R.choice(words[lang]) for _ in range(30)), lang) for i, lang in enumerate(list(words) * 60)]
    rows += [(900, None, "en"), (901, "123 !!", "en"), (902, "the house", None), (0, rows[0][1], "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language.predict_languages(d).collect()
    assert len(out) == len(rows)
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in rows}
    assert all(r.held_out == held[r.doc_id] and 0 <= r.score <= 1 for r in out)
    by = one(out)
    assert by[900].lang_pred == by[901].lang_pred == "und"
    assert all(by[i].lang_pred == lang for i, _, lang in rows[:180])
    assert language.predict_languages(d.where("false")).count() == 0
    assert {r.lang_pred for r in language.predict_languages(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_neighbours(spark):
    gen = np.random.default_rng(3)
    x = gen.normal(size=(700, 16)).astype("f4")
    x[300:420] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(700, None), (701, [0.0] * 16), (702, [float("nan")] + [1.0] * 15), (703, [None] + [1.0] * 15), (750, [1.0, 2.0]), (751, [2.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = neighbours.nearest(v, F.col("vec_id") % 50 == 0, candidates_per_cell=128, queries_per_cell=4).collect()
    d = x.astype("f8")
    unit = d / np.linalg.norm(d, axis=1)[:, None]
    for q in range(0, 700, 50):
        near = unit[q] @ unit.T
        order = sorted((i for i in range(700) if i != q), key=lambda i: (-round(near[i], 12), i))[:5]
        mine = sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5]
        assert [r.vec_id for r in mine] == order
        assert np.allclose([r.score for r in mine], near[order], atol=1e-12)
    assert [(r.vec_id, round(r.score, 9)) for r in out if r.query_id == 750] == [(751, 0.8)]
    # repeated rows, query or not, count once; a null id takes no part
    again = v.unionByName(v.where("vec_id in (0, 50, 51, 300)")).unionByName(v.where("vec_id = 50").select(F.lit(None).cast("long").alias("vec_id"), "embedding"))
    assert sorted(map(tuple, neighbours.nearest(again, F.col("vec_id") % 50 == 0).collect())) == sorted(map(tuple, out))
    assert neighbours.nearest(v.where("false"), F.lit(True)).count() == 0


def words_of(t):
    return (t or "").encode().split()


def test_substring_dedup(docs, empty, monkeypatch):
    rows = [*enumerate(TEXTS), (6, TEXTS[6])]
    windows = Counter(tuple(words_of(t)[p : p + 35]) for _, t in rows for p in range(len(words_of(t)) - 34))
    for crowded in (4_000, 2):
        monkeypatch.setattr(substring_dedup, "CROWDED", crowded)
        out = substring_dedup.remove_repeats(docs).collect()
        assert len(out) == len(rows)
        for r in out:
            w = words_of(TEXTS[r.doc_id])
            gone = {q for p in range(len(w) - 34) if windows[tuple(w[p : p + 35])] > 1 for q in range(p, p + 35)}
            kept = b" ".join(x for q, x in enumerate(w) if q not in gone)
            assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_quality(docs, empty):
    for r in quality_rules.quality(docs).collect():
        text = TEXTS[r.doc_id] or ""
        w = [x.decode() for x in text.encode().split()]
        lines = [x for x in text.split("\n") if x.encode().split()]
        grams = Counter(tuple(w[p : p + 3]) for p in range(len(w) - 2))
        repeated = {q for p in range(len(w) - 2) if grams[tuple(w[p : p + 3])] > 1 for q in range(p, p + 3)}
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(repeated))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text)
        assert r.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w))
        assert not (r.base_failed and r.kept)
    assert quality_rules.quality(empty).count() == 0


def test_quality_removes_lines_first(spark):
    good, more, nav = "It is a plain line of words that ends well.", "So is this one, and it is as long.", "home | news | mail | login"
    d = spark.createDataFrame([(1, "\n".join([good, nav, more])), (2, "\n".join([nav + str(i) for i in range(9)]))], "doc_id long, text string")
    assert [(r.doc_id, r.text) for r in quality_rules.clean_documents(d).collect()] == [(1, f"{good}\n{more}")]


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))) if w else frozenset()


def test_jaccard_join(docs, empty):
    sets = {i: shingles(t) for i, t in enumerate(TEXTS)}
    root = {i: i for i in sets}
    for _ in sets:
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    root[i] = min(root[i], root[j])
    out = jaccard_join.near_duplicates(docs).collect()
    assert len(out) == len(TEXTS) + 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == {i: (len(sets[i]), root[i]) for i in sets}
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_jaccard_join_on_random_groups(spark):
    texts = []
    for size in (6, 9, 12, 15, 18, 22, 40, 200):
        for _ in range(6):
            base = [f"b{R.randrange(10**6)}" for _ in range(size)]
            texts += [" ".join(base)]
            for _ in range(6):
                w = list(base)
                for _ in range(R.randrange(1, 1 + max(1, size // 12))):
                    w[R.choice([0, len(w) - 1, R.randrange(len(w))])] = f"c{R.randrange(10**6)}"
                texts += [" ".join(w[R.randrange(2) :])]
    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))
    for _ in range(6):
        for i, a in enumerate(sets):
            for j in range(i):
                if a & sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(d).collect()}
    assert out == dict(enumerate(root))


def test_simple8b_round_trip():
    for _ in range(60):
        pool = [0, 0, 0, 1, 5, 70, 3000, 60_000, 2**31, 2**59, 2**60 - 2, 2**60 - 1, 2**60, 2**64 - 1][: R.randrange(1, 15)]
        v = np.array([R.choice(pool) for _ in range(R.randrange(900))], np.uint64)
        words, escapes = token_store.pack(v)
        assert (token_store.unpack(words, escapes, len(v)) == v).all()


def test_token_store(spark, docs, empty, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    token_store.write_tokens(docs, path, f"{tmp_path}/t", files=3)
    out = sorted(token_store.read_tokens(spark, f"{tmp_path}/t").collect(), key=lambda r: r.start)
    start = 0
    for r, i in zip(out, sorted([*range(len(TEXTS)), 6]), strict=True):
        ids = np.array([*lib.encode(TEXTS[i] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    token_store.write_tokens(empty, path, f"{tmp_path}/e")
    assert token_store.read_tokens(spark, f"{tmp_path}/e").count() == 0


def test_token_pieces(monkeypatch):
    """The library's ids of hard strings, and one call for each different piece, whatever marks and white space stand around it."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, tokens = Tokenizer.from_file(path), token_store.Encoder(path)
    atoms = [" ", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "a", "the", "it's", "'ll", "'re", "'x", "''", "'S", "s", "ve", "é", "ñandú",
             "×", "÷", "ɐ", "ʀ", "12", "!", "...", "<|", "<|endoftext|>", "|>", "“", "—", "中文", "мир", "🙂", "e\u0301", "²", "½", "º", "٣", "\u200b", "\x00"]
    for k in [3, 8, len(atoms)] * 60:
        pool = R.sample(atoms, k)
        texts = ["".join(R.choice(pool) for _ in range(R.randrange(14))) for _ in range(R.randrange(40))]
        ids, begin = tokens.ids(pa.array(["skipped", *texts], pa.string()).slice(1))
        assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:], strict=False)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    other = public_tokenizers.path("word_bpe_49k.json")  # its texts go to the library whole
    lib, whole = Tokenizer.from_file(other), token_store.Encoder(other)
    lib.no_truncation()
    texts = [t or "" for t in TEXTS]
    ids, begin = whole.ids(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:], strict=False)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    calls = []
    monkeypatch.setattr(token_store.Encoder, "of", lambda self, piece, of=token_store.Encoder.of: calls.append(piece) or of(self, piece))
    names = [f"zq{c}{d}" for c in "abcdef" for d in "uvwxyz"]
    texts = [f"{R.choice(names)}{R.choice(',.;:!?')}  {R.choice(names)}.\n{R.choice(names)}{R.choice(['...', '***', '#'])}" for _ in range(2000)]
    for at in range(0, len(texts), 500):
        tokens.ids(pa.array(texts[at : at + 500]))
    assert max(Counter(calls).values()) == 1
    assert len(calls) <= 2 * len(names) + 20


def test_mixing(docs, empty):
    out = mixing.mix(docs).collect()
    assert len(out) == len(TEXTS) + 1
    sizes = Counter()
    for r in out:
        assert r.size == len(words_of(TEXTS[r.doc_id]))
        assert r.taken <= 2 * r.size
        sizes[r.source] += r.size
    order = [*sorted(s for s in sizes if s is not None), *[None for s in sizes if s is None]]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(target[s] for s in full)
        free -= full
    for r in out:
        assert r.source_size == sizes[r.source]
        assert abs(r.target - target[r.source]) < 1e-6
    for s in order:
        assert abs(sum(r.taken for r in out if r.source == s) - target[s]) <= max(r.size for r in out if r.source == s)
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    assert mixing.mix(empty).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en", f"s{i % 3}", 1) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns, name
        kept.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids = {r.doc_id for r in docs.collect()}
        if name == "language_id":
            assert not ids & {0, 1, 2, 16, 17}
        if name == "near_duplicates":
            assert not ids & {5, 7, 8}
        if name == "repeated_passages":
            assert PASSAGE not in "".join(r.text for r in docs.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) == docs.count()


def test_linked_sets_meet_at_their_first_common_shingle(spark):
    """A pair of Jaccard 0.8 or more passes ``meets`` at its first common shingle, and that shingle is in both prefixes."""
    rng, rows = random.Random(5), []
    for _ in range(4000):
        a = set(rng.sample(range(400), rng.randint(12, 60)))
        b = set(a)
        for x in rng.sample(sorted(a), rng.randint(0, len(a) // 5)):
            b.discard(x)
        b |= {rng.randint(400, 800) - 800 * rng.randint(0, 1) for _ in range(rng.randint(0, len(a) // 5))}
        if 9 * len(a & b) >= 4 * (len(a) + len(b)):
            first = min(a & b)
            places = sorted(a).index(first), sorted(b).index(first)
            assert all(p < jaccard_join.prefix_length(len(x)) for p, x in zip(places, (a, b), strict=True))
            rows.append((len(a), places[0], len(b), places[1]))
    assert len(rows) > 500
    assert spark.createDataFrame(rows, "n int, p int, n2 int, p2 int").where(~jaccard_join.meets("n", "p", "n2", "p2")).count() == 0
