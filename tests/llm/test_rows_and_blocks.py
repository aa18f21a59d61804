"""Rows of one id, near-equal vectors, many languages and sources: what caps and ids must not decide."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosspanel.llm import language, mixing, neighbours


def brute_nearest(rows, k):
    """(query id, rank, id, score) over distinct (id, vector) rows."""
    rows, out = sorted({(i, tuple(v)) for i, v in rows}), []
    x = np.array([v for _, v in rows])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for a, (i, _) in enumerate(rows):
        if i % 50 == 0:
            near = unit @ unit[a]
            order = sorted((b for b in range(len(rows)) if b != a), key=lambda b: (-round(near[b], 11), rows[b][0]))[:k]
            out += [(i, r, rows[b][0], round(near[b], 9)) for r, b in enumerate(order, 1)]
    return sorted(out)


def test_rows_of_one_id_count_each(spark):
    r = np.random.default_rng(9)
    rows = [(i % 90, [float(c) for c in v]) for i, v in enumerate(r.normal(size=(240, 6)))]
    rows += [(7, [0.0, 1.0, 0.0, 0.0, 0.0, 0.0]), (7, [1.0, 0.1, 0.0, 0.0, 0.0, 0.0]), (50, [1.0, 0.1, 0.0, 0.0, 0.0, 0.001])] + rows[:30]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("row", F.lit("x"))
    for cells in ({}, {"candidates_per_cell": 40, "queries_per_cell": 3}):
        out = neighbours.nearest(df, F.col("vec_id") % 50 == 0, **cells).collect()
        assert sorted((x.query_id, x.rank, x.vec_id, round(x.score, 9)) for x in out) == brute_nearest(rows, 5)


@pytest.mark.parametrize("n", [500, 1500])
def test_close_vectors_give_k_rows_a_cell(n):
    r = np.random.default_rng(2)
    v = r.normal(size=16) + 1e-6 * r.normal(size=(n, 16))
    whole, scale, length, off = neighbours.quantise(v)
    every = {"row": np.arange(n), "id": np.arange(n), "v": v, "code": whole, "scale": scale, "length": length, "off": off}
    asked = {x: y[::50] for x, y in every.items()}
    parts = list(neighbours.best_of_cell(asked, every, 5))
    assert sum(len(p[0]) for p in parts) == 5 * len(asked["id"])
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    for q, c, s in zip(*(np.concatenate(x) for x in zip(*parts, strict=True)), strict=True):
        assert abs(s - unit[q] @ unit[c]) < 1e-12 and np.sum(np.delete(unit @ unit[q], q) > s + 1e-12) < 5


@pytest.fixture(scope="module")
def speech(spark):
    words = {"en": ["the", "house", "with"], "fr": ["élan", "très", "où"], "de": ["über", "straße", "nicht"], "it": ["perché", "gli", "zucchero"], "sv": ["är", "på", "mjölk"]}
    r = random.Random(3)
    rows = [(None, " ".join(r.choices(words[lang], k=20)), lang) for lang in words for _ in range(900)] + [(5, "the house with the the house", "en")] * 500
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), words


def test_null_and_equal_ids_do_not_empty_the_sample(speech):
    docs, words = speech
    profiles = language.fit(docs, per_language=20)
    assert {r.lang for r in profiles.select("lang").distinct().collect()} == set(words)
    out = language.identify(docs, profiles).groupBy("lang_pred").count().collect()
    assert {r.lang_pred: r["count"] for r in out} == {lang: 900 + 500 * (lang == "en") for lang in words}
    one_row = docs.where("doc_id = 5")
    assert {r.lang for r in language.fit(one_row, per_language=3).collect()} == {"en"}


def test_blocks_of_languages_change_nothing(speech, monkeypatch):
    docs, _ = speech
    profiles = language.fit(docs)
    some = docs.limit(400).unionByName(docs.limit(1).selectExpr("doc_id", "null text", "lang"))
    once = sorted(map(tuple, language.identify(some, profiles).collect()), key=str)
    kept = language.keep_identified(some, profiles).count()
    monkeypatch.setattr(language, "BLOCK", 2)
    assert sorted(map(tuple, language.identify(some, profiles).collect()), key=str) == once
    assert language.keep_identified(some, profiles).count() == kept == 400


def filled(sizes, share, most, weights):
    """Capped water-filling by giving the excess away again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda x: x.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    cap, budget, fixed = {s: sizes[s] * most for s in names}, sum(sizes.values()) * share, set()
    while True:
        free = [s for s in names if s not in fixed]
        left = budget - sum(cap[s] for s in fixed)
        target = {s: cap[s] if s in fixed else left * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] >= cap[s]}
        if not over:
            return target
        fixed |= over


@pytest.mark.parametrize("n", [1, 7, 300])
def test_water_filling_over_many_parts(spark, n):
    r = random.Random(n)
    sizes = {f"s{i}" if i else None: r.choice([0, 1, 5, 40, 1000]) for i in range(n)}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {x.source: x.target for x in mixing.water_fill(df, 1.5, 2.0).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected = filled(sizes, 1.5, 2.0, mixing.WEIGHTS)
    assert got.keys() == expected.keys() and all(abs(got[s] - expected[s]) <= 1e-9 * max(1, expected[s]) for s in got)


def headed(n: int, seed: int) -> list[tuple]:
    """Texts of 60 words that share a header of 16 words and nothing else, two near copies and one exact copy among them."""
    r = random.Random(seed)
    header = [f"head{i}" for i in range(16)]
    rows = [(i, " ".join([*header, *(f"w{r.randrange(10**9)}" for _ in range(44))])) for i in range(n)]
    return [*rows, (n, rows[7][1] + " tail"), (n + 1, rows[9][1].replace("head3", "changed")), (n + 2, rows[11][1])]


def test_header_case_is_linear_where_every_bucket_is_full(spark, monkeypatch):
    from crosspanel.llm import jaccard_join

    counted, met = jaccard_join.shingle_counts, []
    opened = jaccard_join.open_pairs

    def full(docs, k):
        counts, sizes = counted(docs, k)
        return np.full_like(counts, 8192), sizes

    def counting(*args):
        out = opened(*args)
        met.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "shingle_counts", full)
    monkeypatch.setattr(jaccard_join, "open_pairs", counting)
    monkeypatch.setattr(jaccard_join, "CROWD", 40)
    monkeypatch.setattr(jaccard_join, "WORTH", 0)
    for n in (300, 900):
        found = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(spark.createDataFrame(headed(n, n), "doc_id long, text string")).collect()}
        assert found == {i: i for i in range(n)} | {n: 7, n + 1: 9, n + 2: 11}
    assert met[1] <= 4 * max(met[0], 40 * 40 * 16), met


def test_moving_shingles_last_changes_no_link(spark, monkeypatch):
    from crosspanel.llm import jaccard_join

    r = random.Random(12)
    common = [f"c{i}" for i in range(30)]
    base = [" ".join([*r.sample(common, 12), *common[:10], *(f"x{r.randrange(200)}" for _ in range(r.randrange(20, 60)))]) for _ in range(60)]
    rows = []
    for i, text in enumerate(base):
        words = text.split()
        for j in range(4):
            cut = words.copy()
            for _ in range(j):
                cut[r.randrange(len(cut))] = f"y{r.randrange(10**6)}"
            rows.append((10 * i + j, " ".join(cut)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = {x.doc_id: x.component_id for x in jaccard_join.near_duplicates(docs).collect()}
    monkeypatch.setattr(jaccard_join, "CROWD", 0)
    monkeypatch.setattr(jaccard_join, "WORTH", 0)
    assert {x.doc_id: x.component_id for x in jaccard_join.near_duplicates(docs).collect()} == before
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    ids, root = sorted(sets), {i: i for i in sets}
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {i: min(x, y) if v in (x, y) else v for i, v in root.items()}
    assert before == root


def test_counters_of_the_sketch_are_small(spark):
    from crosspanel.llm import jaccard_join

    counts = np.random.default_rng(1).poisson(0.4, jaccard_join.CHUNK)
    counts[7], counts[9] = 300, 1 << 40
    raw = jaccard_join.packed(counts)
    assert (jaccard_join.unpacked(raw) == counts).all() and len(raw) < jaccard_join.CHUNK // 3


def test_parities_rule_out_no_linked_pair(spark):
    from crosspanel.llm import jaccard_join

    r = np.random.default_rng(5)
    sets, pairs, linked = [], [], set()
    for k in range(400):
        n = int(r.choice([5, 20, 60, 64, 65, 120, 128, 129, 300, 2000]))
        base = r.integers(0, 1 << 63, n + n // 3, np.uint64)
        a = np.unique(base[: n + int(r.integers(0, n // 4 + 1))])
        b = np.unique(np.concatenate([base[int(r.integers(0, n // 4 + 1)) : n], r.integers(0, 1 << 63, int(r.integers(0, n // 12 + 1)), np.uint64)]))
        if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
            continue
        sets += [(2 * k, len(a), jaccard_join.parity(a).tolist()), (2 * k + 1, len(b), jaccard_join.parity(b).tolist())]
        pairs.append((2 * k, 2 * k + 1))
        same = len(np.intersect1d(a, b))
        if 180 * same >= 80 * (len(a) + len(b)):
            linked.add((2 * k, 2 * k + 1))
    found = jaccard_join.likely(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(sets, "h long, n int, odd array<long>"))
    kept = {tuple(x) for x in found.collect()}
    assert linked and linked <= kept < set(pairs)
    assert any(len(x[2]) != len(y[2]) for x, y in zip(sets[::2], sets[1::2], strict=True))
