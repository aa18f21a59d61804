"""Clashing column names, empty tables, null ids and independent forms of what the operators compute."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from crosspanel.llm import fm_index, jaccard_join, language, quality_rules, sharding, shingles, substring_dedup

R = random.Random(11)
CLASH = ["_row", "_ROW_", "_key", "_runs", "_one", "_by", "_mix_copy", "_mix_copies", "_times", "d", "h", "u", "k", "comp", "bucket", "copies"]


def prose(tag: str, n: int) -> str:
    return " ".join(f"{tag}{R.randrange(10**6)}" for _ in range(n))


@pytest.fixture(scope="module")
def clashing(spark):
    shared, base = prose("s", 40), prose("b", 60)
    rows = [(1, base, "en", "x"), (2, base + " tail", "en", "y"), (None, base, None, None), (3, prose("p", 20) + " " + shared, "en", "x"),
            (4, shared + " " + prose("q", 25), "fr", "y"), (5, None, "en", "x"), (6, "", None, "y"), (3, "other words here", "en", "x")]
    rows.append(rows[3])
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars int")
    return docs.select("*", *[F.lit(f"v{i}").alias(c) for i, c in enumerate(CLASH)])


def test_stages_take_clashing_names_empty_tables_and_null_ids(spark, clashing):
    docs = clashing
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("false"), "").count() == 0, name
        kept = stage(spark, docs, "")
        assert kept.columns == docs.columns, name
        rows = kept.collect()
        assert all(r[c] == f"v{i}" for r in rows for i, c in enumerate(CLASH)), name
        docs = spark.createDataFrame(rows, docs.schema)
        if name == "near_duplicates":
            assert Counter(r.doc_id for r in rows) == Counter([1, 3, 3, 4])
        if name == "repeated_passages":
            assert {len((r.text or "").split()) for r in rows} == {60, 20, 25, 3}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()


def test_null_ids_are_linked(spark):
    base = prose("n", 60)
    docs = spark.createDataFrame([(None, base), (None, base + " more"), (9, prose("z", 30)), (8, prose("y", 30)), (None, prose("x", 30))], "doc_id long, text string")
    found = [tuple(r) for r in jaccard_join.near_duplicates(docs).collect()]
    assert sorted(found, key=str) == sorted([(None, 56, None), (None, 57, None), (9, 26, 9), (8, 26, 8), (None, 26, None)], key=str)
    linked = docs.unionByName(docs.sparkSession.createDataFrame([(5, base + " more")], docs.schema))
    assert {r.component_id for r in jaccard_join.near_duplicates(linked).collect() if r.n_shingles > 50} == {5}
    texts = docs.select(F.concat(F.lit("t"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias("doc_id"), "text")
    assert {r.component_id for r in jaccard_join.near_duplicates(texts).collect()} == {"t?", "t9", "t8"}


def test_boundary_follows_the_cost():
    sizes = np.zeros(jaccard_join.MOST + 1, np.int64)
    sizes[5:20] = 100
    rare, often = jaccard_join.boundary(sizes, 0.0)[0], jaccard_join.boundary(sizes, 1.0)[0]
    assert rare < often
    for small, large in (jaccard_join.boundary(sizes, x) for x in (0.0, 0.2, 1.0)):
        assert large <= small + 1 and 5 * large >= 4 * (small + 1)


@pytest.mark.parametrize("shared", [0.0, 1.0])
def test_links_do_not_depend_on_the_boundary_or_the_sketch(spark, monkeypatch, shared):
    texts = []
    for size in (6, 9, 11, 14, 16, 20, 30):
        base = [f"b{R.randrange(10**6)}" for _ in range(size)]
        for _ in range(4):
            w = list(base)
            w[R.choice([0, len(w) - 1])] = f"c{R.randrange(10**6)}"
            texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(shingles.shingle_set(t).tolist()) for t in texts]
    root = list(range(len(sets)))
    for _ in range(5):
        for i, a in enumerate(sets):
            for j in range(i):
                if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    pick = jaccard_join.boundary
    monkeypatch.setattr(jaccard_join, "boundary", lambda sizes, _: pick(sizes, shared))
    monkeypatch.setattr(jaccard_join, "LONG", 1)
    assert {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs).collect()} == dict(enumerate(root))


def test_shards_need_their_base_and_weights_move_one_subtree(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    with pytest.raises(ValueError, match="base"):
        sharding.shard_documents(docs, shards=5)
    grown = sharding.shard_documents(docs, shards=5, base=5).collect()
    assert all(r.grown_shard in (r.shard, 5) for r in grown)
    nine = {r.doc_id: r.grown_shard for r in sharding.shard_documents(docs, shards=8).collect()}
    assert nine == {r.doc_id: r.shard for r in sharding.shard_documents(docs, shards=9).collect()}
    tree = sharding.topology(8)
    light = [sharding.Shard(s.region, s.rack, s.shard, 0.25 if s.shard == 6 else 1.0) for s in tree]
    key = F.col("doc_id").cast("string")
    moved = docs.select(sharding.place(key, tree).alias("a"), sharding.place(key, light).alias("b")).where("a <> b").groupBy("a", "b").count().collect()
    assert moved
    assert all(r.a == 6 or r.a == 7 or (r.a // 4 == 1 and r.b // 4 == 0) for r in moved)  # out of the lightened shard, rack or region alone
    share = Counter(r.s for r in docs.select(sharding.place(key, light).alias("s")).collect())
    assert share[6] < 0.5 * share[5]


def test_rank_distance_by_definition(spark):
    text = {"en": "the cat and the dog with the hat " * 9, "fr": "le chat et le chien avec le chapeau " * 9}
    docs = spark.createDataFrame([(i, text[lang], lang) for i, lang in enumerate(["en", "fr"] * 20)], "doc_id long, text string, lang string")

    def grams(t: str) -> list[str]:
        padded = " " + " ".join(t.split()) + " "
        every = [padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1)]
        count = Counter(g for g in every if g.strip() and " " not in g[1:-1] and g != " ")
        code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
        return sorted(count, key=lambda g: (-count[g], code(g)))[: language.PROFILE]

    asked = "the chat and le dog"
    mine, best = grams(asked), {}
    for lang, t in text.items():
        profile = grams(t)
        best[lang] = sum(abs(profile.index(g) - i) if g in profile else language.PROFILE for i, g in enumerate(mine))
    profiles = language.fit(docs)
    out = language.identify(docs.limit(1).select(F.lit(1).alias("doc_id"), F.lit(asked).alias("text")), profiles).first()
    assert out.lang_pred == min(best, key=lambda x: (best[x], x))
    assert abs(out.score - (1 - min(best.values()) / (language.PROFILE * len(mine)))) < 1e-12


def test_texts_like_no_profile_go_and_all_stay_without_profiles(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog " * 9, "en"), (2, "Ωψ ξζ " * 9, None), (3, "the dog and the cat", None)], "doc_id long, text string, lang string")
    assert {r.doc_id for r in language.keep_identified(docs, language.fit(docs)).collect()} == {1, 3}
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language.keep_identified(none, language.fit(none)).count() == 3


PLAIN = " ".join(f"w{i}" for i in range(80))


@pytest.mark.parametrize(
    ("line", "passes"),
    [("It ends well.", True), ("one. " + PLAIN, False), ("It ends " + "so it goes. " * 8 + "and is cut", True), ("home | news | mail.", False), ("a plain line | with one separator.", True), ("### $$$ &&& it.", False),
     ("wow!! yes!! no!!", False), ("Click here to subscribe.", False), ("We had a cookie after the long and pleasant walk home.", True), (PLAIN, False)],
)
def test_each_line_rule(spark, line, passes):
    assert spark.range(1).select(quality_rules.line_passes(F.lit(line)).alias("p")).first().p == passes


def test_counts_of_characters_equal_plain_python(spark):
    texts = ["", " \t\n\x0b\x0c\r", "a|b##c é<>😀 %$&*", "no symbols here.\nand\u00a0none\u2028there", "|||", "#" * 9 + " x\n\n#"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for chars in (quality_rules.SPACES, "#*$%&|<>"):
        assert [r.x for r in df.select(quality_rules.without(F.col("t"), chars).alias("x")).collect()] == ["".join(c for c in t if c not in chars) for t in texts]
    plan = quality_rules.quality(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "translate(" not in plan  # which makes a string of every character


def test_wrapped_lines_are_one(spark):
    row = spark.range(1).select(quality_rules.clean_lines(F.lit("It is a long line that\nis wrapped here.\nNext\nHome")).alias("x")).first()
    assert row.x == ["It is a long line that is wrapped here."]


def test_index_reports_whole_and_partial_repeats():
    k = 5
    words = np.arange(1, 200, dtype=np.uint64)
    segs = [words[:12], np.concatenate([words[100:103], words[2:9], words[110:113]]), words[50:60], words[70:80], words[50:60]]
    found = {q: (a, n) for q, a, n in substring_dedup.shard_intervals(segs, np.array([4, 9, 7, 5, 7]), k)}
    assert found == {0: (2, 3), 1: (3, 3), 2: (0, 6)}  # the third stands in the index twice, under one name; the fourth once


def test_copies_go_to_the_index_by_place_or_count(spark):
    rows = [(1, 1, (5, 0), (9, 3)), (2, 2, (5, 0), (5, 0)), (3, 1, (5, 0), (5, 0)), (4, 7, (1, 1), (2, 2))]
    groups = spark.createDataFrame(rows, "seg long, c long, first struct<d: long, start: int>, last struct<d: long, start: int>")
    found = Counter(r.seg for r in substring_dedup.two_places(groups, ["seg"]).collect())
    assert found == {1: 2, 2: 2, 3: 1, 4: 2}  # the first is found twice even where the count is wrong


def test_bit_rows_and_search():
    gen = np.random.default_rng(1)
    bit = np.concatenate([np.zeros(300, np.int64), np.ones(300, np.int64), gen.integers(0, 2, 200)])
    row = fm_index.BitRow(bit)
    assert len(row.words) < len(bit) // 64
    assert row.ones(np.arange(len(bit))).tolist() == [int(bit[:i].sum()) for i in range(len(bit))]


def test_many_texts_hash_as_one_by_one():
    texts = ["", "a", "a b c d e f g", "  x\ty\x0bz\n", prose("m", 300), "É é", "a b c d e"]
    words, counts = shingles.many_words([t.encode() for t in texts])
    assert counts.tolist() == [len(t.encode().split()) for t in texts]
    assert words.tolist() == [h for t in texts for h in shingles.word_hashes(t.encode()).tolist()]
    assert len(shingles.shingle_set(texts[2])) == 3
