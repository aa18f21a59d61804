"""Placement in the shard tree by a few lines of MD5, and the line rules in several scripts."""

import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from crosspanel.llm import quality_rules, sharding


def draw(key: str, node: str, weight: float) -> float:
    bits = int(hashlib.md5(f"{key}:{node}".encode()).hexdigest()[:12], 16)
    return -math.log((bits + 1) / (2**48 + 1)) / weight


def placed(key: str, shards: int) -> int:
    """Two racks of two shards in each region; a shard beyond the eighth is a region."""
    leaves = [(i // 4, i % 4 // 2, i, 1.0) for i in range(8)] + [(2 + i, 0, 8 + i, 1.0) for i in range(shards - 8)]
    path = ""
    for level, name in enumerate(("region", "rack", "shard")):
        weights = Counter()
        for leaf in leaves:
            weights[leaf[level]] += leaf[3]
        best = min(weights, key=lambda c: draw(key, f"{path}{name}{c}", weights[c])) if len(weights) > 1 else next(iter(weights))
        leaves = [leaf for leaf in leaves if leaf[level] == best]
        path += f"{name}{best}/"
    return leaves[0][2]


def test_placement_equals_plain_md5(spark):
    rows = [(i, f"text {i % 7}") for i in range(400)] + [(5, "text 5")] * 30 + [(None, "x"), (None, None), (7, None)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit(9)).repartition(6)).collect()
    assert len(out) == len(rows)
    for r in out:
        key = "null" if r.doc_id is None else str(r.doc_id)
        assert (r.shard, r.grown_shard) == (placed(key, 8), placed(key, 9))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


CLEAN = {
    "ja": "今日は天気が良いので、友達と一緒に公園へ散歩に行きました。",
    "zh": "他走进房间，坐在窗边，看着外面的雨慢慢停了下来！",
    "hi": "आज सुबह वह अपने मित्रों के साथ नदी के किनारे टहलने गया था।",
    "ur": "وہ کل شام اپنے دوستوں کے ساتھ دریا کے کنارے سیر کے لیے گیا تھا۔",
    "am": "ዛሬ ጠዋት ከጓደኞቹ ጋር በወንዙ ዳርቻ ለመራመድ ሄደ።",
    "de": "Am Abend ging er mit seinen Freunden am Fluss entlang nach Hause.",
}
BOILERPLATE = {
    "en": "All rights reserved. Terms of use. Privacy policy.",
    "de": "Alle Rechte vorbehalten. Impressum. Nutzungsbedingungen. Hier klicken.",
    "fr": "Tous droits réservés. Mentions légales. Cliquez ici.",
    "es": "Todos los derechos reservados. Aviso legal. Haga clic aquí.",
}


@pytest.mark.parametrize("lang", CLEAN)
def test_prose_of_every_script_stays(spark, lang):
    text = "\n".join(f"{k} {CLEAN[lang]}" for k in range(10))
    kept = quality_rules.clean_documents(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert len(kept) == 1 and len(kept[0].text.split("\n")) == 10


@pytest.mark.parametrize("lang", BOILERPLATE)
def test_boilerplate_of_four_languages_goes(spark, lang):
    rows = spark.range(1).select(quality_rules.line_passes(F.lit(BOILERPLATE[lang])).alias("b"), quality_rules.line_passes(F.lit(CLEAN["de"])).alias("c")).first()
    assert (rows.b, rows.c) == (False, True)
