"""Known pairs of real line-ups, where the CSV files are at hand: IDSYNC_GOLDEN_DIR names a folder with player/, match/ and team/."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from idsync.operators.content import Content
from idsync.operators.engine import MatchSyncEngine, PlayerSyncEngine, TeamSyncEngine
from idsync.sources.frames import split_by_provider

ROOT = Path(os.environ.get("IDSYNC_GOLDEN_DIR", "/nowhere"))
pytestmark = pytest.mark.skipif(not ROOT.is_dir(), reason="IDSYNC_GOLDEN_DIR is not set")
A, B, C = "provider_a", "provider_b", "provider_c"
# Ids of one object with several providers; None where a provider doesn't have it.
CASES = [
    ("player", "2025-07-05-usa-mex", [{A: "332705", B: "12751", C: "24629"}]),
    ("player", "2025-07-15-kor-jpn", [{A: "508366", B: "95406", C: "155852"}, {A: "645847", B: "96073", C: "73729"}]),
    ("player", "2024-09-22-chi-sd-w", [{A: None, B: "218500"}, {A: "27889", B: "33135"}, {A: "13556", B: "5041"}]),
    ("player", "2023-09-13-oma-usa", [{A: None, B: "190928"}, {A: "429448", B: None}]),
    ("match", "2022-25-usa", [{A: "3961387", B: "4447768", C: "1702326"}, {A: "3939974", B: None, C: "1586695"}]),
    ("team", "2025-nwsl", [{A: "21983", B: "13449", C: "3485"}]),
    ("team", "2024-25-ucl", [{A: "1028", B: "197"}, {A: "957", B: None}]),
]
ENGINES = {"player": PlayerSyncEngine, "match": MatchSyncEngine, "team": TeamSyncEngine}


@pytest.mark.parametrize("kind, name, wanted", CASES, ids=lambda x: x if isinstance(x, str) else "")
def test_known_pairs(spark, kind, name, wanted):
    rows = spark.read.option("header", True).csv(str(ROOT / kind / f"{name}.csv")).coalesce(1).withColumn("_row", F.monotonically_increasing_id())
    contents = [Content.of(kind, p, df, order_by="_row") for p, df in split_by_provider(rows, kind).items()]
    found = ENGINES[kind](contents).synchronize().data.collect()
    for ids in wanted:
        hits = [r for r in found if all(r[f"{p}_{kind}_id"] == i for p, i in ids.items())]
        assert len(hits) == 1, ids
