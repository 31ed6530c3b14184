"""Cleaning over micro-batches equals the batch query, also after a restart in the middle."""

import json
import os
import random
from collections import Counter

from momentsift.streaming import cleaning


def test_stream_equals_batch(spark, tmp_path):
    """Runs over the borders of batches, first-tier rows and blanks inside runs, videos without a text, a stream that is stopped and goes on."""
    rng = random.Random(4)
    videos = {f"V{k}": [rng.choice(["a", "a", "a", "b", "License x", " ", None, "c@d"]) for _ in range(60)] for k in range(6)}
    videos |= {"silent": [" ", None, ""] * 5, "purged": ["my license"] * 7, "run": ["x"] * 25}
    rows = [(v, float(k), k + 0.5, t) for v, texts in videos.items() for k, t in enumerate(texts)]
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    os.makedirs(source)

    def add(part, low, high):
        path = f"{source}/{part}.jsonl"
        with open(path + ".tmp", "w", encoding="utf-8") as f:
            some = [r for r in rows if low <= r[1] < high]
            rng.shuffle(some)
            f.writelines(json.dumps({"video_id": v, "start": s, "end": e, "text": t}) + "\n" for v, s, e, t in some)
        os.utime(path + ".tmp", (1_700_000_000 + part, 1_700_000_000 + part))
        os.rename(path + ".tmp", path)

    def run():
        query = cleaning.ingest_cleaned(spark, source, target, state, ["license"], ["@"], files_at_once=1)
        query.awaitTermination()
        assert query.exception() is None

    for part, (low, high) in enumerate(((0, 7), (7, 8), (8, 30))):
        add(part, low, high)
    run()
    for part, (low, high) in enumerate(((30, 31), (31, 60)), 3):
        add(part, low, high)
    run()
    written = spark.read.parquet(target)
    whole = spark.createDataFrame(rows, "video_id string, start double, end_sec double, text string")
    want = Counter(tuple(r) for r in cleaning.clean_batch(whole, ["license"], ["@"]).collect())
    got = Counter(tuple(r) for r in cleaning.cleaned_segments(written).select("video_id", "start", "end_sec", "text").collect())
    assert got == want and got["silent", 0.0, 0.0, ""] == got["purged", 0.0, 0.0, ""] == 1
    log = {r["video_id"]: r for r in cleaning.cleaning_log(written).collect()}
    assert {v: r["seen"] for v, r in log.items()} == {v: len(t) for v, t in videos.items()}
    assert (log["run"]["left"], log["run"]["cut"], log["purged"]["removed"], log["silent"]["left"]) == (2, 23, 7, 0)
    assert sum(r["left"] for r in log.values()) == sum(n for k, n in want.items() if k[3])
