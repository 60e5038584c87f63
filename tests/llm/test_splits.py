import random

import pytest

from ostinato.llm import splits

REC = "rec_id long, filename string, tune string, own boolean, sensor_set int, subject_id int, channel_set string, instrument string, component string, split int"


def recordings(n, subjects, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        subject = rng.choice([None, *range(subjects)]) if rng.random() < 0.9 else 0
        rows.append([i, f"/d/r_{i}.wav", rng.choice(["a", "b", "", None]), True, 0, subject, rng.choice(["x", "y"]), rng.choice(["lab", "own", None]), "c", 1])
    for i in range(n, n + n // 10):  # listed again, the path written otherwise, at times without the subject
        old = rng.choice(rows[:n])
        rows.append([i, old[1].upper().replace("/", "\\") + " ", *old[2:5], rng.choice([old[5], None]), *old[6:]])
    return rows


def leaks(rows, split):
    file = lambda r: r[1].strip().lower().replace("\\", "/")
    by = {}
    for r in rows:
        for key in [("f", file(r))] + ([("s", r[5])] if r[5] is not None else []):
            by.setdefault(key, set()).add(split[r[0]])
    return [k for k, s in by.items() if len(s) > 1]


@pytest.mark.parametrize("shard", [20, 5000])
def test_whole_together_and_in_proportion(spark, monkeypatch, shard):
    monkeypatch.setattr(splits, "SHARD", shard)
    monkeypatch.setattr(splits, "LARGE", 200)
    rows = recordings(1500, 60, 1)
    got = splits.split_recordings(spark.createDataFrame(rows, REC)).collect()
    split = {r["rec_id"]: r["split"] for r in got}
    assert len(got) == len(rows) == len(split)
    assert leaks(rows, split) == []
    share = {s: sum(v == s for v in split.values()) / len(rows) for s in splits.SPLITS}
    for s, want in splits.SPLITS.items():
        assert share[s] == pytest.approx(want, abs=0.01)


@pytest.mark.parametrize("n, subjects", [(3000, 0), (100_000, 0), (40_000, 12_000)])
def test_without_a_hub(spark, n, subjects):
    """Single records, and many even subjects: nothing is a large part of all records."""
    subject = f"cast(id % {subjects} as int)" if subjects else "cast(null as int)"
    label = "concat('t', cast(floor(60 * rand(3) * rand(4)) as int))"
    rows = spark.range(n).selectExpr("id rec_id", "concat('/d/', id, '.wav') filename", f"{label} tune", f"{subject} subject_id", "'x' channel_set", "if(id % 3 = 0, 'lab', 'own') instrument")
    rows = rows.persist()
    got = splits.split_recordings(rows).join(rows, "rec_id").persist()
    assert got.count() == n == got.select("rec_id").distinct().count()
    if subjects:
        assert got.groupBy("subject_id").agg({"split": "min", "component": "min"}).count() == got.select("subject_id", "split").distinct().count()
    share = {r["split"]: r["count"] / n for r in got.groupBy("split").count().collect()}
    for s, want in splits.SPLITS.items():
        assert share[s] == pytest.approx(want, abs=0.005)
    held: dict = {}
    for r in got.groupBy("tune", "split").count().collect():
        held.setdefault(r["tune"], {})[r["split"]] = r["count"]
    off = {t: max(abs(h.get(s, 0) / sum(h.values()) - w) for s, w in splits.SPLITS.items()) for t, h in held.items()}
    size = {t: sum(h.values()) for t, h in held.items()}
    assert max(o for t, o in off.items() if size[t] >= 100) < (0.02 if subjects else 0.01)
    rows.unpersist(), got.unpersist()


def test_chain_of_listings_is_one_component(spark):
    rows = [[i, f"/f{(i + 1) // 2}.wav", "a", True, 0, i // 2, "x", "lab", "", 0] for i in range(40)]
    got = splits.split_recordings(spark.createDataFrame(rows, REC)).collect()
    assert len({r["component"] for r in got}) == 1 and len({r["split"] for r in got}) == 1


def test_components_as_union_find(spark):
    rng = random.Random(4)
    edges = [(str(rng.randint(0, 80)), str(rng.randint(0, 80))) for _ in range(60)] + [(None, "1"), ("2", None)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b:
            parent[root(a)] = root(b)
    got = {r["node"]: r["component"] for r in splits.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    groups = {}
    for x in parent:
        groups.setdefault(root(x), set()).add(x)
    assert got == {x: min(g) for g in groups.values() for x in g}


def test_nulls_copies_and_empty(spark):
    rows = [[1, None, None, None, None, None, None, None, None, None]] * 2 + [[None] * 10, [2, "/a.wav", None, None, None, None, None, None, None, None]]
    got = splits.split_recordings(spark.createDataFrame(rows, REC)).collect()
    assert len(got) == 4 and len({r["split"] for r in got if r["rec_id"] == 1}) == 1
    assert splits.split_recordings(spark.createDataFrame([], REC)).count() == 0
