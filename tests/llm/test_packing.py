import random

from ostinato.llm import packing


def plain_best_fit(sizes, capacity):
    rooms, out = [], []
    for s in sizes:
        fits = [(r, -i) for i, r in enumerate(rooms) if r >= s]
        if fits:
            i = -min(fits)[1]
            rooms[i] -= s
        else:
            rooms.append(capacity - s)
            i = len(rooms) - 1
        out.append(i)
    return rooms, out


def test_segment_tree_finds_the_tightest():
    rng = random.Random(1)
    for capacity in (1, 7, 64, 100):
        sizes = sorted((rng.randint(0, capacity) for _ in range(300)), reverse=True)
        got = packing.best_fit(sizes, capacity)
        used = {}
        for s, c in zip(sizes, got, strict=True):
            used[c] = used.get(c, 0) + s
        assert max(used.values()) <= capacity
        assert sorted(capacity - u for u in used.values()) == sorted(plain_best_fit(sizes, capacity)[0])


def test_pack_is_whole(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 5, 300, 900, 1500, 2048, 2049, 9000]), "x", 1) for i in range(400)]
    rows += [rows[7], (None, 10, "", 0), (1000, None, "", 0), (1001, -5, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, container string, shard int")
    got = packing.pack(df, "doc_id", "n_tokens", shard=100).collect()
    used, pieces = {}, {}
    for r in got:
        used[r["container"]] = used.get(r["container"], 0) + r["n"]
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["first"], r["last"]))
    assert max(used.values()) <= 2048
    for doc, size, *_ in rows:
        size = max(size or 0, 0)
        spans = sorted(set(pieces[doc]))
        assert spans[0][1] == 0 and spans[-1][2] == size
        assert all(a[2] == b[1] and a[2] - a[1] == 2048 for a, b in zip(spans, spans[1:], strict=False))
        assert len(spans) == max(1, -(-size // 2048))
    assert len(pieces[7]) == 2 * len(set(pieces[7]))
    assert sum(used.values()) == sum(max(r[1] or 0, 0) for r in rows)


def test_little_is_left_unused(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, rng.randint(1, 1500)) for i in range(3000)], "doc_id long, n_tokens long")
    got = packing.pack(df, "doc_id", "n_tokens").collect()
    assert sum(r["n"] for r in got) / (2048 * len({r["container"] for r in got})) > 0.97


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long"), "doc_id", "n_tokens").count() == 0
