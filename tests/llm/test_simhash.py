import pytest
import xxhash

from quillmesh.llm import simhash


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = words + ([word] if word else []), ""
        else:
            word += c
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, radius=4):
    found = {}
    for start in prints:
        if start not in found:
            todo, group = [start], {start}
            while todo:
                x = todo.pop()
                for y in prints:
                    if y not in group and bin(prints[x] ^ prints[y]).count("1") <= radius:
                        group.add(y)
                        todo.append(y)
            found.update({x: min(group) for x in group})
    return found


def texts():
    base = "the quick brown fox jumps over the lazy dog and then runs far away from the old farm house".split()
    rows = [None, "", " \n", "one", "Two words", "É Ü É", "a\xa0b c\x85d", " ".join(base * 5)]
    rows += [" ".join([*base * 5, f"w{i}"]) for i in range(6)] + [" ".join(base * 5).upper()] * 2
    return rows + [" ".join(f"{w}{i}" for w in base) for i in range(20)]


def test_fingerprint_equals_brute_force():
    for t in texts():
        assert simhash.fingerprint(None if t is None else t.encode()) == slow_fingerprint(t)


def test_count_blocks_agree(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(500)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "COUNT_BLOCK", 7)
    assert simhash.fingerprint(text) == whole


def test_components_equal_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    got = {r["id"]: (r["fp"] & (2**64 - 1), r["component"]) for r in simhash.near_duplicates(docs).collect()}
    prints = {i: slow_fingerprint(t) for i, t in enumerate(texts())}
    assert {i: f for i, (f, _) in got.items()} == prints
    assert {i: c for i, (_, c) in got.items()} == slow_components(prints)


@pytest.mark.parametrize("radius", [0, 2, 4, 6])
def test_links_at_every_distance(spark, radius):
    import random

    rng = random.Random(7)
    rows, node = [], 0
    for _ in range(40):
        code = rng.getrandbits(64)
        for d in range(7):
            other = code
            for b in rng.sample(range(64), d):
                other ^= 1 << b
            rows.append((other, node))
            node += 1
    rows = list({fp: (fp - 2**64 if fp >= 2**63 else fp, n) for fp, n in rows}.values())
    prints = {n: fp & (2**64 - 1) for fp, n in rows[:120]}
    from quillmesh.operators.components import connected_components

    links = simhash.ball_links(spark.createDataFrame(rows[:120], "fp long, node long"), radius, bucket_rows=4)
    found = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert {n: found.get(n, n) for n in prints} == slow_components(prints, radius)


def test_split_balls_agree(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    codes = rng.integers(0, 2**63, 60, dtype=np.uint64)
    codes = np.unique(np.concatenate([codes, codes ^ np.uint64(0b1011), codes ^ np.uint64(1 << 50)]))
    left = np.full(len(codes), 2, np.int8)
    whole = simhash._forest(codes, left, 64, 4)
    monkeypatch.setattr(simhash, "EXPAND_BLOCK", 64)
    assert (simhash._forest(codes, left, 64, 4) == whole).all()


def test_keep_one_with_repeats_nulls_and_extra_columns(spark):
    same = "a b c d e f g h"
    rows = [(1, same, "x"), (1, same, "x"), (2, same, "y"), (3, "other words entirely here now", None), (None, same, "z"), (None, "alone in the world today", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 3]
    assert simhash.keep_one(docs.limit(0)).count() == 0
