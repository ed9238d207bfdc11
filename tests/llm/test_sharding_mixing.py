import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from scipy_free import chi_square_ok

from quillmesh.llm import draws, mixing, queries, sharding


def test_split_is_exact_and_unbiased():
    rng = np.random.default_rng(1)
    got = np.array([draws.split(rng, [5, 0, 10, 5], 8) for _ in range(4000)])
    assert (got.sum(axis=1) == 8).all() and (got <= [5, 0, 10, 5]).all() and (got[:, 1] == 0).all()
    assert np.allclose(got.mean(axis=0), [2, 0, 4, 2], atol=0.1)


def test_large_draws_have_the_right_moments():
    rng = np.random.default_rng(2)
    good, bad, n = 6 * 10**9, 4 * 10**9, 10**6
    got = np.array([draws.hypergeometric(rng, good, bad, n) for _ in range(300)])
    assert abs(got.mean() - 0.6 * n) < 5 * np.sqrt(n * 0.24 / 300) and 0.8 < got.std() / np.sqrt(n * 0.24) < 1.2


def test_inversion_equals_numpy_law(monkeypatch):
    monkeypatch.setattr(draws, "NUMPY_MOST", 0)
    rng = np.random.default_rng(3)
    got = np.bincount([draws.hypergeometric(rng, 6, 4, 5) for _ in range(6000)], minlength=6) / 6000
    assert np.allclose(got, np.array([0, 6, 60, 120, 60, 6]) / 252, atol=0.03)


def test_matrix_sums():
    rows = [5, 0, 17, 100, 1]
    m = np.array(sharding.communication_matrix(rows, 7))
    assert m.sum(axis=1).tolist() == rows and m.sum(axis=0).tolist() == draws.even(sum(rows), 7)


@pytest.mark.parametrize("bucket_rows", [1 << 16, 8])
def test_shards_are_even_and_slots_gapless(spark, bucket_rows):
    rows = [(i % 90, None if i % 11 == 0 else f"t{i % 5}", [1.0, None], {"a": i}) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, slot string, v array<double>, m map<string,int>").repartition(7)
    got = sharding.shuffle_into_shards(df, 24, bucket_rows=bucket_rows).collect()
    sizes = {}
    for r in got:
        sizes.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == 500 and set(sizes) == set(range(24)) and {len(s) for s in sizes.values()} == {20, 21}
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    assert sorted(r["doc_id"] for r in got) == sorted(i % 90 for i in range(500))
    again = sharding.shuffle_into_shards(df, 24, bucket_rows=bucket_rows).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_shuffle_is_uniform(spark):
    df = spark.range(2400).repartition(5)
    got = sharding.shuffle_into_shards(df, 24).collect()
    assert chi_square_ok([r["shard"] for r in got if r["id"] < 1200], 24)


def test_shards_of_an_empty_table(spark):
    assert sharding.shuffle_into_shards(spark.range(0)).count() == 0


def targets(sizes, weights, share=1.5, most=2.0):
    """The rule of the targets, a source at a time."""
    out, left, open_ = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while open_:
        total = sum(weights[i % len(weights)] for i in open_)
        over = [i for i in open_ if left * weights[i % len(weights)] / total > most * sizes[i]]
        for i in over or open_:
            out[i] = most * sizes[i] if over else left * weights[i % len(weights)] / total
        open_ = open_ - set(over) if over else set()
        left -= sum(out[i] for i in over)
    return out


@pytest.mark.parametrize("sizes", [[100, 100, 100], [0, 10], [], [7, 1000, 13, 0, 400], [1] * 50 + [10**6], [0, 0]])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(enumerate(sizes)), "no long, words long")
    got = {r["no"]: r["target"] for r in mixing.with_targets(rows).collect()}
    want = targets(sizes, [5, 2, 1])
    assert got == {i: pytest.approx(w) for i, w in enumerate(want)}
    assert sum(want) == pytest.approx(1.5 * sum(sizes))


def test_tree_sums():
    room = draws.even(117, 5)
    leaves = np.array(mixing.splitting_tree([10, 0, 7, 100], room, np.random.default_rng(1)))
    assert leaves.sum(axis=0).tolist() == [10, 0, 7, 100] and leaves.sum(axis=1).tolist() == room


def mixed_rows():
    return [(i, "w " * (1 + i % 40), ["a", "b", "c", None][0 if i % 3 else i % 4]) for i in range(3000)] + [(9000, None, "b"), (9001, "", None), (None, "x y", "c"), (5, "again and again", "a"), (5, "again and again", "a")]


@pytest.mark.parametrize("options", [{"block_rows": 64}, {"block_rows": 8, "bucket_rows": 4, "max_broadcast_rows": 0}])
def test_mix_takes_what_it_should(spark, options):
    rows = mixed_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    planned = mixing.plan(docs, **options)
    got = mixing.assign(docs, planned=planned).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        s = by.setdefault(r["source"], [0, 0, r["mix"]["source_size"], r["mix"]["target"]])
        s[0] += r["mix"]["size"]
        s[1] += r["mix"]["size"] * len(r["mix"]["shards"])
        assert len(r["mix"]["shards"]) <= 2 and all(0 <= k < 16 for k in r["mix"]["shards"])
    order = sorted(by, key=lambda s: (s is None, s or ""))
    goal = targets([by[s][0] for s in order], [5, 2, 1])
    for s, g in zip(order, goal):
        assert by[s][0] == by[s][2] and by[s][3] == pytest.approx(g) and abs(by[s][1] - g) <= 25
    assert sorted(map(str, got)) == sorted(map(str, mixing.assign(docs, **options).collect()))
    mixed = mixing.mix(docs, planned=planned)
    assert mixed.columns == ["doc_id", "text", "source", "shard"] and mixed.count() == sum(len(r["mix"]["shards"]) for r in got)


def test_blocks_fill_the_shards_that_the_tree_gave(spark):
    docs = spark.createDataFrame(mixed_rows(), "doc_id long, text string, source string")
    planned = mixing.plan(docs, block_rows=16)
    sources = planned.sources.collect()
    per_shard = [0] * 16
    for s in sources:
        ends = [0, *s["cuts"], s["uses"]]
        assert ends == sorted(ends) and len({(i * s["factor"] + s["start"]) % max(s["uses"], 1) for i in range(s["uses"])}) == s["uses"]
        per_shard = [a + b - c for a, b, c in zip(per_shard, ends[1:], ends)]
    assert sorted(per_shard, reverse=True) == draws.even(sum(s["uses"] for s in sources), 16)
    dealt = np.bincount([k for r in mixing.assign(docs, planned=planned).collect() for k in r["mix"]["shards"]], minlength=16)
    assert dealt.min() > 0.6 * dealt.mean() and dealt.max() < 1.4 * dealt.mean()


def test_sources_have_no_limit(spark):
    docs = spark.range(100_500).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.concat(F.lit("s"), F.col("id")).alias("source"))
    got = mixing.assign(docs).agg(F.count("*").alias("n"), F.sum("mix.target").alias("t"), F.max(F.size("mix.shards")).alias("most")).first()
    assert got["n"] == 100_500 and got["t"] == pytest.approx(1.5 * 201_000) and got["most"] == 2


def test_columns_that_clash_stay(spark):
    docs = spark.createDataFrame([(i, "a b c", "s", i, f"m{i}", 2 * i) for i in range(40)], "doc_id long, text string, source string, shard long, mix string, `a.b` long")
    out = mixing.mix(docs, column=None)
    assert out.columns == docs.columns
    assert all((r["shard"], r["mix"], r["a.b"]) == (r["doc_id"], f"m{r['doc_id']}", 2 * r["doc_id"]) for r in out.collect())


def test_mix_of_an_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_op2_digests_come_from_the_texts_that_land_in_shards(spark, sf, monkeypatch):
    whole = sharding.shuffle_into_shards

    def marked(df, **options):
        return whole(df, **options).withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit("é!")))

    monkeypatch.setattr(sharding, "shuffle_into_shards", marked)
    got = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in queries.op2_sharding(spark, sf).collect()}
    texts = {r["doc_id"]: ((r["text"] or "") + "é!").encode() for r in queries.read(spark, sf, "documents").select("doc_id", "text").collect()}
    assert got == {i: (len(t) + 8, zlib.crc32(t)) for i, t in texts.items()}


def test_op9_counts_the_copies_that_come_out(spark, sf, monkeypatch):
    whole = mixing.mix
    monkeypatch.setattr(mixing, "mix", lambda docs, **options: whole(docs, **options).where("doc_id % 7 <> 0"))
    got = {r["doc_id"]: r for r in queries.op9_mixing(spark, sf).collect()}
    docs = queries.read(spark, sf, "documents").select("doc_id", "text", "source")
    placed = mixing.assign(docs).collect()
    want = {r["doc_id"]: (r["mix"]["size"], len(r["mix"]["shards"])) for r in placed}
    sizes, order = {}, sorted({r["source"] for r in placed}, key=lambda s: (s is None, s or ""))
    for r in placed:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len([w for w in re.split("[ \t\n\x0b\f\r]", r["text"] or "") if w])
    assert {r["doc_id"]: r["target"] for r in got.values()} == {r["doc_id"]: pytest.approx(dict(zip(order, targets([sizes[s] for s in order], [5, 2, 1])))[r["source"]]) for r in placed}
    assert {i: r["taken"] for i, r in got.items()} == {i: n * size if i % 7 else 0 for i, (size, n) in want.items()}
