import math
import random

import pytest

from quillmesh.llm import quality, queries

SPACE = " \t\n\x0b\x0c\r"


def words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in SPACE:
            out, word = out + ([word] if word else []), ""
        else:
            word += c
    return out


def slow(text):
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {p for i, x in enumerate(windows) if windows.count(x) > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def texts():
    rng = random.Random(3)
    out = [None, "", "  \n\t", "a", "a b", "a b c", "a b c a b c", "x x x x x", "é\xa0b ü\n\né\xa0b ü\n", "# * $", "line\nline\n line\nline "]
    out += ["".join(rng.choice(["the ", "of ", "a\n", "Zed. ", "$$ ", "ß\t", "!"]) for _ in range(rng.randrange(200))) for _ in range(60)]
    return out + [" ".join(f"Word{i} runs." for i in range(80)), "He " * 300]


def test_measures_equal_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    for i, t in enumerate(texts()):
        n, c, s, d, rep = slow(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, c, s, d, rep), t
        assert r["base_failed"] == (n < 50 or 100 * rep > 50 * n) and not (r["kept"] and r["base_failed"]) and 0 <= r["posterior"] <= 1
    assert got[len(texts()) - 2]["kept"] and not got[len(texts()) - 1]["kept"]


def slow_em(patterns, names, rounds=12, prior=0.8, imagined=100.0):
    start = quality.START
    chance = {r: start for r in names}

    def post(p):
        z = math.log(prior / (1 - prior))
        for r in names:
            x = math.log(chance[r]["good"][p[r]] / chance[r]["bad"][p[r]])
            z += max(x, 0) if p[r] == 1 else min(x, 0) if p[r] == -1 else 0
        return 1 / (1 + math.exp(-z))

    for _ in range(rounds):
        weight = {"good": [p["n"] * post(p) for p in patterns], "bad": [p["n"] * (1 - post(p)) for p in patterns]}
        chance = {
            r: {c: {v: (sum(w for p, w in zip(patterns, weight[c]) if p[r] == v) + imagined * start[c][v]) / (sum(weight[c]) + imagined) for v in (1, 0, -1)} for c in weight}
            for r in names
        }
        prior = min(max((sum(weight["good"]) + 0.8 * imagined) / (sum(p["n"] for p in patterns) + imagined), 0.05), 0.95)
    return [post(p) for p in patterns]


def test_estimate_equals_plain_python(spark):
    rng = random.Random(5)
    names = ["vote_a", "vote_b", "vote_c"]
    patterns = [{"vote_a": a, "vote_b": b, "vote_c": c, "n": rng.randrange(1, 500)} for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    df = spark.createDataFrame([tuple(p.values()) for p in patterns], "vote_a int, vote_b int, vote_c int, n long")
    model = quality.estimate(df, names)
    got = {(r["vote_a"], r["vote_b"], r["vote_c"]): r["p"] for r in df.withColumn("p", model.posterior()).collect()}
    for p, q in zip(patterns, slow_em(patterns, names)):
        assert abs(got[p["vote_a"], p["vote_b"], p["vote_c"]] - q) < 1e-9


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, kept boolean, w int, lines string")
    assert quality.judge(empty).count() == 0


@pytest.mark.parametrize("n", [20, 1000, 256_000])
def test_lone_bad_votes_count_at_every_size(spark, n):
    names = [f"vote_{k}" for k in quality.rules()]
    good = dict.fromkeys(names, 1)
    kinds = [good, good | {"vote_symbols": -1, "vote_symbol_share": -1}] + [good | {r: -1} for r in names]
    shares = [0.91, 0.08] + [0.01 / len(names)] * len(names)
    rows = [(*k.values(), max(1, round(n * p))) for k, p in zip(kinds, shares)]
    patterns = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in names) + ", n long")
    model = quality.estimate(patterns, names).heard()
    got = [r["p"] for r in patterns.withColumn("p", model.posterior()).collect()]
    assert got[0] > 0.5 and max(got[1:]) < 0.1


@pytest.mark.parametrize("n", [100, 3000])
@pytest.mark.parametrize("kind", ["capitals", "word_length", "lines"])
def test_lone_kind_is_rejected_at_every_size(spark, kind, n):
    def plain(i):
        return " ".join(f"Word{i} runs{j}." for j in range(60))

    lone = {
        "capitals": lambda i: plain(i).upper(),
        "word_length": lambda i: " ".join(f"{'x' * 20}{i}{j}." for j in range(120)),
        "lines": lambda i: "\n".join(x for j in range(12) for x in (f"only{j} once{j} here{i} and{j} now{j}.", "word", "else")),
    }[kind]
    rows = [lone(i) if i % 100 == 0 else plain(i).replace("runs", "$$#runs") if i % 100 < 9 else plain(i) for i in range(n)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert got[0][f"vote_{kind}"] == -1 and not any(r["base_failed"] for r in got.values())
    assert [got[i]["kept"] for i in range(n)] == [i % 100 > 8 for i in range(n)]


def test_query_equals_sql_where_one_rule_objects(spark, tmp_path):
    """1 % with a lone bad vote, 8 % with two: learned weights decide, in the query as in its SQL."""
    import duckdb

    def text(i):
        plain = " ".join(f"Word{i} runs{j}." for j in range(60))
        return plain.upper() if i % 100 == 0 else plain.replace("runs", "$$#runs") if i % 100 < 9 else plain

    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(i, text(i)) for i in range(3000)], "doc_id long, text string").write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    got, want = queries.op6_quality_rules(spark, str(tmp_path)), con.sql(queries.ORACLES["op6_quality_rules"])
    assert got.columns == want.columns
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(want.fetchall())
    assert [r[-1] for r in rows] == [i % 100 == 0 or i % 100 > 8 for i in range(3000)]
