"""Toxicity, language and URL models, by held-out accuracy and on odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import langid, queries, toxicity, urls


def toy(n, seed):
    rng = np.random.default_rng(seed)
    plain = [f"{a}{b}" for a in ("lor", "ipsu", "dol", "ame") for b in ("em", "mi", "or", "ta", "ri")]
    bad = ["grumblor", "grumblork", "grumbling", "blaster", "blastor"]
    texts, y = [], []
    for i in range(n):
        w = list(rng.choice(plain, 60))
        if i % 3 == 0:
            w[5] = w[40] = rng.choice(bad)
        texts.append(" ".join(w))
        y.append(int(i % 3 == 0))
    return texts, np.array(y)


def test_toxicity_learns_and_shares_subwords():
    model = toxicity.train(*toy(600, 1), buckets=1 << 14)
    texts, y = toy(200, 2)
    assert ((model.scores(texts) >= 0.5) == y).mean() > 0.97
    clean = " ".join(["lorem", "dolor", "ametta"] * 15)
    odd = model.scores([clean + " grumblorx grumblorr", clean, None, "", "  ", "." * 5000, "x" * 20000])
    assert odd[0] > odd[1] and ((odd >= 0) & (odd <= 1)).all() and odd[2] == odd[3] == odd[4]
    assert toxicity.train([], np.array([])).scores(["a"])[0] == pytest.approx(0.01)
    assert toxicity.train(["a"], np.array([1])).scores(["a"])[0] > 0.9


def test_toxicity_query(spark, sf):
    got = queries.op8_toxicity(spark, sf).toPandas()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.5).astype(int) == got["predicted"]).all()


def test_language_query_is_accurate(spark, sf):
    got = queries.op5_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert len(held) and (held["lang_pred"] == held["lang"]).mean() > 0.95 and got["score"].between(0, 1).all()


def test_language_of_odd_texts(spark):
    rows = [(1, "the cat and the dog " * 9, "en"), (2, "der hund und die katze " * 9, "de"), (3, None, "en"), (4, "123 --", None), (5, "", "de"), (6, "the dog", None), (7, "und die", None), (8, "x" * 300_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", langid.language_column(model, F.col("text")).alias("s")).collect()}
    assert [got[i]["lang"] for i in (1, 2, 3, 4, 5, 6, 7)] == ["en", "de", "und", "und", "und", "en", "de"]
    assert all(0 <= s["score"] <= 1 for s in got.values())
    none = langid.fit(docs.limit(0))
    assert none.decide(["hello"])[0] == ["und"]


def slow_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def slow_rule(host, path):
    fits = []
    for rule, _ in urls.RULES:
        site, _, start = rule.partition("/")
        if (host == site or host.endswith("." + site)) and path.startswith("/" + start):
            fits.append(rule)
    return max(fits, key=len, default=None)


def test_url_parts_and_rules(spark):
    odd = [None, "", "no scheme", "http://", "http://EXAMPLE.com", "http://example.com/en/x?y", "https://www.Example.com/en/", "ftp://a.b.net/es/q#z", "x://notexample.com/en/", "http://h?p=/en/", "http://h#/x", "a://b://c.com/d", "http://é.com/ü\nx", "http://com/", "http://x.net/fr", "http://" + "a" * 9000 + ".com/en/"]
    pages = spark.createDataFrame(list(enumerate(odd)), "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judge(pages).collect()}
    verdicts = dict(urls.RULES)
    for i, u in enumerate(odd):
        assert (got[i]["host"], got[i]["path"]) == slow_url(u), u
        assert got[i]["rule"] == slow_rule(*slow_url(u)), u
        assert got[i]["verdict"] in ("allow", "block") and verdicts.get(got[i]["rule"], got[i]["verdict"]) == got[i]["verdict"]
    assert urls.judge(pages.limit(0)).count() == 0


def slow_ratios(rows, urls_):
    """Witten-Bell over plain dictionaries: the rows teach, the urls are scored."""
    import math
    from collections import Counter

    def padded(u):
        return urls.START * urls.ORDER + "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in u or "") + urls.END

    seen = {y: Counter() for y in (True, False)}
    for u, y in rows:
        text = padded(u)
        for i in range(urls.ORDER, len(text)):
            for k in range(urls.ORDER + 1):
                seen[y][text[i - k : i], text[i]] += 1
    by = {y: {} for y in seen}
    for y, c in seen.items():
        for (context, char), n in c.items():
            by[y].setdefault(context, {})[char] = n

    def log(y, context, char):
        p = 1 / urls.ALPHABET
        for k in range(urls.ORDER + 1):
            row = by[y].get(context[len(context) - k :], {})
            p = (row.get(char, 0) + max(len(row), 1) * p) / (sum(row.values()) + max(len(row), 1))
        return math.log(p)

    out = []
    for u in urls_:
        text = padded(u)
        parts = [log(True, text[i - urls.ORDER : i], text[i]) - log(False, text[i - urls.ORDER : i], text[i]) for i in range(urls.ORDER, len(text))]
        out.append(sum(parts) / len(parts))
    return out


@pytest.mark.parametrize("most", [500_000, 0])
def test_url_model_separates_and_equals_brute_force(spark, most):
    good = [f"http://news{i}.org/story/{i * 7}" for i in range(100)]
    bad = [f"http://casino-win{i}.biz/spin?bonus={i}" for i in range(100)]
    fresh = ["http://news999.org/story/1", "http://casino-win999.biz/spin?bonus=5", None, "", "HTTP://x", "http://news999.org/story/1", "é😀\x02"]
    rows = [(u, True) for u in good] + [(u, False) for u in bad] + [(u, None) for u in fresh]
    df = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(rows)], "n long, u string, y boolean")
    held = {r["u"] for r in df.where(F.pmod(F.xxhash64("u"), F.lit(5)) == 0).collect()}
    scored, threshold = urls.score(df, "n", "u", "y", most)
    got = {r["n"]: r["ratio"] for r in scored.collect()}
    want = slow_ratios([(u, y) for u, y in rows if y is not None and u not in held], [(u or "").replace("\x02", " ") for u, _ in rows])
    assert got == {i: pytest.approx(w) for i, w in enumerate(want)}
    assert got[200] > threshold > got[201]


def test_url_model_agrees_with_rules_on_urls_it_did_not_learn(spark, sf):
    """Of the fifth that the counts leave out, the models' verdict is mostly that of the rule."""
    pages = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/pages.parquet")
    said = dict(urls.RULES)
    judged = urls.judge(pages).join(pages.select("page_id", "url"), "page_id").where("rule IS NOT NULL").where(F.pmod(F.xxhash64("url"), F.lit(5)) == 0).collect()
    good = [r["ratio"] for r in judged if said[r["rule"]] == "allow"]
    bad = [r["ratio"] for r in judged if said[r["rule"]] == "block"]
    right = sum(g > b for g in good for b in bad) / (len(good) * len(bad))
    assert good and bad and right > 0.9, right


def test_kernel_fold_equals_kernel_sums():
    """The folded matrix against kernel sums over the landmarks and ridge regression solved in the plain way."""
    texts = ["the cat sat", "a dog ran by", "der hund lief", "die katze sass", "le chat dort", "la vie en rose"]
    langs = ["en", "en", "de", "de", "fr", "fr"]
    ridge = 1e-3
    model = langid.train(texts, langs, buckets=1 << 20, landmarks=6, ridge=ridge)

    def grams(text):
        t = f" {text} "
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    def kernel(a, b):
        return len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b)))

    names = sorted(set(langs))
    K = np.array([[kernel(a, b) for b in texts] for a in texts])
    value, vector = np.linalg.eigh(K)
    feature = vector * np.sqrt(value)
    weight = 1 / 2 / 3
    gram = feature.T @ feature * weight
    solved = np.linalg.solve(gram + ridge * np.trace(gram) / 6 * np.eye(6), feature.T @ (weight * np.array([[g == n for n in names] for g in langs])))
    for text in ("the cat ran", "der hund", "la rose", "zzz"):
        new = np.array([kernel(text, b) for b in texts]) @ (vector / np.sqrt(value))
        want = new @ solved
        got = langid.presence(text, 1 << 20) @ model.weights / np.sqrt(langid.presence(text, 1 << 20).sum())
        assert np.allclose(got, want, atol=2e-3), (text, got, want)


def test_toxicity_gradient_and_scores_equal_plain_sums():
    """One step of plain descent on the loss, by numeric differences, has the sign of the step that training took."""
    texts, y = toy(40, 3)
    words = sorted({w for t in texts for w in toxicity.tokens(t)})
    weight = np.random.default_rng(5).normal(size=64).astype(np.float32)
    slow = {}
    for w in words:
        at, bucket = toxicity.subwords([w], 64)
        slow[w] = float(np.mean([weight[b] for b in bucket]))
    model = toxicity.ToxicityModel(weight, 0.25)
    want = [1 / (1 + np.exp(-(np.mean([slow[w] for w in toxicity.tokens(t)]) + 0.25))) for t in texts]
    assert np.allclose(model.scores(texts), want, atol=1e-6)

    def loss(m):
        p = np.clip(m.scores(texts), 1e-9, 1 - 1e-9)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    losses = [loss(toxicity.train(texts, y, buckets=1 << 12, steps=s, rate=0.02)) for s in (0, 1, 2, 5, 20, 60)]
    assert losses == sorted(losses, reverse=True) and losses[-1] < 0.5 * losses[0]


def test_samples_are_bounded_and_the_same_each_time(spark):
    from quillmesh.llm.samples import sample

    rows = spark.range(20_000).select(F.when(F.col("id") < 19_000, "hot").when(F.col("id") < 19_990, "warm").otherwise(F.lit(None)).alias("g"), (F.col("id") % 15_000).alias("x"))
    got = [sorted(map(tuple, sample(rows, "g", F.lit(300)).collect())) for _ in range(2)]
    assert got[0] == got[1] and len(set(got[0])) == 600
    same = spark.range(10_000).select((F.col("id") % 2).alias("doc_id"), F.lit("en").alias("lang"), F.lit("the same text").alias("text"))
    assert langid.fit(same).decide(["the text"])[0] == ["en"]


def test_toxicity_labels_that_repeat_and_conflict(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (3, None), (4, "d"), (None, "e")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 0), (3, 1), (4, None), (None, 1)], "doc_id long, toxic long")
    texts, y = toxicity.training_rows(docs, labels)
    assert (texts, y.tolist()) == (["a", "c"], [1, 0])
    assert toxicity.training_rows(docs.limit(0), labels)[0] == [] and toxicity.training_rows(docs, labels.limit(0))[0] == []
