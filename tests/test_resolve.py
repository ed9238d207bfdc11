import pytest
from pyspark.sql import functions as F

from quillmesh.functions import text as tx
from quillmesh.functions import vectors as vx
from quillmesh.operators import components, embed, extract, resolve, review
from quillmesh.operators.components import connected_components
from quillmesh.operators.pairs import near_pairs
from quillmesh.schemas import CANDIDATE_PAIRS, MENTIONS, REVIEW_DECISIONS
from quillmesh.sources import sinks, tables


def one(spark, rows, *cols):
    names = [f"c{i}" for i in range(len(rows[0]))]
    return [tuple(r) for r in spark.createDataFrame(rows, names).select(*cols).collect()]


@pytest.mark.parametrize(
    "a, b, lexical, overlap",
    [
        ("KOMID", "KOMIB", 0.8, 0.0), ("Komid", "Korea Mining Development Corporation", 0.111111, 0.0), ("Tanchon Commercial Bank", "Tanchon Bank", 0.521739, 0.666667),
        ("Kim Chol Sam", "Kim Ch'Ol-Sam", 0.769231, 0.25), ("Koryo Bank", "Koryobank", 0.8, 0.0), ("Korea Mining Development Corp", "Korea Mining Dev. Corp", 0.724138, 0.6),
        ("Korea Mining Development", "Korea Mining Corp", 0.583333, 0.5), ("Kim Jong Un", "Kim Yo Jong", 0.454545, 0.5), ("Pyongyang", "Nampo", 0.0, 0.0), ("Wise Honest", "Jin Teng", 0.272727, 0.0), ("", "", 1.0, 1.0), ("KOMID", "", 0.0, 0.0),
    ],
)
def test_lexical_goldens(spark, a, b, lexical, overlap):
    ((x, y),) = one(spark, [(a, b)], tx.levenshtein_similarity(F.col("c0"), F.col("c1")), tx.token_overlap(F.col("c0"), F.col("c1")))
    assert x == pytest.approx(lexical, abs=1e-6) and y == pytest.approx(overlap, abs=1e-6)


def test_two_cosines(spark):
    rows = [([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 1.0], [1.0, 1.0])]
    got = one(spark, rows, vx.cosine_similarity(F.col("c0"), F.col("c1")), vx.cosine_distance(F.col("c0"), F.col("c1")))
    assert [tuple(round(x, 9) for x in r) for r in got] == [(0, 0.5), (-1, 1), (0, 1), (1, 0)]
    assert one(spark, [([1.0], [1.0, 2.0])], vx.cosine_similarity(F.col("c0"), F.col("c1"))) == [(0.0,)]
    sets = one(spark, [(["A", "B", "C"], ["B", "C", "D"])], vx.jaccard_distance(F.col("c0"), F.col("c1")))
    assert sets == [(0.5,)]
    assert one(spark, [(float("nan"),), (1.5,), (-1.0,)], vx.clip(F.col("c0"))) == [(1.0,), (1.0,), (0.0,)]


def test_text_forms(spark):
    page = "  Title  \n\n\n\n\nline one \t\n   \nline two \n"
    want = "Title\n\nline one\n\nline two"
    assert one(spark, [(page,)], tx.normalize_page(F.col("c0"))) == [(want,)]
    rows = [("  kim   ch'ol-sam ", "PERSON"), ("wise\thonest", "VESSEL"), ("koryo bank", "ORG")]
    assert [r[0] for r in one(spark, rows, tx.normalize_surface(F.col("c0"), F.col("c1")))] == ["Kim Ch'Ol-Sam", "wise honest", "Koryo Bank"]
    assert [r[0] for r in one(spark, [("gpe",), ("Ship",), ("per",), ("odd",)], tx.map_label(F.col("c0")))] == ["LOCATION", "VESSEL", "PERSON", "ORG"]
    text = "x" * 60 + "\nKOMID\nright " + "y" * 60
    start = text.index("KOMID")
    ((left, right),) = one(spark, [(text,)], tx.context_left(F.col("c0"), F.lit(start)), tx.context_right(F.col("c0"), F.lit(start + 5)))
    assert left == "x" * 49 and right == ("right " + "y" * 60)[:49]
    assert one(spark, [("ab KOMID",)], tx.context_left(F.col("c0"), F.lit(3))) == [("ab",)]
    assert one(spark, [("", "K", "r")], tx.input_text(F.col("c0"), F.col("c1"), F.col("c2"))) == [("K r",)]


def mention(i, form, vector, doc="D1", kind="ORG"):
    return (f"m{i}", doc, 1, form, form, kind, "linked to", "through a front", "", vector, "x", "pattern", kind, 0.9, None)


def test_candidates_with_evidence(spark):
    rows = [mention(1, "Korea Mining Corp", [1.0, 0.0, 0.0]), mention(2, "Korea Mining Corp.", [0.99, 0.01, 0.0], "D2"), mention(3, "Far Away", [0.0, 1.0, 0.0]), mention(4, "Korea Mining Corp", [1.0, 0.0, 0.0], "D3", "PERSON"), mention(5, "Korea Mining Corp", None), mention(6, "Korea Mining Corp", [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, MENTIONS)
    (got,) = [r for r in resolve.generate_candidates(df).collect()]
    assert (got["mention_id_a"], got["mention_id_b"]) == ("m1", "m2") and got["status"] == "pending"
    assert got["reasons"][0] == resolve.REASONS["strong"] and got["reasons"][1] == resolve.REASONS["very_similar"] and got["reasons"][2:] == []
    e = got["evidence"]
    assert e["pair_doc_coverage"] == 2 and e["context_a"] == "linked to Korea Mining Corp through a front" and e["embedding_similarity"] == pytest.approx(0.9999, abs=1e-4)
    low = resolve.generate_candidates(df, 0.2)
    assert low.count() > resolve.generate_candidates(df, 0.2, zero_as_missing=True).count()
    assert {(r[1], r[2]) for r in resolve.generate_candidates(df, token_blocking=True).collect()} == {("m1", "m2")}
    assert sorted(r[0] for r in resolve.generate_candidates(df).collect()) == [got["candidate_id"]]


def pair(a, b, score, status="pending", cid=None):
    return (cid or f"{a}{b}", a, b, score, [], None, status, "v1")


def test_clusters(spark):
    rows = [pair("m1", "m2", 0.8), pair("m1", "m3", 0.9), pair("m2", "m3", 0.85), pair("x", "y", 0.9, "rejected"), pair("p", "q", 0.7, "needs_review")]
    got = {tuple(r["member_mentions"]): r["cluster_score"] for r in resolve.build_clusters(spark.createDataFrame(rows, CANDIDATE_PAIRS)).collect()}
    assert got == {("m1", "m2", "m3"): 0.85, ("p", "q"): 0.7}
    assert resolve.build_clusters(spark.createDataFrame([], CANDIDATE_PAIRS)).count() == 0


def test_components_of_random_graphs(spark):
    import random

    rng = random.Random(11)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(500, 500), (None, 1)]
    label = {x: x for e in edges if None not in e for x in e}
    for _ in range(200):
        for a, b in edges:
            if a is not None:
                label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame(edges, "src long, dst long")
    for found in (connected_components(df), connected_components(df, task_edges=0)):
        assert {r["node"]: r["component"] for r in found.collect()} == label


def test_contracted_components_leave_few_edges(spark):
    """Runs of neighbours are united in their tasks: of 2,000 edges of 20 paths only those that tasks share are left."""
    edges = [(f"{100 * k + i:05d}", f"{100 * k + i + 1:05d}") for k in range(20) for i in range(99)] + [("00050", "00050"), ("x", "x")]
    df = spark.createDataFrame(edges, "b string, a string").select("a", "b")
    rest, leaves = components._contracted(df)
    assert rest.count() < 400 and leaves.count() > 1400
    got = {r["node"]: r["component"] for r in connected_components(df, "a", "b", task_edges=0).collect()}
    assert got == {x: f"{int(x) // 100 * 100:05d}" if x != "x" else "x" for e in edges for x in e}


def test_review_round_trip(spark, tmp_path):
    log, cands = f"{tmp_path}/log", f"{tmp_path}/cands"
    spark.createDataFrame([pair("a", "b", 0.9), pair("c", "d", 0.8)], CANDIDATE_PAIRS).write.parquet(cands)
    say = lambda d, what: spark.createDataFrame([(d, "ab", "r", what, "", "v1", None)], REVIEW_DECISIONS)
    review.submit(say("d1", "approved"), log, cands)
    got = {r["candidate_id"]: r["status"] for r in review.submit(say("d1", "needs_review"), log, cands).collect()}
    assert got == {"ab": "needs_review", "cd": "pending"} and tables.load_table(spark, log, REVIEW_DECISIONS).count() == 1
    assert review.pending_queue(tables.load_table(spark, cands, CANDIDATE_PAIRS)).count() == 1
    with pytest.raises(ValueError):
        review.submit(say("d2", "maybe"), log, cands)


def test_extraction(spark):
    text = "Captain Ri Chol sailed MV Wise Honest for Korea Mining Corporation near port of Nampo."
    chunks = spark.createDataFrame([("D1", 1, text), ("D1", 2, "   ")], "doc_id string, page int, text string")
    got = {(r["entity_type"], r["surface_form"]) for r in extract.extract_mentions(chunks).collect()}
    assert got == {("PERSON", "Captain Ri Chol"), ("VESSEL", "MV Wise Honest"), ("ORG", "Korea Mining Corporation"), ("LOCATION", "port of Nampo")}
    listed = extract.extract_mentions(chunks, extract.gazetteer_extractor({"Wise Honest": "SHIP", "Nampo": "LOC"}))
    assert {(r["entity_type"], r["normalized_form"]) for r in listed.collect()} == {("VESSEL", "Wise Honest"), ("LOCATION", "Nampo")}
    with pytest.raises(ValueError):
        extract.build_extractor("nope")
    assert extract.build_extractor(" Pattern ") is not None


def test_embedding_and_search(spark):
    rows = [mention(i, f, None) for i, f in enumerate(["Koryo Bank", "Tanchon Bank", "Wise Honest"])]
    done = embed.embed_missing(spark.createDataFrame(rows, MENTIONS)).cache()
    assert all(len(r["embedding"]) == 384 and r["model_name"] == embed.MODEL for r in done.collect())
    assert embed.search(done, "linked to Koryo Bank through a front", 1).first()["surface_form"] == "Koryo Bank"
    with pytest.raises(ValueError):
        embed.search(done, "x", 101)


def test_merges(spark, tmp_path):
    old, new = (spark.createDataFrame(rows, "k string, v int") for rows in ([("a", 1), ("b", 2)], [("b", 3), ("c", 4)]))
    assert {tuple(r) for r in sinks.merged(old, new, "k").collect()} == {("a", 1), ("b", 3), ("c", 4)}
    assert {tuple(r) for r in sinks.insert_absent(old, new, "k").collect()} == {("a", 1), ("b", 2), ("c", 4)}
    assert sinks.ensure_tables(spark, str(tmp_path)) == dict.fromkeys(("documents", "mentions", "candidate_pairs", "candidate_clusters"), False)
    assert all(sinks.ensure_tables(spark, str(tmp_path)).values())


def test_manifest_and_pages(spark, tmp_path):
    (tmp_path / "m.csv").write_text("doc_id, title ,report_date,status\n A , Alpha,2023-01-15,\nB,Beta,2023-06-01,fetched\n")
    got = tables.load_manifest(spark, str(tmp_path / "m.csv")).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["title"], str(r["report_date"]), r["status"]) for r in got] == [("A", "Alpha", "2023-01-15", "pending"), ("B", "Beta", "2023-06-01", "fetched")]
    files = spark.createDataFrame([("d", b"one \n\x0c \n\x0cthree"), ("bad", b"\xff\xfe")], "doc_id string, content binary")
    pages = {(r["doc_id"], r["page"]): (r["text"], r["error"]) for r in tables.parse_pages(files, F.col("doc_id")).collect()}
    assert pages["d", 1] == ("one", None) and pages["d", 3] == ("three", None) and len(pages) == 3


def test_near_pairs_are_all_pairs(spark):
    """Blocks of five and the bound by letters lose no pair of a join of all, and cosines are the same to the bit."""
    import random

    rng = random.Random(5)
    forms = ["", "blue ring", "blue rings", "ring blue", "hot bolt", "Kim Ch'Ol"]
    vector = lambda i: [0.0] * 4 if i % 11 == 0 else [rng.gauss(0, 1) for _ in range(3 if i % 7 == 0 else 4)]
    rows = [(f"m{i:02d}", "AB"[i % 3 == 0], rng.choice(forms), vector(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "mention_id string, entity_type string, form string, embedding array<double>")
    lexical = tx.levenshtein_similarity(F.col("a.form"), F.col("b.form"))
    for least, form in ((0.3, "form"), (0.6, "form"), (0.2, None)):
        score = 0.7 * F.col("cosine") + 0.3 * lexical if form else F.col("cosine")
        keep = lambda found: sorted(map(tuple, found.where(score >= least).select("a.mention_id", "b.mention_id", "cosine").collect()))  # noqa: E731, B023
        brute = resolve.pairs_of(df).withColumn("cosine", vx.cosine_similarity(F.col("a.embedding"), F.col("b.embedding")))
        got = keep(near_pairs(df, "mention_id", least, form=form, weights=(0.7, 0.3), block=5))
        assert got == keep(brute) and len(got) > 10


def test_candidates_of_one_mention(spark):
    rows = [mention(i, f"Korea Mining {i}", [1.0, i / 10, 0.0]) for i in range(6)]
    df = spark.createDataFrame(rows, MENTIONS)
    plain = lambda found: sorted(map(str, found.collect()))
    want = resolve.generate_candidates(df, 0.3).where("mention_id_a = 'm3' OR mention_id_b = 'm3'")
    assert plain(resolve.generate_candidates(df, 0.3, of="m3")) == plain(want) and want.count() == 5
