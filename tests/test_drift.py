import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.operators import drift, export, graph, project
from quillmesh.schemas import EmbeddingConfig
from quillmesh.sources import sinks, tables
from quillmesh.sources.fixtures import planted_drift


@pytest.fixture(scope="module")
def planted(spark):
    nodes, relations = planted_drift(spark)
    slices, edges = graph.build_slices(nodes, relations)
    return nodes, relations, slices.cache(), edges.cache()


@pytest.fixture(scope="module")
def scores(planted):
    _, _, slices, edges = planted
    vectors = graph.node_embeddings(slices, edges, EmbeddingConfig(dimensions=16, walk_length=5, num_walks=5))
    return drift.score_all(slices, edges, vectors).cache()


def value(scores, entity, prev, column):
    return scores.where((F.col("entity_id") == entity) & (F.col("slice_id_prev") == prev)).first()[column]


def test_structure(planted):
    nodes, relations, slices, edges = planted
    assert nodes.count() == 30 and relations.count() == 201
    got = {r["slice_id"]: (r["nodes"], r["edges"]) for r in graph.slice_stats(slices, edges).collect()}
    assert got == {"2020": (30, 34), "2021": (30, 34), "2022": (30, 39), "2023": (30, 47), "2024": (30, 47)}
    share = {r["slice_id"]: round(r["share"] * 30) for r in graph.largest_component_share(slices, edges).collect()}
    assert share == {"2020": 23, "2021": 23, "2022": 24, "2023": 30, "2024": 30}
    assert graph.stable_entities(slices).count() == graph.union_entities(slices).count() == 30


def test_golden_signals(scores):
    assert scores.count() == 120
    for entity, prev, near, central in [
        ("PERSON-010", "2020", 0, 0), ("PERSON-010", "2021", 1, 0), ("ORG-015", "2021", 0, 0), ("VESSEL-003", "2021", 0.833333, 0.330049),
        ("ORG-001", "2021", 0.25, 0.027915), ("ORG-015", "2022", 0.888889, 0.440007), ("VESSEL-003", "2022", 0, 0.067558), ("ORG-001", "2022", 0, 0.065095), ("ORG-001", "2023", 0, 0),
    ]:
        assert value(scores, entity, prev, "neighbor_drift") == pytest.approx(near, abs=1e-6)
        assert value(scores, entity, prev, "centrality_drift") == pytest.approx(central, abs=1e-6)
    assert value(scores, "PERSON-010", "2021", "community_drift") == 1.0
    still = scores.where("slice_id_prev IN ('2020', '2023')").agg(F.max("community_drift")).first()[0]
    assert still == 0.0
    for c in scores.columns[3:]:
        low, high = scores.agg(F.min(c), F.max(c)).first()
        assert 0 <= low <= high <= 1


def test_planted_entities_lead(scores):
    best = [r["entity_id"] for r in drift.top_drifters(scores, 6).collect()]
    assert {"PERSON-010", "VESSEL-003"} & set(best)
    assert drift.top_drifters(scores, 5, "2021->2022").select("slice_id_prev").distinct().first()[0] == "2021"
    assert drift.top_drifters(scores, 5, "nonsense").count() == 5
    row = export.run_summary(scores).first()
    assert len(row["top_entities"]) == 3 and row["top_entities"] == best[:3]


def test_strict_and_lenient_graphs(spark, planted):
    nodes, relations, _, _ = planted
    stray = relations.limit(1).withColumns({"edge_id": F.lit("STRAY"), "source_entity_id": F.lit("UNKNOWN-999")})
    with pytest.raises(ValueError, match="STRAY"):
        graph.build_graph(nodes, relations.union(stray))
    kept, edges, skipped = graph.build_graph_lenient(nodes, relations.union(stray))
    assert kept.count() == 30 and [r[0] for r in skipped.collect()] == ["STRAY"]
    assert edges.count() == graph.build_graph(nodes, relations)[1].count()


def test_parallel_edges_add_and_first_wins(spark):
    rows = [("e1", "A", "B", "X", 1.0, "d1", 1), ("e2", "B", "A", "Y", 2.0, "d2", 2), ("e3", "A", "A", "Z", 1.0, "d3", 3)]
    df = spark.createDataFrame(rows, "edge_id string, source_entity_id string, target_entity_id string, relation_type string, weight double, source_doc_id string, seq int").withColumn("report_date", F.lit("2020-06-15").cast("date"))
    got = {(r["u"], r["v"]): r for r in graph.merge_edges(df).collect()}
    assert got["A", "B"]["weight"] == 3.0 and got["A", "B"]["edge_id"] == "e1" and got["A", "B"]["relation_type"] == "X"
    edges = graph.merge_edges(graph.with_slice(df))
    assert {r["entity_id"]: r["neighbors"] for r in graph.neighbours(edges).collect()} == {"A": ["A", "B"], "B": ["A"]}
    assert {r["entity_id"]: r["degree"] for r in graph.degree(edges).collect()} == {"A": 3, "B": 1}


def brute_betweenness(n, pairs):
    from collections import deque
    from itertools import combinations

    near = {i: {b for a, b in pairs + [(y, x) for x, y in pairs] if a == i and b != i} for i in range(n)}

    def paths(s):
        dist, count, todo = {s: 0}, {s: 1}, deque([s])
        while todo:
            x = todo.popleft()
            for y in near[x]:
                if y not in dist:
                    dist[y], count[y] = dist[x] + 1, 0
                    todo.append(y)
                if dist[y] == dist[x] + 1:
                    count[y] += count[x]
        return dist, count

    all_ = [paths(s) for s in range(n)]
    out = [0.0] * n
    for s, t in combinations(range(n), 2):
        if t in all_[s][0]:
            for v in set(all_[s][0]) - {s, t}:
                if t in all_[v][0] and all_[s][0][v] + all_[v][0][t] == all_[s][0][t]:
                    out[v] += all_[s][1][v] * all_[v][1][t] / all_[s][1][t]
    return [x * 2 / ((n - 1) * (n - 2)) if n > 2 else 0.0 for x in out]


def test_betweenness_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    for n, m in ((2, 1), (5, 5), (14, 20)):
        pairs = [tuple(map(int, p)) for p in rng.integers(0, n, (m, 2))]
        nodes = spark.createDataFrame([("2020", f"{i:02d}") for i in range(n)], "slice_id string, entity_id string")
        edges = spark.createDataFrame(sorted({("2020", f"{min(p):02d}", f"{max(p):02d}") for p in pairs}), "slice_id string, u string, v string")
        got = [r["betweenness"] for r in graph.betweenness(nodes, edges, task_work=20).orderBy("entity_id").collect()]
        assert got == pytest.approx(brute_betweenness(n, pairs))


def test_embeddings(spark, planted):
    _, _, slices, edges = planted
    config = EmbeddingConfig(dimensions=16, walk_length=5, num_walks=5)
    one, two = (sorted(map(str, graph.node_embeddings(slices, edges, config).collect())) for _ in range(2))
    assert one == two and len(one) == 150
    lonely = spark.createDataFrame([("2020", "A"), ("2020", "B"), ("2021", "X")], "slice_id string, entity_id string")
    none = spark.createDataFrame([("2020", "A", "B")], "slice_id string, u string, v string")
    got = {(r["slice_id"], r["entity_id"]): r for r in graph.node_embeddings(lonely, none, config).collect()}
    assert all(len(r["embedding"]) == 16 and r["model_name"] == "spectral" for r in got.values())
    assert not any(got["2021", "X"]["embedding"]) and any(got["2020", "A"]["embedding"])
    walks = graph.random_walks(lonely, none, config).collect()
    assert {len(r["walk"]) for r in walks if r["slice_id"] == "2021"} == {1} and {len(r["walk"]) for r in walks if r["slice_id"] == "2020"} == {5}
    with pytest.raises(ValueError):
        EmbeddingConfig(dimensions=1)


def test_missing_embedding_is_half(spark):
    pairs = spark.createDataFrame([("1", "2", "a"), ("1", "2", "b"), ("1", "2", "c"), ("1", "2", "d")], "slice_id_prev string, slice_id_curr string, entity_id string")
    vectors = spark.createDataFrame([("1", "a", [1.0, 0.0]), ("2", "a", [0.0, 1.0]), ("1", "b", [1.0, 0.0]), ("1", "d", [0.0, 0.0]), ("2", "d", [1.0, 0.0])], "slice_id string, entity_id string, embedding array<double>")
    got = {r["entity_id"]: r["embedding_drift"] for r in drift.embedding_drift(pairs, vectors).collect()}
    assert got == {"a": 0.5, "b": 0.5, "c": 0.0, "d": 1.0}


def test_communities_of_two_cliques(spark):
    pairs = [(a, b) for group in ("abcd", "wxyz") for a in group for b in group if a < b]
    nodes = spark.createDataFrame([("1", x) for x in "abcdwxyzq"], "slice_id string, entity_id string")
    edges = spark.createDataFrame([("1", a, b) for a, b in pairs], "slice_id string, u string, v string")
    got = {r["entity_id"]: r["community"] for r in graph.communities(nodes, edges).collect()}
    assert len({got[x] for x in "abcd"}) == 1 and len({got[x] for x in "wxyz"}) == 1 and len(set(got.values())) == 3


def test_slices_round_trip(spark, planted, tmp_path):
    _, _, slices, edges = planted
    sinks.save_slices(slices, edges.where("slice_id <> '2024'"), str(tmp_path))
    nodes, back = tables.load_slices(spark, str(tmp_path))
    assert nodes.select("slice_id").distinct().count() == 4 and back.count() == edges.where("slice_id <> '2024'").count()


def test_projection(planted, scores):
    nodes, _, slices, edges = planted
    vectors = graph.node_embeddings(slices, edges, EmbeddingConfig(dimensions=16, walk_length=5, num_walks=5))
    points = project.with_scores(project.project(vectors), scores, nodes)
    assert points.count() == 150 and points.where("label IS NULL OR composite_score < 0").count() == 0
    assert project.project(vectors.limit(1)).select("x").first()[0] == 0.0
    assert export.trajectories(points).count() == 30


def test_plain_slices_are_the_built_ones(spark):
    rows = [("A", "B", "2020"), ("B", "A", "2020"), ("A", "A", "2020"), ("A", "X", "2020"), ("C", "B", "2021"), ("A", "B", "2021"), ("X", "C", "2021")]
    relations = spark.createDataFrame(rows, "source_entity_id string, target_entity_id string, year string").select(
        "source_entity_id", "target_entity_id", F.concat("year", F.lit("-06-15")).cast("date").alias("report_date"), F.lit(1.0).alias("weight"),
        *[F.col("year").alias(c) for c in ("edge_id", "relation_type", "source_doc_id")],
    )
    nodes = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "entity_id string")
    plain = lambda df: sorted(map(tuple, df.collect()))
    want_nodes, want_edges = graph.build_slices(nodes, relations)
    for limit in (100, 0):
        got_nodes, got_edges = graph.plain_slices(nodes, relations, max_broadcast=limit)
        assert plain(got_nodes) == plain(want_nodes.select("slice_id", "entity_id")) and plain(got_edges) == plain(want_edges.select("slice_id", "u", "v"))
    got = {r["entity_id"]: r["neighbor_drift"] for r in drift.neighbor_drift(drift.scored_entities(got_nodes), got_edges).collect()}
    assert got == pytest.approx({"A": 0.5, "B": 0.5})


def test_components_of_a_slice_are_tasks_of_their_own(spark):
    """Communities and betweenness by component equal those of the whole slice, whose size still scales betweenness."""
    rng = np.random.default_rng(7)
    pairs = sorted({tuple(sorted((f"{b:02d}{x:02d}", f"{b:02d}{y:02d}"))) for b in range(6) for x, y in rng.integers(0, 12, (16, 2))})
    edges = spark.createDataFrame([("1", *p) for p in pairs], "slice_id string, u string, v string")
    names = sorted({x for p in pairs for x in p} | {"lone"})
    nodes = spark.createDataFrame([("1", x) for x in names], "slice_id string, entity_id string")
    at = {x: i for i, x in enumerate(names)}
    near = [np.array(sorted({at[b] for a, b in pairs + [(y, x) for x, y in pairs] if at[a] == i and a != b}), np.int64) for i in range(len(names))]
    label = graph._propagate(near)
    assert {r["entity_id"]: r["community"] for r in graph.communities(nodes, edges).collect()} == {x: names[label[i]] for i, x in enumerate(names)}
    got = [r["betweenness"] for r in graph.betweenness(nodes, edges, task_work=50).orderBy("entity_id").collect()]
    assert got == pytest.approx(brute_betweenness(len(names), [(at[a], at[b]) for a, b in pairs]))
    parts = graph._tied(edges, graph.slice_components(edges)).select("slice_id", "component").distinct().count()
    assert parts >= 6


def test_walks_of_the_queries_are_whole():
    from quillmesh.plans.catalogue import WALKS

    assert WALKS == EmbeddingConfig()


def test_walks_follow_their_weights():
    """A triangle with a tail: from 0 by 1 the way back weighs 1/p, 2 weighs 1, and 3 weighs 1/q."""
    starts, targets = np.array([0, 2, 5, 7, 8]), np.array([1, 2, 0, 2, 3, 0, 1, 1])
    walks = np.concatenate(list(graph._walks(starts, targets, EmbeddingConfig(walk_length=3, num_walks=20_000, p=4.0, q=0.5), [1])))
    assert len(walks) == 80_000 and set(walks[:, 0]) == {0, 1, 2, 3}
    third = walks[(walks[:, 0] == 0) & (walks[:, 1] == 1), 2]
    share = np.bincount(third, minlength=4) / len(third)
    assert share == pytest.approx(np.array([0.25, 0, 1, 2]) / 3.25, abs=0.03)
