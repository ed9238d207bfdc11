from quillmesh.jobs import network, resolution
from quillmesh.schemas import CANDIDATE_CLUSTERS, EmbeddingConfig, RunConfig
from quillmesh.sources import tables
from quillmesh.sources.fixtures import planted_drift
from quillmesh.sources.tables import load_table


def test_resolution_stages(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    for i, form in enumerate(["Korea Mining Corp", "Korea Mining Corporation", "Tanchon Bank"]):
        (raw / f"D{i}.txt").write_text(f"funds moved via {form} to the port\x0c   \x0cnothing here")
    cfg = RunConfig(data_dir=str(tmp_path), store_dir=f"{tmp_path}/store", threshold=0.5)
    assert resolution.parse(spark, cfg).count() == 6
    assert resolution.extract_mentions(spark, cfg).count() == resolution.extract_mentions(spark, cfg).count() == 3
    assert resolution.embed_mentions(spark, cfg).where("size(embedding) = 384").count() == 3
    first, second = (resolution.resolve_aliases(spark, cfg).collect() for _ in range(2))
    assert [r["candidate_id"] for r in first] == [r["candidate_id"] for r in second] and len(first) >= 1
    assert load_table(spark, f"{tmp_path}/store/candidate_clusters", CANDIDATE_CLUSTERS).count() == 1


def test_network_stages(spark, tmp_path):
    nodes, edges = planted_drift(spark)
    nodes.write.parquet(f"{tmp_path}/entities.parquet")
    edges.write.parquet(f"{tmp_path}/relations.parquet")
    cfg = RunConfig(data_dir=str(tmp_path), store_dir=f"{tmp_path}/store", embedding=EmbeddingConfig(dimensions=16, walk_length=5, num_walks=5))
    assert network.build_slices(spark, cfg).count() == 5
    assert network.train_embeddings(spark, cfg).count() == 150
    assert network.score_drift(spark, cfg).count() == 120
    assert network.reduce_points(spark, cfg).count() == 150
    assert len(network.render(spark, cfg).first()["top_entities"]) == 3
    assert tables.load_scores(spark, f"{tmp_path}/store/drift_scores").count() == 120


def test_service_calls(spark, tmp_path):
    import pytest

    from quillmesh.jobs import service
    from quillmesh.schemas import CANDIDATE_PAIRS

    store = str(tmp_path)
    rows = [("c1", "m1", "m2", 0.9, ["why"], None, "pending", "v1")]
    spark.createDataFrame(rows, CANDIDATE_PAIRS).write.parquet(f"{store}/candidate_pairs")
    assert service.health()["status"] == "ok" and service.list_mentions(spark, store).count() == 0
    assert service.get_candidate(spark, store, "c1")["score"] == 0.9
    with pytest.raises(KeyError):
        service.get_candidate(spark, store, "nope")
    service.submit_decision(spark, store, {"decision_id": "d1", "candidate_id": "c1", "decision": "approved"})
    assert service.list_candidates(spark, store, "approved").count() == 1 and service.list_decisions(spark, store).count() == 1
