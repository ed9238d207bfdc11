"""The planted-drift network: thirty entities over five years with three planted changes."""

from __future__ import annotations

from datetime import date
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession

from quillmesh import schemas

YEARS = range(2020, 2025)
#: Who is linked, how, and in which years.
CLUSTER_A = ("ORG-001", "ORG-002", "ORG-003", "ORG-004")
CLUSTER_B = ("ORG-005", "ORG-006", "ORG-007")
STEADY = (
    ("PERSON-001", "ORG-001", "EMPLOYS"), ("PERSON-002", "ORG-002", "EMPLOYS"), ("PERSON-003", "ORG-003", "EMPLOYS"),
    ("PERSON-004", "ORG-004", "EMPLOYS"), ("PERSON-005", "ORG-005", "EMPLOYS"), ("PERSON-006", "ORG-006", "EMPLOYS"),
    ("VESSEL-001", "LOCATION-001", "DOCKS_AT"), ("VESSEL-002", "LOCATION-002", "DOCKS_AT"), ("VESSEL-001", "ORG-001", "OPERATED_BY"),
    ("VESSEL-003", "LOCATION-001", "DOCKS_AT"), ("ORG-008", "ORG-009", "TRANSACTS_WITH"), ("ORG-009", "ORG-010", "ASSOCIATED_WITH"),
    ("ORG-010", "PERSON-007", "EMPLOYS"), ("ORG-008", "LOCATION-001", "OPERATES_IN"), ("PERSON-007", "ORG-008", "EMPLOYS"),
    ("PERSON-008", "ORG-009", "EMPLOYS"), ("PERSON-009", "ORG-010", "ASSOCIATED_WITH"), ("ORG-011", "ORG-012", "ASSOCIATED_WITH"),
    ("ORG-012", "ORG-013", "TRANSACTS_WITH"), ("ORG-013", "ORG-014", "ASSOCIATED_WITH"), ("ORG-011", "PERSON-001", "EMPLOYS"),
)
BEFORE_2022 = (("PERSON-010", "ORG-001", "ASSOCIATED_WITH"), ("PERSON-010", "ORG-002", "TRANSACTS_WITH"), ("PERSON-010", "ORG-003", "ASSOCIATED_WITH"))
FROM_2022 = (
    ("PERSON-010", "ORG-005", "ASSOCIATED_WITH"), ("PERSON-010", "ORG-006", "TRANSACTS_WITH"), ("PERSON-010", "ORG-007", "ASSOCIATED_WITH"),
    ("VESSEL-003", "LOCATION-002", "DOCKS_AT"), ("VESSEL-003", "ORG-001", "OPERATED_BY"), ("VESSEL-003", "ORG-008", "TRANSACTS_WITH"),
    ("VESSEL-003", "ORG-009", "ASSOCIATED_WITH"), ("VESSEL-003", "PERSON-009", "ASSOCIATED_WITH"),
)


def _links(year: int):
    for group, kind in ((CLUSTER_A, "ASSOCIATED_WITH"), (CLUSTER_B, "TRANSACTS_WITH")):
        yield from ((a, b, kind, 1.0) for a, b in combinations(group, 2))
    for links, holds in ((STEADY, True), (BEFORE_2022, year < 2022), (FROM_2022, year >= 2022)):
        if holds:
            yield from ((*link, 1.0) for link in links)
    if year < 2023:
        yield "ORG-015", "ORG-001", "ASSOCIATED_WITH", 1.0
    else:
        yield from (("ORG-015", org, "TRANSACTS_WITH", 2.0) for org in CLUSTER_A)
        yield from (("ORG-015", org, "ASSOCIATED_WITH", 2.0) for org in CLUSTER_B)
        yield from (("ORG-015", person, "EMPLOYS", 1.0) for person in ("PERSON-007", "PERSON-008"))


def planted_drift(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Nodes and relations of the planted network, under the declared schemas."""
    ids = [f"{kind}-{i:03d}" for kind, n in (("ORG", 15), ("PERSON", 10), ("VESSEL", 3), ("LOCATION", 2)) for i in range(1, n + 1)]
    nodes = [(x, x.title(), x.split("-")[0], date(2020, 1, 1), date(2024, 12, 31)) for x in ids]
    links = [(s, t, kind, w, y) for y in YEARS for s, t, kind, w in _links(y)]
    edges = [(f"E{n:04d}", s, t, kind, w, f"DOC-{y}", date(y, 6, 15)) for n, (s, t, kind, w, y) in enumerate(links)]
    return spark.createDataFrame(nodes, schemas.GRAPH_NODES), spark.createDataFrame(edges, schemas.GRAPH_EDGES)
