"""Feeds, intel tables and nearest neighbours."""

import json
import random

import numpy as np
import pytest

from emberlog.operators import intel, similarity
from emberlog.sources.feeds import read_attack_bundle, read_cve_feed


def test_attack_bundle(spark, tmp_path):
    ref = {"source_name": "mitre-attack", "external_id": "T1"}
    phases = [{"kill_chain_name": "mitre-attack", "phase_name": "p1"}, {"kill_chain_name": "x", "phase_name": "p2"},
              {"kill_chain_name": "mitre-attack", "phase_name": "p3"}]
    objects = [
        {"type": "attack-pattern", "id": "a1", "name": "One", "description": "  " + "d" * 3000, "kill_chain_phases": phases,
         "external_references": [{"source_name": "other", "external_id": "X"}, ref, {**ref, "external_id": "T2"}]},
        {"type": "attack-pattern", "id": "a2", "name": "Two", "description": "text"},
        {"type": "attack-pattern", "id": "a3", "description": "gone", "revoked": True},
        {"type": "attack-pattern", "id": "a4", "description": "gone", "x_mitre_deprecated": True},
        {"type": "attack-pattern", "id": "a5", "description": " \n"}, {"type": "malware", "id": "a6", "description": "no"},
    ]
    (tmp_path / "b.json").write_text(json.dumps({"type": "bundle", "objects": objects}, indent=1))
    rows = {r.id: r for r in intel.attack_chunks(read_attack_bundle(spark, str(tmp_path / "b.json"))).collect()}
    assert set(rows) == {"mitre-T1", "mitre-a2"}
    assert rows["mitre-T1"].text == "[T1] One\nTactics: p1, p3\n\n" + "d" * 2000
    assert rows["mitre-T1"].metadata == {"source": "mitre-attack", "technique_id": "T1", "name": "One", "tactics": "p1,p3"}
    assert rows["mitre-a2"].text == "[] Two\nTactics: \n\ntext"


def test_cve_feed(spark, tmp_path):
    def item(i, texts, impact=None):
        return {"cve": {"CVE_data_meta": {"ID": i}, "description": {"description_data": texts}}, "impact": impact or {}}

    en = lambda t: [{"lang": "de", "value": "nein"}, {"lang": "en", "value": t}]
    v3 = lambda s: {"baseMetricV3": {"cvssV3": {"baseScore": s}}}
    v2 = lambda s: {"baseMetricV2": {"cvssV2": {"baseScore": s}}}
    items = [item("C1", en("one"), {**v3(9.8), **v2(5.0)}), item("C2", en("two"), {**v3(0.0), **v2(5)}), item("C3", en("three")),
             item("C4", en("** REJECT ** x")), item("C5", en("** RESERVED ** x")), item("C6", [{"lang": "de", "value": "nein"}])]
    (tmp_path / "f.json").write_text(json.dumps({"CVE_Items": items}))
    df = intel.cve_chunks(read_cve_feed(spark, str(tmp_path / "f.json")))
    rows = {r.id: (r.text, r.cvss, r.metadata["cvss_score"]) for r in df.collect()}
    assert rows == {"cve-C1": ("[C1] CVSS: 9.8\none", 9.8, "9.8"), "cve-C2": ("[C2] CVSS: 5\ntwo", 5.0, "5"),
                    "cve-C3": ("[C3] CVSS: \nthree", None, "")}
    built = intel.build([df, df.limit(0)], per_source=2)
    assert built.count() == 2 and intel.available(built) and not intel.available(built.limit(0))
    assert intel.upsert(built, built.limit(0)).count() == 2 and intel.upsert(built, df).count() == 3


@pytest.mark.parametrize("limit", [similarity.CORPUS_BYTES, 0])
def test_nearest(spark, limit, monkeypatch):
    monkeypatch.setattr(similarity, "CELL_CORPUS_ROWS", 20)
    monkeypatch.setattr(similarity, "CELL_QUERY_ROWS", 10)
    rng = random.Random(5)
    corpus = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(90)]
    corpus += [(100 + i, corpus[i][1]) for i in range(10)] + [(200, [0.0] * 8)]  # equal vectors tie; a zero vector scores 0
    queries = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(25)] + [(50 + i, corpus[i][1]) for i in range(5)]
    schema = "id bigint, embedding array<double>"
    q, c = spark.createDataFrame(queries, schema), spark.createDataFrame(corpus, schema)
    got = {}
    for r in similarity.cosine_topk(q, c, 3, corpus_bytes=limit).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.intel_id)
    for i, v in queries:
        def score(w):
            norm = np.linalg.norm(w)
            return round(float(np.dot(v, w) / np.linalg.norm(v) / norm), 9) if norm else 0.0

        assert got[i] == [j for _, j in sorted((-score(w), j) for j, w in corpus)][:3]
    assert similarity.cosine_topk(q, c.limit(2), 3, corpus_bytes=limit).count() == 2 * len(queries)
    assert similarity.cosine_topk(q, c.limit(0), 3, corpus_bytes=limit).count() == 0


def test_snippets_and_default_vectors(spark):
    intel_rows = similarity.text_vectors(spark.createDataFrame(
        [("i1", "ssh brute force password guessing"), ("i2", "sql injection union select"), ("i3", "dns tunnel")],
        "id string, text string"))
    chunks = spark.createDataFrame([("c1", [0.0] * 256)], "id string, embedding array<float>")
    near = similarity.cosine_topk(intel_rows, intel_rows, 1)
    assert all(r.query_id == r.intel_id for r in near.collect())
    assert similarity.snippets(chunks, near.limit(0), intel_rows).first().snippets == []
    joined = similarity.snippets(intel_rows.select("id"), near, intel_rows)
    assert {r.id: r.snippets for r in joined.collect()}["i3"] == ["dns tunnel"]
