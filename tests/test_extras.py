import json

import numpy as np
from pyspark.sql import functions as F

from lanternflow.operators import gcn, memo, ownership
from lanternflow.sources import guidance, registers
from lanternflow.streaming import deltas

from .test_ownership import edges


def test_gcn_gradient_and_fit(spark):
    rng = np.random.default_rng(0)
    a = (rng.random((12, 12)) < 0.3).astype(float)
    a = a + a.T + np.eye(12)
    root = 1 / np.sqrt(a.sum(1))
    g = gcn.Graph([str(i) for i in range(12)], a * np.outer(root, root), rng.normal(size=(12, 7)))
    seen = (g.spread @ g.spread @ g.x)[:, 0]
    labels = {str(i): bool(seen[i] > np.median(seen)) for i in range(12)}
    scores, losses = gcn.train(g, labels, epochs=1500)
    assert losses[-1] < losses[0] / 2 and len(scores) == 12 and sum((scores[k] > 0.5) == v for k, v in labels.items()) >= 11
    assert gcn.train(g, {}) == ({}, [])
    assert gcn.leave_one_out({"a": True, "b": False}, lambda known: {"a": 0.9, "b": 0.1}) == {"a": True, "b": False}


def test_memo_and_gathering(spark):
    e = edges(spark, [("P", "A", "shareholding", 100.0), ("A", "B", "shareholding", 50.0)]).withColumn("statements", F.array(F.concat(F.lit("s"), "edge_seq")))
    nodes = spark.createDataFrame([("P", "Pat", "RU", "person", 2, 0.9), ("A", "Alpha", "VG", "company", 1, 1.0), ("B", "Beta", "GB", "company", 1, 1.0)], "entity_id string, canonical_name string, jurisdiction string, entity_type string, n_sources int, weakest_link double")
    starts = spark.createDataFrame([("P",)], "root string")
    chain = memo.chain_view(nodes, e, starts)
    assert [r.child_name for r in chain.orderBy("step").collect()] == ["Alpha", "Beta"]
    found = spark.createDataFrame([("P", "person", "Pat", ["RU"], [("r1", "x", "Pat")])], "entity_id string, entity_type string, canonical_name string, jurisdictions array<string>, provenance array<struct<record_id:string,source:string,name_as_recorded:string>>")
    assessed = ownership.assess(ownership.features(nodes, e, starts))
    text = memo.memos(found, assessed, chain, spark.createDataFrame([("P", 1, "G1", "Title")], "entity_id string, rank int, section_id string, title string")).collect()[0].text
    assert "Pat holds 100% of Alpha (shareholding) [stmt:s0]" in text and "[reg:G1]" in text
    g = gcn.gathered(nodes, e)
    assert g.ids == ["A", "B", "P"] and g.x.shape == (3, 7)


def test_guidance_search(spark, tmp_path):
    path = tmp_path / "g.json"
    path.write_text(json.dumps({"sections": [{"id": "F1", "source": "FATF", "title": "Owners", "text": "Beneficial ownership is transparent."}, {"id": "N1", "source": "FinCEN", "title": "Filing", "text": "A reporting company files within 30 days."}, {"id": "M1", "source": "FFIEC", "title": "Manual", "text": "Testing of customer due diligence."}]}))
    q = spark.createDataFrame([(1, "When does a reporting company file?"), (2, "beneficial ownership under FATF")], "query int, question string")
    best = {r.query: r.doc for r in guidance.search(guidance.sections(spark, f"file://{path}"), q).where("rank = 1").collect()}
    assert best == {1: "N1", 2: "F1"}


def test_csv_sources(spark, tmp_path):
    (tmp_path / "companies_house.csv").write_text("company_number,company_name,company_status,jurisdiction,date_of_creation,registered_office_address,sic_code\n07000000,\"A, B Ltd\",active,,2011,,70100\n")
    (tmp_path / "ofac_sdn.csv").write_text("ent_num,SDN_Name,SDN_Type,Program,Nationality,DOB,Remarks\n1,\"VOLKOV, DMITRI\",individual,P,RU,1968-04-11,x\n2,ACME,entity,P,,,\n")
    (tmp_path / "icij_offshore_nodes.csv").write_text("node_id,name,node_type,jurisdiction_description,address,sourceID\nn1,X,officer,PA,,s\n")
    (tmp_path / "icij_offshore_edges.csv").write_text("node_id_start,node_id_end,rel_type,link,start_date,sourceID\nn1,n2,shareholder_of,shareholder of (62.5%),,s\nn1,n3,officer_of,trustee of,,s\n")
    folder = f"file://{tmp_path}"
    c = registers.companies_house(spark, folder).collect()[0]
    assert (c.record_id, c.identifier, c.name, c.jurisdiction) == ("ch-07000000", "07000000", "A, B Ltd", "")
    assert [(r.name, r.entity_type, r.birth_date) for r in registers.ofac(spark, folder).orderBy("record_id").collect()] == [("Dmitri Volkov", "person", "1968-04-11"), ("Acme", "company", "")]
    records, links = registers.icij(spark, folder)
    assert records.collect()[0].entity_type == "person"
    assert [(r.interest_type, r.share_percent, r.confidence) for r in links.orderBy("statement_id").collect()] == [("shareholding", 62.5, 0.75), ("trusteeship", 0.0, 0.75)]


def test_stream(spark, small, tmp_path):
    e = spark.read.parquet(f"{small}/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    schema = ", ".join(f"{n} {t}" for n, t in e.dtypes)
    seen = []
    deltas.per_batch(deltas.read_stream(spark, str(tmp_path / "in"), schema), lambda batch, i: seen.append(batch.count()), str(tmp_path / "cp")).awaitTermination(120)
    assert sum(seen) == e.count() and len(seen) == 3
    assert deltas.windowed_mix(e).agg(F.sum("n")).first()[0] == e.count()
