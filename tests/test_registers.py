from lanternflow.cli import graph_of
from lanternflow.operators import evaluation, ownership, resolution
from lanternflow.sources import registers, synthetic


def test_registers_to_graph(spark, tmp_path):
    truth = synthetic.generate(str(tmp_path / "r"), 15, 20)
    records, statements = registers.load_all(spark, f"file://{tmp_path / 'r'}")
    records, statements = resolution.written(records), resolution.written(statements)
    ids = sorted(x for v in truth.values() for x in v)
    assert sorted(r.record_id for r in records.select("record_id").collect()) == ids
    members = spark.createDataFrame([(k, x) for k, v in truth.items() for x in v], "cluster_id string, record_id string")
    entities, nodes, edges = graph_of(records, statements)
    bridge = resolution.record_to_entity(entities)
    found = resolution.true_pairs(bridge.withColumnRenamed("entity_id", "cluster_id"))
    m = evaluation.pair_metrics(found, resolution.true_pairs(members)).collect()[0]
    assert m.precision > 0.9 and m.recall > 0.8
    assert edges.count() > 0 and ownership.roots(nodes, edges).count() > 0
    assert evaluation.majority_seed(entities, members.withColumnRenamed("cluster_id", "seed")).count() == entities.count()
