"""The tables of a network from a bundle, and seeds from names, on a toy of four entities."""

from pyspark.sql import functions as F

from quillmass.plans.queries import toy_network
from quillmass.sources import bundle, knowledge


def toy_bundle(spark):
    _, _, entities, rules, fragments, diagnostics = toy_network(spark)
    empty = spark.createDataFrame([("x",)], "rule_id string")
    tables = {
        "compound_rules": entities.select(F.lit("c").alias("rule_id"), "entity_id", F.array_join("adducts", ";").alias("adduct"), "target_origin"),
        "transformation_rules": rules.drop("ion_modes").withColumn("anchor_reactant_index", F.lit("0")).unionByName(rules.drop("ion_modes").limit(1).withColumn("rule_id", F.lit("bad")).withColumn("anchor_reactant_index", F.lit("x"))),
        "diagnostic_fragment_rules": diagnostics.withColumn("diagnostic_origin", F.lit("class_consensus_frequency")),
        "neutral_loss_rules": empty,
        "biosynthetic_component_rules": empty,
    }
    artifacts = {a: empty for a in bundle.ARTIFACTS} | {"entity_registry": entities.drop("adducts", "target_origin").withColumn("entity_kind", F.lit("molecule")), "fragment_evidence": fragments}
    return tables, artifacts


def test_bundle_to_tables(spark, tmp_path):
    tables, artifacts = toy_bundle(spark)
    bundle.write_bundle(str(tmp_path), tables, artifacts)
    found = knowledge.load_knowledge(bundle.read_bundle(spark, str(tmp_path)))
    assert {r.rule_id for r in found["rules"].collect()} == {"r1", "r2", "r3"}
    assert {(r.entity_id, r.exact_mass, tuple(r.adducts)) for r in found["entities"].collect()} == {("A", 300.0, ("[M+H]+",)), ("B", 314.01565, ("[M+H]+",)), ("C", 314.01565, ()), ("D", 332.0, ())}
    assert {r.rule_id for r in found["diagnostics"].collect()} == {"d1", "d2"}


def test_names_with_several_entities(spark):
    entities = spark.createDataFrame([("e1", "Alpha"), ("e2", "alpha"), ("e3", "Beta"), ("e4", "beta")], "entity_id string, canonical_name string")
    rules = spark.createDataFrame([("e2",)], "source_entity_id string")
    candidates = spark.createDataFrame([("n1", "ALPHA"), ("n2", "Beta"), ("n3", "none")], "node_id string, name string")
    seeds, rows = knowledge.resolve_seeds(candidates, entities, rules)
    assert [(r.node_id, r.entity_id) for r in seeds.collect()] == [("n1", "e2")]
    assert {r.node_id: r.seed_resolution_status for r in rows.collect()} == {"n1": "resolved", "n2": "ambiguous", "n3": "unresolved"}
