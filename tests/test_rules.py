"""Rule tables from claims, the registry, and references between them."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quillmass.operators import guards, network, references, rules


def table(spark, rows, fields):
    names = fields.split()
    return spark.createDataFrame([(i, *[None if r.get(n) is None else str(r[n]) for n in names]) for i, r in enumerate(rows)], "ord long, " + ", ".join(f"{n} string" for n in names))


CLAIMS = [
    {"claim_type": "compound", "claim_id": "a", "compound_class": "Cls", "compound_name": "Alpha", "formula": "C6H12O6", "exact_mass": "180.06339", "reported_fragments": "100.001;50"},
    {"claim_type": "compound", "claim_id": "b", "compound_class": "cls", "compound_name": "alpha", "ion_mode": "positive", "reported_fragments": "50;75.5", "subclass": "own"},
    {"claim_type": "compound", "claim_id": "c", "compound_class": "Cls", "compound_name": "Beta", "reported_fragments": "100.0", "formula": "C6H12O6", "exact_mass": "170"},
    {"claim_type": "compound", "compound_class": "Cls", "compound_name": "NoEvidence"},
    {"claim_type": "diagnostic_fragment", "claim_id": "d", "compound_class": "Cls", "fragment_mz": "150.0500", "ion_mode": "Positive", "evidence_summary": "s"},
    {"claim_type": "diagnostic_fragment", "claim_id": "e", "compound_class": "cls", "fragment_mz": "150.05", "ion_mode": "positive"},
    {"claim_type": "diagnostic_fragment", "claim_id": "f", "compound_class": "Cls", "fragment_mz": "none"},
    {"claim_type": "neutral_loss", "claim_id": "g", "compound_class": "Cls", "neutral_loss_mass": "162.05", "source_ion_type": "product_ion", "source_ion_mz": "312.05"},
    {"claim_type": "transformation", "claim_id": "h", "compound_class": "Cls", "source_entity": "Alpha", "target_entity": "Beta", "source_exact_mass": "100", "target_exact_mass": "56.0102"},
    {"claim_type": "transformation", "claim_id": "i", "compound_class": "Cls", "source_entity": "Alpha", "delta_mass": "1", "transformation_name": "X"},
    {"claim_type": "precursor", "claim_id": "j", "compound_class": "Cls", "precursor_name": "[M+H]+ ion"},
    {"claim_type": "structural_component", "claim_id": "k", "compound_class": "Cls", "component_name": "Glc", "exact_mass": "162.0528"},
    {"claim_type": "entity_component_membership", "claim_id": "l", "compound_class": "Cls", "entity_name": "Alpha", "component_name": "Rha"},
]
FIELDS = "claim_type claim_id compound_class compound_name formula exact_mass reported_fragments ion_mode subclass fragment_mz evidence_summary neutral_loss_mass source_ion_type source_ion_mz source_entity target_entity source_exact_mass target_exact_mass delta_mass transformation_name precursor_name component_name entity_name"


def test_rule_tables(spark):
    claims = table(spark, CLAIMS, FIELDS)
    concepts = table(spark, [{"type": "compound", "name": "BETA", "subclass": "mapped"}, {"type": "subclass", "name": "Only"}, {"type": "neutral_loss", "name": "water 18.01 Da", "evidence_ids": "q1"}, {"type": "precursor", "name": "Pre", "evidence_ids": "q2"}], "type name subclass evidence_ids")
    found = {name: [r.asDict() for r in df.collect()] for name, df in rules.compile_tables(claims, concepts, "Cls", 2, 0.5, 20).items()}
    alpha, beta = found["compound"]
    sha = lambda prefix, *parts: f"{prefix}_" + hashlib.sha1("|".join(p.lower() for p in parts).encode()).hexdigest()[:14]
    assert alpha["rule_id"] == sha("cmp", "Cls", "Alpha") and alpha["evidence_ids"] == "a;b" and alpha["ion_mode"] == "positive" and alpha["subclass"] == "Only"
    assert alpha["reported_fragments"] == "100.001;50;75.5" and alpha["exact_mass"] == "180.06339" and beta["subclass"] == "mapped"
    fragments = {(r["fragment_mz"], r["ion_mode"]): r for r in found["diagnostic_fragment"]}
    assert fragments["100", ""]["support_compound_count"] == "2" and fragments["100", ""]["evidence_ids"] == "a;c" and fragments["100", ""]["support_compound_fraction"] == "1"
    assert fragments["150.05", "Positive"]["evidence_ids"] == "d;e" and len(fragments) == 2
    losses = {r["loss_mass"]: r for r in found["neutral_loss"]}
    assert losses["162.05"]["interpretation"] == "hexose loss" and losses["162.05"]["required_context"] == "product_ion_cascade;source_ion_mz=312.05"
    assert losses["18.01"]["required_context"] == "concept_evidence" and losses["18.01"]["evidence_ids"] == "q1" and losses["18.01"]["loss_name"] == "water 18.01 Da"
    first, second = found["transformation"]
    assert (first["delta_mass"], first["transformation_name"], first["evidence_type"]) == ("-43.9898", "decarboxylation", "explicit_report") and second["evidence_type"] == "delta_only"
    components = {r["component_name"]: r for r in found["biosynthetic_component"]}
    assert set(components) == {"Glc", "Rha", "Pre"} and components["Rha"]["component_type"] == "entity_component_membership" and components["Rha"]["reaction_logic"] == "Alpha contains or is formed with Rha"
    counts = rules.compilation_counts(claims, concepts).first()
    assert (counts.removed_missing_evidence, counts.removed_fragments, counts.reported_fragment_instances_seen, counts.transformation_names_added) == (1, 1, 5, 1)
    assert [(r.evidence, r.warning) for r in rules.warnings(claims).collect()] == [("c", "formula mass differs from exact_mass")]
    assert {r.fragment_mz: (r.compounds, r.instances) for r in rules.fragment_support(rules.complete(claims)).collect()}["100"] == (2, 2)


def test_unary_reactions(spark):
    names = rules.TRANSFORMATION_COLUMNS
    row = dict.fromkeys(names, "") | {"rule_id": "r", "source_entity": "A", "target_entity": "B", "source_entity_id": "a", "target_entity_id": "b", "transformation_name": "Hexose loss!", "claim_source": "evidence_guided_component_join", "component_delta_formula": "C6H10O5", "delta_mass": "-162"}
    rows = [row, row | {"rule_id": "u", "target_entity_id": "zz"}, row | {"rule_id": "w", "component_delta_formula": "CO2"}, row | {"rule_id": "x", "reaction_arity": "2"}]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} string" for n in names))
    entities = spark.createDataFrame([("a", "C12H22O11", 342.11621), ("b", "C6H12O6", 180.06339)], "entity_id string, formula string, exact_mass double")
    forms = spark.createDataFrame([("f1", "a", "neutral_molecule"), ("f2", "b", "reported_ion")], "form_id string, entity_id string, form_type string")
    found = {r.rule_id: r for r in rules.unary_reactions(df, entities, forms).collect()}
    assert (found["r"].chemical_validation_status, found["r"].relation_evidence_status, found["r"].delta_mass) == ("valid", "component_delta_consistent", "-162.05282")
    assert json.loads(found["r"].reactant_form_ids) == ["f1"] and found["r"].reaction_operator == "hexose_loss" and found["r"].formula_equation == "C12H22O11 -> C6H12O6"
    assert found["u"].chemical_validation_status == "unresolved_entities" and found["u"].required_context == "non_propagating_unresolved_entity"
    assert (found["w"].chemical_validation_status, found["w"].propagation_policy) == ("component_delta_mismatch", "never_propagate")
    assert found["x"].reaction_arity == "2" and found["x"].chemical_validation_status == ""


ENTITIES = [("e1", ["Alpha"], "C6H12O6", 180.06339), ("e2", ["Alpha", "Beta"], "C6H12O6", 180.06339), ("e3", ["Gamma"], "C2H6O", 46.04186), ("e4", ["Gamma"], "CH4O", 32.02621), ("e5", ["Delta"], "", None)]


@pytest.fixture()
def entities(spark):
    return spark.createDataFrame(ENTITIES, "entity_id string, reported_names array<string>, formula string, exact_mass double")


def test_names_resolve_to_one_chemical(spark, entities):
    rows = [(0, "alpha", "", "", None), (1, "Gamma", "", "", None), (2, "Gamma", "", "CH4O", None), (3, "Gamma", "", "", "46.04"), (4, "x", "e5", "", None), (5, "x", "", "", None), (6, "Delta", "", "", None)]
    df = spark.createDataFrame(rows, "ord int, name string, preferred_id string, formula string, exact_mass string")
    assert {r.ord: r.resolved_id for r in references.resolve_names(df, entities).collect()} == {0: "e1", 1: "", 2: "e4", 3: "e3", 4: "e5", 5: "", 6: "e5"}


def test_participants_and_products(spark, entities):
    members = spark.createDataFrame([("c1", "e1"), ("c1", "e3"), ("c1", "gone")], "entity_class_id string, entity_id string")
    rows = [(0, "entity_class", "", "", "c1"), (1, "unresolved", "e1", "", ""), (2, "specific_entity", "e1", "", ""), (3, "specific_entity", "e5", "Alpha", ""), (4, "specific_entity", "e5", "Gamma", ""), (5, "specific_entity", "", "Gamma", ""), (6, "specific_entity", "no", "", "")]
    df = spark.createDataFrame(rows, "ord int, scope string, entity_id string, entity_name string, entity_class_id string")
    found = references.participant_candidates(df, entities, members)
    assert {r.ord: r.members for r in found.collect()} == {0: ["e1", "e3"], 1: [], 2: ["e1"], 3: ["e1"], 4: [], 5: ["e3", "e4"], 6: []}
    status = found.select("ord", references.product_status(F.array(F.struct("scope")), F.col("members")).alias("s"))
    assert {r.ord: r.s for r in status.collect()} == {0: "ambiguous_reported_entities", 1: "mechanism_derived_entity", 2: "unique_reported_entity", 3: "unique_reported_entity", 4: "unresolved_product_class", 5: "ambiguous_reported_entities", 6: "unresolved_product_class"}


def test_fragments_are_reconciled(spark, entities):
    claims = spark.createDataFrame([("Cls", "p1", "Alpha *"), ("Cls", "p2", "Gamma"), ("Cls", "e3", "Gamma")], "compound_class string, entity_id string, compound_name string")
    fragments = spark.createDataFrame([("f1", "p1", "", "target_product_ion"), ("f2", "p2", "", "target_product_ion"), ("f3", "e3", "k", "class_diagnostic"), ("f4", "", "c", "class_diagnostic")], "fragment_id string, entity_id string, entity_class_id string, evidence_role string")
    classes = spark.createDataFrame([("c",)], "entity_class_id string")
    mended, counts = references.reconciled_fragments(fragments, claims, entities, classes)
    assert {r.fragment_id: (r.entity_id, r.entity_class_id, r.evidence_role) for r in mended.collect()} == {"f1": ("e1", "", "target_product_ion"), "f2": ("", "", "unassigned_peak"), "f3": ("e3", "", "unassigned_peak"), "f4": ("", "c", "class_diagnostic")}
    assert tuple(counts.first()) == (1, 1, 1, 0)
    held = spark.createDataFrame([("f", "e2", "target_product_ion")], "fragment_id string, entity_id string, evidence_role string")
    assert {r.entity_id: r.supported_id for r in references.fragment_aliases(entities, held).collect()} == {"e1": "e2", "e2": "e2", "e3": "e3", "e4": "e4", "e5": "e5"}


def test_fragment_contracts(spark):
    reactions = spark.createDataFrame([("d1", "t", "a", ["a", "b"]), ("d2", "none", "a", ["a"])], "derivation_id string, target_entity_id string, anchor_entity_id string, reactant_ids array<string>")
    rows = [("f1", "t", "explicit_target_diagnostic", "target_specific", "x"), ("f2", "t", "target_product_ion", "target_specific", "x"), ("f3", "t", "target_product_ion", "other", "x"), ("f4", "a", "", "", "component_specific"), ("f5", "b", "", "", "component_specific"), ("f6", "z", "", "", "reaction_associated")]
    fragments = spark.createDataFrame(rows, "fragment_id string, entity_id string, evidence_role string, specificity_scope string, evidence_scope string")
    found = {r.derivation_id: r for r in references.fragment_contracts(reactions, fragments).collect()}
    assert found["d1"].reported_target_fragment_ids == ["f1", "f2"] and found["d1"].core_fragment_evidence_ids == ["f4"] and found["d1"].donor_fragment_evidence_ids == ["f5"]
    assert found["d2"].reported_target_fragment_ids == [] and found["d2"].reaction_fragment_evidence_ids == ["f6"]


def test_registry_from_claims(spark):
    rows = [
        {"claim_id": "1", "claim_type": "compound", "compound_class": "Cls", "compound_name": "Alpha", "formula": "C6H12O6", "chunk_id": "c1", "evidence_quote": "q1", "ion_mode": "positive"},
        {"claim_id": "2", "claim_type": "compound", "compound_class": "Cls", "compound_name": "alpha", "formula": "C6H12O6", "chunk_id": "c2", "evidence_quote": "q2"},
        {"claim_id": "3", "claim_type": "compound", "compound_class": "Cls", "compound_name": "Beta", "chunk_id": "c9", "evidence_quote": "q"},
        {"claim_id": "4", "claim_type": "compound", "compound_class": "Cls", "compound_name": "Cls", "chunk_id": "c1", "evidence_quote": "q1"},
        {"claim_id": "5", "claim_type": "entity_class_membership", "compound_class": "Cls", "entity_id": "Alpha", "entity_class_id": "k", "membership_role": "member", "chunk_id": "c1", "evidence_quote": "q1"},
        {"claim_id": "6", "claim_type": "entity_class_membership", "compound_class": "Cls", "entity_name": "Gamma", "entity_class_id": "", "membership_role": "member", "chunk_id": "c1", "evidence_quote": "q1"},
    ]
    claims = table(spark, rows, "claim_id claim_type compound_class compound_name formula chunk_id evidence_quote ion_mode entity_id entity_name entity_class_id membership_role")
    records = spark.createDataFrame([("v1", "c1", "q1"), ("v2", "c2", "q2")], "evidence_id string, chunk_id string, evidence_quote string")
    found = {k: df.collect() for k, df in references.build_registry(claims, records).items()}
    by_name = {r.canonical_name: r for r in found["entities"]}
    assert set(by_name) == {"Alpha", "Gamma"} and by_name["Alpha"].evidence_ids == ["v1", "v2"] and by_name["Alpha"].ion_modes == ["positive"] and abs(by_name["Alpha"].exact_mass - 180.06339) < 1e-4
    assert [(f.form_type, f.formula) for f in found["forms"]] == [("neutral_molecule", "C6H12O6")]
    assert [(m.entity_id, m.entity_class_id) for m in found["memberships"]] == [(by_name["Alpha"].entity_id, "k")] and [c.entity_class_id for c in found["classes"]] == ["k"]
    assert {(a.status, a.reason) for a in found["audits"]} == {("quarantined", "underspecified_compound_class_label"), ("rejected", "missing_accepted_evidence"), ("rejected", "invalid_entity_class_membership")}


def test_compound_candidates(spark):
    rows = [{"claim_type": "compound", "compound_name": "A", "compound_class": "C", "claim_id": "1"}, {"claim_type": "compound", "compound_name": "a", "compound_class": "c", "claim_id": "2", "formula": "H2O"}, {"claim_type": "compound", "compound_name": "B", "compound_class": "C", "claim_id": "3", "reported_precursor_mz": "101.00728", "adduct": "[M + H]+"}]
    found = {r.compound_name: r for r in references.compound_candidates(table(spark, rows, "claim_type compound_name compound_class claim_id formula reported_precursor_mz adduct")).collect()}
    assert found["A"].mass_source == "formula" and found["A"].evidence_ids == ["1", "2"] and found["B"].mass_source == "precursor_adduct" and abs(found["B"].exact_mass - 100) < 1e-4


def test_table_guard(spark):
    pages = spark.createDataFrame([("f", 1, "Table S1. Betalains of beet\nrows"), ("f", 2, "more rows"), ("f", 4, "rows behind a gap"), ("g", 1, "Table 2: other things"), ("h", 1, "text on betalain pigments")], "source_file string, page int, page_text string")
    claims = spark.createDataFrame([(i, *r) for i, r in enumerate([("f", 1, "X"), ("f", 2, "X"), ("f", 4, "X"), ("g", 1, "X"), ("g", 1, "Betanin A"), ("h", 1, "X")])], "claim_id int, source_file string, page int, compound_name string")
    concepts = spark.createDataFrame([("betanin", "compound"), ("abc", "subclass")], "name string, type string")
    found = {r.claim_id: (r.verdict, r.table_scope) for r in guards.table_guard(claims, pages, "Betalain", concepts).collect()}
    assert found == {0: ("pass", "s1"), 1: ("pass", "s1"), 2: ("reject", ""), 3: ("reject", "2"), 4: ("pass", "2"), 5: ("pass", "")}


def test_name_encoded_relations(spark):
    rows = [(0, "transformation", True, "Betanin", "Malonyl betanin", "malonylation", "the malonyl betanin was seen"), (1, "transformation", True, "Betanin", "Malonyl betanin", "malonylation", "nothing"), (2, "transformation", False, "Betanin", "Malonyl betanin", "malonylation", "malonyl betanin"), (3, "transformation", True, "Betanin", "Iso betanin", "malonylation", "iso betanin")]
    df = spark.createDataFrame(rows, "claim_id int, claim_type string, traceable boolean, source_entity string, target_entity string, transformation_name string, evidence_quote string")
    found = {r.claim_id: (r.verdict, r.source_evidence_basis) for r in guards.name_encoded_relations(df, spark.createDataFrame([("Betanin", "compound")], "name string, type string")).collect()}
    assert {k: v[0] for k, v in found.items()} == {0: "recover", 1: "reject", 2: "reject", 3: "reject"} and found[0][1] == "discovered_concept"


def test_discoveries_are_summed(spark):
    rows = [("exact_discover", "a", "", ""), ("fragment_supported_discover", "b", "", ""), ("ambiguous_group_discover", "", "g", "b; c"), ("none", "z", "", "")]
    df = spark.createDataFrame(rows, "annotation_status string, target_entity_id string, target_entity_group_id string, ambiguous_target_entity_ids string")
    r = network.summarize_discoveries(df).first()
    assert (r.formal_discover_node_count, r.raw_exact_discover_entity_count, r.exact_discover_entity_count, r.ambiguous_discover_group_count, r.formal_discovery_unit_count) == (3, 2, 1, 1, 2)
