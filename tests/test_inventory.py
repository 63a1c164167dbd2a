"""Evidence inventory, diagnostic mining, bundles and stage records on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from quillmass.operators import inventory
from quillmass.sources import bundle


def test_inventory(spark):
    chunks = spark.createDataFrame([("c1", "f1", "In positive ion mode the diagnostic ion of Betanin is m/z 389.1."), ("c2", "f1", "Other text.")], "chunk_id string, source_file string, text string")
    claims = spark.createDataFrame(
        [
            ("a", "compound", "cls", "Betanin", "", "389.1; 345", "c1", "the diagnostic  ion of betanin", "target_product_ion", ""),
            ("b", "compound", "cls", "Betanin", "", "100", "c2", "not there", "", ""),
            ("c", "compound", "cls", "X", "", "100", "c9", "gone", "", ""),
            ("d", "compound", "cls", "X", "", "100", "c1", "", "", ""),
            ("e", "diagnostic_fragment", "cls", "", "150.05", "", "c1", "the diagnostic ion", "explicit_target_diagnostic", ""),
        ],
        "claim_id string, claim_type string, compound_class string, compound_name string, fragment_mz string, reported_fragments string, chunk_id string, evidence_quote string, evidence_role string, ion_mode string",
    )
    records, fragments, rejected = inventory.build_inventory(claims, chunks)
    assert records.count() == 2 and {r.evidence_type for r in records.collect()} == {"entity", "fragment"}
    found = {(r.fragment_mz, r.evidence_role, r.ion_mode, r.reported_precision) for r in fragments.collect()}
    assert found == {(389.1, "target_product_ion", "positive", 1), (345.0, "target_product_ion", "positive", 0), (150.05, "class_diagnostic", "positive", 2)}
    assert {(r.claim_id, r.reason) for r in rejected.collect()} == {("b", "quote_not_in_chunk"), ("c", "untraceable_evidence"), ("d", "missing_evidence_quote"), ("e", "fragment_role_downgraded")}


def test_roles_of_tables_stay_conservative(spark):
    rows = [("explicit_target_diagnostic", "", "diagnostic", "e", "structured_table"), ("target_product_ion", "", "", "e", "structured_table"), ("target_product_ion", "", "", "e", "structured_identification_table"), ("", "reaction_associated", "", "", "narrative"), ("", "", "", "e", "narrative"), ("", "", "", "", "unknown")]
    df = spark.createDataFrame(rows, "r string, s string, q string, e string, x string")
    got = [tuple(r[0]) for r in df.select(inventory.fragment_role(F.col("r"), F.col("s"), F.lit("compound"), F.col("q"), F.col("e"), F.col("x"))).collect()]
    assert got == [("explicit_target_diagnostic", "target_specific"), ("theoretical_catalog", "target_associated"), ("target_product_ion", "target_specific"), ("reaction_supporting_fragment", "reaction_associated"), ("target_product_ion", "target_specific"), ("unassigned_peak", "unassigned_peak")]


def test_diagnostics_are_mined_near_their_words(spark):
    body = "x" * 600 + " m/z 222.22 far. " + "y" * 500 + " a diagnostic ion m/z 150.055 and 389.10 of betacyanin."
    chunks = spark.createDataFrame([("c1", "f1", body), ("c2", "f2", "A fingerprint at m/z 389.1"), ("c3", "f3", "m/z 300.00 plain")], "chunk_id string, source_file string, text string")
    rows = inventory.mine_diagnostics(chunks, "cls", {"betacyanin": "betacyanin"}).collect()
    found = {(r.subclass, r.fragment_mz): r.evidence_ids for r in rows}
    assert ("betacyanin", "150.06") in found or ("betacyanin", "150.05") in found
    assert found["betacyanin", "389.1"] == ["c1"] and found["", "389.1"] == ["c2"] and not any(k[1] in ("222.22", "300") for k in found)


def test_bundle_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("r2", ["b"], True), ("r1", ["a", "c"], None)], "rule_id string, ids array<string>, flag boolean")
    tables, artifacts = {t: df for t in bundle.TABLES}, {a: df for a in bundle.ARTIFACTS}
    first = bundle.write_bundle(str(tmp_path), tables, artifacts)
    again = bundle.write_bundle(str(tmp_path), {t: df.repartition(3) for t in tables}, artifacts)
    assert first == again and first["tables"]["compound_rules"]["row_count"] == 2
    read = bundle.read_bundle(spark, str(tmp_path))
    assert sorted((r.rule_id, r.ids, r.flag) for r in read["compound_rules"].collect()) == [("r1", '["a","c"]', ""), ("r2", '["b"]', "TRUE")]
    (tmp_path / "compound_rules.csv").write_text("changed")
    with pytest.raises(ValueError, match="digest differs"):
        bundle.validate_bundle(str(tmp_path))
    with pytest.raises(ValueError, match="a bundle has"):
        bundle.write_bundle(str(tmp_path), {}, artifacts)


def test_stage_records(tmp_path):
    a, b, record = (str(tmp_path / n) for n in ("in", "out", "record.json"))
    for p in (a, b):
        with open(p, "w") as f:
            f.write(p)
    args = ("s", "1", {"k": 1}, [a], [b])
    assert bundle.stage_status(record, *args) == "missing_record"
    bundle.commit_stage(record, *args)
    assert bundle.stage_status(record, *args) == "hit"
    assert bundle.stage_status(record, "s", "1", {"k": 2}, [a], [b]) == "parameter_mismatch"
    with open(b, "w") as f:
        f.write("other")
    assert bundle.stage_status(record, *args) == "output_mismatch"
    with open(a, "w") as f:
        f.write("other")
    assert bundle.stage_status(record, *args) == "input_mismatch"
