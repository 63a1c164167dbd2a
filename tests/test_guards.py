"""Claim verdicts and document windows on hand-made rows."""

from pyspark.sql import functions as F

from quillmass.operators import guards, windows


def test_domain_guard(spark):
    rows = [("a", "transformation", "Betanin", "Isobetanin", "", ""), ("b", "transformation", "Betanin", "", "", ""), ("c", "transformation", "[M+H]+", "Betanin", "", ""), ("d", "compound", "", "", "", "nothing of it"), ("e", "entity_component_membership", "", "", "x", "betalain")]
    claims = spark.createDataFrame(rows, "claim_id string, claim_type string, source_entity string, target_entity string, entity_id string, evidence_quote string")
    concepts = spark.createDataFrame([("Betanin", "compound"), ("ab", "x")], "name string, type string")
    found = {r.claim_id: (r.verdict, r.reason_code) for r in guards.domain_guard(claims, "Betalains", concepts).collect()}
    assert found == {"a": ("pass", ""), "b": ("reject", "missing_transformation_endpoint"), "c": ("reject", "msms_fragmentation_not_entity_transformation"), "d": ("reject", "domain_relevance_not_established"), "e": ("reject", "missing_component_entity")}


def test_critic_decisions(spark):
    claims = spark.createDataFrame([("a", "one – two", ["c1"]), ("b", "end begin", ["c1", "c2"]), ("c", "gone", ["c1"]), ("d", "gone", []), ("e", "one", ["c1"])], "claim_id string, evidence_quote string, source_chunk_ids array<string>")
    chunks = spark.createDataFrame([("c1", "One - two the end"), ("c2", "begin here")], "chunk_id string, text string")
    decisions = spark.createDataFrame([("a", "accept", "explicit_report", ["x"], 1), ("b", "weird", None, None, 1), ("c", "accept", "s", [], 1), ("e", "accept", "s", [], 1), ("e", "reject", "s", [], 2)], "claim_id string, verdict string, support_type string, reason_codes array<string>, ord int")
    found = {r.claim_id: (r.final_verdict, r.traceable, r.reason_codes) for r in guards.critic_decisions(claims, decisions, chunks).collect()}
    assert found == {"a": ("accept", True, ["x"]), "b": ("review", True, []), "c": ("reject", False, ["untraceable_evidence_quote"]), "d": ("review", False, ["untraceable_evidence_quote"]), "e": ("reject", True, [])}


def test_losses_and_structured_rows(spark):
    rows = [("a", "neutral_loss", True, "m/z 150.0 = 312.05 − 162.05", "162.05"), ("b", "neutral_loss", True, "m/z 150.0 = 312.05 - 160", "160"), ("c", "neutral_loss", False, "m/z 1=2-1", "1"), ("d", "neutral_loss", True, None, None)]
    df = spark.createDataFrame(rows, "claim_id string, claim_type string, traceable boolean, evidence_quote string, neutral_loss_mass string")
    assert {r.claim_id: (r.verdict, r.source_ion_mz) for r in guards.recover_losses(df).collect()} == {"a": ("recover", "312.05"), "b": ("reject", None), "c": ("reject", None), "d": ("reject", None)}
    located = guards.prevalidated(df.withColumn("traceability_status", F.when(F.col("claim_id") == "a", "structured")))
    assert {r.claim_id: r.critic_status for r in located.collect()} == {"a": "accept", "b": "review", "c": "review", "d": "review"}


def test_relation_hits_fall_back(spark):
    df = spark.createDataFrame([("a", "g1", ""), ("b", "g2", "direct_hit"), ("c", "g1", "adjacent")], "i string, query_group string, retrieval_origin string")
    assert [r.i for r in guards.relation_hits(df, ["g1"]).collect()] == ["a"] and sorted(r.i for r in guards.relation_hits(df, ["zz"]).collect()) == ["a", "b"]


def test_windows(spark):
    units = spark.createDataFrame([("s", i, str(i) * 10) for i in range(10)] + [("t", 0, "x" * 100)], "source string, position int, content string")
    hits = spark.createDataFrame([("s", 1, 2.0), ("s", 7, 3.0), ("t", 0, 1.0)], "source string, position int, score double")
    rows = windows.document_windows(units, hits, limit=40).collect()
    assert sorted((r.source, r.first_position, r.last_position, r.hit_count) for r in rows if r.source == "s") == [("s", 0, 2, 1), ("s", 6, 8, 1)]
    split = sorted((r.part, r.window_text) for r in rows if r.source == "t")
    assert all(len(t) <= 40 for _, t in split) and len(split) == 3
    picked = windows.pick_windows(spark.createDataFrame(rows).withColumn("signal", F.when(F.col("source") == "t", 1).otherwise(0)), 2).collect()
    assert len(picked) == 2 and {r.source for r in picked} == {"s", "t"}


def test_packing_of_islands():
    assert windows.pack_island([(0, "aa"), (1, "bb"), (2, "cc")], 6) == [(0, 1, 0, "aa\nbb"), (2, 2, 0, "cc")]
    assert windows.pack_island([], 10) == []
