"""The tables of a network run from a rule bundle, seeds from library hits, and the whole chain from spectra to network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmass.functions import chemistry, text
from quillmass.operators import network, spectra

POLARITIES = ("positive", "negative")


def _text(df: DataFrame, name: str) -> Column:
    return F.btrim(F.coalesce(F.col(name).cast("string"), F.lit(""))) if name in df.columns else F.lit("")


def _listed(df: DataFrame, name: str, allowed: tuple[str, ...] | None = None) -> Column:
    """A list column, or a text cell split into one; only allowed values."""
    if name not in df.columns:
        return F.array().cast("array<string>")
    kind = dict(df.dtypes)[name]
    values = F.coalesce(F.col(name), F.array().cast("array<string>")) if kind.startswith("array") else text.split_values(F.col(name))
    return F.filter(values, lambda v: v.isin(*allowed)) if allowed else values


def load_knowledge(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """entities, rules, fragments and diagnostics, as the network takes them.

    Entities are the molecules that have a compound rule; rules without a whole-number anchor, or whose source or
    target is no such entity, are left out; diagnostics are those of class consensus.
    """
    compounds, registry = tables["compound_rules"], tables["entity_registry"]
    known = registry.select(F.btrim("entity_id").alias("entity_id"), _text(registry, "canonical_name").alias("canonical_name"), _text(registry, "compound_class").alias("compound_class"), _text(registry, "entity_kind").alias("entity_kind"), text.safe_float(F.col("exact_mass")).alias("exact_mass"), _listed(registry, "ion_modes", POLARITIES).alias("ion_modes"))
    ruled = compounds.select(_text(compounds, "entity_id").alias("entity_id"), _listed(compounds, "adduct", tuple(chemistry.ADDUCTS)).alias("adducts"), text.first_nonempty(_text(compounds, "target_origin"), F.lit("reported")).alias("target_origin"))
    ruled = ruled.groupBy("entity_id").agg(F.max(F.struct("adducts", "target_origin")).alias("r")).select("entity_id", "r.*")
    entities = known.filter("entity_kind = 'molecule'").join(ruled, "entity_id").drop("entity_kind")
    raw = tables["transformation_rules"]
    ids = entities.select("entity_id")
    rules = raw.select(
        _text(raw, "rule_id").alias("rule_id"),
        _text(raw, "source_entity_id").alias("source_entity_id"),
        _text(raw, "target_entity_id").alias("target_entity_id"),
        _text(raw, "anchor_reactant_index").try_cast("int").alias("anchor"),
        _listed(raw, "ion_mode", POLARITIES).alias("ion_modes"),
        *[_text(raw, c).alias(c) for c in ("chemical_validation_status", "evidence_type", "relation_evidence_status", "product_resolution_status", "reaction_operator")],
        text.first_nonempty(_text(raw, "candidate_policy"), F.lit("literature_supported")).alias("candidate_policy"),
        text.first_nonempty(_text(raw, "propagation_policy"), F.lit("allow_after_identity_gate")).alias("propagation_policy"),
    ).filter("anchor IS NOT NULL")
    for side in ("source_entity_id", "target_entity_id"):
        rules = rules.join(ids.withColumnRenamed("entity_id", side), side, "left_semi")
    seen = tables["fragment_evidence"]
    fragments = seen.select(
        _text(seen, "fragment_id").alias("fragment_id"),
        _text(seen, "entity_id").alias("entity_id"),
        text.safe_float(F.col("fragment_mz")).alias("fragment_mz"),
        text.first_nonempty(_text(seen, "ion_mode"), F.lit("not_reported")).alias("ion_mode"),
        _text(seen, "evidence_role").alias("evidence_role"),
        text.first_nonempty(_text(seen, "discriminative_status"), F.lit("not_evaluated")).alias("discriminative_status"),
        F.coalesce(_text(seen, "competitor_entity_count").try_cast("double").cast("int"), F.lit(0)).alias("competitor_entity_count"),
    ).filter("fragment_id <> '' AND fragment_mz IS NOT NULL")
    rows = tables["diagnostic_fragment_rules"]
    diagnostics = rows.filter(_text(rows, "diagnostic_origin") == "class_consensus_frequency").select(_text(rows, "rule_id").alias("rule_id"), _text(rows, "compound_class").alias("compound_class"), _text(rows, "ion_mode").alias("ion_mode"), text.safe_float(F.col("fragment_mz")).alias("fragment_mz"), _text(rows, "support_rank").try_cast("int").alias("support_rank")).filter("fragment_mz IS NOT NULL")
    return {"entities": entities, "rules": rules.drop("anchor"), "fragments": fragments, "diagnostics": diagnostics}


def resolve_seeds(candidates: DataFrame, entities: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seeds (node_id, entity_id) of library names, and each candidate's status: resolved, ambiguous or unresolved.

    ``candidates``: node_id, name. A name that stands for several entities is resolved if only one of them has rules.
    """
    keys = entities.select("entity_id", F.explode(text.registry_name_keys(F.col("canonical_name"))).alias("key")).distinct()
    active = rules.select(F.col("source_entity_id").alias("entity_id")).distinct().withColumn("active", F.lit(True))
    named = candidates.withColumn("key", text.registry_name(F.col("name"))).join(keys, "key", "left").join(active, "entity_id", "left")
    found = named.groupBy("node_id", "name").agg(F.collect_set("entity_id").alias("all"), F.collect_set(F.when(F.col("active"), F.col("entity_id"))).alias("ruled"))  # the entities of one name
    one = F.when(F.size("all") == 1, F.get("all", F.lit(0))).when(F.size("ruled") == 1, F.get("ruled", F.lit(0)))
    status = F.when(F.size("all") == 0, "unresolved").when(one.isNull(), "ambiguous").otherwise("resolved")
    rows = found.select("node_id", "name", one.alias("entity_id"), status.alias("seed_resolution_status"))
    return rows.filter("entity_id IS NOT NULL").select("node_id", "entity_id").distinct(), rows


def annotate(queries: DataFrame, library: DataFrame, knowledge: dict[str, DataFrame], match: spectra.MatchConfig = spectra.MatchConfig(), config: network.NetworkConfig = network.NetworkConfig(), seed: int = 42) -> dict[str, DataFrame]:
    """Spectra to network: library hits, accepted matches, seeds, preflight, decisions, hypotheses and edges."""
    hits, accepted, near = spectra.run_match(queries, library, match, seed)
    seeds, resolution = resolve_seeds(near.select(F.col("query_id").alias("node_id"), F.col("name_clean").alias("name")), knowledge["entities"], knowledge["rules"])
    nodes = queries.select(F.col("query_id").alias("node_id"), "precursor_mz", "ion_mode", "peaks")
    tables = [knowledge[k] for k in ("entities", "rules", "fragments", "diagnostics")]
    decisions, hypotheses, edges = network.expand(nodes, seeds, *tables, config)
    return {"hits": hits, "accepted": accepted, "seeds": seeds, "resolution": resolution, "preflight": network.preflight(nodes, seeds, tables[0], tables[1], config), "decisions": decisions, "hypotheses": hypotheses, "edges": edges}
