"""Reaction network: seeds expand along rules to unassigned spectra, level by level, through auditable gates.

Tables: nodes (node_id, precursor_mz, ion_mode, peaks), seeds (node_id, entity_id), entities (entity_id,
canonical_name, compound_class, exact_mass, adducts, ion_modes, target_origin), rules (rule_id, source_entity_id,
target_entity_id, ion_modes, chemical_validation_status, evidence_type, relation_evidence_status,
product_resolution_status, candidate_policy, propagation_policy), fragments (fragment_id, entity_id, fragment_mz,
ion_mode, evidence_role, discriminative_status, competitor_entity_count) and diagnostics (rule_id, compound_class,
ion_mode, fragment_mz, support_rank). The driver only loops over depths.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmass.functions import chemistry
from quillmass.operators.bandjoin import band_join
from quillmass.operators.storage import cut

MODES = ("evidence_bundle", "reaction_evidence", "strict", "high_recall", "mass_only", "required_empty", "theoretical_catalog_only")
GATES = ("source_propagation", "ion_mode", "chemical_validation", "target_mass_available", "precursor_ppm", "precursor_da", "fragment_identity", "isomer_uniqueness")
VALID_CHEMISTRY = ("valid", "derived_formula_valid")
ID_LISTS = ("target_ids", "explicit_ids", "product_ids", "catalog_ids", "discriminative_ids", "class_ids")


@dataclass(frozen=True)
class NetworkConfig:
    """Tolerances and thresholds of the gates."""

    ppm: float = 10.0
    da: float = 0.01
    fragment_da: float = 0.10
    max_depth: int = 2
    gate_mode: str = "reaction_evidence"
    least_class: int = 2
    least_target: int = 1
    least_product: int = 2
    discriminative: tuple[str, ...] = ("unique", "low_sharing")
    most_signature_share: float = 0.1
    generic_adducts: bool = True

    def __post_init__(self):
        if self.gate_mode not in MODES:
            raise ValueError(f"gate_mode must be one of {MODES}")
        if self.least_class not in (2, 3):
            raise ValueError("least_class must be 2 or 3")
        if min(self.least_target, self.least_product, self.max_depth) <= 0:
            raise ValueError("thresholds and depth must be positive")
        if not 0 < self.most_signature_share <= 1:
            raise ValueError("most_signature_share must be within (0, 1]")


def matching(edges: dict[int, list[int]], order: list[int]) -> dict[int, int]:
    """A maximum matching of left to right items by augmenting paths, left items in ``order``; right -> left."""
    taken: dict[int, int] = {}

    def place(item: int, tried: set[int]) -> bool:
        for spot in edges.get(item, ()):
            if spot not in tried:
                tried.add(spot)
                if spot not in taken or place(taken[spot], tried):
                    taken[spot] = item
                    return True
        return False

    for item in order:
        place(item, set())
    return taken


def class_matches(candidates: DataFrame) -> DataFrame:
    """node_id, compound_class, class_ids: diagnostics matched to peaks one to one, as many as possible.

    ``candidates``: node_id, compound_class, rule_id, support_rank, peak, error. Rules with fewer candidate peaks go
    first, then better ranks; nearer peaks are tried first. A group is one spectrum's peaks and one class's rules.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rule_id", "error", "peak"])
        names = sorted(rows["rule_id"].unique())
        number = {name: i for i, name in enumerate(names)}
        edges = {number[name]: group["peak"].tolist() for name, group in rows.groupby("rule_id")}
        rank = rows.groupby("rule_id")["support_rank"].min().fillna(1e9)
        order = sorted(edges, key=lambda i: (len(edges[i]), rank[names[i]], names[i]))
        found = sorted(names[i] for i in matching(edges, order).values())
        return pd.DataFrame([{"node_id": key[0], "compound_class": key[1], "class_ids": found}])

    return candidates.groupBy("node_id", "compound_class").applyInPandas(run, "node_id string, compound_class string, class_ids array<string>")


def mass_candidates(nodes: DataFrame, targets: DataFrame, config: NetworkConfig) -> DataFrame:
    """node_id, entity_id and the best passing adduct with its errors, by a polarity-bound band join on expected m/z."""
    generic = F.array(*[F.lit(a) for a in chemistry.ADDUCTS]) if config.generic_adducts else F.array().cast("array<string>")
    own = F.coalesce(F.col("adducts"), F.array().cast("array<string>"))
    each = targets.filter(F.col("exact_mass").isNotNull()).select("entity_id", "exact_mass", F.posexplode(F.array_distinct(F.concat(own, generic))).alias("place", "adduct"))
    each = each.withColumn("ion_mode", chemistry.adduct_mode(F.col("adduct"))).withColumn("expected_mz", chemistry.expected_mz(F.col("exact_mass"), F.col("adduct"))).filter(F.col("expected_mz").isNotNull())
    pairs = band_join(nodes.select("node_id", "precursor_mz", "ion_mode"), each.select("entity_id", "place", "adduct", "ion_mode", "expected_mz"), "precursor_mz", "expected_mz", config.da, on=["ion_mode"], residual=chemistry.mass_match(F.col("a.precursor_mz"), F.col("b.expected_mz"), config.ppm, config.da))
    da, ppm = chemistry.mass_errors(F.col("precursor_mz"), F.col("expected_mz"))
    return pairs.groupBy("node_id", "entity_id").agg(F.min(F.struct(da.alias("error_da"), ppm.alias("error_ppm"), F.col("place"), F.col("adduct"))).alias("mass"))


def fragment_matches(pairs: DataFrame, nodes: DataFrame, entities: DataFrame, fragments: DataFrame, diagnostics: DataFrame, config: NetworkConfig) -> DataFrame:
    """node_id, entity_id and the matched evidence ids by role, for pairs that passed the mass gate."""
    peaks = nodes.join(pairs.select("node_id").distinct(), "node_id", "left_semi").select("node_id", "ion_mode", F.posexplode("peaks").alias("peak", "p")).select("node_id", "ion_mode", "peak", F.col("p.mz").cast("double").alias("peak_mz"))
    wanted = pairs.select("node_id", "entity_id").join(fragments, "entity_id")
    modes = nodes.select("node_id", F.col("ion_mode").alias("node_mode"))
    wanted = wanted.join(modes, "node_id")
    fits = F.col("ion_mode") == F.col("node_mode")
    if config.gate_mode != "strict":
        fits = fits | (F.col("ion_mode") == "not_reported")
    wanted = wanted.filter(fits).drop("ion_mode", "node_mode")
    hit = band_join(peaks.select("node_id", "peak_mz"), wanted.withColumnRenamed("fragment_mz", "expected"), "peak_mz", "expected", config.fragment_da, on=["node_id"])
    role = F.col("evidence_role")

    def ids(condition: Column) -> Column:
        return F.array_sort(F.collect_set(F.when(condition, F.col("fragment_id"))))  # at most an entity's fragments

    strong = F.col("discriminative_status").isin(*config.discriminative) & role.isin("explicit_target_diagnostic", "target_product_ion")
    own = hit.groupBy("node_id", "entity_id").agg(
        ids(role != "class_diagnostic").alias("target_ids"),
        ids(role == "explicit_target_diagnostic").alias("explicit_ids"),
        ids(role == "target_product_ion").alias("product_ids"),
        ids(role == "theoretical_catalog").alias("catalog_ids"),
        ids(strong).alias("discriminative_ids"),
        F.max(F.when(strong, F.col("competitor_entity_count")).otherwise(0)).alias("competitors"),
    )
    classes = pairs.select("node_id", "entity_id").join(entities.select("entity_id", F.lower("compound_class").alias("compound_class")), "entity_id")
    rules = diagnostics.select(F.lower("compound_class").alias("compound_class"), "ion_mode", F.col("fragment_mz").alias("expected"), "rule_id", "support_rank")
    asked = peaks.join(classes.select("node_id", "compound_class").distinct(), "node_id")
    near = band_join(asked, rules, "peak_mz", "expected", config.fragment_da, on=["compound_class", "ion_mode"])
    matched = class_matches(near.select("node_id", "compound_class", "rule_id", "support_rank", "peak", F.abs(F.col("peak_mz") - F.col("expected")).alias("error")))
    by_class = classes.join(matched, ["node_id", "compound_class"]).select("node_id", "entity_id", "class_ids")
    out = pairs.select("node_id", "entity_id").join(own, ["node_id", "entity_id"], "left").join(by_class, ["node_id", "entity_id"], "left")
    for c in ID_LISTS:
        out = out.withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    return out.withColumn("competitors", F.coalesce("competitors", F.lit(0)))


def signature_competitors(matches: DataFrame, nodes: DataFrame, fragments: DataFrame, config: NetworkConfig) -> DataFrame:
    """node_id, entity_id, signature_competitors, signature_universe: entities whose product ions cover every matched one."""
    products = fragments.filter((F.col("evidence_role") == "target_product_ion") & (F.coalesce(F.col("entity_id"), F.lit("")) != "")).select("fragment_id", "entity_id", "fragment_mz", "ion_mode")
    universe = products.groupBy("ion_mode").agg(F.countDistinct("entity_id").alias("signature_universe"))
    signature = matches.select("node_id", "entity_id", F.explode("product_ids").alias("fragment_id")).join(nodes.select("node_id", "ion_mode"), "node_id")
    signature = signature.join(products.select("fragment_id", "ion_mode", "fragment_mz"), ["fragment_id", "ion_mode"]).select("node_id", "entity_id", "ion_mode", F.round("fragment_mz", 9).alias("signature_mz")).distinct()
    need = signature.groupBy("node_id", "entity_id", "ion_mode").agg(F.count("*").alias("need"))
    covered = band_join(signature, products.select(F.col("entity_id").alias("other"), "ion_mode", "fragment_mz"), "signature_mz", "fragment_mz", config.fragment_da, on=["ion_mode"]).select("node_id", "entity_id", "other", "signature_mz").distinct()
    full = covered.groupBy("node_id", "entity_id", "other").agg(F.count("*").alias("held")).join(need, ["node_id", "entity_id"]).filter("held = need AND need >= 2")
    counts = full.groupBy("node_id", "entity_id").agg(F.count("*").alias("signature_competitors"))
    out = matches.select("node_id", "entity_id").join(nodes.select("node_id", "ion_mode"), "node_id").join(universe, "ion_mode", "left").join(counts, ["node_id", "entity_id"], "left")
    return out.select("node_id", "entity_id", F.coalesce("signature_competitors", F.lit(0)).alias("signature_competitors"), F.coalesce("signature_universe", F.lit(0)).alias("signature_universe"))


def fragment_gate(config: NetworkConfig) -> tuple[Column, Column]:
    """passed and level of the fragment gate over hypothesis columns, by the mode."""
    n_class, n_product, n_target = F.size("class_ids"), F.size("product_ids"), F.size("target_ids")
    derived = F.col("target_origin") == "mechanism_derived"
    class_level = F.lit("class_consensus_pair" if config.least_class == 2 else "class_consensus_triplet")
    failed = F.lit("failed")
    pair, many = n_class >= config.least_class, n_product >= config.least_product
    if config.gate_mode == "reaction_evidence":
        passed = ~derived & pair
        return passed, F.when(passed, class_level).otherwise(failed)
    if config.gate_mode == "evidence_bundle":
        explicit = F.col("evidence_type") == "explicit_report"
        balanced = (F.col("evidence_type") == "literature_inferred") & (F.col("relation_evidence_status") == "component_delta_consistent")
        resolved = F.col("product_resolution_status").isin("unique_reported_entity", "ambiguous_reported_entities")
        passed = ~derived & F.col("chemical_validation_status").isin(*VALID_CHEMISTRY) & resolved & (pair | (many & (explicit | balanced)))
        return passed, F.when(passed & pair, class_level).when(passed & explicit, "explicit_relation_target_ion_pair").when(passed, "balanced_relation_target_ion_pair").otherwise(failed)
    if config.gate_mode == "mass_only":
        return F.lit(True), F.lit("mass_only")
    if config.gate_mode == "required_empty":
        return F.lit(False), failed
    if config.gate_mode == "theoretical_catalog_only":
        passed = F.size("catalog_ids") > 0
        return passed, F.when(passed, "theoretical_catalog").otherwise(failed)
    if config.gate_mode == "high_recall":
        # mechanism-derived targets need component evidence, which rules of these tables do not carry
        passed = ~derived & (n_target >= config.least_target)
        return passed, F.when(passed, "broad_reported_fragment").otherwise(failed)
    explicit = F.arrays_overlap("explicit_ids", "discriminative_ids")
    product = many & F.arrays_overlap("product_ids", "discriminative_ids")
    share = F.col("signature_competitors") / F.nullif(F.col("signature_universe"), F.lit(0))
    signature = many & (F.col("signature_competitors") > 0) & (share <= config.most_signature_share)
    signature = F.coalesce(signature, F.lit(False))
    level = F.when(derived, failed).when(explicit, "explicit_target_diagnostic").when(product, "target_product_ion_pair").when(signature, "target_product_ion_signature").otherwise(failed)
    return level != "failed", level


def hypotheses(frontier: DataFrame, nodes: DataFrame, entities: DataFrame, rules: DataFrame, fragments: DataFrame, diagnostics: DataFrame, config: NetworkConfig, depth: int) -> DataFrame:
    """All rule applications of one depth whose target mass fits an open node, with every gate as a column.

    ``frontier``: node_id, entity_id. Replicate nodes of an entity count once, by the smallest id.
    """
    sources = frontier.groupBy(F.col("entity_id").alias("source_entity_id")).agg(F.min("node_id").alias("source_node_id"))
    steps = sources.join(rules, "source_entity_id").join(entities.select(F.col("entity_id").alias("target_entity_id"), "target_origin", "exact_mass", F.col("ion_modes").alias("entity_modes")), "target_entity_id")
    targets = entities.join(steps.select(F.col("target_entity_id").alias("entity_id")).distinct(), "entity_id", "left_semi")
    # each is used several times; kept, its joins run once
    mass = cut(mass_candidates(nodes, targets, config))
    found = cut(fragment_matches(mass, nodes, entities, fragments, diagnostics, config))
    signed = cut(signature_competitors(found, nodes, fragments, config))
    pairs = mass.join(found, ["node_id", "entity_id"]).join(signed, ["node_id", "entity_id"]).withColumnRenamed("entity_id", "target_entity_id")
    rows = steps.join(pairs, "target_entity_id").join(nodes.select("node_id", F.col("ion_mode").alias("node_mode")), "node_id").withColumnRenamed("node_id", "target_node_id")
    passed, level = fragment_gate(config)
    modes = F.when(F.size(F.coalesce("ion_modes", F.array().cast("array<string>"))) > 0, F.col("ion_modes")).otherwise(F.coalesce("entity_modes", F.array().cast("array<string>")))
    gates = {
        "source_propagation": F.lit(True),
        "ion_mode": (F.size(modes) == 0) | F.array_contains(modes, F.col("node_mode")),
        "chemical_validation": F.col("chemical_validation_status").isin(*VALID_CHEMISTRY),
        "target_mass_available": F.col("exact_mass").isNotNull(),
        "precursor_ppm": F.col("mass.error_ppm") <= config.ppm,
        "precursor_da": F.col("mass.error_da") <= config.da,
        "fragment_identity": passed,
        "isomer_uniqueness": F.lit(True),
    }
    for name, gate in gates.items():
        rows = rows.withColumn(f"gate_{name}", F.coalesce(gate, F.lit(False)))
    every = F.lit(True)
    for name in GATES:
        every = every & F.col(f"gate_{name}")
    return rows.withColumn("fragment_gate_level", level).withColumn("passed", every & (F.col("evidence_type") != "delta_only")).withColumn("depth", F.lit(depth)).withColumn("matched_adduct", F.col("mass.adduct")).withColumn("mass_error_da", F.col("mass.error_da")).withColumn("mass_error_ppm", F.col("mass.error_ppm")).drop("mass", "node_mode", "entity_modes")


def decide(rows: DataFrame, config: NetworkConfig) -> DataFrame:
    """One decision for each target node: assigned, ambiguous, or the best that its mass supports."""
    order = F.struct("target_entity_id", "rule_id")
    support = (F.size("target_ids") > 0) | (F.size("class_ids") > 0)
    mass = F.col("gate_chemical_validation") & F.col("gate_precursor_ppm") & F.col("gate_precursor_da")
    marked = rows.withColumn("_support", support).withColumn("_strong", F.size("discriminative_ids") > 0)
    targets = marked.filter("passed").groupBy("target_node_id", "target_entity_id").agg(F.max("_strong").alias("strong"))
    summary = targets.groupBy("target_node_id").agg(F.count("*").alias("n_targets"), F.count_if("strong").alias("n_strong"), F.max(F.when(F.col("strong"), F.col("target_entity_id"))).alias("strong_target"))
    marked = marked.join(summary, "target_node_id", "left")
    settled = (F.col("n_targets") == 1) | (F.col("n_strong") == 1)
    usable = F.col("passed") & ((F.col("n_targets") == 1) | (F.col("target_entity_id") == F.col("strong_target")))
    fields = ["source_entity_id", "target_entity_id", "rule_id", "evidence_type", "target_origin", "candidate_policy", "propagation_policy", "fragment_gate_level", "_support"]
    pick = F.struct(*fields)
    reported = F.min(F.when(F.col("passed"), (F.col("target_origin") == "reported") & F.col("evidence_type").isin("explicit_report", "literature_inferred")))
    grouped = marked.groupBy("target_node_id").agg(
        F.first("n_targets").alias("n_targets"),
        F.first(settled).alias("settled"),
        F.min_by(pick, F.when(usable, order)).alias("chosen"),
        F.min_by(pick, F.when(mass, order)).alias("supported"),
        reported.alias("reported_group"),
        F.min(F.when(F.col("passed"), F.col("candidate_policy") == "literature_explanation_only")).alias("explained"),
        F.array_sort(F.collect_set(F.when(F.col("passed"), F.col("target_entity_id")))).alias("ambiguous_targets"),
        F.array_sort(F.collect_set(F.when(F.col("passed"), F.col("rule_id")))).alias("ambiguous_rules"),
        F.array_sort(F.collect_set(F.when(F.col("passed"), F.col("source_entity_id")))).alias("sources"),
    )
    none = F.col("n_targets").isNull()
    c, s = F.col("chosen"), F.col("supported")
    identified = config.gate_mode in ("strict", "reaction_evidence", "evidence_bundle")
    of_mass = (
        F.when((s["target_origin"] == "mechanism_derived") & s["_support"], "mechanism_supported_exploratory")
        .when((s["candidate_policy"] == "literature_explanation_only") & s["_support"], "literature_explained_candidate")
        .when(s["_support"], "exploratory_candidate")
        .otherwise("candidate")
    )
    of_group = F.when(F.col("reported_group") & F.col("explained"), "ambiguous_literature_explained_candidate").when(F.col("reported_group"), "ambiguous_group_discover").otherwise("ambiguous")
    of_one = (
        F.when(c["candidate_policy"] == "literature_explanation_only", "literature_explained_candidate")
        .when(F.lit(identified) & (c["target_origin"] == "reported"), "fragment_supported_discover")
        .when(c["target_origin"] == "mechanism_derived", "mechanism_supported_exploratory")
        .otherwise("exploratory_candidate")
    )
    status = F.when(none, of_mass).when(F.col("settled"), of_one).otherwise(of_group)
    single = F.when(none, s).when(F.col("settled"), c)
    ambiguous = ~none & ~F.col("settled")
    group = F.concat(F.lit("entity_group_"), F.substring(F.sha1(F.array_join("ambiguous_targets", "|")), 1, 16))
    return (
        grouped.filter(~none | s.isNotNull())
        .withColumn("annotation_status", status)
        .select(
            F.col("target_node_id").alias("node_id"),
            F.coalesce(single["target_entity_id"], F.lit("")).alias("target_entity_id"),
            F.coalesce(single["source_entity_id"], F.when(F.size("sources") == 1, F.get("sources", F.lit(0))), F.lit("")).alias("source_entity_id"),
            F.coalesce(single["rule_id"], F.lit("")).alias("rule_id"),
            "annotation_status",
            (F.col("annotation_status") == "fragment_supported_discover").alias("_found"),
            F.coalesce((F.col("annotation_status") == "fragment_supported_discover") & (single["propagation_policy"] == "allow_after_identity_gate"), F.lit(False)).alias("propagation_eligible"),
            F.when(none, "identity_gate_not_satisfied").when(ambiguous, "multiple_gate_passing_targets").otherwise("").alias("ambiguity_reason"),
            F.coalesce(single["fragment_gate_level"], F.when(F.col("reported_group"), "ambiguous_group").otherwise("ambiguous")).alias("fragment_gate_level"),
            F.when(ambiguous & F.col("reported_group"), group).otherwise("").alias("target_entity_group_id"),
            F.when(ambiguous, F.col("ambiguous_targets")).otherwise(F.array().cast("array<string>")).alias("ambiguous_targets"),
            F.when(ambiguous, F.col("ambiguous_rules")).otherwise(F.array().cast("array<string>")).alias("ambiguous_rules"),
        )
        .drop("_found")
    )


def expand(nodes: DataFrame, seeds: DataFrame, entities: DataFrame, rules: DataFrame, fragments: DataFrame, diagnostics: DataFrame, config: NetworkConfig = NetworkConfig()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decisions, hypotheses and edges of the network.

    Seeds of unknown nodes or entities are left out; a node with several seed entities is an ambiguous seed that
    still spreads from each of them. A (node, target) state is tried at one depth only.
    """
    seeds = seeds.join(nodes.select("node_id"), "node_id", "left_semi").join(entities.select("entity_id"), "entity_id", "left_semi").select("node_id", "entity_id").distinct()
    known = seeds.groupBy("node_id").agg(F.array_sort(F.collect_set("entity_id")).alias("ids"))  # one spectrum's near-tied entities
    one = F.size("ids") == 1
    none = F.array().cast("array<string>")
    decisions = cut(known.select(
        "node_id",
        F.when(one, F.get("ids", F.lit(0))).otherwise("").alias("target_entity_id"),
        F.lit("").alias("source_entity_id"),
        F.lit("").alias("rule_id"),
        F.when(one, "known_match").otherwise("ambiguous_library_seed").alias("annotation_status"),
        F.lit(True).alias("propagation_eligible"),
        F.when(one, "").otherwise("near_tied_library_entities").alias("ambiguity_reason"),
        F.when(one, "").otherwise("library_seed_group").alias("fragment_gate_level"),
        F.when(one, "").otherwise(F.concat(F.lit("entity_group_"), F.substring(F.sha2(F.array_join("ids", "|"), 256), 1, 16))).alias("target_entity_group_id"),
        F.when(one, none).otherwise(F.col("ids")).alias("ambiguous_targets"),
        none.alias("ambiguous_rules"),
        F.lit(0).alias("network_depth"),
    ))
    visited, frontier, audits = seeds.select("node_id", F.col("entity_id").alias("target_entity_id")), seeds, []
    for depth in range(1, config.max_depth + 1):
        open_nodes = nodes.join(decisions.select("node_id"), "node_id", "left_anti")
        rows = hypotheses(frontier, open_nodes, entities, rules, fragments, diagnostics, config, depth)
        rows = cut(rows.join(visited.withColumnRenamed("node_id", "target_node_id"), ["target_node_id", "target_entity_id"], "left_anti"))
        audits.append(rows)
        decided = cut(decide(rows, config).withColumn("network_depth", F.lit(depth)))
        decisions = decisions.unionByName(decided)
        frontier = decided.filter("propagation_eligible").select("node_id", F.col("target_entity_id").alias("entity_id"))
        visited = visited.unionByName(rows.select(F.col("target_node_id").alias("node_id"), "target_entity_id").distinct())
        if frontier.isEmpty():
            break
    every = audits[0]
    for more in audits[1:]:
        every = every.unionByName(more)
    found = decisions.filter(F.col("annotation_status").isin("fragment_supported_discover", "ambiguous_group_discover"))
    edges = found.select("source_entity_id", F.when(F.col("target_entity_id") != "", F.col("target_entity_id")).otherwise(F.col("target_entity_group_id")).alias("target_entity_id"), "rule_id", "annotation_status", "ambiguous_targets", "ambiguous_rules")
    return decisions, every, edges


def reachable(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """node, depth: the least number of steps from a seed, up to ``depth``; one frontier join for each level."""
    seen = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for level in range(1, depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["source"]).select(F.col("target").alias("node")).distinct()
        frontier = step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(level))
        seen = seen.unionByName(frontier)
    return seen


def preflight(nodes: DataFrame, seeds: DataFrame, entities: DataFrame, rules: DataFrame, config: NetworkConfig = NetworkConfig()) -> DataFrame:
    """One row: counts that tell whether a run can find anything, and the reason it cannot."""
    valid = seeds.join(nodes.select("node_id"), "node_id", "left_semi").join(entities.select("entity_id"), "entity_id", "left_semi")
    reach = reachable(rules.select(F.col("source_entity_id").alias("source"), F.col("target_entity_id").alias("target")), valid.select(F.col("entity_id").alias("node")), config.max_depth)
    usable = rules.join(reach.select(F.col("node").alias("source_entity_id")), "source_entity_id", "left_semi")
    modes = [r[0] for r in nodes.select("ion_mode").distinct().limit(3).collect()]  # at most two polarities and none
    fits = (F.size("ion_modes") == 0) | F.arrays_overlap("ion_modes", F.array(*[F.lit(m) for m in modes]).cast("array<string>"))
    counts = valid.agg(F.count("*").alias("seeds")).crossJoin(usable.agg(F.count("*").alias("rules"), F.count_if(fits).alias("polarity_rules")))  # one row each
    reason = F.when(F.col("seeds") == 0, "no_resolved_seed").when(F.col("rules") == 0, "no_reachable_rule").when(F.col("polarity_rules") == 0, "no_polarity_compatible_rule").otherwise("")
    return counts.withColumn("stop_reason", reason)


def best_first(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group in a given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_n") <= k).drop("_n")


#: Statuses of formal discoveries.
EXACT_DISCOVERIES = ("fragment_supported_discover", "exact_discover", "mechanism_supported_discover")
AMBIGUOUS_DISCOVERY = "ambiguous_group_discover"


def summarize_discoveries(rows: DataFrame) -> DataFrame:
    """One row: nodes with a formal discovery, entities found exactly (and outside ambiguous groups), groups, and their sum.

    ``rows``: annotation_status, target_entity_id, target_entity_group_id, ambiguous_target_entity_ids (joined by semicolons).
    """
    status = F.btrim(F.coalesce("annotation_status", F.lit("")))
    entity, group = F.btrim(F.coalesce("target_entity_id", F.lit(""))), F.btrim(F.coalesce("target_entity_group_id", F.lit("")))
    exact, several = status.isin(*EXACT_DISCOVERIES), status == AMBIGUOUS_DISCOVERY
    ids = rows.filter(exact & (entity != "")).select(entity.alias("e")).distinct()
    members = rows.filter(several).select(F.explode(F.split(F.coalesce("ambiguous_target_entity_ids", F.lit("")), ";")).alias("e")).select(F.btrim("e").alias("e")).filter("e <> ''").distinct()
    alone = ids.join(members, "e", "left_anti")
    counts = rows.agg(F.count_if(exact | several).alias("formal_discover_node_count"), F.countDistinct(F.when(several & (group != ""), group)).alias("ambiguous_discover_group_count"))
    one = counts.crossJoin(F.broadcast(ids.agg(F.count("*").alias("raw_exact_discover_entity_count")))).crossJoin(F.broadcast(alone.agg(F.count("*").alias("exact_discover_entity_count"))))  # one row each
    return one.withColumn("formal_discovery_unit_count", F.col("exact_discover_entity_count") + F.col("ambiguous_discover_group_count"))
