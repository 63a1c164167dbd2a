"""References between claims, fragments and entities: the registry built from claims, names resolved, broken links mended.

Names are looked up by keys in joins; what is decided about one name or claim is decided on its few candidates, as
arrays within its row. Nothing is chosen by formula alone.
"""

from __future__ import annotations

from collections.abc import Callable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmass.functions import chemistry, text
from quillmass.operators import evidence, inventory, registry
from quillmass.operators.storage import cut

#: Claim types that name an entity, kinds of entities, types and origins of forms.
ENTITY_TYPES = ("entity", "compound", "precursor", "structural_component", "biosynthetic_component")
ENTITY_KINDS = ("molecule", "moiety", "entity_class")
FORM_TYPES = ("neutral_molecule", "reported_ion", "incorporated_residue", "functional_group")
FORMULA_ORIGINS = ("reported", "reaction_operator_derived")
DIAGNOSTIC_ROLES = ("target_product_ion", "explicit_target_diagnostic")
OPAQUE_ID = r"(?i)^(?:entity|compound|cmp|component|precursor|donor)_[A-Za-z0-9]+$"
MASS_TOLERANCE = 0.01


def col_or(df: DataFrame, name: str) -> Column:
    """A column's cleaned text; empty if the table lacks it."""
    return text.clean_text(F.col(name)) if name in df.columns else F.lit("")


def entity_name(claims: DataFrame) -> Column:
    return text.first_nonempty(*[col_or(claims, c) for c in ("entity_name", "compound_name", "component_name", "precursor_name")])


def entity_id_of(compound_class: Column, name: Column, given: Column) -> Column:
    return inventory.claim_entity_id(given, compound_class, name)


# ---- names to entities


def signature(candidate: Column) -> Column:
    """What makes two records one chemical: formula and mass to six decimals."""
    return F.concat_ws("|", F.coalesce(candidate["formula"], F.lit("")), F.coalesce(F.round(candidate["mass"], 6).cast("string"), F.lit("none")))


def candidates_by_name(rows: DataFrame, entities: DataFrame, key: Column) -> DataFrame:
    """``rows`` with ``candidates``: the entities (entity_id, formula, mass) one of whose names has the key."""
    index = entities.select("entity_id", F.explode("reported_names").alias("n")).select("entity_id", F.explode(text.registry_name_keys(F.col("n"))).alias("_key")).distinct()
    held = index.join(entities.select("entity_id", "formula", F.col("exact_mass").alias("mass")), "entity_id")
    lists = held.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("entity_id", F.coalesce("formula", F.lit("")).alias("formula"), "mass"))).alias("candidates"))  # entities of one name
    return rows.withColumn("_key", key).join(lists, "_key", "left").drop("_key")


def narrowed(candidates: Column, keep) -> Column:
    """The candidates that fit; all, if none does."""
    some = F.filter(candidates, keep)
    return F.when(F.size(some) > 0, some).otherwise(candidates)


def chosen(candidates: Column) -> Column:
    """The smallest id, if all candidates are one chemical; else empty."""
    one = F.size(F.array_distinct(F.transform(candidates, signature))) == 1
    return F.when(one, F.array_min(F.transform(candidates, lambda c: c["entity_id"]))).otherwise("")


def resolve_names(rows: DataFrame, entities: DataFrame, name: str = "name", preferred: str = "preferred_id", formula: str = "formula", mass: str = "exact_mass", out: str = "resolved_id") -> DataFrame:
    """Adds ``out``: a known preferred id; else the entity of the name, narrowed by formula, mass and having a formula."""
    found = cut(candidates_by_name(rows, entities, text.registry_name(text.clean_text(F.col(name)))))
    asked, weight = col_or(rows, formula), text.safe_float(F.col(mass)) if mass in rows.columns else F.lit(None).cast("double")
    c = F.coalesce("candidates", F.array().cast("array<struct<entity_id:string,formula:string,mass:double>>"))
    c = F.when(asked != "", narrowed(c, lambda x: x["formula"] == asked)).otherwise(c)
    c = F.when(weight.isNotNull(), narrowed(c, lambda x: F.abs(x["mass"] - weight) <= MASS_TOLERANCE)).otherwise(c)
    best = chosen(narrowed(c, lambda x: x["formula"] != ""))
    known = entities.select(F.col("entity_id").alias("_known"))
    given = found.withColumn("_given", col_or(rows, preferred))
    joined = given.join(known, F.col("_given") == F.col("_known"), "left")
    return joined.withColumn(out, F.when(F.col("_known").isNotNull(), F.col("_given")).when(F.size(c) > 0, best).otherwise("")).drop("candidates", "_given", "_known")


def participant_candidates(participants: DataFrame, entities: DataFrame, memberships: DataFrame) -> DataFrame:
    """Adds ``members``: the entity ids that a reaction's participant may stand for.

    ``participants``: scope, entity_id, entity_name, entity_class_id. Of a class: its members. Of an id with a formula:
    itself; without one: the entity of the same name that has one, if all such are one chemical, else nothing; itself
    where no such entity is known. Of a name: all entities of the name.
    """
    pools = memberships.join(entities.select("entity_id"), "entity_id", "left_semi").groupBy(F.col("entity_class_id").alias("_class")).agg(F.array_sort(F.collect_set("entity_id")).alias("_pool"))  # a class's entities
    own = entities.select(F.col("entity_id").alias("_own"), F.coalesce("formula", F.lit("")).alias("_own_formula"))
    rows = candidates_by_name(participants, entities, text.registry_name(F.coalesce("entity_name", F.lit(""))))
    rows = rows.join(pools, F.col("entity_class_id") == F.col("_class"), "left").join(own, F.col("entity_id") == F.col("_own"), "left")
    none = F.array().cast("array<string>")
    ids = F.transform("candidates", lambda c: c["entity_id"])
    formed = F.filter("candidates", lambda c: c["formula"] != "")
    stand_in = F.when(F.coalesce(F.size(formed), F.lit(0)) <= 0, F.array("entity_id")).when(chosen(formed) != "", F.array(chosen(formed))).otherwise(none)
    by_id = F.when(F.col("_own").isNull(), none).when(F.col("_own_formula") != "", F.array("entity_id")).otherwise(stand_in)
    members = F.when(F.col("scope") == "entity_class", F.coalesce("_pool", none)).when(F.col("scope") == "unresolved", none).when(F.coalesce("entity_id", F.lit("")) != "", by_id).otherwise(F.coalesce(ids, none))
    return rows.withColumn("members", members).drop("candidates", "_class", "_pool", "_own", "_own_formula")


def product_status(products: Column, members: Column) -> Column:
    """How far a reaction's products (array of participants) are known; ``members`` are those of its only product."""
    scope = products[0]["scope"]
    n = F.size(members)
    named = F.when(n == 1, "unique_reported_entity").when(n > 1, "ambiguous_reported_entities").otherwise("unresolved_product_class")
    return F.when(F.size(products) != 1, "unresolved_product_class").when(scope == "specific_entity", named).when((scope == "entity_class") & (n > 1), "ambiguous_reported_entities").otherwise("mechanism_derived_entity")


# ---- fragments to entities


def reconciled_fragments(fragments: DataFrame, claims: DataFrame, entities: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fragments whose unknown entities are replaced by the one that a claim's name resolves to, or taken away; and counts.

    A fragment that loses its entity (or, as a class diagnostic, its class) becomes an unassigned peak. Footnote marks
    behind a name are ignored. One row of counts: resolved, downgraded entities and classes, ambiguous names.
    """
    name = text.first_nonempty(*[col_or(claims, c) for c in ("compound_name", "component_name", "precursor_name")])
    rows = claims.select(name.alias("name"), entity_id_of(col_or(claims, "compound_class"), name, col_or(claims, "entity_id")).alias("provisional")).filter("provisional <> ''")
    unknown = rows.join(entities.select(F.col("entity_id").alias("provisional")), "provisional", "left_anti").distinct()
    plain = F.btrim(F.regexp_replace("name", r"\s*[\*†‡]+\s*$", ""))
    tried = unknown.withColumn("name", F.explode(F.array_distinct(F.filter(F.array(F.col("name"), plain), lambda n: n != ""))))
    found = resolve_names(tried, entities).filter("resolved_id <> ''").groupBy("provisional").agg(F.countDistinct("resolved_id").alias("n"), F.min("resolved_id").alias("target"))
    found = cut(found)
    out = fragments.join(found.filter("n = 1").select(F.col("provisional").alias("entity_id"), "target"), "entity_id", "left")
    out = out.join(entities.select(F.col("entity_id"), F.lit(True).alias("_known")), "entity_id", "left").join(classes.select(F.col("entity_class_id"), F.lit(True).alias("_class")).distinct(), "entity_class_id", "left")
    lost = (F.coalesce("entity_id", F.lit("")) != "") & F.col("_known").isNull()
    no_class = (F.coalesce("entity_class_id", F.lit("")) != "") & F.col("_class").isNull()
    marked = cut(out.withColumn("_lost", lost).withColumn("_no_class", no_class))
    unassigned = (F.col("_lost") & F.col("target").isNull() & F.col("evidence_role").isin(*DIAGNOSTIC_ROLES, "theoretical_catalog")) | (F.col("_no_class") & (F.col("evidence_role") == "class_diagnostic"))
    changed = {"entity_id": F.when(F.col("_lost"), F.coalesce("target", F.lit(""))).otherwise(F.col("entity_id")), "entity_class_id": F.when(F.col("_no_class"), "").otherwise(F.col("entity_class_id"))}
    changed |= {c: F.when(unassigned, "unassigned_peak").otherwise(F.col(c)) for c in ("evidence_role", "evidence_scope", "specificity_scope") if c in fragments.columns}
    mended = marked.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in fragments.columns])
    counts = marked.agg(F.count_if(F.col("_lost") & F.col("target").isNotNull()).alias("resolved_unknown_entity_count"), F.count_if(F.col("_lost") & F.col("target").isNull()).alias("downgraded_unknown_entity_count"), F.count_if("_no_class").alias("downgraded_unknown_class_count"))
    return mended, counts.crossJoin(F.broadcast(found.agg(F.count_if(F.col("n") > 1).alias("ambiguous_provisional_entity_count"))))  # one row each


def fragment_aliases(entities: DataFrame, fragments: DataFrame) -> DataFrame:
    """entity_id, supported_id: for each entity, itself if it has target fragments, else the only alias that has.

    An alias shares a name key and agrees in formula or in mass.
    """
    held = fragments.filter(F.col("evidence_role").isin(*DIAGNOSTIC_ROLES) & (F.coalesce("entity_id", F.lit("")) != "")).select("entity_id").distinct()
    names = entities.select("entity_id", F.explode("reported_names").alias("n")).select("entity_id", F.explode(text.registry_name_keys(F.col("n"))).alias("key")).distinct()
    chem = entities.select("entity_id", F.coalesce("formula", F.lit("")).alias("formula"), "exact_mass")
    bare = names.join(held, "entity_id", "left_anti").join(chem, "entity_id").select(F.col("entity_id").alias("a"), "key", F.col("formula").alias("fa"), F.col("exact_mass").alias("ma"))
    full = names.join(held, "entity_id", "left_semi").join(chem, "entity_id").select(F.col("entity_id").alias("b"), "key", F.col("formula").alias("fb"), F.col("exact_mass").alias("mb"))
    agrees = ((F.col("fa") != "") & (F.col("fa") == F.col("fb"))) | F.coalesce(F.abs(F.col("ma") - F.col("mb")) <= MASS_TOLERANCE, F.lit(False))
    only = bare.join(full, "key").filter(agrees).groupBy("a").agg(F.countDistinct("b").alias("n"), F.min("b").alias("b")).filter("n = 1")
    return entities.select("entity_id").join(only, F.col("entity_id") == F.col("a"), "left").select("entity_id", F.coalesce("b", "entity_id").alias("supported_id"))


def fragment_contracts(reactions: DataFrame, fragments: DataFrame, shown: Callable[[Column], Column] = lambda ids: ids) -> DataFrame:
    """derivation_id and sorted fragment ids by role: what was reported for a reaction's target, anchor, other reactants, and reactions.

    ``reactions``: derivation_id, target_entity_id, anchor_entity_id, reactant_ids (array). Nothing is made up for a
    product without reports. Fragments are gathered once for each set of targets and of participants that reactions
    have; ``shown`` is applied to these arrays before reactions join them (F.size: only counts travel).
    """
    scoped = F.col("specificity_scope") == "target_specific" if "specificity_scope" in fragments.columns else F.col("evidence_scope") == "target_specific"

    def ids(condition: Column, name: str) -> Column:
        return F.array_sort(F.collect_set(F.when(condition, F.col("fragment_id")))).alias(name)

    each = F.filter(F.transform("reactant_ids", lambda r: F.struct(F.col("anchor_entity_id").alias("anchor"), r.alias("entity_id"))), lambda p: p["entity_id"].isNotNull())
    sets = reactions.select("derivation_id", "target_entity_id", each.alias("each")).groupBy("derivation_id").agg(F.count("*").cast("int").alias("rows"), F.array_sort(F.collect_set("target_entity_id")).alias("targets"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("each")))).alias("parts"))
    none = F.col("derivation_id").isNull()  # joined nothing
    sets = sets.withColumns({"targets": F.when(~none, F.col("targets")), "parts": F.when(~none, F.col("parts"))})

    explicit, product = (F.col("evidence_role") == "explicit_target_diagnostic") & scoped, (F.col("evidence_role") == "target_product_ion") & scoped
    of_target = sets.select("targets").distinct().select("targets", F.explode("targets").alias("entity_id")).join(fragments, "entity_id")
    targets = of_target.groupBy("targets").agg(ids(explicit | product, "reported_target_fragment_ids"), ids(explicit, "explicit_target_diagnostic_ids"), ids(product, "target_product_ion_ids"), ids(F.col("evidence_role") == "class_diagnostic", "class_diagnostic_ids"), ids(F.col("evidence_role") == "theoretical_catalog", "theoretical_catalog_ids"))
    parts = sets.select("parts").distinct().select("parts", F.explode("parts").alias("p")).select("parts", "p.*").join(fragments.filter("evidence_scope = 'component_specific'"), "entity_id")
    sides = parts.groupBy("parts").agg(ids(F.col("entity_id") == F.col("anchor"), "core_fragment_evidence_ids"), ids(F.col("entity_id") != F.col("anchor"), "donor_fragment_evidence_ids"))
    general = fragments.filter("evidence_scope = 'reaction_associated'").agg(F.array_sort(F.collect_set("fragment_id")).alias("reaction_fragment_evidence_ids"))  # one row
    empty = shown(F.array().cast("array<string>"))

    def made(df: DataFrame, key: str) -> DataFrame:
        return df.select(*([key] if key else []), *[shown(F.col(c)).alias(c) for c in df.columns if c != key])

    dealt = sets.select("targets", "parts", F.explode(F.array_repeat("derivation_id", F.col("rows"))).alias("derivation_id"))
    out = dealt.join(made(targets, "targets"), "targets", "left").join(made(sides, "parts"), "parts", "left").crossJoin(F.broadcast(made(general, ""))).drop("targets", "parts")
    return out.select("derivation_id", *[F.coalesce(c, empty).alias(c) for c in out.columns if c != "derivation_id"])


# ---- the registry


def claim_evidence(claims: DataFrame, records: DataFrame) -> DataFrame:
    """``ord``, evidence_ids: the accepted records of a claim's chunks that hold its quote (any quote, if it has no id).

    ``claims``: ord, claim_id, chunk_id, source_chunk_ids (array), evidence_quote; ``records``: evidence_id, chunk_id,
    evidence_quote.
    """
    more = F.coalesce("source_chunk_ids", F.array().cast("array<string>")) if "source_chunk_ids" in claims.columns else F.array().cast("array<string>")
    ids = F.array_distinct(F.filter(F.concat(F.array(col_or(claims, "chunk_id")), more), lambda c: c != ""))
    each = claims.select("ord", col_or(claims, "claim_id").alias("claim"), text.first_nonempty(col_or(claims, "evidence_quote"), col_or(claims, "evidence_sentence")).alias("quote"), F.explode(ids).alias("chunk_id"))
    met = each.join(records.select("chunk_id", "evidence_id", F.col("evidence_quote").alias("held")), "chunk_id").filter("claim = '' OR held = quote")
    return met.groupBy("ord").agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"))  # a claim's citations


def participant_entities(claims: DataFrame) -> DataFrame:
    """Entity claims of the specific participants of valid reactions; ``reactants`` and ``products`` are arrays of structs."""
    valid = claims.filter((F.lower(col_or(claims, "claim_type")) == "reaction_template") & (F.lower(col_or(claims, "structured_validation_status")) != "invalid"))
    out = None
    for side in ("reactants", "products"):
        if side not in claims.columns:
            continue
        each = valid.withColumn("p", F.explode(side)).filter((F.lower(text.clean_text(F.col("p.scope"))) == "specific_entity") & (text.clean_text(F.col("p.entity_name")) != "") & (text.clean_text(F.col("p.entity_id")) != ""))
        fields = {f.name for f in claims.schema[side].dataType.elementType.fields}
        part = lambda c: text.clean_text(F.col(f"p.{c}")) if c in fields else F.lit("")  # noqa: E731, B023
        rows = each.withColumns({"claim_type": F.lit("entity"), "entity_id": part("entity_id"), "entity_name": part("entity_name"), "entity_kind": F.lit("molecule"), "formula": part("formula"), "exact_mass": part("exact_mass")}).drop("p")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else valid.limit(0)


def membership_entities(claims: DataFrame) -> DataFrame:
    """Entity claims of memberships that name an entity which no entity claim has; an id that is no opaque one is a name."""
    named = claims.filter(F.lower(col_or(claims, "claim_type")).isin(*ENTITY_TYPES)).select(registry.registry_key(entity_name(claims)).alias("_key")).filter("_key <> ''").distinct()
    supplied = col_or(claims, "entity_id")
    reported = text.first_nonempty(col_or(claims, "entity_name"), F.when(~supplied.rlike(OPAQUE_ID), supplied).otherwise(""))
    rows = claims.filter(F.lower(col_or(claims, "claim_type")) == "entity_class_membership").withColumn("_name", reported).filter("_name <> ''")
    rows = rows.withColumn("_key", registry.registry_key(F.col("_name"))).join(named, "_key", "left_anti")
    made = {"claim_type": F.lit("entity"), "entity_id": entity_id_of(col_or(claims, "compound_class"), F.col("_name"), F.lit("")), "entity_name": F.col("_name"), "entity_kind": F.lit("molecule"), "formula": F.lit("")}
    return rows.withColumns(made).drop("_name", "_key")


def build_registry(claims: DataFrame, records: DataFrame) -> dict[str, DataFrame]:
    """entities, forms, classes, memberships and audits from claims (``ord`` and claim fields) and accepted evidence records.

    Names that are no molecule's are quarantined; aliases that the evidence teaches become one entity; of conflicting
    formulas the best supported one stays; claims without accepted evidence are rejected, with the reason.
    """
    names = ("claim_id claim_type compound_class entity_id entity_name compound_name component_name precursor_name entity_kind formula exact_mass ion_mode synonyms source_structure chunk_id evidence_quote "
             "entity_class_id entity_class_name membership_role role membership_id form_id form_type formula_origin reaction_operator structured_validation_status").split()  # fmt: skip
    given = claims.select("ord", *[col_or(claims, c).alias(c) for c in names], (F.col("source_chunk_ids") if "source_chunk_ids" in claims.columns else F.lit(None)).cast("array<string>").alias("source_chunk_ids"), *[c for c in ("reactants", "products") if c in claims.columns])
    parts = [given, participant_entities(given), membership_entities(given)]
    rows = None
    for k, df in enumerate(parts):
        df = df.drop("reactants", "products").withColumn("ord", F.struct(F.lit(k).alias("part"), F.col("ord").alias("at")))
        rows = df if rows is None else rows.unionByName(df, allowMissingColumns=True)
    rows = cut(rows.withColumn("name", entity_name(rows)).withColumn("named", F.lower("claim_type").isin(*ENTITY_TYPES)).withColumn("ord_key", F.to_json("ord")))
    rows = rows.withColumn("record", F.when(F.col("named"), entity_id_of(F.col("compound_class"), F.col("name"), F.col("entity_id"))).otherwise(F.col("entity_id"))).withColumn("issue", F.when(F.col("named"), registry.name_issue(F.col("name"), F.col("compound_class"))).otherwise(""))
    bad = rows.filter("issue <> ''").select(F.lit("entity").alias("record_type"), F.col("record").alias("record_id"), F.lit("quarantined").alias("status"), F.col("issue").alias("reason")).distinct()
    fine = rows.filter("issue = ''")
    seen = claim_evidence(fine.drop("ord").withColumnRenamed("ord_key", "ord"), records).withColumnRenamed("ord", "ord_key")
    fine = cut(fine.join(seen, "ord_key", "left").withColumn("evidence_ids", F.coalesce("evidence_ids", F.array().cast("array<string>"))))
    named = fine.filter("named")
    with_evidence = named.filter("size(evidence_ids) > 0")
    aliases = registry.learn_aliases(with_evidence.select(F.col("record").alias("entity_id"), "name", "formula", "compound_class", "evidence_quote"))
    moved = cut(fine.join(aliases.select(F.col("entity_id").alias("record"), "canonical_id"), "record", "left").withColumn("entity_id", F.coalesce("canonical_id", "record")).drop("canonical_id", "record"))
    named = moved.filter("named")
    best = cut(registry.formula_consensus(named.select("entity_id", "formula", "source_structure", "evidence_ids", "ord_key").withColumnRenamed("ord_key", "ord_text").withColumn("ord", F.xxhash64("ord_text"))))
    kind = text.first_nonempty(F.lower("entity_kind"), F.when(F.lower("claim_type") == "structural_component", "moiety").otherwise("molecule"))
    checked = named.join(best.select("entity_id", F.col("formula").alias("best"), "conflict"), "entity_id", "left").withColumn("kind", kind).withColumn("why", F.when(F.col("name") == "", "missing_name").when(F.size("evidence_ids") == 0, "missing_accepted_evidence").when(~F.col("kind").isin(*ENTITY_KINDS), "invalid_entity_kind").otherwise(""))
    checked = cut(checked.withColumn("formula", F.coalesce("best", "formula")))
    good = checked.filter("why = ''").withColumn("names", F.concat(F.array("name"), text.split_values(F.col("synonyms")))).withColumn("modes", F.filter(text.split_values(F.lower("ion_mode")), lambda m: m.isin("positive", "negative", "not_reported")))
    merged = evidence.ordered_merge(good.withColumn("ord", F.col("ord_key")), ["entity_id"], "ord", first=["name", "kind", "compound_class", "formula"], union=["names", "modes"], sorted_union=["evidence_ids"])
    entities = cut(merged.select("entity_id", F.col("name").alias("canonical_name"), F.col("names").alias("reported_names"), F.col("kind").alias("entity_kind"), F.coalesce("compound_class", F.lit("")).alias("compound_class"), F.coalesce("formula", F.lit("")).alias("formula"), chemistry.formula_mass(F.col("formula")).alias("exact_mass"), F.col("modes").alias("ion_modes"), "evidence_ids"))
    audit = [bad, aliases.select(F.lit("entity").alias("record_type"), F.col("entity_id").alias("record_id"), F.lit("merged").alias("status"), F.concat(F.lit("evidence_derived_alias_to:"), "canonical_id").alias("reason"))]
    audit.append(best.filter("conflict").select(F.lit("entity").alias("record_type"), F.col("entity_id").alias("record_id"), F.lit("conflict").alias("status"), F.lit("entity_formula_conflict").alias("reason")))
    audit.append(checked.filter("why <> ''").select(F.lit("entity").alias("record_type"), F.when(F.col("why") == "missing_name", F.col("claim_id")).otherwise(F.col("entity_id")).alias("record_id"), F.lit("rejected").alias("status"), F.col("why").alias("reason")))
    forms, form_audit = _forms(moved, entities)
    classes, memberships, member_audit = _memberships(moved, entities)
    audits = audit[0]
    for a in (*audit[1:], form_audit, member_audit):
        audits = audits.unionByName(a)
    return {"entities": entities, "forms": forms, "classes": classes, "memberships": memberships, "audits": audits}


def _forms(rows: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Forms that claims state, then one of each molecule's own formula."""
    stated = rows.filter(F.lower("claim_type") == "entity_form").withColumn("form_type", F.lower("form_type")).withColumn("formula_origin", F.lower("formula_origin"))
    key = text.stable_json_id("form", F.struct("entity_id", "form_type", "formula", "reaction_operator"))
    stated = stated.withColumn("form_id", text.first_nonempty(F.col("form_id"), key)).join(entities.select("entity_id", F.lit(True).alias("known")), "entity_id", "left")
    fine = F.coalesce(F.col("known") & F.col("form_type").isin(*FORM_TYPES) & F.col("formula_origin").isin(*FORMULA_ORIGINS) & (F.size("evidence_ids") > 0) & chemistry.formula_mass(F.col("formula")).isNotNull(), F.lit(False))
    columns = ["form_id", "entity_id", "form_type", "formula", "exact_mass", "formula_origin", "reaction_operator", "evidence_ids"]
    good = stated.filter(fine).withColumn("exact_mass", chemistry.formula_mass(F.col("formula"))).select(*columns, F.lit(0).alias("late"))
    kind = F.when(F.col("formula").rlike(r"(?:\^\d+[+-]|[+-])$"), "reported_ion").otherwise("neutral_molecule")
    own = entities.filter("entity_kind = 'molecule' AND formula <> ''").withColumn("form_type", kind)
    own = own.withColumn("form_id", text.stable_json_id("form", F.struct("entity_id", "form_type", "formula"))).withColumns({"formula_origin": F.lit("reported"), "reaction_operator": F.lit("")}).select(*columns, F.lit(1).alias("late"))
    both = good.unionByName(own)
    first = both.groupBy("form_id").agg(F.min_by(F.struct(*columns[1:]), "late").alias("f")).select("form_id", "f.*")
    lost = stated.filter(~fine).select(F.lit("form").alias("record_type"), F.col("form_id").alias("record_id"), F.lit("rejected").alias("status"), F.lit("invalid_entity_form").alias("reason"))
    return first, lost


def _memberships(rows: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes and memberships; an unknown entity id is read as a name if one entity has it."""
    stated = rows.filter(F.lower("claim_type") == "entity_class_membership").withColumn("member_role", text.first_nonempty(F.col("membership_role"), F.col("role")))
    known = stated.join(entities.select("entity_id", F.lit(True).alias("known")), "entity_id", "left")
    index = registry.name_index(entities).filter(F.size("entity_ids") == 1).select(F.col("key").alias("_key"), F.col("entity_ids")[0].alias("by_name"))
    found = known.withColumn("_key", text.registry_name(F.col("entity_id"))).join(index, "_key", "left").withColumn("entity_id", F.when(F.col("known"), F.col("entity_id")).otherwise(F.coalesce("by_name", F.lit(""))))
    fine = (F.col("entity_id") != "") & (F.col("entity_class_id") != "") & (F.col("member_role") != "") & (F.size("evidence_ids") > 0)
    good = cut(found.filter(fine).withColumn("membership_id", text.first_nonempty(F.col("membership_id"), text.stable_json_id("membership", F.struct("entity_class_id", "entity_id", F.col("member_role").alias("role"))))))
    classes = good.groupBy("entity_class_id").agg(F.min_by(text.first_nonempty(F.col("entity_class_name"), F.col("entity_class_id")), "ord_key").alias("class_label"), F.min_by("evidence_ids", "ord_key").alias("evidence_ids"))
    members = good.groupBy("membership_id").agg(F.max_by(F.struct("entity_id", "entity_class_id", F.col("member_role").alias("role"), "evidence_ids"), "ord_key").alias("m")).select("membership_id", "m.*")
    lost = found.filter(~fine).select(F.lit("membership").alias("record_type"), F.col("claim_id").alias("record_id"), F.lit("rejected").alias("status"), F.lit("invalid_entity_class_membership").alias("reason"))
    return classes, members, lost


# ---- candidates of inference


def neutral_mass(mz: Column, adduct: Column) -> Column:
    """The neutral mass of a singly charged ion of the common adducts; null for others."""
    offsets = chemistry.literal_map({a: chemistry.ADDUCTS[a][1] for a in ("[M+H]+", "[M-H]-", "[M+Na]+", "[M+NH4]+")}, "map<string,double>")
    return text.safe_float(mz) - F.element_at(offsets, F.regexp_replace(text.clean_text(adduct), " ", ""))


def claim_mass(claims: DataFrame) -> Column:
    """struct(mass, source): the stated mass, else the formula's, else that of the precursor's ion."""
    stated, calculated = text.safe_float(F.col("exact_mass")) if "exact_mass" in claims.columns else F.lit(None).cast("double"), chemistry.formula_mass(col_or(claims, "formula"))
    ion = neutral_mass(text.first_nonempty(col_or(claims, "reported_precursor_mz"), col_or(claims, "precursor_mz")), col_or(claims, "adduct"))
    source = F.when(stated.isNotNull(), "exact_mass").when(calculated.isNotNull(), "formula").when(ion.isNotNull(), "precursor_adduct").otherwise("")
    return F.struct(F.coalesce(stated, calculated, ion).alias("mass"), source.alias("source"))


def compound_candidates(claims: DataFrame) -> DataFrame:
    """One row for each compound of a class, as evidence.infer_transformations takes them: the first value of each field in order."""
    fields = ("compound_name", "compound_class", "subclass", "formula", "source_file", "chunk_id")
    ids = text.first_nonempty(*[col_or(claims, c) for c in ("evidence_ids", "claim_id", "chunk_id")])
    rows = claims.filter(col_or(claims, "claim_type") == "compound").select("ord", *[col_or(claims, c).alias(c) for c in fields], claim_mass(claims).alias("m"), text.split_values(ids).alias("evidence_ids"), F.filter(F.array(col_or(claims, "evidence_summary")), lambda s: s != "").alias("evidence_summary")).filter("compound_name <> ''")
    rows = rows.withColumns({"k_class": F.lower("compound_class"), "k_name": F.lower("compound_name"), "mass_text": F.col("m.mass").cast("string")})
    merged = evidence.ordered_merge(rows, ["k_class", "k_name"], "ord", first=[*fields, "mass_text"], union=["evidence_ids", "evidence_summary"])
    sources = rows.filter("mass_text IS NOT NULL").groupBy("k_class", "k_name").agg(F.min_by("m.source", "ord").alias("mass_source"))
    out = merged.join(sources, ["k_class", "k_name"], "left")
    return out.select("ord", *[F.coalesce(c, F.lit("")).alias(c) for c in fields], F.col("mass_text").cast("double").alias("exact_mass"), F.coalesce("mass_source", F.lit("")).alias("mass_source"), "evidence_ids", F.array_join("evidence_summary", ";").alias("evidence_summary"))
