"""Entity registry: formula consensus, alias learning from repeated series, merged entities, and audits of gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmass.functions import chemistry, text
from quillmass.operators.storage import cut

#: How far a formula's source is trusted.
FORMULA_SOURCES = {"supplementary_catalog": 4, "supplementary_table": 4, "structured_table": 3, "compound_identification_table": 3, "fragmentation_table": 3}
GAP_STATUSES = ("compiled", "merged", "rejected", "quarantined", "unresolved", "nonmaterializable_explanatory_only", "not_applicable")


def registry_key(name: Column) -> Column:
    """The comparison form of a name: folded, ``20-(S)`` as ``20(S)``, without a trailing energy, scan or file number."""
    plain = F.regexp_replace(name, r"(?<=\d)-\(([RrSs])\)", "($1)")
    plain = F.regexp_replace(plain, r"(?i)\s+(?:CE|collision\s*energy|scan|file)\s*[:=_-]?\s*\d+(?:\.\d+)?(?:\s*eV)?$", "")
    return text.registry_name(plain)


def name_issue(name: Column, compound_class: Column) -> Column:
    """Why a name is no unique molecule: missing, mixed scripts, or the bare class label after its locants. Else empty."""
    key, label = registry_key(name), registry_key(compound_class)
    bare = F.regexp_replace(key, r"^(?:(?:\d+(?:,\d+)*)?(?:\([rs]\))[-\s]*|\d+(?:,\d+)*[-\s]*)+", "")
    return F.when(key == "", "missing_name").when(text.mixed_script(name), "mixed_latin_cyrillic_name").when((label != "") & ((key == label) | (bare == label)), "underspecified_compound_class_label").otherwise("")


def formula_consensus(claims: DataFrame) -> DataFrame:
    """entity_id, formula, conflict: the formula with most evidence, then best and most trusted sources, then the earliest.

    ``claims``: entity_id, formula, source_structure, evidence_ids (array), ord. Formulas that do not parse take no part.
    """
    source = F.lower(text.clean_text(F.col("source_structure")))
    trust = F.coalesce(F.element_at(chemistry.literal_map(FORMULA_SOURCES, "map<string,int>"), source), F.when(source != "", 2).otherwise(1))
    rows = claims.filter(chemistry.formula_mass(F.col("formula")).isNotNull() & (F.size("evidence_ids") > 0)).withColumn("trust", trust)
    support = rows.select("entity_id", "formula", F.explode("evidence_ids").alias("e")).groupBy("entity_id", "formula").agg(F.countDistinct("e").alias("evidence"))
    sources = rows.groupBy("entity_id", "formula").agg(F.max("trust").alias("best"), F.sum("trust").alias("total"), F.min("ord").alias("first"))
    both = support.join(sources, ["entity_id", "formula"])
    return both.groupBy("entity_id").agg(F.max_by("formula", F.struct("evidence", "best", "total", (-F.col("first")).alias("early"))).alias("formula"), (F.count("*") > 1).alias("conflict"))


def learn_aliases(records: DataFrame, least_series: int = 2, rounds: int = 20) -> DataFrame:
    """entity_id, canonical_id, reason: entities that are another one under a short or equivalent name.

    ``records``: entity_id, name, formula, compound_class, evidence_quote, of claims that have evidence. Three ways,
    the first that names a target wins: equal folded names; a short prefix (four letters at most) whose series shares
    two or more suffixes and formulas with a longer prefix of the same first letter; a longer name that adds an
    identifier and stands in the quote. Chains are followed to their end. Equal formulas alone never make an alias.
    """
    rows = records.filter((F.col("name") != "") & (F.col("formula") != "")).select("entity_id", "name", "formula", F.lower("compound_class").alias("cls"), registry_key(F.col("name")).alias("key"), registry_key(F.col("evidence_quote")).alias("quote"))
    rows = cut(rows.distinct())
    folded = F.lower("name") != F.col("key")  # names that folding leaves as they are come first
    named = rows.groupBy("cls", "formula", "key", "entity_id").agg(F.min(folded).alias("changed"))
    first = named.groupBy("cls", "formula", "key").agg(F.min_by("entity_id", F.struct("changed", "entity_id")).alias("target"), F.count("*").alias("n")).filter("n > 1")
    equal = named.join(first, ["cls", "formula", "key"]).filter("entity_id <> target").select("entity_id", "target", F.lit(0).alias("way"), F.lit("equivalent_name").alias("reason"))
    # series: modifier, prefix, suffix of names like "X-a1" and "mod X a1"
    shape = r"^(.*?)(?<![a-z0-9])([a-z][a-z0-9]{0,30})(?:-|\s+)([a-z]+\d*[a-z]?)$"
    parts = rows.select("entity_id", "cls", "formula", *[F.regexp_extract("key", shape, i).alias(n) for i, n in enumerate(("lead", "prefix", "suffix"), 1)]).filter("prefix <> ''")
    parts = cut(parts.withColumn("modifier", F.array_join(F.regexp_extract_all("lead", F.lit("[a-z0-9]+"), F.lit(0)), " ")).distinct())
    short, long = parts.alias("s"), parts.alias("l")
    fits = (F.length("s.prefix") <= 4) & (F.length("l.prefix") > F.length("s.prefix")) & (F.substring("s.prefix", 1, 1) == F.substring("l.prefix", 1, 1))
    same = (F.col("s.cls") == F.col("l.cls")) & (F.col("s.formula") == F.col("l.formula")) & (F.col("s.modifier") == F.col("l.modifier")) & (F.col("s.suffix") == F.col("l.suffix"))
    pairs = short.join(long, same & fits & (F.col("s.entity_id") != F.col("l.entity_id")))
    plain = pairs.filter("s.modifier = ''")
    series = cut(plain.groupBy(F.col("s.cls").alias("cls"), F.col("s.prefix").alias("p"), F.col("l.prefix").alias("q")).agg(F.countDistinct("s.suffix").alias("n")).filter(F.col("n") >= least_series))
    signature = ["cls", "formula", "modifier", "suffix", "p", "q"]
    held = pairs.select(F.col("s.cls").alias("cls"), F.col("s.formula").alias("formula"), F.col("s.modifier").alias("modifier"), F.col("s.suffix").alias("suffix"), F.col("s.prefix").alias("p"), F.col("l.prefix").alias("q"), F.col("s.entity_id").alias("a"), F.col("l.entity_id").alias("b")).join(series.drop("n"), ["cls", "p", "q"])
    counted = held.groupBy(*signature).agg(F.countDistinct("a").alias("n_short"), F.countDistinct("b").alias("n_long"), F.min("a").alias("a"), F.min("b").alias("b"))
    # names without a modifier are what taught the series; others must be the only ones of their signature
    unique = counted.filter("modifier <> '' AND n_short = 1 AND n_long = 1").select("a", "b").unionByName(held.filter("modifier = ''").select("a", "b")).distinct()
    by_series = unique.select(F.col("a").alias("entity_id"), F.col("b").alias("target"), F.lit(1).alias("way"), F.lit("series_prefix").alias("reason"))
    # identifier: the longer name begins with the shorter one, word by word
    words = F.split("key", " ")
    longer = rows.select(F.col("entity_id").alias("b"), "cls", "formula", F.col("key").alias("long_key"), F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))).alias("key"))
    begun = rows.join(longer, ["cls", "formula", "key"]).filter((F.col("entity_id") != F.col("b")) & (F.length("long_key") > F.length("key")))
    tail = F.btrim(F.substr(F.col("long_key"), F.length("key") + 1))
    named_in = begun.filter(tail.rlike(r"(?i)^(?:[a-z]{1,6}\d+[a-z0-9-]*|[ivxlcdm]+)$") & F.col("quote").contains(F.col("long_key")))
    by_identifier = named_in.groupBy("entity_id").agg(F.countDistinct("b").alias("n"), F.min("b").alias("target")).filter("n = 1").select("entity_id", "target", F.lit(2).alias("way"), F.lit("identifier_suffix").alias("reason"))
    found = equal.unionByName(by_series).unionByName(by_identifier)
    chosen = cut(found.groupBy("entity_id").agg(F.min_by(F.struct("target", "reason"), F.struct("way", "target")).alias("t")).select("entity_id", F.col("t.target").alias("canonical_id"), F.col("t.reason").alias("reason")))
    for _ in range(rounds):
        onward = chosen.select(F.col("entity_id").alias("canonical_id"), F.col("canonical_id").alias("onward"))
        step = cut(chosen.join(onward, "canonical_id", "left").withColumn("moved", F.col("onward").isNotNull() & (F.col("onward") != F.col("entity_id"))).select("entity_id", F.when(F.col("moved"), F.col("onward")).otherwise(F.col("canonical_id")).alias("canonical_id"), "reason", "moved"))
        chosen = step.drop("moved")
        if step.filter("moved").isEmpty():
            break
    return chosen


def merge_entities(claims: DataFrame, aliases: DataFrame, formulas: DataFrame) -> DataFrame:
    """One row for each canonical entity: first name and class, all reported names, the consensus formula and its mass."""
    rows = claims.join(aliases.select("entity_id", "canonical_id"), "entity_id", "left").withColumn("entity", F.coalesce("canonical_id", "entity_id"))
    merged = rows.groupBy("entity").agg(F.min_by("name", "ord").alias("canonical_name"), F.min_by("compound_class", "ord").alias("compound_class"), F.array_sort(F.collect_set("name")).alias("reported_names"), F.count("*").alias("claims"))
    out = merged.join(formulas.select(F.col("entity_id").alias("entity"), "formula", "conflict"), "entity", "left")
    return out.withColumn("exact_mass", chemistry.formula_mass(F.col("formula"))).withColumnRenamed("entity", "entity_id")


def name_index(entities: DataFrame) -> DataFrame:
    """key, entity_ids: every key of every reported name."""
    keys = entities.select("entity_id", F.explode("reported_names").alias("name")).select("entity_id", F.explode(text.registry_name_keys(F.col("name"))).alias("key"))
    return keys.groupBy("key").agg(F.array_sort(F.collect_set("entity_id")).alias("entity_ids"))  # the entities of one name


def gap_audit(parts: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Gap rows of several stages (gap_type, terminal_status, subject, detail) with ids, each once; and counts by status.

    A status that is not one of GAP_STATUSES is an error. Statuses without rows count zero.
    """
    out = None
    for stage, df in parts.items():
        rows = df.select(F.lit(stage).alias("source_stage"), "gap_type", "terminal_status", "subject", "detail")
        out = rows if out is None else out.unionByName(rows)
    checked = out.withColumn("terminal_status", F.when(F.col("terminal_status").isin(*GAP_STATUSES), F.col("terminal_status")).otherwise(F.raise_error(F.concat(F.lit("unknown status "), F.coalesce("terminal_status", F.lit("null")))).cast("string")))
    key = text.stable_json_id("audit", F.struct("detail", "gap_type", "source_stage", "subject", "terminal_status"))
    rows = checked.withColumn("audit_id", key).dropDuplicates(["audit_id"])
    names = out.sparkSession.createDataFrame([(s,) for s in GAP_STATUSES], "terminal_status string")
    summary = names.join(rows.groupBy("terminal_status").count(), "terminal_status", "left").select("terminal_status", F.coalesce("count", F.lit(0)).alias("rows"))
    return rows.orderBy("source_stage", "gap_type", "audit_id"), summary
