"""Evidence inventory: claims and chunks become atomic evidence and fragment records; what fails is kept with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmass.functions import text
from quillmass.operators import evidence

#: Scopes, roles and source structures of fragment evidence.
SCOPES = ("target_specific", "target_associated", "class_diagnostic", "component_specific", "reaction_associated", "unassigned_peak")
ROLES = ("explicit_target_diagnostic", "target_product_ion", "class_diagnostic", "reaction_supporting_fragment", "neutral_loss", "theoretical_catalog", "unassigned_peak")
STRUCTURES = ("narrative", "structured_table", "structured_identification_table", "supplementary_catalog", "unknown")
TRACED = ("exact", "normalized", "fuzzy", "structured")
DIAGNOSTIC = r"(?i)\b(?:diagnostic|characteristic|marker|signature)\b"
#: Words of statements that explain a fragment.
EXPLICIT_TERMS = ("diagnostic", "distinctive", "fingerprint", "essential fragment", "essential fragments", "identifying ion", "identifying ions", "identifying fragment", "identifying fragments")
MAPPING_TERMS = ("structural section", "structural sections", "structurally mapped", "matched with exclusive", "mapped with exclusive", "mapped to", "matched with", "core ions", "aglycone", "pyrimidine ring")
CLAIM_FIELDS = ("claim_id", "claim_type", "compound_class", "compound_name", "component_name", "precursor_name", "entity_id", "entity_class_id", "fragment_mz", "reported_fragments", "evidence_role", "specificity_scope", "source_structure", "claim_source", "ion_mode", "adduct", "assignment", "chunk_id", "source_chunk_ids", "evidence_quote", "traceability_status")


def complete_claims(claims: DataFrame) -> DataFrame:
    """Claims with every field of CLAIM_FIELDS as text; fields that a table lacks are null."""
    return claims.select(*[(F.col(c) if c in claims.columns else F.lit(None)).cast("string").alias(c) for c in CLAIM_FIELDS])


def evidence_type(kind: Column) -> Column:
    k = F.lower(text.clean_text(kind))
    return F.when(k.isin("fragment", "diagnostic_fragment"), "fragment").when(k == "reaction_template", "reaction").when(k == "entity_class_membership", "class_membership").when(k.isin("compound", "entity"), "entity").when(k == "", "other").otherwise(k)


def source_structure(structure: Column, claim_source: Column) -> Column:
    given, source = F.lower(text.clean_text(structure)), F.lower(text.clean_text(claim_source))
    return F.when(given.isin(*STRUCTURES), given).when(source.contains("structured") | source.contains("table"), "structured_table").otherwise("unknown")


def claim_entity_id(entity_id: Column, compound_class: Column, *names: Column) -> Column:
    """The given id, else a hash of class and name; empty without a name."""
    given = text.clean_text(entity_id)
    name = text.first_nonempty(*[text.clean_text(n) for n in names])
    payload = F.struct(F.lower(text.clean_text(compound_class)).alias("compound_class"), F.lower(name).alias("reported_name"))
    return F.when(given != "", given).when(name == "", "").otherwise(text.stable_json_id("entity", payload))


def fragment_role(requested: Column, scope_given: Column, kind: Column, quote: Column, entity_id: Column, structure: Column) -> Column:
    """struct(role, scope): what a fragment's wording and origin allow. Catalogues are diagnostic only where they say so."""
    asked = F.lower(text.clean_text(requested))
    given = F.lower(text.clean_text(scope_given))
    k = F.lower(text.clean_text(kind))
    scope = F.when(given.isin(*SCOPES), given).when(k == "diagnostic_fragment", "class_diagnostic").otherwise("unassigned_peak")
    stated = given != ""
    says = text.clean_text(quote).rlike(DIAGNOSTIC)
    known = F.coalesce(entity_id, F.lit("")) != ""

    def pair(role: str, where: Column | str) -> Column:
        return F.struct(F.lit(role).alias("role"), (F.lit(where) if isinstance(where, str) else where).alias("scope"))

    explicit = pair("explicit_target_diagnostic", "target_specific")
    product = pair("target_product_ion", "target_specific")
    of_class = pair("class_diagnostic", "class_diagnostic")
    none = pair("unassigned_peak", "unassigned_peak")
    catalog = pair("theoretical_catalog", F.when(known, "target_associated").otherwise("unassigned_peak"))
    tabled = F.when((asked == "explicit_target_diagnostic") & known & says, explicit)
    in_table = tabled.when((scope == "class_diagnostic") & says, of_class).otherwise(catalog)
    identified = tabled.when((asked == "target_product_ion") & known, product).when((scope == "class_diagnostic") & says, of_class).otherwise(catalog)
    return (
        F.when(structure == "structured_identification_table", identified)
        .when(structure.isin("structured_table", "supplementary_catalog"), in_table)
        .when(asked == "explicit_target_diagnostic", F.when(known & says, explicit).otherwise(of_class))
        .when(asked == "target_product_ion", F.when(known, product).otherwise(none))
        .when(asked == "class_diagnostic", of_class)
        .when(asked == "reaction_supporting_fragment", pair("reaction_supporting_fragment", "reaction_associated"))
        .when(asked == "neutral_loss", pair("neutral_loss", "reaction_associated"))
        .when(asked == "theoretical_catalog", catalog)
        .when(asked == "unassigned_peak", none)
        .when((scope == "class_diagnostic") | (k == "diagnostic_fragment"), F.when(known & says, explicit).otherwise(of_class))
        .when(scope.isin("component_specific", "reaction_associated"), pair("reaction_supporting_fragment", scope))
        .when(k == "neutral_loss", pair("neutral_loss", "reaction_associated"))
        .when((scope == "unassigned_peak") & stated, none)
        .when(known, product)
        .otherwise(none)
    )


def fragment_values(cell: Column) -> Column:
    """array of struct(mz, decimals): the first number that stands alone in each part of a cell; positive, each once."""
    parts = F.transform(F.split(F.coalesce(cell, F.lit("")), "[;,|]"), lambda p: F.regexp_extract(p, r"(?<![A-Za-z0-9])(\d{1,5}(?:\.\d+)?)(?![A-Za-z0-9])", 1))
    read = F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.struct(p.cast("double").alias("mz"), F.length(F.regexp_extract(p, r"\.(\d+)$", 1)).alias("decimals")))
    usable = F.filter(read, lambda r: r["mz"] > 0)
    return F.filter(usable, lambda r, i: ~F.exists(F.slice(usable, F.lit(1), i), lambda q: F.round(q["mz"], 9) == F.round(r["mz"], 9)))


#: How a text speaks of a polarity.
SPOKEN = {
    "positive": r"(?i)\bpositive\b.{0,30}\bion\s+mode\b|\bESI\s*\+|\[\s*M\s*\+\s*(?:H|Na|NH4)\s*\]\s*\+",
    "negative": r"(?i)\bnegative\b.{0,30}\bion\s+mode\b|\bESI\s*-|\[\s*M\s*(?:-\s*H|\+\s*HCOO)\s*\]\s*-",
}


def speaks_of(mode: str, content: Column) -> Column:
    """Whether a text speaks of a polarity."""
    return F.translate(text.clean_text(content), "−–—", "---").rlike(SPOKEN[mode])


def mode_words(content: Column) -> Column:
    """positive, negative or empty: the one polarity that a text speaks of."""
    up, down = speaks_of("positive", content), speaks_of("negative", content)
    return F.when(up & ~down, "positive").when(down & ~up, "negative").otherwise("")


def build_inventory(claims: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Evidence, fragments and rejections.

    ``chunks``: chunk_id, source_file, text (page, sheet_name, section, row_index may be missing). A claim is split
    into one evidence record for each cited chunk that holds its quote; its fragments take the polarity the claim
    states, else the one its chunks speak of, else the one its documents do.
    """
    place = [(F.col(c) if c in chunks.columns else F.lit(None)).alias(c) for c in ("page", "sheet_name", "section", "row_index")]
    held = chunks.select("chunk_id", "source_file", F.col("text").alias("chunk_text"), *place)
    c = complete_claims(claims).withColumn("quote", text.clean_text(F.col("evidence_quote")))
    ids = F.array_distinct(F.filter(F.concat(F.array(text.clean_text(F.col("chunk_id"))), text.split_values(F.col("source_chunk_ids"), ";,|")), lambda x: x != ""))
    c = c.withColumn("cited", ids)
    early = c.filter((F.col("quote") == "") | (F.size("cited") == 0)).select("claim_id", F.when(F.col("quote") == "", "missing_evidence_quote").otherwise("untraceable_evidence").alias("reason"), F.lit("").alias("chunk_id"), F.lit("").alias("detail"))
    each = c.filter((F.col("quote") != "") & (F.size("cited") > 0)).withColumn("cited_id", F.explode("cited")).join(held.withColumnRenamed("chunk_id", "cited_id"), "cited_id", "left")
    traced = F.lower(text.clean_text(F.col("traceability_status"))).isin(*TRACED)
    present = text.traceability_text(F.col("chunk_text")).contains(text.traceability_text(F.col("quote")))
    verdict = F.when(F.col("chunk_text").isNull(), "untraceable_evidence").when(~traced & ~present, "quote_not_in_chunk").otherwise("accepted")
    payload = F.struct(F.col("cited_id").alias("chunk_id"), "claim_id", F.col("quote").alias("evidence_quote"), evidence_type(F.col("claim_type")).alias("evidence_type"))
    judged = each.withColumn("verdict", verdict).withColumn("evidence_id", text.stable_json_id("evidence", payload))
    good = judged.filter("verdict = 'accepted'")
    records = good.select("evidence_id", evidence_type(F.col("claim_type")).alias("evidence_type"), text.clean_text(F.col("source_file")).alias("source_file"), F.col("cited_id").alias("chunk_id"), "page", "sheet_name", F.col("section").alias("table_id"), "row_index", F.col("quote").alias("evidence_quote"), text.first_nonempty(text.clean_text(F.col("claim_source")), F.lit("llm")).alias("extraction_method"), F.lit("accepted").alias("review_status")).dropDuplicates(["evidence_id"])
    # the polarity of cited chunks, and of their whole documents
    by_document = chunks.groupBy("source_file").agg(F.max(speaks_of("positive", F.col("text"))).alias("up"), F.max(speaks_of("negative", F.col("text"))).alias("down"))
    with_documents = good.join(by_document, "source_file", "left")

    def one(up: Column, down: Column) -> Column:
        return F.when(up & ~down, "positive").when(down & ~up, "negative")

    own = {m: F.max(speaks_of(m, F.col("chunk_text"))) for m in SPOKEN}
    spoken = with_documents.groupBy("claim_id").agg(F.coalesce(one(own["positive"], own["negative"]), one(F.max(F.coalesce("up", F.lit(False))), F.max(F.coalesce("down", F.lit(False)))), F.lit("not_reported")).alias("spoken_mode"), F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"))  # a claim's citations
    structure = source_structure(F.col("source_structure"), F.col("claim_source"))
    entity = claim_entity_id(F.col("entity_id"), F.col("compound_class"), F.col("compound_name"), F.col("component_name"), F.col("precursor_name"))
    rows = c.join(spoken, "claim_id").withColumn("entity", entity).withColumn("structure", structure)
    rows = rows.withColumn("decided", fragment_role(F.col("evidence_role"), F.col("specificity_scope"), F.col("claim_type"), F.col("quote"), F.col("entity"), F.col("structure")))
    cell = F.when(text.clean_text(F.col("fragment_mz")) != "", F.col("fragment_mz")).otherwise(F.col("reported_fragments"))
    rows = rows.withColumn("values", fragment_values(cell)).filter(F.size("values") > 0)
    stated = text.normalize_ion_mode(F.col("ion_mode"))
    flat = rows.select("claim_id", "entity", "structure", "decided", "evidence_ids", "adduct", "assignment", "entity_class_id", "evidence_role", F.when(stated != "", stated).otherwise(F.col("spoken_mode")).alias("mode"), F.explode("values").alias("value"))
    key = F.struct(text.clean_text(F.col("adduct")).alias("adduct"), text.clean_text(F.col("entity_class_id")).alias("entity_class_id"), F.col("entity").alias("entity_id"), "evidence_ids", F.col("decided.role").alias("evidence_role"), F.col("decided.scope").alias("evidence_scope"), F.round("value.mz", 9).alias("fragment_mz"), F.col("mode").alias("ion_mode"), F.col("structure").alias("source_structure"))
    fragments = flat.select(text.stable_json_id("fragment", key).alias("fragment_id"), F.col("entity").alias("entity_id"), text.clean_text(F.col("entity_class_id")).alias("entity_class_id"), F.col("value.mz").alias("fragment_mz"), F.col("value.decimals").alias("reported_precision"), F.col("mode").alias("ion_mode"), text.clean_text(F.col("assignment")).alias("assignment"), F.col("decided.scope").alias("evidence_scope"), F.col("decided.role").alias("evidence_role"), F.col("structure").alias("source_structure"), text.clean_text(F.col("adduct")).alias("adduct"), "evidence_ids")
    asked = F.lower(text.clean_text(F.col("evidence_role")))
    lowered = rows.filter((asked != "") & (asked != F.col("decided.role"))).select("claim_id", F.lit("fragment_role_downgraded").alias("reason"), F.lit("").alias("chunk_id"), F.concat(asked, F.lit("->"), "decided.role").alias("detail"))
    rejected = early.unionByName(judged.filter("verdict <> 'accepted'").select("claim_id", F.col("verdict").alias("reason"), F.col("cited_id").alias("chunk_id"), F.lit("").alias("detail"))).unionByName(lowered)
    return records, fragments.dropDuplicates(["fragment_id"]), rejected


def diagnostic_type(content: Column) -> Column:
    """explicit_diagnostic, structural_mapping or empty, by the words of a text."""
    low = F.lower(F.coalesce(content, F.lit("")))

    def any_of(terms: tuple[str, ...]) -> Column:
        return F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: low.contains(t))

    return F.when(any_of(EXPLICIT_TERMS), "explicit_diagnostic").when(any_of(MAPPING_TERMS), "structural_mapping").otherwise("")


def statement_windows(content: Column, width: int = 700) -> Column:
    """array of texts around each explaining word, half the width on both sides; those that overlap are one."""
    terms = sorted((*EXPLICIT_TERMS, *MAPPING_TERMS), key=len, reverse=True)
    low, half = F.lower(content), width // 2

    def spans_of(term: str) -> Column:
        # a term's places: the lengths of what stands before each of its occurrences
        pieces = F.split(low, "\\Q" + term + "\\E")
        counts = F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1)))
        at = F.transform(counts, lambda i: F.aggregate(F.slice(pieces, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x)) + (i - 1) * len(term))
        found = F.transform(at, lambda x: F.struct(F.greatest(x - half, F.lit(0)).alias("a"), F.least(x + len(term) + half, F.length(content)).alias("b")))
        return F.when(F.size(pieces) > 1, found).otherwise(F.array().cast("array<struct<a:int,b:int>>"))

    spans = [spans_of(t) for t in terms]
    ordered = F.array_sort(F.concat(*spans))
    merged = F.aggregate(
        ordered,
        F.array().cast("array<struct<a:int,b:int>>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["b"] >= s["a"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], s["b"]).alias("b"))))).otherwise(F.concat(acc, F.array(s))),
    )
    return F.transform(merged, lambda s: F.substr(content, s["a"] + 1, s["b"] - s["a"]))


def quote_around(content: Column, mz: Column, width: int = 500) -> Column:
    """The text around the first place of an m/z, half the width on both sides; from the start if it does not occur."""
    at = F.greatest(F.call_function("instr", content, mz) - 1, F.lit(0))
    start = F.greatest(at - width // 2, F.lit(0))
    return text.clean_text(F.substr(content, start + 1, at + width // 2 - start))


def mine_diagnostics(chunks: DataFrame, compound_class: str, subclasses: dict[str, str] | None = None, low: float = 100.0, high: float = 450.0) -> DataFrame:
    """Diagnostic fragment claims: the m/z values near explaining words, merged by (subclass, m/z, type).

    ``subclasses``: name -> pattern. Chunks: chunk_id, source_file, text. Evidence ids and sources are united.
    """
    rows = chunks.select("chunk_id", "source_file", text.clean_text(F.col("text")).alias("t")).withColumn("kind", diagnostic_type(F.col("t"))).filter("kind <> ''")
    each = rows.withColumn("w", F.explode(statement_windows(F.col("t"))))
    low_t, low_w = F.lower("t"), F.lower("w")

    def sub(c: Column) -> Column:
        return F.array_join(F.filter(F.array(*[F.when(c.rlike(p), n) for n, p in (subclasses or {"": "$^"}).items()]), lambda x: x.isNotNull()), "; ")

    marked = F.regexp_extract_all("w", F.lit(r"(?i)m/z\s*(?:with\s*)?([0-9]{2,4}\.[0-9]{1,4})"), F.lit(1))
    plain = F.regexp_extract_all("w", F.lit(r"\b([0-9]{2,4}\.[0-9]{2})\b"), F.lit(1))
    values = F.array_distinct(F.transform(F.filter(F.transform(F.concat(marked, plain), lambda x: x.cast("double")), lambda x: (x >= low) & (x <= high)), lambda x: text.format_number(x, 2)))
    found = each.withColumn("subclass", text.first_nonempty(sub(low_w), sub(low_t))).withColumn("fragment_mz", F.explode(values))
    merged = found.groupBy(F.lower("subclass").alias("subclass"), "fragment_mz", F.col("kind").alias("diagnostic_evidence_type")).agg(F.array_sort(F.collect_set("chunk_id")).alias("evidence_ids"), F.array_sort(F.collect_set("source_file")).alias("source_files"))
    score = F.when(F.col("diagnostic_evidence_type") == "explicit_diagnostic", 0.85).otherwise(0.75)
    key = text.stable_id("claim_diag", F.lit(compound_class), F.col("subclass"), F.col("fragment_mz"), F.col("diagnostic_evidence_type"), F.get("evidence_ids", F.lit(0)))
    return merged.select(key.alias("claim_id"), F.lit("diagnostic_fragment").alias("claim_type"), F.lit(compound_class).alias("compound_class"), "*", score.alias("confidence"))


def polarity_specificity(fragments: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Fragments of an inventory with their sharing among entities."""
    return evidence.specificity(fragments, tolerance)
