"""Verdicts on extracted claims: domain guards, critic decisions, recovered losses, prevalidated rows. One row each, never lost."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmass.functions import text

#: Fields of a claim that may speak of its domain.
DOMAIN_FIELDS = ("compound_name", "precursor_name", "component_name", "entity_name", "entity_id", "entity_class_id", "source_entity", "target_entity", "reaction_name", "evidence_quote", "evidence_summary")
VERDICTS = ("accept", "review", "reject")


def ascii_words(c: Column) -> Column:
    """Lower-case letters and digits, single blanks between."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def looks_like_ion(c: Column) -> Column:
    """Whether an endpoint is an ion or a bare mass, not an entity."""
    value = F.coalesce(c, F.lit(""))
    return value.rlike(r"(?i)\[\s*M[^\]]*\][+-]?|\bm\s*/\s*z\b") | value.rlike(r"^\s*\d+(?:\.\d+)?\s*(?:Da)?\s*$")


def _field(claims: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in claims.columns else F.lit("")


def domain_guard(claims: DataFrame, compound_class: str, concepts: DataFrame) -> DataFrame:
    """Adds verdict (pass or reject), reason_code and domain_terms: endpoints must be entities, some term must occur.

    ``concepts``: name, type. The terms of one class are few; they are gathered with their distinct words first.
    """
    terms = concepts.select(ascii_words(F.col("name")).alias("term")).unionByName(concepts.sparkSession.createDataFrame([(compound_class,)], "n string").select(ascii_words(F.col("n")).alias("term")))
    listed = terms.filter(F.length("term") >= 3).distinct().agg(F.array_sort(F.collect_set("term")).alias("_terms"))  # one row
    rows = claims.crossJoin(F.broadcast(listed))
    kind = _field(claims, "claim_type")
    blank = {n: text.normalize_space(_field(claims, n)) == "" for n in ("source_entity", "target_entity", "entity_id", "entity_name", "component_name")}
    shape = (
        F.when((kind == "transformation") & (blank["source_entity"] | blank["target_entity"]), "missing_transformation_endpoint")
        .when((kind == "transformation") & (looks_like_ion(_field(claims, "source_entity")) | looks_like_ion(_field(claims, "target_entity"))), "msms_fragmentation_not_entity_transformation")
        .when(kind.isin("entity_class_membership", "entity_component_membership") & blank["entity_id"] & blank["entity_name"], "missing_membership_entity")
        .when((kind == "entity_component_membership") & blank["component_name"], "missing_component_entity")
        .otherwise("")
    )
    haystack = ascii_words(F.concat_ws(" ", *[_field(claims, f) for f in DOMAIN_FIELDS]))
    rows = rows.withColumn("_shape", shape).withColumn("_hay", haystack).withColumn("domain_terms", F.when(F.col("_shape") == "", F.filter("_terms", lambda t: F.col("_hay").contains(t))).otherwise(F.array().cast("array<string>")))
    reason = F.when(F.col("_shape") != "", F.col("_shape")).when(F.size("domain_terms") == 0, "domain_relevance_not_established").otherwise("")
    return rows.withColumn("reason_code", reason).withColumn("verdict", F.when(F.col("reason_code") == "", "pass").otherwise("reject")).drop("_shape", "_hay", "_terms")


def critic_decisions(claims: DataFrame, decisions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds semantic_verdict, final_verdict, traceable, support_type and reason_codes.

    ``decisions``: claim_id, verdict, support_type, reason_codes (array); of several the last in ``ord`` counts. An
    unknown or missing verdict is a review. A quote that none of its chunks, nor all of them joined, holds is
    rejected, or reviewed where nobody decided. ``claims`` have claim_id, evidence_quote, source_chunk_ids (array).
    """
    last = decisions.groupBy("claim_id").agg(F.max_by(F.struct("verdict", "support_type", "reason_codes"), "ord").alias("_d"))
    cited = claims.select("claim_id", F.posexplode("source_chunk_ids").alias("_n", "chunk_id")).join(chunks.select("chunk_id", text.traceability_text(F.col("text")).alias("_t")), "chunk_id")
    held = cited.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("_n", "_t"))).alias("_c"))  # a claim's citations
    rows = claims.join(last, "claim_id", "left").join(held, "claim_id", "left")
    quote = text.traceability_text(F.col("evidence_quote"))
    texts = F.transform("_c", lambda c: c["_t"])
    traceable = F.coalesce((quote != "") & (F.exists(texts, lambda t: t.contains(quote)) | F.array_join(texts, " ").contains(quote)), F.lit(False))
    given = F.lower(F.coalesce(F.col("_d.verdict"), F.lit("review")))
    semantic = F.when(given.isin(*VERDICTS), given).otherwise("review")
    rows = rows.withColumn("traceable", traceable).withColumn("semantic_verdict", semantic)
    final = F.when(F.col("traceable"), F.col("semantic_verdict")).when(F.col("_d").isNotNull(), "reject").otherwise("review")
    reasons = F.concat(F.coalesce("_d.reason_codes", F.array().cast("array<string>")), F.when(F.col("traceable"), F.array().cast("array<string>")).otherwise(F.array(F.lit("untraceable_evidence_quote"))))
    return rows.withColumn("final_verdict", final).withColumn("support_type", F.coalesce("_d.support_type", F.lit("not_assessed"))).withColumn("reason_codes", F.array_sort(F.array_distinct(F.filter(reasons, lambda r: r != "")))).drop("_d", "_c")


def recover_losses(rejected: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Adds verdict (recover or reject), source_ion_mz and product_ion_mz: losses whose quote balances product = source - loss.

    ``rejected``: claim_type, traceable, evidence_quote, neutral_loss_mass (text).
    """
    shape = r"(?i)m\s*/\s*z\s*(\d+(?:\.\d+)?)\s*=\s*(\d+(?:\.\d+)?)\s*[-−–]\s*(\d+(?:\.\d+)?)"
    product, source, loss = (F.regexp_extract(F.coalesce(F.col("evidence_quote"), F.lit("")), shape, i) for i in (1, 2, 3))
    p, s, q = (c.try_cast("double") for c in (product, source, loss))
    stated = F.col("neutral_loss_mass").cast("string").try_cast("double")
    balanced = (F.abs(s - p - q) <= tolerance) & (F.abs(stated - q) <= tolerance)
    fine = F.coalesce((F.col("claim_type") == "neutral_loss") & F.col("traceable") & balanced, F.lit(False))
    return rejected.withColumn("verdict", F.when(fine, "recover").otherwise("reject")).withColumn("source_ion_mz", F.when(fine, source)).withColumn("product_ion_mz", F.when(fine, product))


#: How a table's label is printed.
TABLE_LABEL = r"(?i)\b(?:continue\s+)?table\s+([A-Za-z]*\d+[A-Za-z]*)\s*(?:\.|:)"


def table_scopes(pages: DataFrame) -> DataFrame:
    """source_file, page, table_label: the first label on a page, else that of the page before, if it follows at once.

    ``pages``: source_file, page, page_text. A page that is missing ends a run, and a run's first unlabelled pages have none.
    """
    label = F.lower(F.regexp_extract("page_text", TABLE_LABEL, 1))
    rows = pages.select("source_file", "page", label.alias("own"))
    of_source = Window.partitionBy("source_file").orderBy("page")
    runs = rows.withColumn("run", F.col("page") - F.row_number().over(of_source))
    carried = F.last(F.nullif("own", F.lit("")), ignorenulls=True).over(Window.partitionBy("source_file", "run").orderBy("page").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return runs.select("source_file", "page", F.coalesce(carried, F.lit("")).alias("table_label"))


def _has_term(content: Column, terms: Column) -> Column:
    words = ascii_words(content)
    return F.exists(terms, lambda t: words.contains(t))


def relevant_tables(pages: DataFrame, terms: Column) -> DataFrame:
    """source_file, table_label of tables whose caption (up to the next label, or 1000 characters) has a term, or whose page has and no other table."""
    labels = F.transform(F.regexp_extract_all("page_text", F.lit(TABLE_LABEL), F.lit(1)), lambda x: F.lower(x))
    rows = pages.withColumn("labels", labels).filter(F.size("labels") > 0)
    # what stands behind each label, up to the next one
    parts = F.slice(F.split("page_text", TABLE_LABEL), 2, 1 << 20)
    each = rows.select("source_file", "page_text", "labels", F.posexplode(F.arrays_zip(F.col("labels").alias("l"), parts.alias("t"))).alias("n", "p"))
    caption = F.when(F.col("n") + 1 == F.size("labels"), F.substring("p.t", 1, 1000)).otherwise(F.col("p.t"))
    named = each.filter(_has_term(F.concat_ws(" ", F.lit("table"), F.col("p.l"), caption), terms)).select("source_file", F.col("p.l").alias("table_label"))
    alone = rows.filter((F.size(F.array_distinct("labels")) == 1) & _has_term(F.col("page_text"), terms)).select("source_file", F.col("labels")[0].alias("table_label"))
    return named.unionByName(alone).distinct()


def table_guard(claims: DataFrame, pages: DataFrame, compound_class: str, concepts: DataFrame) -> DataFrame:
    """Adds table_scope, page_relevant, table_relevant, entity_relevant, verdict and reason_code: rows of tables of other domains are rejected.

    A row stays if its table, or its page outside of tables, names the class or a subclass, or its entity any known
    compound. ``concepts``: name, type; their terms (of four letters or more) are few and gathered first.
    """
    spark = claims.sparkSession
    given = concepts.select(ascii_words(F.col("name")).alias("term"), F.col("type").alias("kind")).unionByName(spark.createDataFrame([(compound_class,)], "n string").select(ascii_words(F.col("n")).alias("term"), F.lit("subclass").alias("kind")))
    terms = [(r.term, r.kind) for r in given.filter((F.length("term") >= 4) & F.col("kind").isin("subclass", "compound", "synonym")).distinct().collect()]
    scope = F.array(*[F.lit(t) for t in sorted({t for t, k in terms if k == "subclass"})]).cast("array<string>")
    every = F.array(*[F.lit(t) for t in sorted({t for t, _ in terms})]).cast("array<string>")
    labels = table_scopes(pages)
    page_hits = pages.select("source_file", "page", _has_term(F.col("page_text"), scope).alias("page_has"))
    fitting = relevant_tables(pages, scope).withColumn("table_has", F.lit(True))
    rows = claims.join(labels, ["source_file", "page"], "left").join(page_hits, ["source_file", "page"], "left").join(fitting, ["source_file", "table_label"], "left")
    label = F.coalesce("table_label", F.lit(""))
    who = F.concat_ws(" ", *[_field(claims, c) for c in ("compound_name", "entity_name", "component_name", "evidence_quote")])
    rows = rows.withColumn("page_relevant", (label == "") & F.coalesce("page_has", F.lit(False))).withColumn("table_relevant", (label != "") & F.coalesce("table_has", F.lit(False))).withColumn("entity_relevant", _has_term(who, every))
    fine = F.col("page_relevant") | F.col("table_relevant") | F.col("entity_relevant")
    out = rows.withColumn("table_scope", label).withColumn("verdict", F.when(fine, "pass").otherwise("reject")).withColumn("reason_code", F.when(fine, "").otherwise("structured_domain_scope_not_established"))
    return out.select(*claims.columns, "table_scope", "page_relevant", "table_relevant", "entity_relevant", "verdict", "reason_code")


def longest_common(a: Column, b: Column) -> Column:
    """The length of the longest text that both hold."""

    @F.pandas_udf("int")
    def longest(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p or "", q or "").find_longest_match().size for p, q in zip(x, y, strict=True)], dtype="int32")

    return longest(a, b)


def name_encoded_relations(rejected: DataFrame, concepts: DataFrame) -> DataFrame:
    """Adds verdict (recover or reject), modifier_similarity and source_evidence_basis to rejected transformations.

    A relation that only names state is recovered, as an inference: the target's name holds the source's and a modifier
    that shares six letters in a row with the transformation's name, and the target's words stand in a traceable quote.
    ``rejected``: claim_type, traceable, source_entity, target_entity, transformation_name, evidence_quote.
    """
    source, target, change, quote = (ascii_words(_field(rejected, c)) for c in ("source_entity", "target_entity", "transformation_name", "evidence_quote"))
    known = concepts.filter(F.col("type").isin("compound", "synonym")).select(ascii_words(F.col("name")).alias("_term")).filter("_term <> ''").distinct().withColumn("_known", F.lit(True))
    rows = rejected.withColumns({"_source": source, "_target": target, "_change": change, "_quote": quote})
    at = F.call_function("instr", F.col("_target"), F.col("_source"))
    modifier = F.when((F.col("_source") != "") & (at > 0), F.btrim(F.concat(F.substr(F.col("_target"), F.lit(1), at - 1), F.lit(" "), F.substr(F.col("_target"), at + F.length("_source"))))).otherwise("")
    rows = rows.withColumn("modifier_similarity", longest_common(F.col("_change"), modifier)).join(known, F.col("_source") == F.col("_term"), "left")
    words = F.filter(F.split("_target", " "), lambda w: F.length(w) >= 2)
    held = F.split("_quote", " ")
    fine = (
        (_field(rejected, "claim_type") == "transformation")
        & F.coalesce(F.col("traceable"), F.lit(False))
        & (at > 0)
        & (F.col("_source") != F.col("_target"))
        & (F.size(words) > 0)
        & (F.size(F.array_except(words, held)) == 0)
        & (F.col("modifier_similarity") >= 6)
        & ~looks_like_ion(_field(rejected, "source_entity"))
        & ~looks_like_ion(_field(rejected, "target_entity"))
    )
    basis = F.when(F.col("_known"), "discovered_concept").otherwise("target_name_substring")
    return rows.withColumn("verdict", F.when(fine, "recover").otherwise("reject")).withColumn("source_evidence_basis", basis).drop("_source", "_target", "_change", "_quote", "_term", "_known")


def prevalidated(claims: DataFrame) -> DataFrame:
    """Adds critic_status and reason_code: rows that the table parser located are accepted, others reviewed."""
    located = F.coalesce(F.col("traceability_status"), F.lit("")) == "structured"
    return claims.withColumn("critic_status", F.when(located, "accept").otherwise("review")).withColumn("reason_code", F.when(located, "deterministic_structured_parser").otherwise("structured_traceability_missing"))


def relation_hits(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Direct hits of relation-bearing query groups; all direct hits where there is none of these."""
    direct = rows.filter(F.coalesce(text.nonempty(F.col("retrieval_origin")), F.lit("direct_hit")) == "direct_hit")
    some = direct.agg(F.coalesce(F.max(F.col("query_group").isin(*groups)), F.lit(False)).alias("_some"))  # one row
    return direct.crossJoin(F.broadcast(some)).filter(~F.col("_some") | F.col("query_group").isin(*groups)).drop("_some")
