"""The stages of a run, from literature files to an annotated network. Each reads and writes folders and returns counts.

Stages are functions of a session and paths; ``python -m quillmass`` calls them, and ``run_all`` chains them, leaving out
what its record shows to be up to date.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmass.functions import text
from quillmass.operators import evidence, guards, inventory, network, references, registry, retrieval, rules, tables, windows
from quillmass.operators import spectra as matching
from quillmass.operators.storage import cut, stored
from quillmass.sources import bundle, documents, extraction, knowledge
from quillmass.sources import spectra as files

MODES = ("positive", "negative")


def safe_stem(name: str) -> str:
    """A name as a file's stem: lower case, other characters as underscores."""
    import re

    return re.sub(r"[^A-Za-z0-9._-]+", "_", name.strip().lower()).strip("_") or "compound_class"


def matching_paths(spark: SparkSession, patterns: list[str]) -> list[str]:
    """The files that glob patterns name, each once, sorted; a pattern that names none is an error."""
    found: set[str] = set()
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    for pattern in patterns:
        where = jvm.org.apache.hadoop.fs.Path(pattern)
        hits = where.getFileSystem(jsc.hadoopConfiguration()).globStatus(where)
        if not hits:
            raise FileNotFoundError(pattern)
        found |= {h.getPath().toString() for h in hits}
    return sorted(found)


def require_one(spark: SparkSession, patterns: list[str]) -> str:
    """The one file that patterns name."""
    found = matching_paths(spark, patterns)
    if len(found) != 1:
        raise ValueError(f"{patterns} name {len(found)} files, not one")
    return found[0]


def summary(path: str, **counts: Any) -> dict[str, Any]:
    bundle.write_json(path, counts)
    return counts


# ---- literature


def prepare_corpus(spark: SparkSession, folder: str, out: str, size: int = 1200, overlap: int = 200) -> dict[str, Any]:
    report = documents.write_corpus(spark, folder, out, size, overlap)
    row = report.agg(F.count("*").alias("files"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"), F.count_if(F.col("parse_status") != "success").alias("failed")).first()
    return summary(f"{out}/corpus.json", **row.asDict())


CHUNK = "chunk_id string, source_file string, file_type string, page int, sheet_name string, row_index int, section string, text string, char_start int, char_end int"


def read_chunks(spark: SparkSession, corpus: str) -> DataFrame:
    return spark.read.schema(CHUNK).json(f"{corpus}/chunks")


def build_index(spark: SparkSession, corpus: str, out: str) -> dict[str, Any]:
    return retrieval.save_index(read_chunks(spark, corpus), out)


def search(spark: SparkSession, index: str, queries: list[str], out: str, top_k: int = 12) -> dict[str, Any]:
    """Hits of each query with their place and a preview."""
    held = retrieval.load_index(spark, index)
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    hits = retrieval.search_index(held, asked, top_k).join(held["documents"], "chunk_id").join(F.broadcast(asked), "query_id")
    page = F.when(F.col("page").isNotNull(), F.concat(F.lit("page "), "page")).when(F.col("row_index").isNotNull(), F.concat_ws(" ", F.col("sheet_name"), F.lit("row"), F.col("row_index").cast("string")))
    shown = hits.select("query", "rank", "score", "chunk_id", F.concat_ws(", ", "source_file", page).alias("place"), "section", text.preview(F.col("text")).alias("preview"))
    bundle.write_table(shown.orderBy("query", "rank"), out, "json")
    return {"queries": len(queries), "hits": spark.read.json(out).count() if shown.limit(1).count() else 0}


def plan(spark: SparkSession, compound_class: str, out: str, chat: extraction.Chat | None = None, purposes: list[str] = (), ion_modes: list[str] = MODES, seeds: list[str] = ()) -> dict[str, Any]:
    """A query plan by a model, or the general one without it."""
    made = extraction.build_plan(chat, compound_class, purposes, ion_modes, seeds) if chat else retrieval.normalized_plan(retrieval.generic_plan(compound_class), compound_class)
    bundle.write_json(out, made)
    return made


def hit_units(chunks: DataFrame) -> DataFrame:
    """source, position, content: chunks in their order within a source, as units of windows."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("source_file").orderBy(F.coalesce("page", F.lit(0)), F.coalesce("sheet_name", F.lit("")), F.coalesce("row_index", F.lit(0)), F.coalesce("char_start", F.lit(0)), "chunk_id")
    return chunks.withColumn("position", F.row_number().over(order)).select(F.col("source_file").alias("source"), "position", F.col("text").alias("content"), "chunk_id")


def mine_literature(spark: SparkSession, corpus: str, plan_path: str, out: str, chat: extraction.Chat | None = None, top_k: int = 12, most_chunks: int = 40, most_chars: int = 1800, most_queries: int = 60, most_windows: int = 24) -> dict[str, Any]:
    """Claims from tables, and with a model from retrieved chunks and document windows, criticized and merged.

    Two rounds of retrieval: by the plan, then by the concepts that were found.
    """
    made = bundle.read_json(plan_path)
    name = made["compound_class"]
    chunks = stored(read_chunks(spark, corpus), "chunks")
    first = cut(retrieval.retrieve(chunks, retrieval.plan_queries(spark, made), top_k))
    mined, members = tables.mine_tables(chunks, name)
    rows = [mined.withColumn("ord", F.to_json("ord")), members.withColumn("ord", F.to_json("ord")).withColumn("component_count", F.col("component_count").cast("string"))]
    accepted = rejected = 0
    concepts = None
    hits = first
    if chat is not None:
        concepts = cut(extraction.discover_concepts(_with_text(retrieval.prompt_chunks(first, most_chunks, most_chars), chunks), chat, name))
        more = retrieval.concept_queries(concepts.filter("verdict = 'accepted'").withColumn("ord", F.xxhash64(F.to_json("ord"))), most_queries)
        more = more.select(F.row_number().over(_one("ord")).alias("ord"), "query_group", "query")
        hits = cut(first.unionByName(retrieval.retrieve(chunks, more, top_k)))
        found = [extraction.extract_claims(_with_text(retrieval.prompt_chunks(hits, most_chunks, most_chars), chunks), chat, name)]
        units = cut(hit_units(chunks))
        scored = guards.relation_hits(hits.withColumn("retrieval_origin", F.lit("direct_hit")), list(retrieval.RELATION_GROUPS)).join(units, "chunk_id").select("source", "position", "score")
        made_windows = windows.document_windows(units.drop("chunk_id"), scored)
        picked = windows.pick_windows(made_windows.withColumn("signal", retrieval.relation_signal(F.col("window_text"))), most_windows)
        keyed = picked.withColumn("window_id", text.stable_id("docwin", F.col("source"), F.col("first_position").cast("string"), F.col("part").cast("string")))
        held = keyed.join(units.select("source", "position", "chunk_id"), "source").filter(F.col("position").between(F.col("first_position"), F.col("last_position")))
        of = held.groupBy("window_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("source_chunk_ids"))  # a window's chunks
        found.append(extraction.extract_relations(keyed.join(of, "window_id").select("window_id", F.col("source").alias("source_file"), F.col("window_text").alias("text"), "source_chunk_ids"), chat, name).drop("source_file"))
        said = cut(found[0].withColumn("ord", F.to_json("ord")).unionByName(found[1].withColumn("ord", F.to_json("ord")), allowMissingColumns=True))
        judged = cut(guards.critic_decisions(said, extraction.critic_decisions(said, chat, name), chunks))
        accepted, rejected = judged.filter("final_verdict <> 'reject'").count(), judged.filter("final_verdict = 'reject'").count()
        rows.append(judged.filter("final_verdict <> 'reject'").select(*said.columns))
        bundle.write_table(concepts.withColumn("ord", F.to_json("ord")), f"{out}/concepts", "json")
    claims = rows[0]
    for r in rows[1:]:
        shared = set(claims.columns) & set(r.columns)
        claims, r = (df.withColumns({c: F.col(c).cast("string") for c in shared if c != "source_chunk_ids"}) for df in (claims, r))
        claims = claims.unionByName(r, allowMissingColumns=True)
    bundle.write_table(claims.drop("ord"), f"{out}/claims", "json")
    bundle.write_table(hits.drop("text"), f"{out}/retrieval", "json")
    state = retrieval.retrieval_state(hits).first()
    return summary(f"{out}/mining.json", compound_class=name, claims=spark.read.json(f"{out}/claims").count(), accepted=accepted, rejected=rejected, concepts=0 if concepts is None else concepts.count(), **state.asDict())


def _one(order: str):
    from pyspark.sql.window import Window

    return Window.orderBy(order)  # over the few queries of concepts


def _with_text(shown: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks of a prompt with the shortened text that it shows."""
    return shown.select("chunk_id", "text").join(chunks.select("chunk_id", "source_file", "page"), "chunk_id")


def read_claims(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.json(f"{folder}/claims").withColumn("ord", F.monotonically_increasing_id())


def mine_diagnostics(spark: SparkSession, corpus: str, compound_class: str, out: str, subclasses: dict[str, str] | None = None) -> dict[str, Any]:
    """Diagnostic fragment claims, and counts of chunks by their kind."""
    chunks = read_chunks(spark, corpus)
    mined = cut(inventory.mine_diagnostics(chunks, compound_class, subclasses))
    bundle.write_table(mined, f"{out}/diagnostics", "json")
    kinds = chunks.select(F.when(text.clean_text(F.col("text")) == "", "empty_text").otherwise(inventory.diagnostic_type(F.col("text"))).alias("k")).groupBy("k").count().collect()
    return summary(f"{out}/diagnostics.json", claims=mined.count(), chunks={r.k or "no_diagnostic_evidence_type": r["count"] for r in kinds})


def infer(spark: SparkSession, claims_folder: str, out: str) -> dict[str, Any]:
    """Transformation claims between compounds whose masses differ by a general transformation, and the unions with theirs."""
    found = cut(evidence.infer_transformations(references.compound_candidates(read_claims(spark, claims_folder))))
    bundle.write_table(found, f"{out}/inferred", "json")
    return summary(f"{out}/inferred.json", inferred=found.count())


# ---- rules


def compile_rules(spark: SparkSession, claims_folder: str, corpus: str, out: str, compound_class: str = "", least_compounds: int = 20, least_fraction: float = 0.2, most: int = 20) -> dict[str, Any]:
    """A bundle of rule tables and artifacts from claims: inventory, registry, tables, references, and what was left out."""
    claims = cut(read_claims(spark, claims_folder))
    chunks = read_chunks(spark, corpus)
    concepts_path = f"{claims_folder}/concepts"
    concepts = spark.read.json(concepts_path).withColumn("ord", F.monotonically_increasing_id()) if bundle.exists(f"{concepts_path}/_SUCCESS") else None
    records, fragments, rejected = inventory.build_inventory(claims, chunks)
    records, fragments = cut(records), cut(fragments)
    made = references.build_registry(claims, records)
    fragments = fragments.withColumn("specificity_scope", F.col("evidence_scope"))
    mended, mended_counts = references.reconciled_fragments(fragments, claims, made["entities"], made["classes"])
    judged = evidence.specificity(mended).withColumnRenamed("competitor_count", "competitor_entity_count").withColumnRenamed("status", "discriminative_status")
    frames = rules.compile_tables(claims, concepts, compound_class, least_compounds, least_fraction, most)
    entities = made["entities"]
    named = lambda df, name, preferred, result: references.resolve_names(df.withColumn("_name", F.col(name)).withColumn("_given", F.col(preferred) if preferred in df.columns else F.lit("")), entities, "_name", "_given", "formula" if "formula" in df.columns else "_none", "exact_mass" if "exact_mass" in df.columns else "_none", result).drop("_name", "_given")
    compounds = named(frames["compound"], "compound_name", "entity_id", "_id")
    compounds = compounds.withColumn("entity_id", text.first_nonempty(F.col("_id"), F.col("entity_id"))).drop("_id")
    changes = frames["transformation"]
    for side in ("source", "target"):
        changes = named(changes, f"{side}_entity", f"{side}_entity_id", "_id").withColumn(f"{side}_entity_id", F.col("_id")).drop("_id")
    changes = rules.unary_reactions(changes, entities, made["forms"])
    bundle_tables = {"compound_rules": compounds, "transformation_rules": changes, "diagnostic_fragment_rules": frames["diagnostic_fragment"], "neutral_loss_rules": frames["neutral_loss"], "biosynthetic_component_rules": frames["biosynthetic_component"]}
    artifacts = {"entity_registry": entities, "entity_forms": made["forms"], "entity_classes": made["classes"], "entity_class_memberships": made["memberships"], "evidence_inventory": records, "fragment_evidence": judged}
    manifest = bundle.write_bundle(out, {k: cut(v) for k, v in bundle_tables.items()}, {k: cut(v) for k, v in artifacts.items()})
    gaps = {
        "inventory": rejected.select(F.col("reason").alias("gap_type"), F.lit("rejected").alias("terminal_status"), F.coalesce("claim_id", F.lit("")).alias("subject"), F.coalesce("detail", F.lit("")).alias("detail")),
        "registry": made["audits"].select(F.col("reason").alias("gap_type"), F.when(F.col("status").isin(*registry.GAP_STATUSES), F.col("status")).otherwise("unresolved").alias("terminal_status"), F.coalesce("record_id", F.lit("")).alias("subject"), F.col("record_type").alias("detail")),
    }
    audit, statuses = registry.gap_audit(gaps)
    bundle.write_table(audit, f"{out}/gap_audit", "json")
    bundle.write_table(rules.warnings(claims), f"{out}/warnings", "json")
    counts = {k: int(v or 0) for k, v in (rules.compilation_counts(claims, concepts).first().asDict() | mended_counts.first().asDict()).items()}
    return summary(f"{out}/compilation.json", rows={k: v["row_count"] for k, v in (manifest["tables"] | manifest["artifacts"]).items()}, gaps={r.terminal_status: r.rows for r in statuses.collect()}, **counts)


# ---- spectra


def match(spark: SparkSession, table: str, spectra: str, libraries: list[str], mode: str, out: str, config: matching.MatchConfig = matching.MatchConfig(), seed: int = 42, most_queries: int = 0) -> dict[str, Any]:
    """Features with their spectra against libraries: hits, accepted matches, and the audit of features."""
    queries, audit = files.link_features(files.read_feature_table(spark, table), files.read_mgf(spark, spectra), mode)
    queries = queries.orderBy("query_id").limit(most_queries) if most_queries else queries
    queries = cut(queries)
    library = _library(spark, libraries)
    hits, accepted, near = (cut(df) for df in matching.run_match(queries, library, config, seed))
    for name, df in (("queries", queries), ("hits", hits), ("accepted", accepted), ("candidates", near), ("feature_audit", audit)):
        df.write.mode("overwrite").parquet(f"{out}/{name}")
    return summary(f"{out}/match.json", queries=queries.count(), hits=hits.count(), accepted=accepted.filter("accepted").count())


def _library(spark: SparkSession, patterns: list[str]) -> DataFrame:
    out = None
    for path in matching_paths(spark, patterns):
        rows = files.read_msp(spark, path).filter(F.col("ion_mode").isin(*MODES))
        out = rows if out is None else out.unionByName(rows)
    return out


def annotate(spark: SparkSession, match_folder: str, rule_folder: str, out: str, config: network.NetworkConfig = network.NetworkConfig()) -> dict[str, Any]:
    """The network over matched features and the rules of a bundle."""
    known = {k: cut(v) for k, v in knowledge.load_knowledge(bundle.read_bundle(spark, rule_folder)).items()}
    queries, near = (spark.read.parquet(f"{match_folder}/{n}") for n in ("queries", "candidates"))
    seeds, resolution = knowledge.resolve_seeds(near.select(F.col("query_id").alias("node_id"), F.col("name_clean").alias("name")).distinct(), known["entities"], known["rules"])
    nodes = queries.select(F.col("query_id").alias("node_id"), "precursor_mz", "ion_mode", "peaks")
    decisions, hypotheses, edges = network.expand(nodes, cut(seeds), *[known[k] for k in ("entities", "rules", "fragments", "diagnostics")], config)
    decisions = cut(decisions)
    for name, df in (("decisions", decisions), ("hypotheses", hypotheses), ("edges", edges), ("seeds", resolution)):
        df.write.mode("overwrite").parquet(f"{out}/{name}")
    return summary(f"{out}/network.json", decisions=decisions.count(), seeds=seeds.count())


# ---- runs


def frozen(rows: DataFrame, out: str) -> str:
    """Claims written once, in an order of their own, with their digest: later stages read what was decided on."""
    names = sorted(c for c in rows.columns if c != "ord")
    kept = rows.select(*names)
    kept.write.mode("overwrite").json(f"{out}/claims", ignoreNullFields=False)
    found = retrieval.corpus_digest(kept.select(*[F.col(c).cast("string") if not dict(kept.dtypes)[c].startswith(("array", "struct", "map")) else F.to_json(c).alias(c) for c in names]))
    bundle.write_json(f"{out}/claims.json", {"digest": found, "columns": names})
    return found


def run_all(spark: SparkSession, literature: str, compound_class: str, out: str, chat: extraction.Chat | None = None, params: Mapping[str, Any] | None = None, force: bool = False) -> dict[str, Any]:
    """Literature to rules. A stage whose record fits its inputs, parameters and summary is not run again."""
    settings = dict(params or {})
    names = ("corpus", "plan", "claims", "diagnostics", "inferred", "rules")
    folder = {n: f"{out}/{n}" for n in names}
    steps: list[tuple[str, Callable[[], Any], list[str], str]] = [
        ("corpus", lambda: prepare_corpus(spark, literature, folder["corpus"]), [], f"{folder['corpus']}/corpus.json"),
        ("plan", lambda: plan(spark, compound_class, f"{folder['plan']}/plan.json", chat), [], f"{folder['plan']}/plan.json"),
        ("claims", lambda: mine_literature(spark, folder["corpus"], f"{folder['plan']}/plan.json", folder["claims"], chat, **settings.get("claims", {})), [f"{folder['corpus']}/corpus.json", f"{folder['plan']}/plan.json"], f"{folder['claims']}/mining.json"),
        ("diagnostics", lambda: mine_diagnostics(spark, folder["corpus"], compound_class, folder["diagnostics"]), [f"{folder['corpus']}/corpus.json"], f"{folder['diagnostics']}/diagnostics.json"),
        ("inferred", lambda: infer(spark, folder["claims"], folder["inferred"]), [f"{folder['claims']}/mining.json"], f"{folder['inferred']}/inferred.json"),
        ("rules", lambda: compile_rules(spark, folder["claims"], folder["corpus"], folder["rules"], compound_class, **settings.get("rules", {})), [f"{folder['claims']}/mining.json"], f"{folder['rules']}/compilation.json"),
    ]
    done = {}
    for name, step, inputs, result in steps:
        record, about = f"{out}/records/{name}.json", {"class": compound_class, "literature": literature, "settings": json.dumps(settings.get(name, {}), sort_keys=True)}
        status = "forced" if force else bundle.stage_status(record, name, "1", about, inputs, [result])
        if status != "hit":
            step()
            bundle.commit_stage(record, name, "1", about, inputs, [result])
        done[name] = {"status": status, "result": bundle.read_json(result)}
    bundle.write_json(f"{out}/run.json", done)
    return done
