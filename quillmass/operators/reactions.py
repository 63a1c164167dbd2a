"""Reaction templates: capped combinations of candidate reactants, balanced by formula."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmass.functions import chemistry
from quillmass.operators.storage import cut


def combinations(templates: DataFrame, pools: list[str], most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Every combination of one candidate from each pool (array columns), and the audit of templates that yield none.

    A template with an empty pool, or with more than ``most`` combinations, is audited instead; so a template
    explodes to at most ``most`` rows, and nothing is joined.
    """
    sizes = [F.size(F.coalesce(F.col(p), F.array().cast("array<string>"))) for p in pools]
    n = reduce(lambda a, b: a * b, [s.cast("long") for s in sizes], F.lit(1).cast("long"))
    empty = reduce(lambda a, b: a | b, [s <= 0 for s in sizes])
    marked = templates.withColumn("combination_count", n).withColumn("status", F.when(empty, "reactant_unresolved").when(n > most, "combination_limit_exceeded").otherwise("materialized"))
    out = marked.filter("status = 'materialized'")
    for p in pools:
        out = out.withColumn(p, F.explode(p))
    audit = marked.filter("status <> 'materialized'").drop(*pools)
    return out.drop("status"), audit


def pools_of(classes: DataFrame, members: DataFrame) -> DataFrame:
    """class_id, members: the sorted distinct entities of each class that the registry knows."""
    return members.join(classes.select("class_id"), "class_id", "left_semi").groupBy("class_id").agg(F.array_sort(F.collect_set("entity_id")).alias("members"))


def balanced(rows: DataFrame, reactants: Column, products: Column, operator: Column) -> DataFrame:
    """Adds status, expected_formula and mass of the reaction balance."""
    return rows.withColumn("_b", chemistry.reaction_balance(reactants, products, operator)).select("*", "_b.status", "_b.expected_formula", "_b.mass").drop("_b")


def complete_reactants(templates: DataFrame, forms: DataFrame, rounds: int = 5) -> DataFrame:
    """Formulas of entities that lack one, solved from templates where it is the only unknown; until none is new.

    ``templates``: template_id, operator, reactants and products (arrays of struct(entity_id, coefficient));
    ``forms``: entity_id, formula. An entity solved in one round is known in the next; of several solutions the one
    of the smallest template id stays.
    """
    known = forms.select("entity_id", "formula").where(F.col("formula").isNotNull())
    for _ in range(rounds):
        sides = []
        for side in ("reactants", "products"):
            each = templates.select("template_id", F.explode(side).alias("p")).select("template_id", "p.entity_id", "p.coefficient")
            each = each.join(known, "entity_id", "left")
            got = F.collect_list(F.when(F.col("formula").isNotNull(), F.struct("formula", "coefficient")))
            lack = F.collect_list(F.when(F.col("formula").isNull(), F.struct("entity_id", "coefficient")))
            sides.append(each.groupBy("template_id").agg(got.alias(side), lack.alias(f"{side}_lack")))  # a template's participants
        both = templates.select("template_id", "operator").join(sides[0], "template_id").join(sides[1], "template_id")
        open_one = both.filter((F.size("reactants_lack") == 1) & (F.size("products_lack") == 0))
        lacking = F.get("reactants_lack", F.lit(0))
        solved = open_one.select("template_id", lacking["entity_id"].alias("entity_id"), chemistry.missing_reactant(F.col("reactants"), F.col("products"), F.col("operator"), lacking["coefficient"]).alias("m"))
        solved = cut(solved.filter("m.status = 'derived_formula_valid'").groupBy("entity_id").agg(F.min_by("m.formula", "template_id").alias("formula")))
        if solved.isEmpty():
            break
        known = known.unionByName(solved)
    return known
