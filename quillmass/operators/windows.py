"""Context windows over documents: hit units and their neighbours, packed to a size and picked for diversity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WINDOW = "source string, first_position int, last_position int, part int, window_text string, hit_count int, score double"


def pack_island(units: list[tuple[int, str]], limit: int) -> list[tuple[int, int, int, str]]:
    """(first, last, part, text) of consecutive units packed to ``limit`` characters; longer units are split with overlap."""
    overlap = min(240, limit // 5)
    out: list[tuple[int, int, int, str]] = []
    held: list[tuple[int, str]] = []

    def flush() -> None:
        if held:
            out.append((held[0][0], held[-1][0], 0, "\n".join(t for _, t in held)))
            held.clear()

    for position, content in units:
        if len(content) > limit:
            flush()
            starts = range(0, max(1, len(content) - overlap), limit - overlap)
            out += [(position, position, k, content[a : a + limit]) for k, a in enumerate(starts)]
            continue
        if held and sum(len(t) + 1 for _, t in held) + len(content) > limit:
            flush()
        held.append((position, content))
    flush()
    return out


def document_windows(units: DataFrame, hits: DataFrame, limit: int = 6000, radius: int = 1) -> DataFrame:
    """Windows of each source: hit positions and ``radius`` neighbours, consecutive ones together, at most ``limit`` characters.

    ``units``: source, position, content. ``hits``: source, position, score. A group is one document's islands.
    """
    around = hits.select("source", F.explode(F.sequence(F.col("position") - radius, F.col("position") + radius)).alias("position")).distinct()
    marks = hits.groupBy("source", "position").agg(F.count("*").alias("hit_count"), F.max("score").alias("score"))
    near = units.join(around, ["source", "position"]).join(marks, ["source", "position"], "left")
    run = near.withColumn("_run", F.col("position") - F.row_number().over(Window.partitionBy("source").orderBy("position")))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position")
        found = pack_island(list(zip(rows["position"].tolist(), rows["content"].fillna("").tolist(), strict=True)), limit)
        out = []
        for first, last, part, content in found:
            inside = rows[(rows["position"] >= first) & (rows["position"] <= last)]
            out.append((key[0], first, last, part, content, int(inside["hit_count"].fillna(0).sum()), float(inside["score"].fillna(0).max())))
        return pd.DataFrame(out, columns=["source", "first_position", "last_position", "part", "window_text", "hit_count", "score"])

    return run.groupBy("source", "_run").applyInPandas(pack, WINDOW)


def pick_windows(windows: DataFrame, most: int, signal: str = "signal") -> DataFrame:
    """At most ``most`` windows: a third by relation signal, one for each source; then unseen sources; then by score.

    Ranks are taken within tiers, so only the picked windows are ever brought together.
    """
    budget = max(1, most // 3)
    of_source = Window.partitionBy("source")
    best = windows.withColumn("_s", F.row_number().over(of_source.orderBy(F.desc(signal), F.desc("score"), "first_position", "part"))).withColumn("_q", F.row_number().over(of_source.orderBy(F.desc("score"), "first_position", "part")))
    key = ["source", "first_position", "part"]
    order = [F.desc("score"), F.col("source"), F.col("first_position"), F.col("part")]
    first = best.filter((F.col("_s") == 1) & (F.col(signal) > 0)).orderBy(F.desc(signal), *order).limit(budget).select(*key, F.lit(0).alias("tier"))
    second = best.filter("_q = 1").join(first.select("source").distinct(), "source", "left_anti").orderBy(*order).limit(most).select(*key, F.lit(1).alias("tier"))
    third = windows.orderBy(*order).limit(most * 3).select(*key, F.lit(2).alias("tier"))
    ranked = first.unionByName(second).unionByName(third).groupBy(*key).agg(F.min("tier").alias("tier"))
    chosen = windows.join(ranked, key).orderBy("tier", *order).limit(most)
    return chosen.drop("tier")
