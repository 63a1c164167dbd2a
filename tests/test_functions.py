"""Column functions against plain Python on hand-made values."""

import pytest
from pyspark.sql import functions as F

from quillmass.functions import chemistry, text


def values(spark, expression, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x")).alias("y")).collect()]


def test_text_functions(spark):
    assert values(spark, text.clean_text, ["  a \n b ", "NaN", "none", None, ""]) == ["a b", "", "", "", ""]
    assert values(spark, text.canonical_feature_id, ["12.0", ' "7" ', "1.50", None]) == ["12", "7", "1.50", ""]
    assert values(spark, text.normalize_ion_mode, ["POS", "ESI-", "both", None]) == ["positive", "negative", "", ""]
    assert values(spark, text.ion_mode_from_adduct, ["[M+H]+", "[M-H]-", "M", None]) == ["positive", "negative", "", ""]
    assert values(spark, text.clean_library_name, ["A|x", " b ", None]) == ["A", "b", ""]
    assert values(spark, lambda c: text.split_values(c), ["a; b|c", '["x", "y "]', "[bad", None]) == [["a", "b", "c"], ["x", "y"], ["[bad"], []]
    assert values(spark, lambda c: text.format_number(c, 2), [1.5, 2.0, -0.001, None], "double") == ["1.5", "2", "0", ""]
    assert values(spark, text.scientific_tokens, ["[M+H]+ at m / z 301.5, α–b 2-keto"]) == [["[m+h]+", "at", "m/z", "301.5", "b", "2-keto"]]
    assert values(spark, lambda c: text.join_unique(F.split(c, ",")), ["a,B,b, A ,c"]) == ["a;B;c"]
    assert values(spark, text.registry_name, ["Ｆull Straße", "Plain  Name", None]) == ["full strasse", "plain name", ""]
    assert values(spark, text.registry_name_keys, ["Outer (inner/other)", "a (b)"]) == [["outer (inner/other)", "outer", "inner/other", "inner", "other"], ["a (b)"]]
    assert values(spark, text.parse_confidence, ["0.5", "7", "x", None]) == [0.5, 1.0, 0.0, 0.0]


def test_formulas(spark):
    assert values(spark, lambda c: chemistry.hill_formula(chemistry.parse_formula(c)), ["C6H12O6", "OH2", "ClNa+", "Xx", "", "C0", None]) == ["C6H12O6", "H2O", "ClNa", None, None, None, None]
    water = values(spark, chemistry.formula_mass, ["H2O"])[0]
    assert water == pytest.approx(18.010565, abs=1e-5)
    assert values(spark, lambda c: chemistry.apply_delta(c, F.lit("condensation_h2o_loss")), ["C2H6O", "CH4"]) == ["C2H4", None]


def test_balance(spark):
    rows = [
        ([("C6H12O6", 2)], [("C12H22O11", 1)], "condensation_h2o_loss"),
        ([("C6H12O6", 2)], [], "condensation_h2o_loss"),
        ([("C6H12O6", 1)], [("CH4", 1)], "identity"),
        ([("bad", 1)], [], "identity"),
        ([("CH4", 1)], [], "unknown"),
    ]
    kind = "array<struct<formula:string,coefficient:int>>"
    df = spark.createDataFrame(rows, f"r {kind}, p {kind}, o string")
    found = [x[0] for x in df.select(chemistry.reaction_balance(F.col("r"), F.col("p"), F.col("o"))["status"]).collect()]
    assert found == ["valid", "derived_formula_valid", "atom_balance_failed", "formula_parse_failed", "stoichiometry_unresolved"]
    solved = spark.createDataFrame([([("C6H12O6", 1)], [("C12H22O11", 1)], 1)], f"k {kind}, p {kind}, n int").select(chemistry.missing_reactant(F.col("k"), F.col("p"), F.lit("condensation_h2o_loss"), F.col("n"))["formula"]).first()[0]
    assert solved == "C6H12O6"
