"""The stages of a run on paths: literature to rules without a model, once and again; search; the command line."""

import json

import pytest

from quillmass import __main__ as command
from quillmass.plans import stages
from quillmass.sources import bundle

from .test_documents import TABLE


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("run")
    folder = base / "lit"
    folder.mkdir()
    (folder / "table.txt").write_text(TABLE)
    (folder / "prose.txt").write_text("Betalains of beet. A diagnostic ion at m/z 150.05 was seen in negative ion mode. " * 3)
    return str(folder), str(base / "out"), stages.run_all(spark, str(folder), "Betalain", str(base / "out"))


def test_run_gives_a_bundle_and_is_not_repeated(spark, run):
    folder, out, done = run
    assert done["corpus"]["result"]["files"] == 2 and done["claims"]["result"]["claims"] >= 4 and done["diagnostics"]["result"]["claims"] == 1
    assert {d["status"] for d in done.values()} == {"missing_record"}
    tables = bundle.read_bundle(spark, f"{out}/rules")
    assert {r.compound_name for r in tables["compound_rules"].collect()} >= {"Betanin", "Rg1 isomer"} and tables["entity_registry"].count() >= 3
    assert tables["biosynthetic_component_rules"].count() >= 1 and done["rules"]["result"]["rows"]["compound_rules"] == tables["compound_rules"].count()
    again = stages.run_all(spark, folder, "Betalain", out)
    assert {d["status"] for d in again.values()} == {"hit"}


def test_index_and_search(spark, run, tmp_path):
    _, out, _ = run
    manifest = stages.build_index(spark, f"{out}/corpus", str(tmp_path / "index"))
    assert manifest["document_count"] == 2 or manifest["document_count"] > 2
    found = stages.search(spark, str(tmp_path / "index"), ["diagnostic ion beet"], str(tmp_path / "hits"), 3)
    assert found["hits"] >= 1 and spark.read.json(str(tmp_path / "hits")).first().preview


def test_paths_and_arguments(spark, tmp_path):
    (tmp_path / "a.msp").write_text("")
    (tmp_path / "b.msp").write_text("")
    assert len(stages.matching_paths(spark, [f"{tmp_path}/*.msp", f"{tmp_path}/a.msp"])) == 2 and stages.require_one(spark, [f"{tmp_path}/a.msp"]).endswith("a.msp")
    with pytest.raises(ValueError):
        stages.require_one(spark, [f"{tmp_path}/*.msp"])
    with pytest.raises(FileNotFoundError):
        stages.matching_paths(spark, [f"{tmp_path}/none*"])
    assert stages.safe_stem(" Beta lains! ") == "beta_lains" and stages.safe_stem("  ") == "compound_class"
    given = command.arguments().parse_args(["search", "--index", "i", "--queries", "a", "b", "--out", "o", "--top_k", "3"])
    assert (given.stage, given.queries, given.top_k) == ("search", ["a", "b"], 3)
    made = stages.plan(spark, "Betalain", str(tmp_path / "plan.json"))
    assert json.loads((tmp_path / "plan.json").read_text()) == made


def test_match_from_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Alignment ID,Average Mz,Average Rt(min)\n1,301.0,1.0\n2,400.0,1.0\n")
    (tmp_path / "s.mgf").write_text("".join(f"BEGIN IONS\nFEATURE_ID={i}\nPEPMASS={m}\nIONMODE=positive\n100 50\n150 100\nEND IONS\n" for i, m in ((1, 301.0), (2, 400.0))))
    (tmp_path / "l.msp").write_text("Name: Alpha\nPrecursorMZ: 301.0\nPrecursorType: [M+H]+\nNum Peaks: 2\n100 50\n150 100\n\n")
    found = stages.match(spark, str(tmp_path / "t.csv"), str(tmp_path / "s.mgf"), [str(tmp_path / "*.msp")], "positive", str(tmp_path / "m"))
    assert found["queries"] == 2 and found["hits"] == 1
