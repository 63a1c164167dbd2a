"""Literature files to chunks, and compound records from tables."""

import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quillmass.operators import tables
from quillmass.sources import documents


def workbook(sheets):
    """A small XLSX file: shared strings, numbers, a boolean, an inline string and a gap."""
    strings = sorted({v for rows in sheets.values() for row in rows for v in row if isinstance(v, str)})
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        names = list(sheets)
        refs = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{refs}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            body = ""
            for n, row in enumerate(rows, 1):
                cells = ""
                for c, v in enumerate(row):
                    at = f"{chr(65 + c)}{n}"
                    if isinstance(v, bool):
                        cells += f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
                    elif isinstance(v, str):
                        cells += f'<c r="{at}" t="s"><v>{strings.index(v)}</v></c>'
                    elif v is not None:
                        cells += f'<c r="{at}"><v>{v}</v></c>'
                body += f'<row r="{n}">{cells}</row>'
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def pdf(pages):
    out = b"%PDF-1.4\n"
    for n, lines in enumerate(pages):
        body = b"BT /F1 12 Tf " + b" ".join(b"1 0 0 1 0 0 Td (" + line.replace("(", "\\(").replace(")", "\\)").encode() + b") Tj" for line in lines) + b" ET"
        body = zlib.compress(body)
        out += b"%d 0 obj\n<< /Length %d /Filter /FlateDecode >>\nstream\n" % (n, len(body)) + body + b"\nendstream\nendobj\n"
    return out


def test_corpus_of_all_kinds(spark, tmp_path):
    folder = tmp_path / "lit"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.txt").write_bytes(b"\xef\xbb\xbf1. Introduction\nSome words here. " + b"word " * 400)
    (folder / "sub" / "b.csv").write_text("Name, Mass,\nAlpha,12.5,x\n,,\nBeta,,\n")
    (folder / "c.xlsx").write_bytes(workbook({"One": [["Name", "N", None], ["Alpha", 12, True], ["Beta", 1.5]], "Empty": []}))
    (folder / "d.pdf").write_bytes(pdf([["Results", "First (page)"], ["Second page"]]))
    (folder / "bad.xlsx").write_bytes(b"no zip")
    (folder / "empty.txt").write_text("  \n")
    (folder / "skipped.md").write_text("not read")
    chunks, report = documents.prepare_corpus(spark, str(folder))
    status = {r.source_file: (r.file_type, r.parse_status, r.chunk_count) for r in report.collect()}
    assert status["a.txt"] == ("txt", "success", 2) and status["sub/b.csv"] == ("csv", "success", 2) and status["c.xlsx"] == ("xlsx", "success", 2)
    assert status["d.pdf"] == ("pdf", "success", 2) and status["empty.txt"] == ("txt", "empty", 0) and status["bad.xlsx"][:2] == ("xlsx", "failed") and len(status) == 6
    rows = {(r.source_file, r.page, r.sheet_name, r.row_index, r.char_start): r for r in chunks.collect()}
    assert rows["sub/b.csv", None, None, 2, 0].text == "Name: Alpha | Mass: 12.5 | column_3: x" and rows["sub/b.csv", None, None, 4, 0].text == "Name: Beta"
    assert rows["c.xlsx", None, "One", 2, 0].text == "Name: Alpha | N: 12 | column_3: True" and rows["c.xlsx", None, "One", 3, 0].text == "Name: Beta | N: 1.5"
    assert rows["d.pdf", 1, None, None, 0].text == "Results\nFirst (page)" and rows["d.pdf", 1, None, None, 0].section == "Results"
    assert rows["a.txt", None, None, None, 0].section == "1. Introduction" and len({r.chunk_id for r in rows.values()}) == len(rows)
    found = documents.write_corpus(spark, str(folder), str(tmp_path / "out"))
    assert found.count() == 6 and spark.read.json(str(tmp_path / "out" / "chunks")).count() == len(rows)
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "parse_failures")).count() == 2
    with pytest.raises(ValueError):
        documents.prepare_corpus(spark, str(folder), 100, 100)


TABLE = """Table 1. Compound name   Molecular formula   measured value (m/z)   product ions
negative ion mode [M-H]-
1    Betanin    C24H26N2O13    549.1362    387.08[M-H-Glc], 343.10[M-H-Glc-CO2]
2    Isobetanin-    C24H26N2O13    549.1362    387.0800, 343.1000
     glucoside
Neobetanin
3    C24H24N2O13    547.1205    no
(12) Rg1 isomer    C42H72O14    799.48    637.43[M-H-Glc]; 475.38[M-H-2Glc]
"""


def test_rows_of_a_fixed_width_table():
    profile = tables.Profile("negative", "[M-H]-", "precursor", True)
    found = [r for r in tables.PageReader(TABLE, profile).records() if r["kind"] == "compound"]
    by_name = {r["compound_name"]: r for r in found}
    betanin = by_name["Betanin"]
    assert betanin["formula"] == "C24H26N2O13" and betanin["exact_mass"] == "550.143489" and betanin["reported_precursor_mz"] == "549.1362"
    assert betanin["reported_fragments"] == "387.08;343.1" and betanin["component_profile"] == {"Glc": 1} and betanin["evidence_role"] == "target_product_ion"
    assert betanin["component_masses"] == {"Glc": pytest.approx(206.0362)}  # the upper median of what both ions give
    assert "Isobetanin-glucoside" in by_name and by_name["Isobetanin-glucoside"]["reported_fragments"] == "387.08;343.1"
    assert by_name["Rg1 isomer"]["component_profile"] == {"Glc": 2}


def test_labelled_and_substituent_records():
    labelled = "Compound 7 Name: structure  Betanin Chemical Formula C24H26N2O13 Monoisotopic mass 550.1435 m/z [M+H] 551.15 fragments (m/z) 389.10 345.1 12 9999 References 400.5"
    (record,) = tables.PageReader(labelled).labelled()
    assert (record["compound_name"], record["formula"], record["exact_mass"], record["reported_precursor_mz"], record["reported_fragments"]) == ("Betanin", "C24H26N2O13", "550.1435", "551.15", "389.1;345.1")
    sites = "Name    R1    R2\nGinsenoside    -Glc-Rha    -H    -2Glc\nRg2\n"
    (found,) = tables.PageReader(sites).substituents()
    assert found["compound_name"] == "Ginsenoside Rg2" and found["component_profile"] == {"Glc": 2, "Rha": 1}


@pytest.mark.parametrize(("cell", "name"), [("(3) Betanin *", "Betanin"), ("12 Betanin a", "Betanin"), ("Betanin 1), 2)", "Betanin"), ("123.4", ""), ("No.", ""), ("-Glc", ""), ("C24H26N2O13", ""), ("Betanin-", ""), ("isomer", ""), ("x" * 141, "")])
def test_names_of_cells(cell, name):
    assert tables.clean_name(cell) == name


def test_split_names_are_closed_up():
    assert tables.repaired_name("Beta nin iso mer", {"betanin", "isomer"}) == "Betanin isomer"
    assert tables.repaired_name("Ginsenoside Rg1", {"ginsenosiderg"}) == "Ginsenoside Rg1"
    assert "betanin" in tables.join_candidates("Beta nin x") and tables.united(["a", "B", "b", "A"]) == "a;B"


def test_claims_of_tables(spark):
    half = len(TABLE) // 2
    rows = [("c1", "f.pdf", "pdf", 1, 0, half + 40, TABLE[: half + 40]), ("c2", "f.pdf", "pdf", 1, half, len(TABLE), TABLE[half:]), ("c3", "g.txt", "txt", None, 0, 9, "no table.")]
    chunks = spark.createDataFrame(rows, "chunk_id string, source_file string, file_type string, page int, char_start int, char_end int, text string")
    pages = {r.place: r.page_text for r in tables.pages_of(chunks).collect()}
    assert pages["page 1"] == TABLE and pages["chunk c3"] == "no table."
    profile = {r.source_file: r for r in tables.source_profiles(tables.pages_of(chunks)).collect()}["f.pdf"]
    assert (profile.ion_mode, profile.adduct, profile.mass_after_formula, profile.ion_column) == ("negative", "[M-H]-", "precursor", True)
    claims, members = tables.mine_tables(chunks, "betalain")
    by_name = {r.compound_name: r for r in claims.collect()}
    assert by_name["Betanin"].chunk_id == "c1" and by_name["Rg1 isomer"].chunk_id == "c2" and by_name["Betanin"].reported_fragments == "387.08;343.1"
    assert {(r.entity_name, r.component_name, r.component_count) for r in members.collect()} == {("Betanin", "Glc", 1), ("Rg1 isomer", "Glc", 2)}
    again = tables.refreshed(claims.withColumn("claim_source", F.lit("llm")).drop("ord").withColumn("ord", F.lit(1)), claims)
    assert again.count() == claims.count()
