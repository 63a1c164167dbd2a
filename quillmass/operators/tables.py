"""Compound records from the text of tables: labelled records, fixed-width rows, substituent tables, and claims from them.

A page's lines are read by a small reader on executors (``PageReader``), since what a cell means depends on the lines
around it. All that spans pages is DataFrame work: pages are put together from chunks, a source's profile is folded from
its pages, split names are repaired against the source's words by a join, records find the chunk that holds them, and
equal claims merge. No source is ever gathered in one task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmass.functions import chemistry, text
from quillmass.operators import evidence

#: Formulas as tables print them, with carbon and hydrogen and at least one other element.
_OTHER_ELEMENTS = "|".join(sorted(set(chemistry.ATOMIC_MASSES) - {"C", "H"}, key=lambda e: (-len(e), e)))
FORMULA = re.compile(rf"\bC\s?\d{{1,3}}\s*H\s?\d{{1,3}}(?:\s*(?:{_OTHER_ELEMENTS})(?:\s?\d{{1,3}})?)+\b")
#: A wrapped cell that ends a name (an identifier or numeral), and dashes at which names wrap.
SUFFIX = re.compile(r"(?:[A-Z]{1,6}\d+[A-Za-z0-9-]*|[IVXLCDM]+|[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫ]+)(?:\s+(?:isomer|derivative))?", re.I)
OPEN_ENDS = ("-", "‐", "‑", "‒", "–")
#: Annotations of the whole molecule, and losses that are no components.
WHOLE_IONS = {"m-h", "m+h", "m+na", "m+nh4", "m+hcoo", "m+fa-h"}
PLAIN_LOSSES = {"m", "h", "h2o", "co", "co2", "nh3", "ch2o", "ch3oh"}
#: Header words of tables, and of product-ion columns.
HEADER = re.compile(r"\b(?:compound\s+name|chemical\s+formula|molecular\s+formula|product\s+ions?|measured\s+value|observed\s+m\s*/\s*z)\b", re.I)
ION_COLUMN = re.compile(r"\b(?:product\s+ions?|ms\s*2\s+ions?|fragmentation\s+ions?)\b", re.I)
LEAST_MZ, MOST_MZ = 40.0, 2000.0
EDGE = " :;,.|*"


def spaced(value: str | None) -> str:
    return " ".join((value or "").split())


def cells_of(line: str) -> list[str]:
    """A line's cells: parts between tabs or runs of blanks."""
    return [c for c in (part.strip() for part in re.split(r"\s{2,}|\t+", line.strip())) if c]


def shown_number(value: str | float) -> str:
    return f"{float(value):.6f}".rstrip("0").rstrip(".")


def united(values: list[str]) -> str:
    """Distinct values (by lower case) in order, the first spelling kept, joined by semicolons."""
    first: dict[str, str] = {}
    for v in values:
        first.setdefault(v.lower(), v)
    return ";".join(first.values())


def masses_in(pattern: str, content: str) -> list[str]:
    return [shown_number(m) for m in re.findall(pattern, content) if LEAST_MZ <= float(m) <= MOST_MZ]


# ---- names


#: What is stripped from a name's cell, in order, and after each the edge characters.
_STRIPPED = (re.compile(r"^\(\d+\)\s*"), re.compile(r"^[A-Z]?\d+\s+(?=[A-Za-z])"), re.compile(r"(?:\s*\d+\)\s*,?)+$"), re.compile(r"\s+[ab]$"))
_NUMERIC = re.compile(r"[\s\d.+\-−–—]+")
_NO_NAME = re.compile(r"No\.?|[RS]|[αβ]", re.I)


def clean_name(cell: str, wrapped: bool = False) -> str:
    """A compound's name from a table cell, or empty. With ``wrapped`` it may go on in another cell."""
    name = spaced(cell).strip(EDGE)
    for pattern in _STRIPPED:
        name = pattern.sub("", name)
        name = name.strip(EDGE) if pattern.pattern.endswith("$") else name
    if wrapped and re.fullmatch(r"\d+(?:,\d+)*-", name):
        return name
    faults = (
        not 0 < len(name) <= 140,
        len(re.findall("[A-Za-z]", name)) < 2,
        _NUMERIC.fullmatch(name),
        _NO_NAME.fullmatch(name),
        name.startswith(("-", "/", "−", "–", "—")),
        not wrapped and name.endswith(("-", "/")),
        any(c in name for c in "�[]、銆"),
        FORMULA.search(name),
        not wrapped and name.lower() in ("isomer", "derivative"),
    )
    return "" if any(faults) else name


def is_suffix(cell: str) -> bool:
    return SUFFIX.fullmatch(spaced(cell)) is not None


def joined_name(parts: list[str]) -> str:
    """Parts of a wrapped name: closed up after a dash, or where a short word goes on in lower case."""
    name = ""
    for part in filter(None, parts):
        last = re.split(r"\s+", name)[-1].rstrip("-")
        closed = name.endswith(OPEN_ENDS) or (name[-1:].isalpha() and part[0].islower() and len(last) <= 3)
        name = name + part if closed or not name else f"{name} {part}"
    return spaced(name)


def labelled_name(content: str) -> str:
    """The name after ``Name:``, up to the next label of a record."""
    found = re.search(r"\bName\s*:\s*(.+?)(?:\bChemical\s+Formula\b|\bMolecular\s+weight\b|\bMonoisotopic\s+mass\b|\bm\s*/\s*z\b|\bfragments?\b|$)", content, re.I)
    name = re.sub(r"^(?:chemical structure|structure)\s+", "", spaced(found[1]) if found else "", flags=re.I)
    return spaced(name).strip(" :;,.")


_SPLIT = re.compile(r"([A-Za-z]{2,})\s+([A-Za-z]+)(?=[^A-Za-z]|$)")
_KEEPS_APART = re.compile(r"(?:[A-Z]{1,6}\d+[A-Za-z0-9-]*|[IVXLCDM]+)", re.I)


def join_candidates(name: str, most: int = 9) -> list[str]:
    """Lower-case words that a name's neighbouring letter runs would make if joined."""
    out = set()
    for group in re.findall(r"[A-Za-z]+(?:\s+[A-Za-z]+)+", spaced(name)):
        runs = group.lower().split()
        out |= {"".join(runs[i:j]) for i in range(len(runs)) for j in range(i + 2, min(len(runs), i + most) + 1)}
    return sorted(out)


def repaired_name(name: str, words: set[str]) -> str:
    """A name whose split words are closed up where the whole word stands in the source (``words``, lower case)."""

    def closed(m: re.Match) -> str:
        ends = m.string[m.end() :]
        if _KEEPS_APART.fullmatch(m[2]) or (len(m[2]) <= 2 and ends[:1].isdigit()) or (m[1] + m[2]).lower() not in words:
            return m[0]
        return m[1] + m[2]

    found = spaced(name)
    for _ in range(8):
        before, found = found, _SPLIT.sub(closed, found)
        if found == before:
            break
    return spaced(re.sub(r"(?<=[A-Za-z0-9])(?=isomer(?:\b|/))", " ", found, flags=re.I).rstrip("/ "))


# ---- ions and components


def annotated_ions(content: str) -> list[str]:
    """Masses with an annotation in brackets, but for those of the whole molecule and footnotes."""
    out = []
    for mass, note in re.findall(r"(?<![A-Za-z])([0-9]{2,4}(?:\.[0-9]+)?)\s*\[([^\]]+)\]", content):
        key = re.sub(r"\s+", "", note).lower().translate(str.maketrans("−–", "--"))
        if key not in WHOLE_IONS and not key.isdigit() and LEAST_MZ <= float(mass) <= MOST_MZ:
            out.append(shown_number(mass))
    return out


def listed_ions(content: str) -> list[str]:
    """Masses of lists with commas or semicolons, line by line."""
    runs = re.compile(r"(?<![A-Za-z0-9])(\d{2,4}(?:\.\d+)?(?:\s*[,;]\s*\d{2,4}(?:\.\d+)?)+)(?![A-Za-z0-9])")
    lines = re.sub(r"\[[^\]]*\]", " ", content).splitlines()
    return [m for line in lines for run in runs.findall(line) for m in masses_in(r"\d{2,4}(?:\.\d+)?", run)]


def labelled_ions(content: str) -> list[str]:
    """Masses after the word ``fragments``, up to the next record."""
    start = re.search(r"\bfragments?\s*(?:\(\s*m\s*/\s*z\s*\)|m\s*/\s*z)?", content, re.I)
    if not start:
        return []
    tail = re.split(r"\b(?:references|chemical structure|name\s*:|compound\s+\d+)\b", content[start.end() :], maxsplit=1, flags=re.I)[0]
    return masses_in(r"(?<![A-Za-z])\d{2,4}(?:\.\d+)?(?![A-Za-z])", tail)


def component_labels(cell: str) -> list[str]:
    """Labels of components in a cell like ``-2Glc-Rha``, as they are reported."""
    found = re.findall(r"(?<![A-Za-z])(?:\d+)?([A-Z][a-z]{1,15}(?:\([A-Za-z]+\))?|[a-z]{3,15})(?![A-Za-z])", cell.translate(str.maketrans("−–—", "---")))
    return [f for f in found if f.lower() not in PLAIN_LOSSES]


_COUNTED = re.compile(r"(\d+)?([A-Za-z][A-Za-z]*(?:\([A-Za-z]+\))?)")


def losses_of(note: str, edge: str) -> Counter:
    """How often each component is lost in an annotation like ``M-H-2Glc``."""
    out: Counter = Counter()
    for part in re.split("[-−–—]", note):
        m = _COUNTED.fullmatch(part.strip(edge))
        if m and m[2].lower() not in PLAIN_LOSSES:
            out[m[2]] += int(m[1] or 1)
    return out


def component_profile(content: str) -> dict[str, int]:
    """The largest count of each component that an ion of the molecule loses."""
    most: Counter = Counter()
    for note in re.findall(r"\[([^\]]+)\]", content):
        if re.search(r"\bM\b|M\s*[-+]", note, re.I):
            most |= losses_of(note, " ()+−–—")
    return dict(most)


def component_masses(content: str, precursor: str) -> dict[str, float]:
    """The mass of each component, from ions that lose it alone: the upper median of what the ions give."""
    if not precursor:
        return {}
    seen: dict[str, list[float]] = {}
    for mass, note in re.findall(r"(\d{2,4}(?:\.\d+)?)\s*\[([^\]]+)\]", content):
        lost = losses_of(note, " \t\n\r")
        if len(lost) == 1:
            ((label, count),) = lost.items()
            one = (float(precursor) - float(mass)) / count
            if 20.0 <= one <= 250.0:
                seen.setdefault(label, []).append(one)
    return {label: sorted(v)[len(v) // 2] for label, v in seen.items()}


# ---- profiles of sources


@dataclass(frozen=True)
class Profile:
    """What a source's tables say of polarity, adduct, the mass after a formula, and product ions."""

    ion_mode: str = ""
    adduct: str = ""
    mass_after_formula: str = ""
    ion_column: bool = False


#: The statements that a profile is made of, by flag; they are looked for in single-spaced text.
FLAGS = {
    "negative": r"(?i)\[M\s*-\s*H\]\s*[-−–ˉ]|negative\s+ion\s+mode",
    "positive": r"(?i)\[M\s*\+\s*H\]\s*\+|positive\s+ion\s+mode",
    "theoretical": r"(?i)(?:molecular\s+)?formula.{0,80}theoretical\s+(?:exact\s+)?mass",
    "measured": r"(?i)(?:molecular\s+)?formula.{0,100}(?:measured\s+(?:value\s*)?\(m\s*/\s*z\)|\[M[^\]]+\]\s*[-+−–ˉ]?\s*ion)",
    "ions": r"(?is)(?:molecular\s+)?formula.{0,300}(?:product\s+ions?|ms\s*2\s+ions?|fragmentation\s+ions?)",
    "words_formula": r"(?i)\bformula\b",
    "words_seen": r"(?i)\b(?:measured|observed)\b",
    "words_ions": r"(?i)\b(?:product\s+ions?|ms\s*2\s+ions?|fragmentation\s+ions?)\b",
    "words_name": r"(?i)\bcompound\s+name\b",
}


def source_profiles(pages: DataFrame) -> DataFrame:
    """source_file, ion_mode, adduct, mass_after_formula, ion_column: flags of its pages, any of which may state them."""
    plain = text.normalize_space(F.col("page_text"))
    flags = [(F.col("page_text") if name == "ions" else plain).rlike(p).alias(name) for name, p in FLAGS.items()]
    found = pages.select("source_file", *flags).withColumn("together", F.col("words_formula") & F.col("words_seen") & F.col("words_ions") & F.col("words_name"))
    per = found.groupBy("source_file").agg(*[F.max(c).alias(c) for c in ("negative", "positive", "theoretical", "measured", "ions", "together")])
    mode = F.when(F.col("negative") & ~F.col("positive"), "negative").when(F.col("positive") & ~F.col("negative"), "positive").otherwise("")
    adduct = F.when(mode == "negative", "[M-H]-").when(mode == "positive", "[M+H]+").otherwise("")
    after = F.when(F.col("theoretical"), "exact").when(F.col("measured"), "precursor").otherwise("")
    return per.select("source_file", mode.alias("ion_mode"), adduct.alias("adduct"), after.alias("mass_after_formula"), (F.col("ions") | F.col("together")).alias("ion_column"))


# ---- pages


def pages_of(chunks: DataFrame) -> DataFrame:
    """source_file, place, page, first_chunk, page_text and members (chunk_id, text): PDF pages put together, other chunks alone.

    Chunks of a PDF page overlap; a row that a chunk's end cuts is whole again on the page. Chunks whose offsets do
    not fit their text stay alone.
    """
    fits = (F.lower(F.coalesce("file_type", F.lit(""))) == "pdf") & F.col("page").isNotNull() & (F.col("char_end") - F.col("char_start") == F.length("text"))
    rows = chunks.withColumn("source_file", F.coalesce("source_file", F.lit(""))).withColumn("paged", F.coalesce(fits, F.lit(False)))
    rows = rows.withColumn("place", F.when(F.col("paged"), F.concat(F.lit("page "), F.col("page").cast("string"))).otherwise(F.concat(F.lit("chunk "), "chunk_id")))
    held = rows.groupBy("source_file", "place").agg(  # at most a page's chunks
        F.array_sort(F.collect_list(F.struct(F.coalesce("char_start", F.lit(0)).alias("char_start"), "chunk_id", F.col("text").alias("chunk_text")))).alias("parts"),
        F.first("page").alias("page"),
        F.first("paged").alias("paged"),
    )

    def grown(acc: Column, c: Column) -> Column:
        """Pieces of the page so far and its length; they are joined once."""
        at = c["char_start"] - F.col("parts")[0]["char_start"]
        gap, known = at - acc["length"], acc["length"] - at
        piece = F.when(gap > 0, F.concat(F.repeat(F.lit("\n"), gap), c["chunk_text"])).when(known < F.length(c["chunk_text"]), F.substr(c["chunk_text"], known + 1)).otherwise("")
        return F.struct(F.concat(acc["pieces"], F.array(piece)).alias("pieces"), F.greatest(acc["length"], at + F.length(c["chunk_text"])).alias("length"))

    start = F.struct(F.array().cast("array<string>").alias("pieces"), F.lit(0).alias("length"))
    whole = F.array_join(F.aggregate("parts", start, grown)["pieces"], "")
    content = F.when(F.col("paged"), whole).otherwise(F.col("parts")[0]["chunk_text"])
    members = F.transform("parts", lambda p: F.struct(p["chunk_id"].alias("chunk_id"), p["chunk_text"].alias("text")))
    return held.select("source_file", "place", "page", F.col("parts")[0]["chunk_id"].alias("first_chunk"), F.coalesce(content, F.lit("")).alias("page_text"), members.alias("members"))


# ---- the reader of a page


RECORD = (
    "kind string, compound_name string, formula string, exact_mass string, reported_precursor_mz string, reported_fragments string, ion_mode string, adduct string, mass_derivation string, "
    "evidence_role string, specificity_scope string, source_structure string, evidence_quote string, anchor string, component_profile map<string,int>, component_masses map<string,double>, profile_source string"
)


@dataclass
class PageReader:
    """Reads the records of one page's lines."""

    content: str
    profile: Profile = Profile()
    lines: list[str] = field(init=False)

    def __post_init__(self):
        self.lines = self.content.splitlines()

    def records(self) -> Iterator[dict]:
        yield from self.substituents()
        if re.search(r"\b(?:Name\s*:|Chemical\s+Formula|Monoisotopic\s+mass|fragments?\s*\(\s*m\s*/\s*z)", self.content, re.I):
            yield from self.labelled()
        yield from self.rows()

    def labelled(self) -> Iterator[dict]:
        """The one record whose fields stand after labels."""
        flat = spaced(self.content)

        def after(pattern: str, flags: int = re.I) -> str:
            found = re.search(pattern, flat, flags)
            return spaced(found[1]) if found else ""

        name = labelled_name(flat)
        formula = after(r"\bChemical\s+Formula\s+([A-Z][A-Za-z0-9]*)\b")
        masses = [after(p) for p in (r"\bMonoisotopic\s+mass\s+(\d+(?:\.\d+)?)\b", r"\bm\s*/\s*z\s*(?:\[[^\]]+\])?\s*(\d+(?:\.\d+)?)\b")]
        exact, precursor = (shown_number(m) if m else "" for m in masses)
        ions = united(labelled_ions(flat))
        if name and (formula or exact or precursor or ions):
            yield {"kind": "compound", "compound_name": name, "formula": formula, "exact_mass": exact, "reported_precursor_mz": precursor, "reported_fragments": ions, "mass_derivation": "reported", "evidence_role": "theoretical_catalog" if ions else "", "specificity_scope": "target_associated" if ions else "", "source_structure": "supplementary_catalog"}

    def substituents(self) -> Iterator[dict]:
        """Rows of tables with sites R1, R2: a name, then cells that begin with a bond."""
        if not re.search(r"\bR\s*1\b|\bR1\b", self.content, re.I):
            return
        for i, line in enumerate(self.lines):
            cells = cells_of(line)
            bonds = [k for k, c in enumerate(cells) if c.startswith(("-", "−", "–", "—")) and component_labels(c)]
            if not bonds or not bonds[0]:
                continue
            name = self.name_before(cells, bonds[0])
            if not name or re.fullmatch(r"R\s*\d+", name, re.I):
                continue
            behind = next((s for s in (spaced(x).strip(EDGE) for x in self.lines[i + 1 : i + 4]) if s), "")
            if behind and is_suffix(behind):
                name = joined_name([name, behind])
            count: Counter = Counter()
            for cell in cells[bonds[0] :]:
                if not cell.startswith(("-", "−", "–", "—")):
                    break
                count.update(component_labels(cell))
            if count:
                yield {"kind": "components", "compound_name": name, "component_profile": dict(count), "profile_source": "structure_substituent_table", "evidence_quote": spaced(line), "anchor": line}

    # names around a row's formula

    @staticmethod
    def name_before(cells: list[str], place: int) -> str:
        parts: list[str] = []
        for name in filter(None, (clean_name(c, wrapped=True) for c in cells[:place])):
            if parts and not (is_suffix(name) or parts[-1].endswith(OPEN_ENDS)):
                break
            parts.append(name)
        return joined_name(parts)

    @staticmethod
    def name_after(lines: list[str], most: int | None) -> tuple[str, int]:
        """A name behind the formula and on the lines below, and how many lines it takes."""
        parts: list[str] = []
        used = 0
        for i, line in enumerate(lines):
            cells = cells_of(line)
            if not i:
                places = [k for k, c in enumerate(cells) if FORMULA.search(c)]
                cells = cells[places[0] + 1 :] if places else []
            plain = ((spaced(c).strip(EDGE), c) for c in cells)
            names = [n for n in (p if is_suffix(p) else clean_name(c, wrapped=True) for p, c in plain) if n]
            if not names:
                used = i + 1 if parts else used
                continue
            goes_on = not parts or names[0][0].islower()
            if not goes_on and not is_suffix(names[0]):
                break
            parts.append(names[0])
            used = i + 1
            if not goes_on or len(parts) == most:
                break
        return joined_name(parts), used

    def name_above(self, row: int) -> tuple[str, str]:
        """A name on one of the two lines above a row, with the lines from there on; none behind a header or a formula."""
        for i in range(row - 1, max(-1, row - 3), -1):
            if FORMULA.search(self.lines[i]) or HEADER.search(self.lines[i]):
                break
            name = next((n for n in (clean_name(c, wrapped=True) for c in cells_of(self.lines[i])) if n), "")
            if name:
                return name, "\n".join(self.lines[i:row])
        return "", ""

    def rows(self) -> Iterator[dict]:
        """Rows of fixed-width tables: a line of at least three cells with a formula behind the first."""
        ions_here = ION_COLUMN.search(self.content) is not None
        lists_here = ions_here or re.search(r"\bfragments?\b", self.content, re.I) is not None
        identified = ions_here or self.profile.ion_column
        for i, line in enumerate(self.lines):
            hit = FORMULA.search(line)
            cells = cells_of(line) if hit else []
            place = next((k for k, c in enumerate(cells) if FORMULA.search(c)), -1)
            if len(cells) < 3 or place <= 0:
                continue
            name, body = self.row_name(i, cells, place)
            formula = re.sub(r"\s+", "", hit[0])
            mass = formula_mass(formula)
            if not name or name.endswith(OPEN_ENDS) or mass is None:
                continue
            precursor = ""
            if self.profile.mass_after_formula == "precursor":
                decimals = [m for m in re.findall(r"(?<![A-Za-z0-9])\d{2,4}(?:\.\d+)?(?![A-Za-z])", line[hit.end() :]) if "." in m and LEAST_MZ <= float(m) <= MOST_MZ]
                precursor = shown_number(decimals[0]) if decimals else ""
            record = "\n".join(body)
            ions = united(annotated_ions(record) + (listed_ions(record) if lists_here else []))
            parts = component_profile(record)
            yield {
                "kind": "compound",
                "compound_name": name,
                "formula": formula,
                "exact_mass": shown_number(mass),
                "reported_precursor_mz": precursor,
                "reported_fragments": ions,
                "ion_mode": self.profile.ion_mode,
                "adduct": self.profile.adduct,
                "mass_derivation": "formula_calculated",
                "evidence_role": ("target_product_ion" if identified else "theoretical_catalog") if ions else "",
                "specificity_scope": ("target_specific" if identified else "target_associated") if ions else "",
                "source_structure": "structured_identification_table" if identified else "structured_table",
                "evidence_quote": spaced(record),
                "anchor": line,
                "component_profile": parts,
                "component_masses": component_masses(record, precursor),
                "profile_source": "annotated_fragment_loss" if parts else "",
            }

    def row_name(self, i: int, cells: list[str], place: int) -> tuple[str, list[str]]:
        """The name of a row, from its own cells and the lines above and below, and the lines of its record."""
        own = self.name_before(cells, place)
        above, above_lines = self.name_above(i)
        if own and not above.endswith(OPEN_ENDS):
            above, above_lines = "", ""
        body = [self.lines[i]]
        for line in self.lines[i + 1 : i + 9]:
            if FORMULA.search(line):
                break
            body.append(line)
        behind = ""
        if own:
            ends = (spaced(x).strip(EDGE) for x in body[1:])
            own = joined_name([own, next((e for e in ends if is_suffix(e)), "")])
        if not own or own.endswith(OPEN_ENDS):
            behind, used = self.name_after(body, 1 if above else None)
            body = body[:used] if used else body
            if behind[:1].isupper() and not above.endswith(OPEN_ENDS):
                above, above_lines = "", ""
        return joined_name([above, own, behind]), ([above_lines] if above_lines else []) + body


def formula_mass(formula: str) -> float | None:
    """The mass of a formula of known elements with positive counts, else None."""
    total = 0.0
    for element, count in re.findall(r"([A-Z][a-z]?)(\d*)", formula):
        if element not in chemistry.ATOMIC_MASSES or count and not int(count):
            return None
        total += chemistry.ATOMIC_MASSES[element] * int(count or 1)
    return total


def read_records(pages: DataFrame) -> DataFrame:
    """The records (RECORD) of pages with their source's profile."""
    names = [c.split()[0] for c in RECORD.split(", ")]

    @F.pandas_udf(f"array<struct<{RECORD.replace(', ', ',').replace(' ', ':')}>>")
    def read(content: pd.Series, mode: pd.Series, adduct: pd.Series, after: pd.Series, column: pd.Series) -> pd.Series:
        out = []
        for t, *given in zip(content, mode, adduct, after, column, strict=True):
            found = PageReader(t, Profile(given[0], given[1], given[2], bool(given[3]))).records()
            out.append([{n: r.get(n) if n in r or n.startswith("component_") else "" for n in names} for r in found])
        return pd.Series(out, dtype=object)

    joined = pages.join(source_profiles(pages), "source_file")
    found = joined.withColumn("r", F.explode(read("page_text", "ion_mode", "adduct", "mass_after_formula", "ion_column")))
    return found.select("source_file", "place", "page", "first_chunk", "members", "r.*")


def repaired(records: DataFrame, pages: DataFrame) -> DataFrame:
    """Records whose names' split words are closed up where the source holds the whole word."""

    @F.pandas_udf("array<string>")
    def candidates(names: pd.Series) -> pd.Series:
        return names.map(join_candidates)

    @F.pandas_udf("string")
    def closed(names: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([repaired_name(n, set(w if w is not None else ())) for n, w in zip(names, words, strict=True)], dtype=object)

    asked = records.select("source_file", "compound_name").distinct().withColumn("word", F.explode(candidates("compound_name")))
    words = pages.select("source_file", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("page_text"), F.lit("[a-z]+"), F.lit(0)))).alias("word"))
    held = words.join(asked.select("source_file", "word").distinct(), ["source_file", "word"], "left_semi").distinct()
    known = asked.join(held, ["source_file", "word"]).groupBy("source_file", "compound_name").agg(F.collect_set("word").alias("words"))  # of one name
    both = records.join(known, ["source_file", "compound_name"], "left")
    return both.withColumn("compound_name", closed("compound_name", "words")).drop("words")


def usable_name(name: Column) -> Column:
    """Whether clean_name leaves anything of a name."""

    @F.pandas_udf("boolean")
    def usable(names: pd.Series) -> pd.Series:
        return names.map(lambda n: bool(clean_name(n)))

    return usable(name)


def membership_claims(records: DataFrame, compound_class: str) -> DataFrame:
    """A claim for each component of each record's profile; equal ones once (the last in order)."""
    each = records.filter(F.col("component_profile").isNotNull()).select("*", F.explode("component_profile").alias("component_name", "component_count")).filter("component_name <> '' AND component_count > 0")
    basis = F.concat_ws("|", F.lit(compound_class.casefold()), F.lower("compound_name"), F.lower("component_name"), F.col("component_count").cast("string"), "profile_source", "chunk_id")
    key = ["_name", "_part", "component_count", "_source", "profile_source"]
    keyed = each.withColumns({"_name": F.lower("compound_name"), "_part": F.lower("component_name"), "_source": F.lower("source_file"), "claim_id": F.concat(F.lit("claim_component_membership_"), F.substring(F.sha1(basis), 1, 16)), "mass": F.element_at("component_masses", F.col("component_name"))})
    last = keyed.groupBy(*key).agg(F.max_by(F.struct("claim_id", "compound_name", "component_name", "mass", "chunk_id", "source_file", "page", "evidence_quote"), "ord").alias("c"), F.max("ord").alias("ord"))
    return last.select(
        "ord",
        "c.claim_id",
        F.lit("entity_component_membership").alias("claim_type"),
        F.lit(compound_class).alias("compound_class"),
        F.col("c.compound_name").alias("entity_name"),
        "c.component_name",
        "component_count",
        F.col("profile_source").alias("component_profile_source"),
        F.col("c.mass").alias("component_loss_mass"),
        F.array("c.chunk_id").alias("source_chunk_ids"),
        "c.chunk_id",
        "c.source_file",
        "c.page",
        F.lit("structured_composition_table").alias("source_structure"),
        "c.evidence_quote",
        F.lit("structured_table_mining").alias("claim_source"),
        F.lit("structured").alias("traceability_status"),
        F.lit(0.9).alias("confidence"),
        F.col("c.chunk_id").alias("evidence_ids"),
    )


def mine_tables(chunks: DataFrame, compound_class: str) -> tuple[DataFrame, DataFrame]:
    """Compound claims and component-membership claims of all chunks (chunk_id, source_file, file_type, page, char_start, char_end, text)."""
    pages = pages_of(chunks)
    found = repaired(read_records(pages), pages).filter(usable_name(F.col("compound_name")) | (F.col("kind") == "components"))
    anchor = text.normalize_space(F.col("anchor"))
    owner = F.filter("members", lambda m: text.normalize_space(m["text"]).contains(anchor))
    owned = found.withColumn("chunk_id", F.when((anchor != "") & (F.size(owner) > 0), F.get(owner, F.lit(0))["chunk_id"]).otherwise(F.col("first_chunk"))).drop("members")
    quote = F.when(F.col("evidence_quote") != "", F.col("evidence_quote")).otherwise(F.concat_ws(" ", *[text.nonempty(F.col(c)) for c in ("compound_name", "formula", "exact_mass", "reported_precursor_mz")]))
    # pages in order of source and place, records by name: an order that no partitioning changes
    rows = owned.withColumn("evidence_quote", quote).withColumn("ord", F.struct("source_file", F.coalesce("page", F.lit(-1)).alias("page"), "place", "anchor", "compound_name"))
    fields = ("compound_name", "formula", "exact_mass", "reported_precursor_mz", "evidence_role", "source_structure")
    compounds = rows.filter("kind = 'compound'")
    key = [F.lower(F.coalesce(c, F.lit(""))) if c in ("compound_name", "formula") else F.coalesce(c, F.lit("")) for c in fields]
    keyed = compounds.withColumns({f"_k{i}": k for i, k in enumerate(key)} | {"chunks": F.array("chunk_id"), "ions": text.split_values(F.col("reported_fragments")), "parts": F.to_json("component_profile")})
    first = ["compound_name", "formula", "exact_mass", "reported_precursor_mz", "evidence_role", "specificity_scope", "source_structure", "ion_mode", "adduct", "mass_derivation", "evidence_quote", "chunk_id", "source_file", "page", "parts", "profile_source"]
    merged = evidence.ordered_merge(keyed, [f"_k{i}" for i in range(len(key))], "ord", first=first, union=["ions"], sorted_union=["chunks"])
    claim_id = F.concat(F.lit("claim_struct_"), F.substring(F.sha1(F.concat_ws("|", F.lit(compound_class.lower()), *[F.col(f"_k{i}") for i in range(len(key))])), 1, 16))
    claims = merged.select(
        "ord",
        claim_id.alias("claim_id"),
        F.lit("compound").alias("claim_type"),
        F.lit(compound_class).alias("compound_class"),
        *[c for c in first if c not in ("parts", "profile_source")],
        F.array_join("ions", ";").alias("reported_fragments"),
        F.col("chunks").alias("source_chunk_ids"),
        F.array_join("chunks", ";").alias("evidence_ids"),
        F.col("parts").alias("component_profile"),
        F.col("profile_source").alias("component_profile_source"),
        F.lit("structured_table_mining").alias("claim_source"),
        F.lit("structured").alias("traceability_status"),
        F.lit(0.85).alias("confidence"),
    )
    return claims, membership_claims(rows, compound_class)


def refreshed(existing: DataFrame, mined: DataFrame) -> DataFrame:
    """Claims of other sources as they are, with mined table claims in place of older ones, equal claims merged.

    Both have ``ord`` and the claim fields as text, ``evidence_ids`` and ``reported_fragments`` of values.
    """
    kept = existing.filter(F.coalesce("claim_source", F.lit("")) != "structured_table_mining")
    names = sorted((set(kept.columns) | set(mined.columns)) - {"ord"})

    def full(df: DataFrame, part: int) -> DataFrame:
        cells = [(F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")).alias(c) for c in names]
        return df.select(F.struct(F.lit(part).alias("part"), F.col("ord").cast("string").alias("at")).alias("ord"), *cells)

    rows = full(kept, 0).unionByName(full(mined, 1))
    for c in {"claim_id", "evidence_ids", "reported_fragments"} - set(names):
        rows = rows.withColumn(c, F.lit(None).cast("string"))
    ids = F.array_distinct(F.concat(text.split_values(F.col("evidence_ids")), F.filter(F.array("claim_id"), lambda x: x.isNotNull())))
    lists = {"evidence_ids": ids, "reported_fragments": text.split_values(F.col("reported_fragments"))}
    keyed = evidence.keyed_claims(rows).withColumns(lists)
    merged = evidence.ordered_merge(keyed, ["key"], "ord", first=[c for c in names if c not in lists], union=list(lists))
    return merged.withColumns({c: F.array_join(c, ";") for c in lists}).drop("key")
