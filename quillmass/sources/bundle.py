"""Rule bundles: tables and artifacts in one directory, with a manifest of row counts and digests; and stage records.

Bundles are small and read as a whole by other tools, so their bytes are written from the driver, ordered, and
refused over MAX_ROWS rows; everything larger is a table of its own.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
import re
import tempfile
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmass.functions import text

SCHEMA_VERSION = "4.0"
MAX_ROWS = 1_000_000
#: The tables and artifacts of a bundle.
TABLES = ("compound_rules", "transformation_rules", "diagnostic_fragment_rules", "neutral_loss_rules", "biosynthetic_component_rules")
ARTIFACTS = ("entity_registry", "entity_forms", "entity_classes", "entity_class_memberships", "evidence_inventory", "fragment_evidence")


def _hadoop(path: str):
    """The file system and path of a URI (scheme://...) in the active session; None for a plain path of this machine."""
    spark = SparkSession.getActiveSession()
    if "://" not in path or spark is None:
        return None
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def local(path: str) -> str:
    return re.sub("^file:/+", "/", path)


def atomic_write(path: str, content: bytes) -> None:
    """Written beside, then renamed: a reader sees the old or the new file. URIs go through Spark's file systems."""
    held = _hadoop(path)
    if held is not None:
        fs, where = held
        beside = where.suffix(f".{os.urandom(6).hex()}.part")
        out = fs.create(beside, True)
        try:
            for at in range(0, len(content), 1 << 22):
                out.write(bytearray(content[at : at + (1 << 22)]))
        finally:
            out.close()
        if fs.exists(where):
            fs.delete(where, False)
        if not fs.rename(beside, where):
            raise OSError(f"could not rename to {path}")
        return
    path = local(path)
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    handle, beside = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(handle, "wb") as file:
        file.write(content)
        file.flush()
        os.fsync(file.fileno())
    os.replace(beside, path)


def exists(path: str) -> bool:
    held = _hadoop(path)
    return held[0].exists(held[1]) if held is not None else os.path.exists(local(path))


def read_bytes(path: str) -> bytes:
    """A file's content; OSError if it cannot be read."""
    held = _hadoop(path)
    if held is None:
        with open(local(path), "rb") as file:
            return file.read()
    fs, where = held
    if not fs.exists(where):
        raise FileNotFoundError(path)
    stream = fs.open(where)
    try:
        return bytes(SparkSession.getActiveSession().sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def read_json(path: str) -> object:
    return json.loads(read_bytes(path))


def write_json(path: str, value: object) -> None:
    atomic_write(path, json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True).encode())


def append_json_line(path: str, row: Mapping) -> None:
    """One line at the end of a log on this machine."""
    os.makedirs(os.path.dirname(os.path.abspath(local(path))), exist_ok=True)
    with open(local(path), "a", encoding="utf-8") as file:
        file.write(json.dumps(row, ensure_ascii=False, default=str) + "\n")


def read_json_lines(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """A table of JSON objects, one in a line, with ``ord`` (their order within each file); lines that are none are an error.

    Blank lines are left out. Every row must have the ``required`` fields as text that is not empty.
    """
    if not exists(path):
        raise FileNotFoundError(path)
    lines = spark.read.text(path).filter(F.btrim("value") != "")
    broken = lines.filter(F.expr("try_parse_json(value)").isNull() | ~F.btrim("value").startswith("{")).limit(1).collect()
    if broken:
        raise ValueError(f"{path}: not a JSON object: {broken[0].value[:80]!r}")
    rows = spark.read.json(path).withColumn("ord", F.monotonically_increasing_id())
    lacking = [c for c in required if c not in rows.columns]
    blank = reduce(lambda a, b: a | b, [F.coalesce(F.col(c).cast("string"), F.lit("")) == "" for c in required if c in rows.columns], F.lit(False))
    if lacking or rows.filter(blank).limit(1).count():
        raise ValueError(f"{path}: rows without {', '.join(lacking or required)}")
    return rows


def write_table(df: DataFrame, path: str, kind: str = "json", compress: bool = False) -> None:
    """A table as a folder of JSON lines or CSV files, written by executors; of any size."""
    writer = df.write.mode("overwrite").option("compression", "gzip" if compress else "none")
    if kind == "json":
        writer.option("ignoreNullFields", False).json(path)
    elif kind == "csv":
        df.select(*[text.serialize_cell(F.col(f.name), f.dataType.simpleString()).alias(f.name) for f in df.schema.fields]).write.mode("overwrite").option("header", True).option("compression", "gzip" if compress else "none").csv(path)
    else:
        raise ValueError(f"unknown kind of file: {kind}")


def canonical(value: object) -> bytes:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()


def digest(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()


def _rows(df: DataFrame) -> list:
    rows = df.limit(MAX_ROWS + 1).collect()
    if len(rows) > MAX_ROWS:
        raise ValueError(f"a bundle table of over {MAX_ROWS} rows; write it as a table of its own")
    return rows


def csv_bytes(df: DataFrame) -> bytes:
    """The table as CSV: cells serialized, rows in the order of all columns, so equal tables have equal bytes."""
    cells = df.select(*[text.serialize_cell(F.col(f.name), f.dataType.simpleString()).alias(f.name) for f in df.schema.fields])
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(df.columns)
    writer.writerows(_rows(cells.orderBy(*df.columns)))
    return ("﻿" + out.getvalue()).encode()


def jsonl_bytes(df: DataFrame) -> bytes:
    return b"".join(canonical(r.asDict(recursive=True)) + b"\n" for r in sorted(_rows(df), key=lambda r: canonical(r.asDict(recursive=True))))


def write_bundle(folder: str, tables: Mapping[str, DataFrame], artifacts: Mapping[str, DataFrame], version: str = "1") -> dict:
    """Exactly the five tables and six artifacts, and their manifest."""
    if set(tables) != set(TABLES) or set(artifacts) != set(ARTIFACTS):
        raise ValueError(f"a bundle has the tables {TABLES} and the artifacts {ARTIFACTS}")
    manifest: dict = {"schema_version": SCHEMA_VERSION, "compiler_version": version, "tables": {}, "artifacts": {}}
    for kind, frames, suffix, dump in (("tables", tables, "csv", csv_bytes), ("artifacts", artifacts, "jsonl", jsonl_bytes)):
        for name, df in sorted(frames.items()):
            content = dump(df)
            atomic_write(f"{folder}/{name}.{suffix}", content)
            manifest[kind][name] = {"file": f"{name}.{suffix}", "columns": df.columns, "row_count": df.count(), "sha256": digest(content)}
    atomic_write(f"{folder}/rules_manifest.json", json.dumps(manifest, indent=2, sort_keys=True).encode())
    return manifest


def validate_bundle(folder: str) -> dict:
    """The manifest, if every file is there with its digest; an error that names the fault otherwise."""
    try:
        manifest = read_json(f"{folder}/rules_manifest.json")
    except (OSError, ValueError) as error:
        raise ValueError(f"no readable manifest in {folder}") from error
    if manifest.get("schema_version") != SCHEMA_VERSION:
        raise ValueError(f"schema {manifest.get('schema_version')!r} is not {SCHEMA_VERSION}")
    for kind, names in (("tables", TABLES), ("artifacts", ARTIFACTS)):
        if set(manifest.get(kind, {})) != set(names):
            raise ValueError(f"{kind} must be {names}")
        for name, entry in manifest[kind].items():
            try:
                content = read_bytes(f"{folder}/{entry['file']}")
            except OSError as error:
                raise ValueError(f"{name}: file is missing") from error
            if digest(content) != entry["sha256"]:
                raise ValueError(f"{name}: digest differs")
    return manifest


def read_bundle(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every table (all text) and artifact of a valid bundle."""
    manifest = validate_bundle(folder)
    out = {}
    for name, entry in manifest["tables"].items():
        schema = ", ".join(f"`{c}` string" for c in entry["columns"])
        out[name] = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(f"{folder}/{entry['file']}").na.fill("")
    for name, entry in manifest["artifacts"].items():
        out[name] = spark.read.json(f"{folder}/{entry['file']}")
    return out


def stage_key(stage: str, version: str, params: Mapping, inputs: Mapping[str, str]) -> str:
    """SHA-256 over a stage, its version, parameters and the digests of its input files."""
    return digest(canonical({"stage": stage, "version": version, "params": dict(params), "inputs": dict(inputs)}))


def file_digest(path: str) -> str:
    return digest(read_bytes(path))


def commit_stage(record: str, stage: str, version: str, params: Mapping, inputs: list[str], outputs: list[str]) -> None:
    """Record that ``outputs`` are what the stage makes of ``inputs``."""
    found = {p: file_digest(p) for p in inputs}
    entry = {"key": stage_key(stage, version, params, found), "params": dict(params), "inputs": found, "outputs": {p: file_digest(p) for p in outputs}}
    atomic_write(record, json.dumps(entry, sort_keys=True).encode())


def stage_status(record: str, stage: str, version: str, params: Mapping, inputs: list[str], outputs: list[str]) -> str:
    """hit, or why the stage must run again."""
    if not exists(record):
        return "missing_record"
    try:
        entry = read_json(record)
        known = entry["inputs"], entry["outputs"], entry["params"], entry["key"]
    except (ValueError, KeyError, TypeError):
        return "invalid_record"
    if not all(map(exists, inputs)):
        return "missing_input"
    found = {p: file_digest(p) for p in inputs}
    if known[0] != found:
        return "input_mismatch"
    if known[2] != json.loads(canonical(dict(params))) or known[3] != stage_key(stage, version, params, found):
        return "parameter_mismatch"
    if set(known[1]) != set(outputs):
        return "output_set_mismatch"
    if not all(map(exists, outputs)):
        return "missing_output"
    return "hit" if all(file_digest(p) == d for p, d in known[1].items()) else "output_mismatch"
