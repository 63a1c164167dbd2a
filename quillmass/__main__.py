"""``python -m quillmass STAGE ...``: the stages of a run on paths."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from quillmass.plans import stages
from quillmass.sources import extraction


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="quillmass")
    commands = parser.add_subparsers(dest="stage", required=True)

    def command(name: str, *options: tuple, **defaults) -> None:
        sub = commands.add_parser(name)
        for flag, kind in options:
            sub.add_argument(f"--{flag}", **kind)
        for flag, value in defaults.items():
            sub.add_argument(f"--{flag}", type=type(value), default=value)

    need, many = {"required": True}, {"required": True, "nargs": "+"}
    command("prepare_corpus", ("folder", need), ("out", need), size=1200, overlap=200)
    command("build_index", ("corpus", need), ("out", need))
    command("search", ("index", need), ("queries", many), ("out", need), top_k=12)
    command("plan", ("compound_class", need), ("out", need))
    command("mine_literature", ("corpus", need), ("plan_path", need), ("out", need), top_k=12, most_chunks=40)
    command("mine_diagnostics", ("corpus", need), ("compound_class", need), ("out", need))
    command("infer", ("claims_folder", need), ("out", need))
    command("compile_rules", ("claims_folder", need), ("corpus", need), ("out", need), compound_class="", least_compounds=20, least_fraction=0.2, most=20)
    command("match", ("table", need), ("spectra", need), ("libraries", many), ("mode", {"required": True, "choices": stages.MODES}), ("out", need), seed=42, most_queries=0)
    command("annotate", ("match_folder", need), ("rule_folder", need), ("out", need))
    command("run_all", ("literature", need), ("compound_class", need), ("out", need))
    return parser


def chat_from_environment() -> extraction.Chat | None:
    """A chat model where OPENAI_MODEL, OPENAI_BASE_URL and OPENAI_API_KEY are set."""
    model, url, key = (os.environ.get(f"OPENAI_{n}", "") for n in ("MODEL", "BASE_URL", "API_KEY"))
    return extraction.Chat(model=model, base_url=url, api_key=key) if model and url and key else None


def main(argv: list[str] | None = None) -> int:
    given = vars(arguments().parse_args(argv))
    stage = getattr(stages, given.pop("stage"))
    if "chat" in stage.__annotations__:
        given["chat"] = chat_from_environment()
    spark = SparkSession.builder.appName(f"quillmass-{stage.__name__}").getOrCreate()
    try:
        print(json.dumps(stage(spark, **given), indent=2, sort_keys=True, default=str))
    except (ValueError, OSError, extraction.ExtractionError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
