"""Command line: init-config, doctor, run FILE, batch DIRECTORY.

Exit codes of run and batch: 0 all clean, 1 something failed (an empty directory too), 2 a person has to look at something.
"""

from __future__ import annotations

import argparse
import os
import sys
from datetime import datetime, timezone

from sparkveil import __version__, options, providers
from sparkveil.plans.pipeline import deidentify
from sparkveil.sources import sinks, transcripts
from sparkveil.storage import cut_lineage, temporary_tables


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("sparkveil").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _options() -> options.Options:
    return options.from_env({**options.read_settings_file(".env"), **os.environ})


def init_config(path: str, local: bool, force: bool) -> int:
    if os.path.exists(path) and not force:
        print(f"{path} is already there; --force replaces it", file=sys.stderr)
        return 1
    with open(path, "w", encoding="utf-8") as f:
        f.write(options.template(local))
    print(f"wrote {path}")
    return 0


def doctor() -> int:
    try:
        chosen = _options()
        models = providers.list_models(chosen)
    except (ValueError, OSError, KeyError) as error:
        print(f"FAILED: {error}", file=sys.stderr)
        return 1
    if chosen.model not in models:
        print(f"FAILED: {chosen.base_url} has no model {chosen.model}", file=sys.stderr)
        return 1
    print(f"OK: {'local' if chosen.loopback else 'remote'} {chosen.provider} endpoint {chosen.base_url}; model {chosen.model}")
    return 0


def metadata(chosen: options.Options | None) -> dict:
    now = datetime.now(timezone.utc).isoformat().replace("+00:00", "Z")
    return {"model": chosen.model if chosen else "none", "model_digest": providers.model_digest(chosen) if chosen else None, "pipeline_version": __version__, "started_at_utc": now}


def process(path: str, output: str, transcript_id: str | None = None, model: bool = True, spark=None) -> int:
    """One job over all files; a failing file is reported and doesn't stop the others."""
    spark = spark or _session()
    single = os.path.isfile(path)
    if not single and not any(name.lower().endswith((".txt", ".json")) for name in (os.listdir(path) if os.path.isdir(path) else ())):
        print(f"no .txt or .json files in {path}", file=sys.stderr)
        return 1
    try:
        chosen = _options() if model else None
        run = metadata(chosen)
    except (ValueError, OSError, RuntimeError) as error:
        print(f"FAILED: {error}", file=sys.stderr)
        return 1
    with temporary_tables(spark):
        return _process(spark, transcripts.load(transcripts.discover(spark, path, single), transcript_id), os.path.abspath(output), chosen, run)


def _process(spark, loaded: transcripts.Loaded, output: str, chosen: options.Options | None, run: dict) -> int:
    """What fails, in reading or in the model, is reported by file and left out of the results; the rest is written."""
    turns, failures = loaded.turns, loaded.errors.select("path", "message")
    paths = loaded.files.select("transcript_id", "path")
    mentions = residuals = None
    if chosen and not turns.isEmpty():
        turns = cut_lineage(turns)
        answers = providers.from_model(turns, chosen)
        failures = failures.unionByName(answers.errors.join(paths, "transcript_id").select("path", "message"))
        turns, mentions = turns.join(answers.errors, "transcript_id", "left_anti"), answers.rows
        late: list[providers.Answers] = []

        def residuals(redacted):
            late.append(providers.residuals_from_model(redacted, chosen))
            return late[0].rows

    done = review = 0
    if not turns.isEmpty():
        result = deidentify(turns, mentions, residuals, chosen.low_confidence_threshold if chosen else 0.5, run)
        if chosen and late:
            failures = failures.unionByName(late[0].errors.join(paths, "transcript_id").select("path", "message"))
            result = result.without(late[0].errors)
        written = cut_lineage(sinks.write_files(result, output))
        told = written.join(result.reports.select("transcript_id", "n_spans", "n_review_items"), "transcript_id").join(paths, "transcript_id")
        for r in told.orderBy("path").toLocalIterator():
            print(f"{r.transcript_id}: status={r.status}, {r.n_spans} replacements, {r.n_review_items} review items")
            done, review = done + 1, review + (r.status == "needs_review")
    failed = 0
    for r in failures.orderBy("path").toLocalIterator():
        print(f"FAILED {r.path}: {r.message}", file=sys.stderr)
        failed += 1
    print(f"processed {done + failed}, needs review {review}, failed {failed}")
    return 1 if failed or not done else 2 if review else 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sparkveil", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    init = commands.add_parser("init-config", help="write a settings file")
    init.add_argument("-o", "--output", default=".env")
    init.add_argument("--local", action="store_true")
    init.add_argument("--force", action="store_true")
    commands.add_parser("doctor", help="check the settings and the model")
    for name, what in (("run", "one transcript"), ("batch", "all transcripts of a directory")):
        command = commands.add_parser(name, help=f"de-identify {what}")
        command.add_argument("input")
        command.add_argument("--output-dir", default="output")
        command.add_argument("--no-model", action="store_true", help="structured patterns only")
        if name == "run":
            command.add_argument("--id")
    args = parser.parse_args(argv)
    if args.command == "init-config":
        return init_config(args.output, args.local, args.force)
    if args.command == "doctor":
        return doctor()
    return process(args.input, args.output_dir, getattr(args, "id", None), not args.no_model)


if __name__ == "__main__":
    sys.exit(main())
