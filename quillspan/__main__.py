"""Command line: reconstruct, audit, export, analyze, figures, validate and reproduce."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from . import __version__, engine, figures, sinks
from .operators import release


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillspan", description="Analyse logs of writing with suggestions.")
    p.add_argument("--version", action="version", version=f"%(prog)s {__version__}")
    sub = p.add_subparsers(dest="command", required=True)
    texts = {
        "reconstruct": "requests, selections and closes of all sessions; files that cannot be read are listed, and the exit code is 1",
        "audit": "checks of the reconstruction",
        "export": "metric tables as CSV",
        "analyze": "metric and analysis tables as CSV",
        "figures": "the tables of the two figures, and the figures where they can be drawn",
        "validate": "the written tables against frozen counts",
        "reproduce": "all of it in order, stopping at the first failure",
    }
    for name, about in texts.items():
        c = sub.add_parser(name, help=about)
        if name in ("figures", "validate"):
            c.add_argument("--analysis-dir", required=True, help="folder that analyze wrote")
        else:
            c.add_argument("path", help="folder of session logs")
            c.add_argument("--pattern", default="*.jsonl")
        if name == "reconstruct":
            c.add_argument("--summary", action="store_true")
        if name == "export":
            c.add_argument("--layer", choices=("all", *engine.LAYERS), default="all")
        if name == "audit":
            c.add_argument("--which", choices=("all", *engine.AUDITS), default="all")
        if name == "reproduce":
            c.add_argument("--skip-audits", action="store_true")
        if name in ("validate", "reproduce"):
            c.add_argument("--expected", help="JSON file of expected counts in place of the published corpus'")
        if name in ("export", "analyze", "figures", "reproduce"):
            c.add_argument("--out", required=True)
        if name in ("analyze", "reproduce"):
            c.add_argument("--models", action="store_true", help="also clusterings and predictions")
    return p


def reported(rows: DataFrame) -> bool:
    """Prints a short report; whether all its checks hold."""
    found = rows.collect()
    for r in found:
        print("  " + "  ".join(str(v) for v in r))
    return all(r["ok"] for r in found if "ok" in r)


def audited(events: DataFrame, which: str) -> bool:
    ok = True
    for name in engine.AUDITS if which == "all" else (which,):
        print(name)
        ok &= reported(engine.audit(events, name))
    return ok


def exported(spark: SparkSession, events: DataFrame, layers: tuple[str, ...], out: str) -> dict[str, DataFrame]:
    """Writes the layers' tables and reads them back, so that sessions are replayed once for each layer."""
    tables: dict[str, DataFrame] = {}
    for layer in layers:
        tables |= engine.export(events, layer)
    sinks.write_csv(tables, f"{out}/processed", may_be_empty=("selection_metrics", "request_outcomes"))
    return {n: engine.read_csv(spark, f"{out}/processed", n, df.schema) for n, df in tables.items()}


def analyzed(spark: SparkSession, known: dict[str, DataFrame], out: str, models: bool) -> None:
    tables = engine.analyze(known["selection_metrics"], known["session_metrics"], known["target_behavior_metrics"], known["request_outcomes"])
    if models:
        tables |= engine.analyze_clusters(known["ml_session_features"]) | engine.analyze_prediction(known["selection_metrics"])
    sinks.write_csv(tables, f"{out}/analysis", may_be_empty=tuple(tables))
    for name, content in engine.manifests(known["ml_session_features"]).items():
        sinks.write_json(spark, content, f"{out}/analysis/{name}.json")
    labels = list(figures.INDICATOR_LABELS)
    sinks.write_matrix(tables["target_behavior_correlations"], "feature_a", "feature_b", "spearman_rho", labels, f"{out}/analysis/target_behavior_correlation_matrix.csv", missing="nan")


def drawn(spark: SparkSession, analysis: str, out: str) -> None:
    shares = spark.read.option("header", True).option("inferSchema", True).csv(f"{analysis}/target_outcomes_by_ai_share.csv")
    tables = figures.figure_tables(spark, shares, f"{analysis}/target_behavior_correlation_matrix.csv")
    sinks.write_csv(tables, out)
    for path in figures.draw(tables, out):
        print(path)


def validated(spark: SparkSession, analysis: str, expected: str | None) -> bool:
    read = lambda folder, name: spark.read.option("header", True).option("inferSchema", True).csv(f"{folder}/{name}.csv")
    root = analysis.rstrip("/").rsplit("/", 1)[0]
    where = {"processed": ("session_metrics", "selection_metrics", "target_behavior_metrics", "request_outcomes", "ml_session_features"), "figures": ("ai_share_response_outcomes", "trace_indicator_correlations")}
    folder = {n: f"{root}/{f}" for f, names in where.items() for n in names}
    tables = {n: read(folder.get(n, analysis), n) for needs in release.NEEDS.values() for n in needs if n != "sessions"}
    tables["sessions"] = tables["session_metrics"].select("session_id")
    return reported(engine.validate(tables, json.load(open(expected)) if expected else release.EXPECTED))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("quillspan").getOrCreate()
    if args.command == "figures":
        drawn(spark, args.analysis_dir, args.out)
        return 0
    if args.command == "validate":
        return 0 if validated(spark, args.analysis_dir, args.expected) else 1
    if args.command == "reconstruct":
        events, bad = engine.reconstruct(spark, args.path, args.pattern)
        print(engine.summary(events).first().asDict())
        if not args.summary:
            engine.export(events, "modern")["selection_metrics"].show(truncate=False)
        failed = bad.orderBy("path", "line").collect()  # a line for each that cannot be read
        for r in failed:
            print(f"FAIL  {r.path}:{r.line}: {r.error}")
        return 1 if failed else 0
    events = engine.load(spark, args.path, args.pattern)
    if args.command == "audit":
        return 0 if audited(events, args.which) else 1
    if args.command == "export":
        exported(spark, events, engine.LAYERS if args.layer == "all" else (args.layer,), args.out)
        return 0
    stages = [] if getattr(args, "skip_audits", True) else [("audits", lambda: audited(events, "all"))]
    known: dict[str, DataFrame] = {}
    stages += [("export", lambda: known.update(exported(spark, events, engine.LAYERS, args.out))), ("analysis", lambda: analyzed(spark, known, args.out, args.models))]
    if args.command == "reproduce":
        stages.append(("figures", lambda: drawn(spark, f"{args.out}/analysis", f"{args.out}/figures")))
        if args.models:
            stages.append(("validation", lambda: validated(spark, f"{args.out}/analysis", args.expected)))
    for name, stage in stages:
        began = time.perf_counter()
        if stage() is False:
            print(f"stage failed: {name}")
            return 1
        print(f"{name}: {time.perf_counter() - began:.1f} s")
    return 0


if __name__ == "__main__":
    sys.exit(main())
