"""Command line: run the pipeline over recordings, show its report of each, what is in them, or what can be chosen."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="kinelake", description="Motion analytics over many recordings at once.")
    sub = parser.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="recordings to tables of cycles, curves, figures and scores")
    run.add_argument("input", help="path or glob of JSON documents")
    run.add_argument("output", help="folder of the results")
    run.add_argument("--settings", help="JSON or YAML file")
    run.add_argument("--csv", action="store_true", help="CSV rather than Parquet")
    info = sub.add_parser("info", help="what recordings hold")
    info.add_argument("input")
    analyze = sub.add_parser("analyze", help="figures, patterns and warnings of each recording, on the screen")
    analyze.add_argument("input")
    analyze.add_argument("--settings", help="JSON or YAML file")
    sub.add_parser("choices", help="registered steps, angle methods, event methods and backends")
    asked = parser.parse_args(arguments)
    if asked.command == "choices":
        from kinelake.operators import backends, events, pose, signals

        for what, names in (("steps", signals.list_steps()), ("angle methods", pose.list_angle_methods()), ("event methods", events.list_event_methods()), ("backends", backends.list_models())):
            print(f"{what}: {', '.join(names)}")
        return 0

    from kinelake.plans import pipeline
    from kinelake.sources import pivot, settings, sinks

    spark = SparkSession.builder.getOrCreate()
    documents = pivot.read_documents(spark, asked.input)
    if asked.command == "info":
        documents.select("trial_id", "status.kind", "meta.fps", _frames(), "extraction.model").show(truncate=False)
        return 0
    results = pipeline.run(documents, settings.load(asked.settings) if asked.settings else None)
    if asked.command == "analyze":
        shown = ["trial_id", "cadence", "speed", "stance_pct", "overall_si", "cycle_duration_cv", "flags", "patterns", "warnings"]
        results.report.join(results.diagnosis.select("trial_id", "warnings"), "trial_id").select(*shown).show(truncate=False)
        results.release()
        return 0
    tables = {"angles": results.angles, "events": results.events, "cycles": results.cycles}
    if asked.csv:
        sinks.write_csv(tables | {"stats": sinks.statistics_long(results.figures)}, asked.output)
    else:
        for name, df in (tables | {"curves": results.curves, "summary": results.summary, "figures": results.figures, "gvs": results.gvs, "gps": results.gps, "quality": results.quality, "report": results.report, "diagnosis": results.diagnosis, "phases": results.phases}).items():
            df.write.mode("overwrite").parquet(f"{asked.output}/{name}")
    results.errors.write.mode("overwrite").json(f"{asked.output}/errors")
    results.outcome.write.mode("overwrite").json(f"{asked.output}/outcome")
    failed = results.outcome.filter("status = 'error'").count()
    if failed:
        print(f"{failed} recordings failed, see errors and outcome")
    results.release()
    return 0


def _frames():
    from pyspark.sql import functions as F

    return F.size("frames").alias("n_frames")


if __name__ == "__main__":
    raise SystemExit(main())
