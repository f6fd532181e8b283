"""Command line: compare three corpora of text files, survey an export of records, simulate power."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import functions as F


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    ap = argparse.ArgumentParser(prog="lexidrift", description=__doc__)
    sub = ap.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compare", help="patterns of one folder of .txt files against two others")
    for name in ("ai", "pre", "contemporary"):
        c.add_argument(f"--{name}", required=True)
    c.add_argument("--output", required=True)
    c.add_argument("--min-ai-docs", type=int, default=2)
    c.add_argument("--min-ai-occurrences", type=int, default=2)
    s = sub.add_parser("survey", help="counts of records by model, domain, attack and decoding")
    s.add_argument("csv")
    p = sub.add_parser("power", help="power over a grid of sources, from a JSON file of parameters")
    p.add_argument("params")
    p.add_argument("--replicates", type=int, default=2000)
    p.add_argument("--seed", type=int, default=20260815)
    p.add_argument("--smoke", action="store_true", help="two grid points and few replicates")
    f = sub.add_parser("first", help="the first study, from the records export and the answers, to a CSV file of verdicts")
    n = sub.add_parser("second", help="the second study, from the records export and a list of excluded sources, to a folder")
    g = sub.add_parser("choose", help="parameters of the records of calibration sources, and the number of sources they ask for")
    for x in (f, n, g):
        x.add_argument("records", help="the records export (CSV)")
    f.add_argument("answers", help="the answers (JSON lines)")
    for x in (n, g):
        x.add_argument("sources", help="a list of source ids: excluded ones, or those to calibrate on")
    for x in (f, n):
        x.add_argument("--output", required=True)
    n.add_argument("--sources-a-phase", type=int, default=70)
    n.add_argument("--resamples", type=int, default=2000)
    return ap.parse_args(argv)


def main(argv: Sequence[str] | None = None) -> int:
    args = arguments(argv)
    from lexidrift.operators import comparison, records, resampling
    from lexidrift.session import build_session
    from lexidrift.sources import readers, writers

    spark = build_session()
    if args.command == "compare":
        frames = [readers.text_folder(spark, getattr(args, c), c) for c in ("ai", "pre", "contemporary")]
        rows = comparison.ranked(comparison.compared(frames[0].unionByName(frames[1]).unionByName(frames[2]), args.min_ai_docs, args.min_ai_occurrences))
        print(f"{writers.result_csv(rows, args.output)} patterns written to {args.output}")
    elif args.command == "survey":
        found = records.survey(records.records(readers.records_csv(spark, args.csv), ("model", "domain", "attack", "decoding")))
        print(writers.summary(found.orderBy("field", F.desc("rows"), "value"), ("field", "value", "rows")))
    elif args.command == "first":
        from lexidrift.plans import studies

        answers = readers.answers_jsonl(spark, args.answers).withColumn("q_id", F.concat_ws(":", "file", "line_no"))
        print(f"{studies.write_first_study(readers.records_csv(spark, args.records), answers, args.output)} candidates written to {args.output}")
    elif args.command == "second":
        from lexidrift.plans import studies

        raid, excluded = readers.records_csv(spark, args.records), readers.exclusion_list(spark, args.sources)
        study = studies.SecondStudy(records.second_study(raid, excluded, args.sources_a_phase), records.sources(raid))
        summary = study.write(excluded, args.output, args.resamples)
        print(f"{summary['discovery_candidates']} candidates, {summary['replicated_patterns']} replicated, written to {args.output}")
    elif args.command == "choose":
        rows = records.calibration_rows(records.records(readers.records_csv(spark, args.records), records.CELL_FIELDS), readers.exclusion_list(spark, args.sources))
        found = resampling.document_params(rows.select(F.col("id").alias("doc_id"), "model", F.col("generation").alias("text")))
        params, quartiles = resampling.measured({k: v for k, v in found.first().asDict().items() if k != "skeletons"}, "the calibration sources")
        print(params)
        print("sources for each domain and phase:", resampling.select_sources(spark, resampling.sensitivity(params, quartiles)))
    else:
        params = readers.params_json(args.params)
        grid, replicates = ((50, 70), 50) if args.smoke else (resampling.GRID, args.replicates)
        curve = resampling.power_curve(spark, params, grid, replicates=replicates, seed=args.seed)
        print(writers.summary(curve.orderBy("sources"), ("sources", "power")))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
