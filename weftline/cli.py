"""Command line: analyze, explain, project-scan, corpus audit | train | open-test."""

from __future__ import annotations

import argparse
import dataclasses
import json

from weftline import api
from weftline.operators import project, training
from weftline.operators.scoring import Config
from weftline.session import build
from weftline.sources import reports


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftline")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("analyze", "explain"):
        a = sub.add_parser(name)
        a.add_argument("file")
        a.add_argument("--window", type=int, default=4)
        a.add_argument("--threshold", type=float)
        a.add_argument("--min-prominence", dest="minimum_prominence", type=float)
        a.add_argument("--prominence-radius", type=int)
        a.add_argument("--boundary-reward-weight", type=float)
        a.add_argument("--cut-penalty", type=float)
        a.add_argument("--selection-policy")
        a.add_argument("--project-index")
        a.add_argument("--structured-model")
        if name == "analyze":
            a.add_argument("--json")
        else:
            a.add_argument("--after-line", type=int, required=True)
            a.add_argument("--region")
    s = sub.add_parser("project-scan")
    s.add_argument("root")
    s.add_argument("--json")
    c = sub.add_parser("corpus").add_subparsers(dest="task", required=True)
    a = c.add_parser("audit")
    a.add_argument("folder")
    a.add_argument("--json", required=True)
    t = c.add_parser("train")
    t.add_argument("folder")
    t.add_argument("--artifact", required=True)
    for f in dataclasses.fields(training.TrainingConfig):
        t.add_argument("--" + f.name.replace("_", "-"), type=type(f.default), default=f.default)
    o = c.add_parser("open-test")
    o.add_argument("folder")
    o.add_argument("--artifact", required=True)
    o.add_argument("--report", required=True)
    return p


def run(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = build()
    if args.command == "project-scan":
        index = api.project_scan(spark, args.root).cache()
        rows = index.collect()
        print(f"Files: {len(rows)}\nProject symbols: {len({r.path.rpartition('/')[2] for r in rows})}\nResolved project calls: {sum(len(r.resolved_project_calls) for r in rows)}")
        if args.json:
            project.write_index(index, args.json)
        return 0
    if args.command == "corpus":
        if args.task == "audit":
            report = api.audit(spark, args.folder)
            training.save(report, args.json)
            print(json.dumps(report, indent=2, sort_keys=True))
            return 0 if report["passed"] else 1
        if args.task == "train":
            config = training.TrainingConfig(**{f.name: getattr(args, f.name) for f in dataclasses.fields(training.TrainingConfig)})
            done = api.train(spark, args.folder, args.artifact, config, progress=lambda e: print(f"epoch {e['epoch']} loss {e['train_normalized_structured_nll']:.4f} f1 {e['validation_f1_exact']:.3f}{' *best*' if e['improved'] else ''}", flush=True))
            print(json.dumps(done["selection"], indent=2, sort_keys=True))
            return 0
        print(json.dumps(api.open_test(spark, args.folder, args.artifact, args.report)["test_metrics"], indent=2, sort_keys=True, default=str))
        return 0
    index = project.read_index(spark, args.project_index) if args.project_index else None
    if args.structured_model:
        rows = api.analyze_structured(spark, args.file, training.theta_of(training.load(args.structured_model)), index)
        rows.orderBy("region_id", "boundary_index").show(1000, truncate=False)
        return 0
    config = reports.load_policy(args.selection_policy) if args.selection_policy else Config()
    given = {k: v for k in ("threshold", "minimum_prominence", "prominence_radius", "boundary_reward_weight", "cut_penalty") if (v := getattr(args, k)) is not None}
    analysis = api.analyze(spark, args.file, dataclasses.replace(config, **given), args.window, index=index).cache()
    if args.command == "explain":
        row = api.explain(analysis, args.after_line, args.region)
        print(reports.explanation(analysis.where((analysis.region_id == row.region_id) & (analysis.boundary_index == row.boundary_index))).first().text)
        return 0
    for r in reports.listing(analysis).orderBy("region_id", "boundary_index").collect():
        print(r.region_id, r.line)
    for r in reports.explanation(analysis.where("recommended")).orderBy("region_id", "boundary_index").collect():
        print(r.text)
    if args.json:
        reports.write_json(analysis, args.json)
    return 0


def main() -> None:
    try:
        raise SystemExit(run())
    except (OSError, ValueError) as e:
        raise SystemExit(f"error: {e}") from e


if __name__ == "__main__":
    main()
