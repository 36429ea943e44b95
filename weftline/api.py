"""The engine's entry points: analyse, explain, scan a project, audit, train, open the sealed test."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import energy, facts, flow, project, quality, scoring, training
from weftline.schema import KEY
from weftline.session import materialize, shipped
from weftline.sources import corpus, mlang
from weftline.sources.registry import default


@shipped
def program(spark: SparkSession, path: str, index: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Statements and dependence edges of a path; source files have flow graphs, other frontends linear def-use."""
    frontend = default().select(path)
    if frontend is not mlang.read:
        if index is not None:
            raise ValueError("a project index applies to source files only")
        return frontend(spark, path), None
    folder, _, name = path.rpartition("/")
    regions = materialize(mlang.programs(corpus.read_sources(spark, folder or ".", name)), "regions")
    st = mlang.statements(regions)
    return (st if index is None else project.enrich(st, index)), flow.projected(regions, include_internal=True)


@shipped
def analyze(spark: SparkSession, path: str, config: scoring.Config = scoring.Config(), window: int = 4, medium: int = 12, index: DataFrame | None = None) -> DataFrame:
    """Every boundary with facts, features, score, peak, prominence, rejections, recommendation, adjacent quality."""
    st, edges = program(spark, path, index)
    between = None if edges is None else edges.where("source <> target")
    rows = scoring.analyze(st, between, config, window, medium, edges)
    near = quality.adjacent_quality(st, window, edges).withColumnRenamed("split", "boundary_index")
    return rows.join(near, [*KEY, "boundary_index"], "left")


@shipped
def analyze_structured(spark: SparkSession, path: str, theta: np.ndarray, index: DataFrame | None = None) -> DataFrame:
    st, edges = program(spark, path, index)
    return energy.structured_analysis(st, theta, edges)


def explain(analysis: DataFrame, after_line: int, region: str | None = None):
    """The one boundary after a line, as a row."""
    rows = analysis.where(F.col("after_line") == after_line)
    if region is not None:
        rows = rows.where(F.col("region_id") == region)
    found = rows.limit(50).collect()
    if not found:
        raise ValueError("no legal boundary found after that line")
    if len(found) > 1:
        raise ValueError(f"boundary is ambiguous; choose a region from: {', '.join(r.region_id for r in found)}")
    return found[0]


@shipped
def region_semantics(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A source file's regions with their flow graphs, the dependence graph of each, and the facts of each boundary."""
    folder, _, name = path.rpartition("/")
    regions = materialize(mlang.programs(corpus.read_sources(spark, folder or ".", name)), "regions")
    graph = flow.dependence_graph(regions)
    return {"regions": regions, "graph": graph, "facts": facts.boundary_facts(mlang.statements(regions), flow.semantic_def_use(regions))}


@shipped
def project_scan(spark: SparkSession, root: str) -> DataFrame:
    regions = materialize(mlang.programs(corpus.read_sources(spark, root)), "regions")
    return project.scan(project.worker_summary(regions))


@shipped
def corpus_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    sources = corpus.read_sources(spark, folder)
    regions = materialize(mlang.programs(sources), "regions")
    st = mlang.statements(regions)
    edges = flow.projected(regions, include_internal=True)
    data = edges.where("kind = 'DATA' and source <> target").select(*KEY, "source", "target", "symbol").distinct()
    return {"manifest": materialize(corpus.read_manifest(spark, f"{folder}/manifest.jsonl"), "manifest"), "sources": sources, "statements": st, "edges": edges, "facts": facts.boundary_facts(st, data)}


@shipped
def audit(spark: SparkSession, folder: str) -> dict:
    t = corpus_tables(spark, folder)
    rows = corpus.audit_errors(t["manifest"], t["sources"], t["statements"], t["facts"]).orderBy("subject", "error").collect()
    return {
        "passed": not rows, "errors": [f"{r.subject}: {r.error}" for r in rows], "splits": {r.split: {k: v for k, v in r.asDict().items() if k != "split"} for r in corpus.audit_counts(t["manifest"]).collect()},
        "reliability": {r.channel: r.asDict() for r in corpus.reliability_report(t["facts"], t["manifest"]).collect()}, "reliability_reason_codes": {r.code: r["count"] for r in corpus.reason_codes(t["facts"]).collect()},
    }


@shipped
def corpus_examples(spark: SparkSession, folder: str, splits: tuple[str, ...]) -> DataFrame:
    t = corpus_tables(spark, folder)
    chosen = corpus.require_trainable(t["manifest"].where(F.col("split").isin(*splits)))
    return training.examples_of(t["statements"], corpus.truth(chosen), t["edges"])


@shipped
def train(spark: SparkSession, folder: str, artifact: str, config: training.TrainingConfig = training.TrainingConfig(), progress=None) -> dict:
    """Trains and selects on train and validation, writes the artifact; the test split is not read."""
    who = corpus.identity(spark, folder)
    payload = training.train(corpus_examples(spark, folder, ("train", "validation")), config, progress=progress)
    payload |= {"dataset": who, "source_commit": training.source_commit(folder)}
    training.save(payload, artifact)
    return payload


@shipped
def open_test(spark: SparkSession, folder: str, artifact: str, report: str) -> dict:
    return training.open_sealed_test(corpus_examples(spark, folder, ("test",)), corpus.identity(spark, folder)["dataset_sha256"], artifact, report)
