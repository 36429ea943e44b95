"""Labelled corpora: manifest, split map, sources, policy, audit, examples."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.metrics import distribution

SEGMENT = "struct<region_id:string,start_line:int,end_line:int>"
BOUNDARY = "struct<region_id:string,boundary:int,after_line:int,label:string>"
PROVENANCE = "struct<project:string,source_kind:string,annotation_status:string,annotation_confidence:string,source_sha256:string,revision:string>"
MANIFEST = f"sample_id string, split string, relative_path string, source_sha256 string, segments array<{SEGMENT}>, boundaries array<{BOUNDARY}>, provenance {PROVENANCE}, _corrupt_record string"
SPLITS = ("train", "validation", "test")
CUT_LABELS = ("preferred_cut", "acceptable_cut")
#: Source kinds that may not or may be trained on.
FORBIDDEN_KINDS = ("real_project", "github_real", "external_unlabeled", "detection_only")
TRAINABLE_KINDS = ("curated_real_gold",)
DEFAULT_REGION = "script:top-level"


def read_manifest(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """One row for each line; malformed lines are kept in _corrupt_record."""
    rows = spark.read.schema(MANIFEST).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows if split is None else rows.where(F.col("split") == split)


def read_split_map(spark: SparkSession, path: str) -> DataFrame:
    """project, split."""
    rows = spark.read.schema("projects map<string,string>").option("multiLine", True).json(path)
    return rows.select(F.explode("projects").alias("project", "split"))


def read_sources(spark: SparkSession, folder: str, pattern: str = "*.m") -> DataFrame:
    """path (below the folder), content, sha256 of every file, recursively."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    base = F.lit(folder.rstrip("/") + "/")
    below = F.element_at(F.split(F.col("path"), base, 2), -1)
    return rows.select(below.alias("path"), "content", F.sha2("content", 256).alias("sha256"))


def policy_violation() -> Column:
    """The first rule of provenance that a record breaks, or null."""
    p = lambda k: F.col(f"provenance.{k}")
    kind, status = p("source_kind"), p("annotation_status")
    curated = kind == "curated_real_gold"
    blank = lambda c: c.isNull() | (c == "")
    return (
        F.when(kind.isNull(), "no_source_kind")
        .when(kind.isin(*FORBIDDEN_KINDS), "forbidden_source_kind")
        .when(curated & ~F.coalesce(status.isin("expert_accepted", "user_adjudicated"), F.lit(False)), "not_reviewed")
        .when(curated & (status == "expert_accepted") & ~F.coalesce(p("annotation_confidence") == "high", F.lit(False)), "not_high_confidence")
        .when(curated & (blank(p("source_sha256")) | blank(p("revision"))), "no_immutable_provenance")
        .when(~kind.isin(*TRAINABLE_KINDS), "unapproved_source_kind")
    )


def require_trainable(manifest: DataFrame) -> DataFrame:
    """The manifest, if every record may be trained on."""
    bad = manifest.select("sample_id", policy_violation().alias("rule")).where("rule is not null").orderBy("sample_id").first()
    if bad:
        raise ValueError(f"{bad.sample_id}: {bad.rule}")
    return manifest


def _regions(manifest: DataFrame, field: str) -> DataFrame:
    rows = manifest.select("sample_id", "split", "relative_path", "provenance.project", F.explode(field).alias("e"))
    return rows.select("sample_id", "split", F.col("relative_path").alias("path"), "project", F.coalesce("e.region_id", F.lit(DEFAULT_REGION)).alias("region_id"), "e")


def truth(manifest: DataFrame) -> DataFrame:
    """path, region_id, sample_id, project, split, cuts (sorted) of each annotated region."""
    segments = _regions(manifest, "segments").groupBy("sample_id", "path", "region_id", "project", "split").agg(F.count("*").alias("segments"))
    cut = F.when(F.col("e.label").isin(*CUT_LABELS), F.col("e.boundary"))
    found = _regions(manifest, "boundaries").groupBy(F.col("sample_id").alias("s"), F.col("path").alias("p"), F.col("region_id").alias("r")).agg(F.array_sort(F.collect_list(cut)).alias("cuts"), F.max(F.col("e.boundary").isNull().cast("int")).alias("missing"))
    # a sample_id may recur (duplicates tells which do): each path has cuts of its own
    rows = segments.join(found, (F.col("sample_id") == F.col("s")) & F.col("path").eqNullSafe(F.col("p")) & (F.col("region_id") == F.col("r")), "left")
    fail = F.when(F.col("missing") == 1, F.raise_error(F.concat("sample_id", F.lit(":"), "region_id", F.lit(" lacks statement-index truth"))).cast("array<int>"))
    cuts = F.coalesce(fail, "cuts", F.array().cast("array<int>"))
    return rows.select("path", "region_id", F.concat("sample_id", F.lit(":"), "region_id").alias("sample_id"), F.coalesce("project", F.lit("unknown")).alias("project"), "split", cuts.alias("cuts"))


def duplicates(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("sample_id").agg(F.count("*").alias("n")).where("n > 1")


def split_leakage(manifest: DataFrame) -> DataFrame:
    """Projects that occur in more than one split."""
    return manifest.where(F.col("split").isin(*SPLITS) & F.col("provenance.project").isNotNull()).groupBy(F.col("provenance.project").alias("project")).agg(F.array_sort(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1)


def audit_errors(manifest: DataFrame, sources: DataFrame, statements: DataFrame, facts: DataFrame) -> DataFrame:
    """subject, error: every constraint a labelled corpus breaks; the corpus passes if there is none.

    manifest: read_manifest, sources: read_sources, statements and facts: of the sources' frontend.
    """
    one = lambda df, subject, error: df.select(subject.alias("subject"), error.alias("error"))
    text = lambda s: F.lit(s)
    ok = manifest.where(F.col("_corrupt_record").isNull())
    name = F.coalesce("sample_id", F.lit("<missing>"))
    out = [one(manifest.where(F.col("_corrupt_record").isNotNull()), F.lit("manifest"), text("invalid JSON"))]
    out.append(one(duplicates(ok), F.col("sample_id"), text("duplicate sample_id")))
    out.append(one(ok.withColumn("rule", policy_violation()).where("rule is not null"), name, F.concat(F.lit("policy: "), "rule")))
    out.append(one(ok.where(~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))), name, text("invalid split")))
    out.append(one(ok.where(F.col("provenance.project").isNull()), name, text("missing provenance project")))
    out.append(one(split_leakage(ok), F.col("project"), text("project split leakage")))
    known = sources.select(F.col("path").alias("relative_path"), "sha256")
    joined = ok.join(known, "relative_path", "left")
    out.append(one(joined.where("sha256 is null"), name, text("source is missing")))
    out.append(one(joined.where("sha256 is not null and not (sha256 <=> source_sha256)"), name, text("record source hash mismatch")))
    out.append(one(joined.where("sha256 is not null and not (sha256 <=> provenance.source_sha256)"), name, text("provenance source hash mismatch")))
    out.append(one(known.join(ok, "relative_path", "left_anti"), F.col("relative_path"), text("unreferenced source")))
    seg = _regions(ok, "segments").groupBy("sample_id", "path", "region_id").agg(F.count("*").alias("segments"))
    size = statements.groupBy("path", "region_id").agg(F.count("*").alias("n"))
    seg = seg.join(size, ["path", "region_id"], "left")
    subject = F.concat("sample_id", F.lit(":"), "region_id")
    out.append(one(seg.where("n is null"), subject, text("annotated region is missing")))
    marks = _regions(ok, "boundaries").select("sample_id", "path", "region_id", "e.boundary", "e.label")
    by = marks.groupBy("sample_id", "region_id").agg(F.count("*").alias("k"), F.countDistinct("boundary").alias("distinct"), F.min("boundary").alias("low"), F.max("boundary").alias("high"), F.sum(F.col("label").isin(*CUT_LABELS).cast("int")).alias("cuts"), F.max(F.col("boundary").isNull().cast("int")).alias("gap"))
    both = seg.where("n is not null").join(by, ["sample_id", "region_id"], "left").na.fill(0, ["k", "distinct", "cuts", "gap"])
    whole = F.col("gap") == 0
    out.append(one(both.where("gap = 1"), subject, text("non-integer statement boundary")))
    out.append(one(both.where(whole & (F.col("k") != F.col("distinct"))), subject, text("duplicate statement boundary")))
    out.append(one(both.where(whole & ((F.col("distinct") != F.col("n") - 1) | (F.coalesce("low", F.lit(1)) < 1) | (F.coalesce("high", F.lit(0)) > F.col("n") - 1))), subject, text("boundary truth is not exhaustive")))
    out.append(one(both.where(whole & (F.col("segments") != F.col("cuts") + 1)), subject, text("segment and cut counts disagree")))
    held = marks.join(seg.where("n is not null").select("sample_id", "region_id"), ["sample_id", "region_id"]).join(facts.select("path", "region_id", F.col("boundary_index").alias("boundary"), "constraints"), ["path", "region_id", "boundary"], "left")
    spot = F.concat(subject, F.lit(":S"), F.col("boundary").cast("string"))
    out.append(one(held.where("boundary is not null and constraints is null"), spot, text("boundary not analyzable")))
    out.append(one(held.where(F.col("label").isin(*CUT_LABELS) & (F.size("constraints") > 0)), spot, F.concat(F.lit("true cut violates "), F.array_join("constraints", ","))))
    rows = out[0]
    for x in out[1:]:
        rows = rows.unionByName(x)
    return rows


def audit_counts(manifest: DataFrame) -> DataFrame:
    """split, files, regions, modules, cuts, projects."""
    ok = manifest.where(F.col("split").isin(*SPLITS))
    files = ok.groupBy("split").agg(F.count("*").alias("files"), F.countDistinct("provenance.project").alias("projects"))
    seg = _regions(ok, "segments").groupBy("split").agg(F.countDistinct("sample_id", "region_id").alias("regions"), F.count("*").alias("modules"))
    cuts = _regions(ok, "boundaries").groupBy("split").agg(F.sum(F.col("e.label").isin(*CUT_LABELS).cast("long")).alias("cuts"))
    return files.join(seg, "split", "left").join(cuts, "split", "left").na.fill(0)


def reliability_report(facts: DataFrame, manifest: DataFrame) -> DataFrame:
    """channel, count, minimum, mean, p10, median over the annotated boundaries."""
    at = _regions(manifest, "boundaries").select("path", "region_id", F.col("e.boundary").alias("boundary_index"))
    channels = F.array(*(F.struct(F.lit(c).alias("channel"), F.col(f"reliability.{c}").alias("value")) for c in ("parse", "call_resolution", "dependency", "role", "effect")))
    rows = facts.join(at, ["path", "region_id", "boundary_index"]).select(F.explode(channels).alias("x")).select("x.*")
    return distribution(rows, "value", "channel")


def reason_codes(facts: DataFrame) -> DataFrame:
    return facts.select(F.explode("reliability.reason_codes").alias("code")).groupBy("code").count()


def merkle(leaves: DataFrame, each: int = 256) -> str:
    """The root of a hash tree over the column `leaf` (hexadecimal SHA-256 hashes), independent of the rows' order.

    A leaf lies under the leading digits of its hash; equal leaves are one with their number. Nodes hash their children in
    order, sixteen at a time, with so many levels that a lowest node has about `each` leaves. Only the root, and the number
    of leaves, reach the driver.
    """
    counted = leaves.groupBy("leaf").count()
    n, depth = counted.count(), 0
    while n > each * 16**depth:
        depth += 1
    told = F.concat("leaf", F.lit(":"), F.col("count").cast("string"))
    nodes = counted.groupBy(F.substring("leaf", 1, depth).alias("place")).agg(F.array_sort(F.collect_list(told)).alias("parts"))
    nodes = nodes.select("place", F.sha2(F.array_join("parts", ","), 256).alias("node"))
    for d in range(depth - 1, -1, -1):
        nodes = nodes.groupBy(F.substring("place", 1, d).alias("place")).agg(F.array_sort(F.collect_list(F.struct("place", "node"))).alias("parts"))
        nodes = nodes.select("place", F.sha2(F.array_join(F.transform("parts", lambda x: x["node"]), ","), 256).alias("node"))
    root = nodes.first()
    return root.node if root else hashlib.sha256(b"").hexdigest()


def leaf(kind: str, name: Column, digest: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(kind), name, digest), 256).alias("leaf")


def dataset_hash(manifest_lines: DataFrame, sources: DataFrame) -> str:
    """A hash of manifest and sources: of per-line and per-file hashes, added up as a tree in tasks."""
    lines = manifest_lines.select(leaf("line", F.lit(""), F.sha2("value", 256)))
    return merkle(lines.unionByName(sources.select(leaf("source", F.col("path"), F.col("sha256")))))


def identity(spark: SparkSession, folder: str, pattern: str = "*.m") -> dict:
    """The dataset's hash, splits and projects; raises if sources, hashes or the declared split don't hold."""
    manifest = read_manifest(spark, f"{folder}/manifest.jsonl")
    sources = read_sources(spark, folder, pattern).select("path", "sha256")
    declared = read_split_map(spark, f"{folder}/split_projects.json").withColumnRenamed("split", "declared")
    rows = manifest.select("sample_id", "split", F.col("relative_path").alias("path"), F.coalesce("source_sha256", "provenance.source_sha256").alias("want"), "provenance.project").join(sources, "path", "left").join(declared, "project", "left")
    error = F.when(F.col("sha256").isNull(), "missing supervised source").when(F.col("sha256") != F.col("want"), "source hash mismatch").when(~F.col("declared").eqNullSafe(F.col("split")), "project split mismatch")
    bad = rows.select("sample_id", "project", error.alias("error")).where("error is not null").orderBy("sample_id").first()
    if bad:
        raise ValueError(f"{bad.error}: {bad.sample_id} ({bad.project})")
    if leak := split_leakage(manifest).first():
        raise ValueError(f"project leakage across splits: {leak.project}")
    by = {r.split: r for r in rows.groupBy("split").agg(F.array_sort(F.collect_set("sample_id")).alias("samples"), F.array_sort(F.collect_set("project")).alias("projects")).collect()}
    lines = spark.read.text(f"{folder}/manifest.jsonl").unionByName(spark.read.option("wholetext", True).text(f"{folder}/split_projects.json"))
    used = sources.join(manifest.select(F.col("relative_path").alias("path")), "path", "left_semi")
    return {
        "dataset_sha256": dataset_hash(lines, used), "record_count": manifest.count(), "projects": sum(len(r.projects) for r in by.values()),
        "split_samples": {s: list(by[s].samples) if s in by else [] for s in SPLITS}, "split_projects": {s: list(by[s].projects) if s in by else [] for s in SPLITS},
    }
