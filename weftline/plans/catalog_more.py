"""Further registered queries: metrics, corpus rules, programs rendered from tables, flow graphs, structured model."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import dependence, energy, facts, flow, metrics, project, segments, semantic, training
from weftline.operators.pieces import map_rows
from weftline.operators.quality import MODULE_WEIGHTS
from weftline.plans import catalog
from weftline.plans.catalog import events, flat, read, register
from weftline.plans.oracle import chain
from weftline.schema import KEY
from weftline.session import materialize
from weftline.sources import corpus, mlang

# matching and metrics: cuts after purchases against cuts after large purchases and sign-ups


def samples(spark, sf_dir) -> DataFrame:
    st = events(spark, sf_dir)
    value = read(spark, sf_dir, "events").select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("region_id"), "ts", "event_id", "value", "event_type", "user_id")
    cut = lambda cond: F.array_sort(F.filter(F.collect_list(F.when(cond, F.col("idx") + 1)), lambda x: x.isNotNull()))
    rows = st.select("region_id", "idx", "kind", F.col("call_sites")[0]["is_only_operation"].alias("big"))
    out = rows.groupBy("region_id").agg(cut(F.col("kind") == "purchase").alias("predicted"), cut(((F.col("kind") == "purchase") & F.col("big")) | (F.col("kind") == "signup")).alias("truth"), F.count("*").cast("int").alias("n"))
    who = value.select("region_id", "user_id").distinct()
    out = out.join(who, "region_id")
    return out.select("region_id", F.concat(F.lit("p"), (F.col("user_id") % 7).cast("string")).alias("project"), F.when(F.col("user_id") % 3 == 0, "script").otherwise("function").alias("region_kind"), metrics.length_bucket(F.col("n")).alias("length_bucket"), "predicted", "truth", (F.col("n") / 10.0).alias("nll"), (F.col("n") % 2).cast("int").alias("violations"))


SAMPLES = [
    ("mt", "SELECT region_id, count(*) FILTER (kind = 'purchase' AND v >= 20) AS tp, count(*) FILTER (kind = 'purchase' AND v < 20) AS fp, count(*) FILTER (kind = 'signup') AS fn, count(*) AS n, CAST(split_part(region_id, ':', 2) AS BIGINT) AS u FROM st GROUP BY 1"),
    ("ms", "SELECT *, 'p' || (u % 7) AS project, CASE WHEN u % 3 = 0 THEN 'script' ELSE 'function' END AS region_kind, CASE WHEN n < 30 THEN 'short_lt_30' WHEN n <= 80 THEN 'medium_30_80' ELSE 'long_gt_80' END AS bucket FROM mt"),
]
#: greedy matching within 1 and 2: each prediction takes its nearest free truth
GREEDY = [
    ("pt", "SELECT region_id, coalesce(list(idx + 1 ORDER BY idx) FILTER (kind = 'purchase'), []) AS p, coalesce(list(idx + 1 ORDER BY idx) FILTER ((kind = 'purchase' AND v >= 20) OR kind = 'signup'), []) AS t FROM st GROUP BY 1"),
    ("gm", """SELECT region_id, tol, p, len(t) AS nt, t AS free, 0 AS i, 0 AS hit FROM pt, (VALUES (1), (2)) x(tol) UNION ALL
        SELECT region_id, tol, p, nt, CASE WHEN near IS NULL THEN free ELSE list_filter(free, lambda x: x <> near) END, i + 1, hit + CASE WHEN near IS NULL THEN 0 ELSE 1 END FROM (SELECT *, list_min(list_transform(list_filter(free, lambda x: abs(p[i + 1] - x) <= tol), lambda x: abs(p[i + 1] - x) * 1000000 + x)) % 1000000 AS near FROM gm WHERE i < len(p))"""),
    ("gr", "SELECT region_id, tol, CAST(hit AS BIGINT) AS tp, CAST(len(p) - hit AS BIGINT) AS fp, CAST(nt - hit AS BIGINT) AS fn FROM gm WHERE i = len(p)"),
]
PRF = "CASE WHEN tp + fp > 0 THEN tp * 1.0 / (tp + fp) WHEN tp + fn > 0 THEN 0.0 ELSE 1.0 END"
REC = "CASE WHEN tp + fn > 0 THEN tp * 1.0 / (tp + fn) WHEN tp + fp > 0 THEN 0.0 ELSE 1.0 END"


def rates_sql(by: str) -> str:
    return f"SELECT *, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM (SELECT *, {PRF} AS p, {REC} AS r FROM ({by}))"


@register("q_match_exact", chain("mt", "SELECT region_id, tp, fp, fn FROM mt", SAMPLES))
def match_exact(spark, sf_dir):
    return flat(metrics.matched(samples(spark, sf_dir)).select("region_id", "tp", "fp", "fn"))


@register("q_match_tolerance", chain("gr", "SELECT region_id, tp, fp, fn FROM gr WHERE tol = 1", GREEDY))
def match_tolerance(spark, sf_dir):
    return flat(metrics.matched(samples(spark, sf_dir), 1).select("region_id", "tp", "fp", "fn"))


#: as GREEDY within 1, with the loose predictions kept; errors are the ignored positions
IGNORED = [
    ("pi", "SELECT region_id, coalesce(list(idx + 1 ORDER BY idx) FILTER (kind = 'purchase'), []) AS p, coalesce(list(idx + 1 ORDER BY idx) FILTER (kind = 'signup'), []) AS t, coalesce(list(idx + 1 ORDER BY idx) FILTER (kind = 'error'), []) AS g FROM st GROUP BY 1"),
    ("gi", """SELECT region_id, p, t, g, t AS free, 0 AS i, 0 AS hit, 0 AS wrong FROM pi UNION ALL
        SELECT region_id, p, t, g, CASE WHEN near IS NULL THEN free ELSE list_filter(free, lambda x: x <> near) END, i + 1, hit + CASE WHEN near IS NULL THEN 0 ELSE 1 END, wrong + CASE WHEN near IS NULL AND len(list_filter(g, lambda x: abs(p[i + 1] - x) <= 1)) = 0 THEN 1 ELSE 0 END
        FROM (SELECT *, list_min(list_transform(list_filter(free, lambda x: abs(p[i + 1] - x) <= 1), lambda x: abs(p[i + 1] - x) * 1000000 + x)) % 1000000 AS near FROM gi WHERE i < len(p))"""),
]


@register("q_match_ignored", chain("gi", "SELECT region_id, CAST(hit AS BIGINT) AS tp, CAST(wrong AS BIGINT) AS fp, CAST(len(free) AS BIGINT) AS fn FROM gi WHERE i = len(p)", IGNORED))
def match_ignored(spark, sf_dir):
    """Cuts after purchases against cuts after sign-ups, within 1; those near an error count neither way."""
    at = lambda kind: F.array_sort(F.filter(F.collect_list(F.when(F.col("kind") == kind, F.col("idx") + 1)), lambda x: x.isNotNull()))
    rows = events(spark, sf_dir).groupBy("region_id").agg(at("purchase").alias("predicted"), at("signup").alias("truth"), at("error").alias("ignored"))
    return flat(metrics.matched(rows, 1, "ignored").select("region_id", "tp", "fp", "fn"))


@register("q_micro_prf", chain("ms", f"SELECT project, tp, fp, fn, precision, recall, f1 FROM ({rates_sql('SELECT project, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM ms GROUP BY 1')})", SAMPLES))
def micro_prf(spark, sf_dir):
    return flat(metrics.micro(metrics.matched(samples(spark, sf_dir)), "project"))


_SETS = "SELECT CASE WHEN grouping(project) = 0 THEN 'project' WHEN grouping(region_kind) = 0 THEN 'region_kind' WHEN grouping(bucket) = 0 THEN 'length_bucket' ELSE 'overall' END AS stratum, coalesce(project, region_kind, bucket, 'all') AS name, count(*) AS samples, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg(n / 10.0) AS nll, avg(CASE WHEN fp = 0 AND fn = 0 THEN 1.0 ELSE 0.0 END) AS same, avg(abs(fp - fn)) AS err, avg(greatest(fp - fn, 0)) AS over, avg(greatest(fn - fp, 0)) AS under, CAST(sum(n % 2) AS BIGINT) AS violations FROM ms GROUP BY GROUPING SETS ((), (project), (region_kind), (bucket))"
_ROLL = "samples, precision AS precision_exact, recall AS recall_exact, f1 AS f1_exact, round(nll, 6) AS structured_nll, round(same, 6) AS exact_segmentation_accuracy, round(err, 6) AS average_cut_count_error, round(over, 6) AS average_overcut, round(under, 6) AS average_undercut, violations AS hard_constraint_violations"


@register("q_metrics_rollup", chain("ms", f"SELECT stratum, name, {_ROLL} FROM ({rates_sql(_SETS)})", SAMPLES))
def metrics_rollup(spark, sf_dir):
    rows = metrics.rollup(samples(spark, sf_dir)).where("stratum <> 'project_macro'")
    return flat(rows.drop(*(c for c in rows.columns if "tolerance" in c)))


_NAMES = ("exact", "tolerance_1", "tolerance_2")
_RATE = {n: (f"CASE WHEN tp_{n} + fp_{n} > 0 THEN tp_{n} * 1.0 / (tp_{n} + fp_{n}) WHEN tp_{n} + fn_{n} > 0 THEN 0.0 ELSE 1.0 END", f"CASE WHEN tp_{n} + fn_{n} > 0 THEN tp_{n} * 1.0 / (tp_{n} + fn_{n}) WHEN tp_{n} + fp_{n} > 0 THEN 0.0 ELSE 1.0 END") for n in _NAMES}
_ALL = [
    ("my", "SELECT ms.*, a.tp AS tp1, a.fp AS fp1, a.fn AS fn1, z.tp AS tp2, z.fp AS fp2, z.fn AS fn2 FROM ms JOIN gr a ON a.region_id = ms.region_id AND a.tol = 1 JOIN gr z ON z.region_id = ms.region_id AND z.tol = 2"),
    ("rs", _SETS.replace("FROM ms", "FROM my").replace("sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn", ", ".join(f"sum({c}{k}) AS {c}_{n}" for n, k in zip(_NAMES, ("", "1", "2")) for c in ("tp", "fp", "fn")))),
    ("rp", "SELECT *, " + ", ".join(f"{p} AS precision_{n}, {r} AS recall_{n}" for n, (p, r) in _RATE.items()) + " FROM rs"),
    ("rfs", "SELECT *, " + ", ".join(f"CASE WHEN precision_{n} + recall_{n} > 0 THEN 2 * precision_{n} * recall_{n} / (precision_{n} + recall_{n}) ELSE 0.0 END AS f1_{n}" for n in _NAMES) + " FROM rp"),
]
_COLS = [f"{c}_{n}" for n in _NAMES for c in ("precision", "recall", "f1")]
_REST = {"nll": "structured_nll", "same": "exact_segmentation_accuracy", "err": "average_cut_count_error", "over": "average_overcut", "under": "average_undercut"}


def _rolled(head: str, f: str, violations: str, tail: str) -> str:
    return f"SELECT {head}, {', '.join(f'round({f}({c}), 6) AS {c}' for c in _COLS)}, {', '.join(f'round({f}({k}), 6) AS {v}' for k, v in _REST.items())}, {violations} AS hard_constraint_violations FROM rfs {tail}"


@register("q_metrics_rollup_all", chain("rfs", _rolled("stratum, name, samples", "", "violations", "") + " UNION ALL " + _rolled("'project_macro', 'all', count(*)", "avg", "CAST(sum(violations) AS BIGINT)", "WHERE stratum = 'project'"), [*SAMPLES, *GREEDY, *_ALL]))
def metrics_rollup_all(spark, sf_dir):
    return flat(metrics.rollup(samples(spark, sf_dir)))


@register("q_distribution", "SELECT event_type, count(*) AS count, round(min(value), 6) AS minimum, round(avg(value), 6) AS mean, round(list_sort(list(value))[CAST(round_even((count(*) - 1) * 0.1, 0) AS BIGINT) + 1], 6) AS p10, round(list_sort(list(value))[CAST(round_even((count(*) - 1) * 0.5, 0) AS BIGINT) + 1], 6) AS median FROM events GROUP BY 1")
def distribution(spark, sf_dir):
    return flat(metrics.distribution(read(spark, sf_dir, "events"), "value", "event_type"))


# a labelled manifest made of documents and labels

SPLIT = "CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'validation' ELSE 'test' END"
KIND = "CASE doc_id % 8 WHEN 0 THEN 'real_project' WHEN 1 THEN NULL WHEN 2 THEN 'sketch' ELSE 'curated_real_gold' END"
STATUS = "CASE doc_id % 5 WHEN 0 THEN 'draft' WHEN 1 THEN 'user_adjudicated' ELSE 'expert_accepted' END"
CONFIDENCE = "CASE WHEN doc_id % 7 < 5 THEN 'high' ELSE 'medium' END"
PROJECT = "CASE WHEN doc_id % 97 = 0 THEN 'shared' ELSE source END"
REVISION = "CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'r1' END"


def manifest(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    n = (F.col("n_chars") % 5 + 1).cast("int")
    segments = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.lit("script:top-level").alias("region_id"), (i * 10).alias("start_line"), (i * 10 + 9).alias("end_line")))
    labels = F.array(*(F.lit(x) for x in ("preferred_cut", "acceptable_cut", "discouraged_cut", "no_cut")))
    bounds = F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda i: F.struct(F.lit(None).cast("string").alias("region_id"), i.alias("boundary"), (i * 10).alias("after_line"), F.get(labels, ((F.col("doc_id") + i) % 4).cast("int")).alias("label")))
    prov = F.struct(F.expr(PROJECT).alias("project"), F.expr(KIND).alias("source_kind"), F.expr(STATUS).alias("annotation_status"), F.expr(CONFIDENCE).alias("annotation_confidence"), F.lit("aa").alias("source_sha256"), F.expr(REVISION).alias("revision"))
    rows = docs.select(F.concat(F.lit("d"), (F.col("doc_id") - F.col("doc_id") % 3 * F.when(F.col("doc_id") % 50 == 1, 1).otherwise(0)).cast("string")).alias("sample_id"), F.expr(SPLIT).alias("split"), F.concat(F.lit("sources/"), F.col("doc_id").cast("string")).alias("relative_path"), F.lit("aa").alias("source_sha256"), segments.alias("segments"), bounds.alias("boundaries"), prov.alias("provenance"))
    return rows.withColumn("_corrupt_record", F.lit(None).cast("string"))


SAMPLE_ID = "'d' || (doc_id - (doc_id % 3) * CASE WHEN doc_id % 50 = 1 THEN 1 ELSE 0 END)"


@register("q_audit_duplicates", f"SELECT {SAMPLE_ID} AS sample_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def audit_duplicates(spark, sf_dir):
    return flat(corpus.duplicates(manifest(spark, sf_dir)))


_TREE = """WITH lf AS (SELECT leaf, count(*) AS c FROM (SELECT sha256('line||' || sha256(lang || ':' || source)) AS leaf FROM documents UNION ALL SELECT sha256('source|sources/' || doc_id || '|' || sha256(text)) FROM documents) GROUP BY 1),
    dp AS (SELECT min(d) AS depth FROM range(12) t(d) WHERE (SELECT count(*) FROM lf) <= 256 * 16 ** d),
    l0 AS (SELECT leaf[1:depth] AS place, depth, sha256(string_agg(leaf || ':' || c, ',' ORDER BY leaf)) AS node FROM lf, dp GROUP BY 1, 2)"""
_LEVELS = "".join(f", l{k + 1} AS (SELECT CASE WHEN depth > 0 THEN place[1:depth - 1] ELSE '' END AS place, greatest(depth - 1, 0) AS depth, CASE WHEN any_value(depth) > 0 THEN sha256(string_agg(node, ',' ORDER BY place)) ELSE any_value(node) END AS node FROM l{k} GROUP BY 1, 2, depth)" for k in range(6))


@register("q_dataset_hash", f"{_TREE}{_LEVELS} SELECT node AS dataset_sha256 FROM l6")
def dataset_hash(spark, sf_dir):
    """The hash tree over all documents as sources, and a line of a manifest for each."""
    docs = read(spark, sf_dir, "documents")
    lines = docs.select(F.concat("lang", F.lit(":"), "source").alias("value"))
    root = corpus.dataset_hash(lines, docs.select(F.concat(F.lit("sources/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256")))
    return spark.createDataFrame([(root,)], "dataset_sha256 string")


@register("q_split_leakage", f"SELECT {PROJECT} AS project, string_agg(DISTINCT {SPLIT}, ',' ORDER BY {SPLIT}) AS splits FROM documents GROUP BY 1 HAVING count(DISTINCT {SPLIT}) > 1")
def split_leakage(spark, sf_dir):
    return flat(corpus.split_leakage(manifest(spark, sf_dir)))


@register("q_source_anti_join", "SELECT 'sources/' || doc_id AS relative_path, CASE WHEN l.doc_id IS NULL THEN 'missing' END AS state FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) WHERE l.doc_id IS NULL")
def source_anti_join(spark, sf_dir):
    have = read(spark, sf_dir, "labels").select(F.concat(F.lit("sources/"), F.col("doc_id").cast("string")).alias("relative_path"))
    return manifest(spark, sf_dir).join(have, "relative_path", "left_anti").select("relative_path", F.lit("missing").alias("state"))


@register("q_policy_gate", f"""SELECT rule, count(*) AS n FROM (SELECT CASE WHEN k IS NULL THEN 'no_source_kind' WHEN k = 'real_project' THEN 'forbidden_source_kind' WHEN k = 'curated_real_gold' AND s NOT IN ('expert_accepted', 'user_adjudicated') THEN 'not_reviewed'
    WHEN k = 'curated_real_gold' AND s = 'expert_accepted' AND c <> 'high' THEN 'not_high_confidence' WHEN k = 'curated_real_gold' AND r = '' THEN 'no_immutable_provenance' WHEN k <> 'curated_real_gold' THEN 'unapproved_source_kind' ELSE 'trainable' END AS rule FROM (SELECT {KIND} AS k, {STATUS} AS s, {CONFIDENCE} AS c, {REVISION} AS r FROM documents)) GROUP BY 1""")
def policy_gate(spark, sf_dir):
    return manifest(spark, sf_dir).groupBy(F.coalesce(corpus.policy_violation(), F.lit("trainable")).alias("rule")).agg(F.count("*").alias("n"))


#: a corpus with faults: every sequence a source with its truth, spoiled by the user's number
_FAULTS = [
    ("am", "SELECT *, 'u' || u AS sample_id, CASE WHEN k = 5 THEN 'ghost:region' ELSE 'script:top-level' END AS region, CASE WHEN u % 11 = 0 THEN 'nope' WHEN u % 10 < 7 THEN 'train' WHEN u % 10 < 9 THEN 'validation' ELSE 'test' END AS split, CASE WHEN u % 13 = 0 THEN NULL WHEN u % 17 = 0 THEN 'shared' ELSE 'p' || (u % 20) END AS project FROM (SELECT region_id, n, u, u % 7 AS k FROM (SELECT *, CAST(split_part(region_id, ':', 2) AS BIGINT) AS u FROM n))"),
    ("ab0", "SELECT am.*, st.idx + 1 AS boundary, st.kind = 'purchase' AS cut FROM am JOIN st ON st.region_id = am.region_id AND st.idx + 1 < am.n"),
    ("ab", "SELECT * FROM ab0 WHERE k <> 1 OR boundary <> n - 1 UNION ALL SELECT * FROM ab0 WHERE k = 2 AND boundary = 1 UNION ALL SELECT *, NULL, false FROM am WHERE k = 3 UNION ALL SELECT *, n + 5, false FROM am WHERE k = 6"),
    ("ag", "SELECT region_id, count(*) AS c, count(DISTINCT boundary) AS d, min(boundary) AS low, max(boundary) AS high, count(*) FILTER (cut) AS cuts, bool_or(boundary IS NULL) AS gap FROM ab GROUP BY 1"),
    ("sk", "SELECT region_id, count(*) FILTER (cut) + 1 AS segments FROM ab0 GROUP BY 1"),
    ("bo", "SELECT am.*, sample_id || ':' || region AS subject, coalesce(c, 0) AS c, coalesce(d, 0) AS d, coalesce(low, 1) AS low, coalesce(high, 0) AS high, coalesce(cuts, 0) AS cuts, coalesce(gap, false) AS gap, coalesce(segments, 1) + CASE WHEN k = 4 THEN 1 ELSE 0 END AS segments FROM am LEFT JOIN ag ON ag.region_id = am.region_id LEFT JOIN sk ON sk.region_id = am.region_id WHERE k <> 5"),
    ("he", "SELECT ab.sample_id || ':' || ab.region || ':S' || ab.boundary AS subject, ab.cut, fx.constraints FROM ab LEFT JOIN fx ON fx.region_id = ab.region_id AND fx.b + 1 = ab.boundary WHERE ab.k <> 5 AND ab.boundary IS NOT NULL"),
]


@register("q_audit", chain("am", """SELECT sample_id AS subject, 'policy: no_immutable_provenance' AS error FROM am WHERE u % 31 = 0 UNION ALL SELECT sample_id, 'invalid split' FROM am WHERE u % 11 = 0 UNION ALL SELECT sample_id, 'missing provenance project' FROM am WHERE u % 13 = 0
    UNION ALL SELECT project, 'project split leakage' FROM am WHERE split <> 'nope' AND project IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1 UNION ALL SELECT sample_id, 'source is missing' FROM am WHERE u % 19 = 0 UNION ALL SELECT sample_id, unnest(['record source hash mismatch', 'provenance source hash mismatch']) FROM am WHERE u % 23 = 0 AND u % 19 <> 0
    UNION ALL SELECT 'extra.m', 'unreferenced source' UNION ALL SELECT sample_id || ':' || region, 'annotated region is missing' FROM am WHERE k = 5 UNION ALL SELECT subject, 'non-integer statement boundary' FROM bo WHERE gap UNION ALL SELECT subject, 'duplicate statement boundary' FROM bo WHERE NOT gap AND c <> d
    UNION ALL SELECT subject, 'boundary truth is not exhaustive' FROM bo WHERE NOT gap AND (d <> n - 1 OR low < 1 OR high > n - 1) UNION ALL SELECT subject, 'segment and cut counts disagree' FROM bo WHERE NOT gap AND segments <> cuts + 1 UNION ALL SELECT subject, 'boundary not analyzable' FROM he WHERE constraints IS NULL UNION ALL SELECT subject, 'true cut violates ' || constraints FROM he WHERE cut AND constraints <> ''""", _FAULTS))
def audit(spark, sf_dir):
    st = events(spark, sf_dir)
    user = F.split("region_id", ":")[1].cast("long")
    placed = lambda df: df.withColumn("path", F.concat(F.lit("src/"), user.cast("string"), F.lit(".m"))).withColumn("region_id", F.lit("script:top-level"))
    mark = lambda b, label: F.struct(F.lit(None).cast("string").alias("region_id"), b.cast("int").alias("boundary"), b.cast("int").alias("after_line"), label.alias("label"))
    label = F.when(F.col("kind") == "purchase", "preferred_cut").otherwise("no_cut")
    rows = st.groupBy("region_id").agg(F.count("*").cast("int").alias("n"), F.array_sort(F.collect_list(F.struct((F.col("idx") + 1).alias("b"), label.alias("l")))).alias("all")).withColumn("u", user).withColumn("k", F.col("u") % 7)
    rows = rows.withColumn("m", F.transform(F.filter("all", lambda x: x["b"] < F.col("n")), lambda x: mark(x["b"], x["l"])))
    more = lambda b: F.concat("m", F.array(mark(b, F.lit("no_cut"))))
    spoiled = F.when(F.col("k") == 1, F.slice("m", 1, F.greatest(F.lit(0), F.size("m") - 1))).when(F.col("k") == 2, F.concat("m", F.slice("m", 1, 1))).when(F.col("k") == 3, more(F.lit(None))).when(F.col("k") == 6, more(F.col("n") + 5)).otherwise(F.col("m"))
    cuts = F.size(F.filter("m", lambda x: x["label"] == "preferred_cut")) + F.when(F.col("k") == 4, 2).otherwise(1)
    region = F.when(F.col("k") == 5, "ghost:region")
    # the ghost's boundaries lie in the ghost
    spoiled = F.transform(spoiled, lambda x: x.withField("region_id", region))
    segments = F.transform(F.sequence(F.lit(1), cuts), lambda i: F.struct(region.alias("region_id"), i.alias("start_line"), i.alias("end_line")))
    project = F.when(F.col("u") % 13 == 0, None).when(F.col("u") % 17 == 0, "shared").otherwise(F.concat(F.lit("p"), (F.col("u") % 20).cast("string")))
    split = F.when(F.col("u") % 11 == 0, "nope").when(F.col("u") % 10 < 7, "train").when(F.col("u") % 10 < 9, "validation").otherwise("test")
    prov = F.struct(project.alias("project"), F.lit("curated_real_gold").alias("source_kind"), F.lit("expert_accepted").alias("annotation_status"), F.lit("high").alias("annotation_confidence"), F.lit("aa").alias("source_sha256"), F.when(F.col("u") % 31 == 0, "").otherwise("r1").alias("revision"))
    path = F.concat(F.lit("src/"), F.col("u").cast("string"), F.lit(".m"))
    records = rows.select(F.concat(F.lit("u"), F.col("u").cast("string")).alias("sample_id"), split.alias("split"), path.alias("relative_path"), F.lit("aa").alias("source_sha256"), segments.alias("segments"), spoiled.alias("boundaries"), prov.alias("provenance"), F.lit(None).cast("string").alias("_corrupt_record"))
    files = rows.where("u % 19 <> 0").select(path.alias("path"), F.when(F.col("u") % 23 == 0, "bb").otherwise("aa").alias("sha256")).unionByName(spark.createDataFrame([("extra.m", "aa")], "path string, sha256 string"))
    return corpus.audit_errors(records, files, placed(st), placed(facts.boundary_facts(st)))


@register("q_example_cuts", f"""SELECT 'sources/' || doc_id AS path, {SAMPLE_ID} || ':script:top-level' AS sample_id, {PROJECT} AS project, {SPLIT} AS split, coalesce((SELECT string_agg(i, ',' ORDER BY i) FROM range(1, 7) t(i) WHERE i <= d.n_chars % 5 + 1 AND (d.doc_id + i) % 4 < 2), '') AS cuts FROM documents d""")
def example_cuts(spark, sf_dir):
    return flat(corpus.truth(manifest(spark, sf_dir)).drop("region_id"))


@register("q_access_domain_regex", r"SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(url, '[a-z]+\.[a-z]+'))), ',') AS domains FROM pages")
def access_domain_regex(spark, sf_dir):
    found = F.array_sort(F.array_distinct(F.regexp_extract_all("url", F.lit(r"([a-z]+\.[a-z]+)"), 1)))
    return flat(read(spark, sf_dir, "pages").select("page_id", found.alias("domains")))


@register("q_reachability", chain("tc", "SELECT region_id, source, target FROM tc", [("tc", "SELECT region_id, src AS source, tgt AS target FROM ed UNION SELECT tc.region_id, tc.source, ed.tgt FROM tc JOIN ed ON ed.region_id = tc.region_id AND ed.src = tc.target")]))
def reachability(spark, sf_dir):
    """Statements that a value reaches in any number of uses; each step doubles the number of uses, until nothing new is found."""
    key = ["region_id", "source", "target"]
    found = materialize(dependence.linear_def_use(events(spark, sf_dir)).select(*key).distinct(), "reached")
    size, last = found.count(), -1
    while size != last:
        hop = found.select("region_id", F.col("source").alias("target"), F.col("target").alias("next"))
        more = found.join(hop, ["region_id", "target"]).select("region_id", "source", F.col("next").alias("target"))
        found = materialize(found.unionByName(more).distinct(), "reached")
        size, last = found.count(), size
    return flat(found)


# programs rendered from conversations

ROLES = ("acquisition", "transformation", "aggregation", "normalization", "shaping", "decision", "output")


def graphs(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    conv = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("turn"))
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    t, c = F.col("turn"), F.col("conv_id")
    gid = F.concat(F.lit("conv"), c.cast("string"))
    text = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    tasks = conv.select(gid.alias("graph_id"), t.alias("ordinal"), text("t", t).alias("task_id"), pick(ROLES, (c + t) % 7).alias("role"), F.when(t == 0, F.array().cast("array<string>")).otherwise(F.array(text("x", t - 1))).alias("inputs"), F.array(text("x", t)).alias("outputs"), (t % 3 + 1).alias("steps"), pick(semantic.CONTROLS, (c + t) % 7).alias("control"), (t % 2).alias("tail"), text("m", F.floor(t / 2)).alias("module_id"))
    bounds = conv.where("turn % 3 = 1").select(gid.alias("graph_id"), text("b", t).alias("boundary_id"), text("t", t).alias("left_task_id"), text("t", t + 1).alias("right_task_id"), F.when(c % 2 == 0, "ambiguous").otherwise("cut").alias("label"))
    ops = spark.createDataFrame([], semantic.OPERATION)
    links = spark.createDataFrame([], "graph_id string, source_op string, target_op string")
    return tasks, ops, links, bounds


GRAPHS = """WITH tk AS (SELECT 'conv' || conv_id AS graph_id, conv_id AS c, CAST(turn AS BIGINT) AS t, turn % 3 + 1 AS steps, turn % 2 AS tail FROM conversations)"""


@register("q_task_boundaries", f"""{GRAPHS}, w AS (SELECT *, lead(t) OVER (PARTITION BY graph_id ORDER BY t) AS nt, sum(steps + tail) OVER (PARTITION BY graph_id ORDER BY t) AS cut FROM tk)
    SELECT graph_id, 't' || t AS left_task_id, 't' || nt AS right_task_id, CASE WHEN t % 3 = 1 AND nt = t + 1 THEN (CASE WHEN c % 2 = 0 THEN 'ambiguous' ELSE 'cut' END) WHEN t // 2 = nt // 2 THEN 'no_cut' ELSE 'cut' END AS label, CAST(cut AS BIGINT) AS cut FROM w WHERE nt IS NOT NULL""")
def task_boundaries(spark, sf_dir):
    tasks, _, _, bounds = graphs(spark, sf_dir)
    return flat(semantic.boundary_truth(tasks, bounds).select("graph_id", "left_task_id", "right_task_id", "label", "cut"))


@register("q_resolved_ops", f"""{GRAPHS}, o AS (SELECT *, unnest(range(1, CAST(steps + tail + 1 AS BIGINT))) AS i FROM tk)
    SELECT graph_id, 't' || t || CASE WHEN i > steps THEN '.completion' || (i - steps) ELSE '.op' || i END AS op_id, CASE WHEN i > steps THEN 't' || t || '.final' || (i - steps) ELSE 'x' || t END AS definitions, CASE WHEN i = 1 THEN (CASE WHEN t = 0 THEN '' ELSE 'x' || (t - 1) END) WHEN i - 1 > steps THEN 't' || t || '.final' || (i - 1 - steps) ELSE 'x' || t END AS reads FROM o""")
def resolved_ops(spark, sf_dir):
    tasks, ops, _, _ = graphs(spark, sf_dir)
    return flat(semantic.resolved_operations(tasks, ops).select("graph_id", "op_id", "definitions", "reads"))


@register("q_graph_violations", f"{GRAPHS} SELECT DISTINCT graph_id, 'boundary references an unknown task' AS error FROM tk a WHERE t % 3 = 1 AND NOT EXISTS (SELECT 1 FROM tk b WHERE b.graph_id = a.graph_id AND b.t = a.t + 1)")
def graph_violations(spark, sf_dir):
    return semantic.violations(*graphs(spark, sf_dir))


def sources(spark, sf_dir) -> DataFrame:
    tasks, ops, _, bounds = graphs(spark, sf_dir)
    return semantic.rendered(tasks, ops, bounds).select(F.concat("graph_id", F.lit(".m")).alias("path"), F.encode("source", "UTF-8").alias("content"))


def _case(key: str, table: dict[str, str], other: str = "NULL") -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {other} END"


def _texts(lines: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in lines) + "]"


#: the same graphs' symbols, names, lines and truth, by SQL
_DRAWN = f"""{GRAPHS.replace("WITH tk", "WITH tk0")}, tk AS (SELECT *, {_texts(list(ROLES))}[(c + t) % 7 + 1] AS role, {_texts(list(semantic.CONTROLS))}[(c + t) % 7 + 1] AS control, CASE WHEN t = 0 THEN [] ELSE ['x' || (t - 1)] END AS inputs, CASE WHEN t = 0 THEN 't0_condition' ELSE 'x' || (t - 1) END AS condition FROM tk0),
    w AS (SELECT *, lead(t) OVER (PARTITION BY graph_id ORDER BY t) AS nt FROM tk),
    bo AS (SELECT graph_id, t, 't' || t || '->t' || nt AS own, CASE WHEN t % 3 = 1 AND nt = t + 1 THEN (CASE WHEN c % 2 = 0 THEN 'ambiguous' ELSE 'cut' END) WHEN t // 2 = nt // 2 THEN 'no_cut' ELSE 'cut' END AS label, CASE WHEN t % 3 = 1 AND nt = t + 1 THEN 'b' || t ELSE 't' || t || '->t' || nt END AS boundary_id FROM w WHERE nt IS NOT NULL),
    o AS (SELECT *, t * 10000 + i AS op, 't' || t || CASE WHEN i > steps THEN '.completion' || (i - steps) ELSE '.op' || i END AS op_id, CASE WHEN i > steps THEN 't' || t || '.final' || (i - steps) ELSE 'x' || t END AS def, CASE WHEN i = 1 THEN inputs WHEN i - 1 > steps THEN ['t' || t || '.final' || (i - 1 - steps)] ELSE ['x' || t] END AS reads FROM (SELECT *, unnest(range(1, CAST(steps + tail + 1 AS BIGINT))) AS i FROM tk)),
    us AS (SELECT graph_id, t, op, 0 AS pos, unnest(reads) AS symbol FROM o UNION ALL SELECT graph_id, t, op, len(reads), def FROM o UNION ALL SELECT graph_id, t, -1, 0, condition FROM tk WHERE control <> 'none'),
    fu AS (SELECT *, 'v' || lpad(CAST(CAST('0x' || substr(md5('0:' || symbol), 1, 8) AS BIGINT) % 1000 AS VARCHAR), 3, '0') AS base FROM us QUALIFY row_number() OVER (PARTITION BY graph_id, symbol ORDER BY t, op, pos) = 1),
    nm AS (SELECT graph_id, symbol, base || CASE WHEN k > 1 THEN '_' || k ELSE '' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, base ORDER BY t, op, pos, symbol) AS k FROM fu)),
    ol AS (SELECT o.graph_id, t, CASE WHEN i > steps THEN 3 ELSE 1 END AS part, op, op_id, CASE WHEN i > steps OR control = 'none' THEN '' WHEN control IN ('nested', 'loop_branch') THEN repeat(' ', 8) ELSE repeat(' ', 4) END || d.name || ' = ' || replace({_case("CASE WHEN i > steps THEN 'shaping' ELSE role END", {k: "'" + v + "'" for k, v in semantic.TEMPLATES.items()}, "'{x} + 1'")}, '{{x}}', coalesce(r.name, 'randn(16, 1)')) || ';' AS text, CASE WHEN i > steps OR control = 'none' THEN 1 ELSE 0 END AS counts
        FROM o JOIN nm d ON d.graph_id = o.graph_id AND d.symbol = o.def LEFT JOIN nm r ON r.graph_id = o.graph_id AND r.symbol = o.reads[1]),
    fr AS (SELECT tk.graph_id, t, part, unnest(range(len(texts))) AS op, NULL AS op_id, unnest(texts) AS raw, name FROM (SELECT tk.*, 0 AS part, {_case("control", {k: _texts(v) for k, v in semantic.OPENING.items()})} AS texts FROM tk UNION ALL SELECT tk.*, 2, {_case("control", {k: _texts(v) for k, v in semantic.CLOSING.items()})} FROM tk) tk JOIN nm ON nm.graph_id = tk.graph_id AND nm.symbol = tk.condition WHERE control <> 'none'),
    li AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY t, part, op) AS line FROM (SELECT graph_id, t, part, op, op_id, text, counts FROM ol UNION ALL SELECT graph_id, t, part, op, op_id, replace(raw, '{{c}}', name), CASE WHEN part = 0 AND op = 0 THEN 1 ELSE 0 END FROM fr)),
    rg AS (SELECT graph_id, t, sum(n) OVER (PARTITION BY graph_id ORDER BY t) AS cut FROM (SELECT graph_id, t, sum(counts) AS n FROM li GROUP BY 1, 2)),
    tr AS (SELECT bo.*, cut FROM bo JOIN rg USING (graph_id, t)),
    tj AS (SELECT graph_id, '[' || string_agg('{{"ordinal":' || t || ',"task_id":"t' || t || '","role":"' || role || '","inputs":[' || CASE WHEN t = 0 THEN '' ELSE '"x' || (t - 1) || '"' END || '],"outputs":["x' || t || '"],"steps":' || steps || ',"control":"' || control || '","tail":' || tail || ',"module_id":"m' || (t // 2) || '"}}', ',' ORDER BY t) || ']' AS j FROM tk GROUP BY 1),
    bj AS (SELECT graph_id, '[' || string_agg('{{"boundary_id":"b' || t || '","left_task_id":"t' || t || '","right_task_id":"t' || (t + 1) || '","label":"' || CASE WHEN c % 2 = 0 THEN 'ambiguous' ELSE 'cut' END || '"}}', ',' ORDER BY 'b' || t) || ']' AS j FROM tk WHERE t % 3 = 1 GROUP BY 1),
    pi AS (SELECT tj.graph_id, sha256(tj.j || coalesce(bj.j, '[]')) AS semantic_program_id FROM tj LEFT JOIN bj USING (graph_id))"""


@register("q_program_id", f"{_DRAWN} SELECT graph_id, semantic_program_id FROM pi")
def program_id(spark, sf_dir):
    tasks, _, _, bounds = graphs(spark, sf_dir)
    return semantic.program_id(tasks, bounds)


@register("q_render", f"""{_DRAWN} SELECT a.graph_id, a.source, coalesce(b.true_cuts, '') AS true_cuts, coalesce(b.ambiguous, '') AS ambiguous, sha256(concat_ws('|', semantic_program_id, 'vectorized', '0', a.places, coalesce(b.bounds, ''))) AS trace
    FROM (SELECT graph_id, string_agg(text, chr(10) ORDER BY line) || chr(10) AS source, string_agg(op_id || ':' || line, ',' ORDER BY line) AS places FROM li GROUP BY 1) a JOIN pi USING (graph_id)
    LEFT JOIN (SELECT graph_id, string_agg(cut, ',' ORDER BY t) FILTER (label = 'cut') AS true_cuts, string_agg(cut, ',' ORDER BY t) FILTER (label = 'ambiguous') AS ambiguous, string_agg(boundary_id || ':' || cut, ',' ORDER BY t) AS bounds FROM tr GROUP BY 1) b USING (graph_id)""")
def render(spark, sf_dir):
    tasks, ops, _, bounds = graphs(spark, sf_dir)
    return flat(semantic.rendered(tasks, ops, bounds).select("graph_id", "source", "true_cuts", "ambiguous", "trace"))


def regions(spark, sf_dir, *parts: str) -> DataFrame:
    return mlang.programs(sources(spark, sf_dir), parts)


def _quoted(names) -> str:
    return "[" + ", ".join(f"'{x}'" for x in sorted(names)) + "]"


def _listed(c: str) -> str:
    return f"array_to_string(list_sort(list_distinct({c})), ',')"


_BUILTIN = _quoted(mlang.BUILTIN)
_NAME = "[A-Za-z][A-Za-z0-9_]*"
#: the statements of those programs by SQL: regular expressions over lines, then what a statement's lines add up to
_PARSED = f"""{_DRAWN.replace("WITH tk0", "WITH RECURSIVE tk0", 1).replace("li AS (", "li AS MATERIALIZED (", 1)},
    l0 AS (SELECT li.graph_id, li.t, part, op, line, trim(text) AS x, control <> 'none' AND part < 3 AS block FROM li JOIN tk ON tk.graph_id = li.graph_id AND tk.t = li.t),
    l1 AS MATERIALIZED (SELECT *, dense_rank() OVER (PARTITION BY graph_id ORDER BY first) - 1 AS idx FROM (SELECT *, CASE WHEN block THEN min(line) OVER (PARTITION BY graph_id, t, block) ELSE line END AS first FROM l0)),
    l2 AS MATERIALIZED (SELECT *, list_filter(names, lambda n: NOT list_contains(calls, n)) AS reads FROM (SELECT *, regexp_extract_all(rhs, '{_NAME}') AS names, regexp_extract_all(rhs, '({_NAME})\\(', 1) AS calls FROM (SELECT *, regexp_extract(x, '^({_NAME}) = ', 1) AS lhs,
        CASE WHEN x LIKE 'if %' THEN x[4:] WHEN x LIKE 'while %' THEN x[7:] WHEN x LIKE 'for %' OR x IN ('else', 'end') THEN '' ELSE regexp_replace(x, '^{_NAME} = ', '') END AS rhs FROM l1))),
    s0 AS (SELECT graph_id, CAST(idx AS BIGINT) AS idx, bool_or(block) AS block, min(line) AS start_line, max(line) AS end_line, list_distinct(list(lhs) FILTER (lhs <> '')) AS definitions, list_distinct(flatten(list(reads)) || coalesce(list('loop_index') FILTER (x LIKE 'for %'), [])) AS reads, list_distinct(flatten(list(calls))) AS calls, string_agg(x, ' ' ORDER BY line) AS text FROM l2 GROUP BY 1, 2),
    fd AS (SELECT graph_id, name, min(idx) AS f FROM (SELECT graph_id, idx, unnest(definitions) AS name FROM s0) GROUP BY 1, 2),
    sx AS (SELECT graph_id, idx, list(name) FILTER (f < idx) AS known FROM (SELECT s.graph_id, s.idx, unnest(s.calls) AS name FROM s0 s) c LEFT JOIN fd USING (graph_id, name) GROUP BY 1, 2),
    s1 AS (SELECT s0.*, coalesce(known, []) AS known, list_filter(calls, lambda c: NOT list_contains(coalesce(known, []), c)) AS rest FROM s0 LEFT JOIN sx USING (graph_id, idx)),
    s2 AS MATERIALIZED (SELECT *, list_filter(rest, lambda c: list_contains({_BUILTIN}, c)) AS resolved, list_filter(rest, lambda c: NOT list_contains({_BUILTIN}, c)) AS unresolved,
        list_filter([{', '.join(f"CASE WHEN len(list_intersect(calls, {_quoted(v)})) > 0" + (f" OR {' OR '.join(f'contains(text, {chr(39)}{m.replace(chr(39), chr(39) * 2)}{chr(39)})' for m in mlang.ROLE_CHARACTERS[k])}" if k in mlang.ROLE_CHARACTERS else "") + f" THEN '{k}' END" for k, v in mlang.ROLE_CALLS.items())}, CASE WHEN block THEN 'control_computation' END, CASE WHEN NOT block AND (contains(text, '/') OR contains(text, '\\')) THEN 'normalization' END], lambda r: r IS NOT NULL) AS roles FROM s1)"""


@register("q_parse_m", f"""{_PARSED} SELECT graph_id || '.m' AS path, 'script:top-level' AS region_id, idx, CASE WHEN block THEN 'compound' ELSE 'assignment' END AS kind, start_line, end_line, {_listed('definitions')} AS definitions, {_listed('reads')} AS reads, '' AS mutations, '' AS access_domains, {_listed('calls')} AS calls, {_listed('resolved')} AS resolved_calls, {_listed('known')} AS resolved_indexes, {_listed('unresolved')} AS unresolved_calls,
    CASE WHEN len(calls) > 0 THEN 'call_or_index' ELSE '' END AS effects, '' AS control_effects, CASE WHEN len(roles) > 0 THEN {_listed('roles')} ELSE 'unknown' END AS roles, CASE WHEN len(unresolved) > 0 THEN 'ambiguous_call_or_index' ELSE '' END AS risks, '' AS forbid_cut_before, '' AS forbid_cut_after, block AS is_compound, true AS parse_reliable, true AS call_resolution_available FROM s2""")
def parse_m(spark, sf_dir):
    return flat(mlang.statements(regions(spark, sf_dir, "statements")).drop("call_sites"))


#: what any flow graph has: fe (edges a, b), nd (nodes with their statement idx), wr and ru (nodes' written and read symbols)
CLOSURES = """
    rd AS (SELECT w.graph_id, w.node AS d, w.s, fe.b AS at FROM wr w JOIN fe ON fe.graph_id = w.graph_id AND fe.a = w.node UNION SELECT rd.graph_id, rd.d, rd.s, fe.b FROM rd JOIN fe ON fe.graph_id = rd.graph_id AND fe.a = rd.at LEFT JOIN wr ON wr.graph_id = rd.graph_id AND wr.node = rd.at AND wr.s = rd.s WHERE wr.node IS NULL),
    rr AS MATERIALIZED (SELECT DISTINCT rd.graph_id, d AS source, rd.at AS target, rd.s AS symbol FROM rd JOIN ru ON ru.graph_id = rd.graph_id AND ru.node = rd.at AND ru.s = rd.s),
    an AS MATERIALIZED (SELECT graph_id, node FROM nd UNION ALL SELECT DISTINCT graph_id, 0 FROM nd UNION ALL SELECT DISTINCT graph_id, 1 FROM nd),
    av AS (SELECT graph_id, node AS b, CAST(1 AS BIGINT) AS x FROM an WHERE node <> 1 UNION SELECT av.graph_id, av.b, fe.a FROM av JOIN fe ON fe.graph_id = av.graph_id AND fe.b = av.x AND fe.a <> av.b),
    pd AS MATERIALIZED (SELECT a.graph_id, a.node AS a, b.node AS b FROM an a JOIN an b ON b.graph_id = a.graph_id LEFT JOIN av ON av.graph_id = a.graph_id AND av.b = b.node AND av.x = a.node WHERE av.x IS NULL),
    pc AS (SELECT graph_id, a, count(*) AS k FROM pd GROUP BY 1, 2),
    cd AS MATERIALIZED (SELECT DISTINCT fe.graph_id, fe.a AS source, pd.b AS target FROM fe JOIN pd ON pd.graph_id = fe.graph_id AND pd.a = fe.b LEFT JOIN pd q ON q.graph_id = fe.graph_id AND q.a = fe.a AND q.b = pd.b AND q.b <> fe.a WHERE q.b IS NULL),
    pg AS (SELECT DISTINCT e.graph_id, x.idx AS source, y.idx AS target, kind, symbol FROM (SELECT *, 'DATA' AS kind FROM rr UNION ALL SELECT graph_id, source, target, NULL, 'CONTROL' FROM cd) e JOIN nd x ON x.graph_id = e.graph_id AND x.node = e.source JOIN nd y ON y.graph_id = e.graph_id AND y.node = e.target)"""


#: their flow graphs (nodes numbered in the order of lines), reaching definitions and post-dominators
_FLOW = f"""{_PARSED},
    n0 AS (SELECT graph_id, idx, t, part, op, lhs, reads, x, 1 + row_number() OVER (PARTITION BY graph_id ORDER BY line) AS node FROM l2 WHERE part IN (0, 1, 3) OR x = 'fallback_value = 0;'),
    nd AS MATERIALIZED (SELECT n0.*, tk.control FROM n0 JOIN tk ON tk.graph_id = n0.graph_id AND tk.t = n0.t),
    bl AS (SELECT graph_id, idx, any_value(control) AS control, bool_or(part = 0) AS block, max(node) FILTER (part = 0 AND op = 0) AS head, max(node) FILTER (part = 0 AND op = 1) AS inner_head, max(node) FILTER (part = 2) AS fallback, arg_min(node, op) FILTER (part IN (1, 3)) AS first, arg_max(node, op) FILTER (part IN (1, 3)) AS last FROM nd GROUP BY 1, 2),
    be0 AS (SELECT *, CASE WHEN block THEN head ELSE first END AS entry FROM bl), be1 AS MATERIALIZED (SELECT *, coalesce(lead(entry) OVER (PARTITION BY graph_id ORDER BY idx), 1) AS after FROM be0),
    fe AS MATERIALIZED (SELECT graph_id, CAST(0 AS BIGINT) AS a, entry AS b FROM be1 WHERE idx = 0 UNION SELECT graph_id, first, after FROM be1 WHERE NOT block UNION SELECT graph_id, head, coalesce(inner_head, first) FROM be1 WHERE block UNION SELECT graph_id, head, coalesce(fallback, after) FROM be1 WHERE block
        UNION SELECT graph_id, inner_head, first FROM be1 WHERE inner_head IS NOT NULL UNION SELECT graph_id, inner_head, CASE WHEN control = 'nested' THEN after ELSE head END FROM be1 WHERE inner_head IS NOT NULL UNION SELECT graph_id, fallback, after FROM be1 WHERE fallback IS NOT NULL UNION SELECT graph_id, last, CASE WHEN control IN ('for', 'while', 'loop_branch') THEN head ELSE after END FROM be1 WHERE block
        UNION SELECT graph_id, node, follow FROM (SELECT graph_id, node, part, lead(node) OVER (PARTITION BY graph_id, idx ORDER BY op) AS follow FROM nd WHERE control <> 'none' AND part = 1) WHERE follow IS NOT NULL),
    wr AS MATERIALIZED (SELECT DISTINCT graph_id, node, s FROM (SELECT graph_id, node, CASE WHEN x LIKE 'for %' THEN 'loop_index' ELSE lhs END AS s FROM nd) WHERE s <> ''),
    ru AS MATERIALIZED (SELECT DISTINCT graph_id, node, unnest(reads) AS s FROM nd), {CLOSURES}"""
_AT = "graph_id || '.m' AS path, 'script:top-level' AS region_id"


NEIGHBOURS = f"SELECT {_AT}, an.node, coalesce(p.l, '') AS predecessors, coalesce(q.l, '') AS successors FROM an LEFT JOIN (SELECT graph_id, b AS node, string_agg(a, ',' ORDER BY a) AS l FROM fe GROUP BY 1, 2) p USING (graph_id, node) LEFT JOIN (SELECT graph_id, a AS node, string_agg(b, ',' ORDER BY b) AS l FROM fe GROUP BY 1, 2) q USING (graph_id, node)"
POSTDOMINATORS = f"SELECT {_AT.replace('graph_id', 'pd.graph_id')}, pd.a AS node, string_agg(pd.b, ',' ORDER BY pd.b) AS dominators, arg_max(pd.b, pc.k) FILTER (pd.b <> pd.a) AS nearest FROM pd JOIN pc ON pc.graph_id = pd.graph_id AND pc.a = pd.b GROUP BY pd.graph_id, pd.a"


@register("q_flow_neighbours", f"{_FLOW} {NEIGHBOURS}")
def flow_neighbours(spark, sf_dir):
    return neighbours(regions(spark, sf_dir, "graph"))


def neighbours(r: DataFrame) -> DataFrame:
    return flat(dependence.neighbours(r))


@register("q_reaching_defs_cfg", f"{_FLOW} SELECT {_AT}, source, target, symbol FROM rr")
def reaching_defs_cfg(spark, sf_dir):
    return flat(flow.reaching_definitions(regions(spark, sf_dir, "graph")))


@register("q_postdominators", f"{_FLOW} {POSTDOMINATORS}")
def postdominators(spark, sf_dir):
    return flat(flow.postdominance(regions(spark, sf_dir, "graph")))


@register("q_control_dep", f"{_FLOW} SELECT {_AT}, source, target FROM cd")
def control_dep(spark, sf_dir):
    return flat(flow.control_dependence(regions(spark, sf_dir, "graph")))


@register("q_pdg_union", f"{_FLOW} SELECT {_AT}, source, target, kind, symbol FROM pg")
def pdg_union(spark, sf_dir):
    return flat(flow.projected(regions(spark, sf_dir, "graph"), include_internal=True))


@register("q_semantic_def_use", f"{_FLOW} SELECT {_AT}, source, target, symbol FROM pg WHERE kind = 'DATA' AND source <> target")
def semantic_def_use(spark, sf_dir):
    return flat(flow.semantic_def_use(regions(spark, sf_dir, "graph")))


@register("q_project_scan", f"{_PARSED} SELECT graph_id || '.m' AS path, 'script' AS kind, graph_id AS primary_name, '' AS local_functions, {_listed('flatten(list(calls))')} AS calls, '' AS resolved_project_calls, {_listed('flatten(list(calls))')} AS unresolved_calls, '' AS diagnostics FROM s2 GROUP BY graph_id")
def project_scan(spark, sf_dir):
    return flat(project.scan(project.worker_summary(regions(spark, sf_dir, "statements"))))


def _library(spark, sf_dir) -> DataFrame:
    """The programs, and a file for each function that some of them may call."""
    made = spark.createDataFrame([("lib/any.m", "function y = any(x)\ny = x;\nend\n"), ("lib/norm.m", "function y = norm(x)\ny = x;\nend\n")], "path string, text string")
    return mlang.programs(sources(spark, sf_dir).unionByName(made.select("path", F.encode("text", "UTF-8").alias("content"))))


@register("q_project_enrich", f"""{_PARSED}, s3 AS (SELECT *, list_intersect(unresolved, ['any', 'norm']) AS found FROM s2) SELECT graph_id || '.m' AS path, 'script:top-level' AS region_id, idx, {_listed('resolved || found')} AS resolved_calls, {_listed('list_filter(unresolved, lambda c: NOT list_contains(found, c))')} AS unresolved_calls, CASE WHEN len(unresolved) > len(found) THEN 'ambiguous_call_or_index' ELSE '' END AS risks, true AS call_resolution_available FROM s3""")
def project_enrich(spark, sf_dir):
    """Calls of the programs' statements, resolved by a library that provides some of the functions they call."""
    r = materialize(_library(spark, sf_dir), "regions")
    rows = project.enrich(mlang.statements(r), project.scan(project.worker_summary(r))).where("path not like 'lib/%'")
    return flat(rows.select(*KEY, "idx", "resolved_calls", F.array_sort("unresolved_calls").alias("unresolved_calls"), "risks", "call_resolution_available"))


# structured model

#: the programs over whole sequences, statement by statement; mx and mn: of the statements from each start on
_STEP = "list_append(list_transform(mx, lambda x: greatest(x, v[j + 1])), v[j + 1]) AS mx, list_append(list_transform(mn, lambda x: least(x, v[j + 1])), v[j + 1]) AS mn"
_OPTION = "CASE WHEN i > 1 THEN 0.004 * abs(v[i] - v[i - 1]) - 0.3 ELSE 0.0 END + 0.4 - 0.01 * (mx[i] - mn[i]) - 0.05 * (j + 2 - i)"
_NONE = "CAST([] AS DOUBLE[]) AS mx, CAST([] AS DOUBLE[]) AS mn"
PROGRAMS = [
    ("vs", "SELECT region_id, list(v ORDER BY idx) AS v FROM st GROUP BY 1"),
    ("hd", f"""SELECT region_id, v, 0 AS j, {_NONE}, CAST([0.0] AS DOUBLE[]) AS best, CAST([0] AS BIGINT[]) AS back FROM vs UNION ALL
        SELECT region_id, v, j + 1, mx, mn, list_append(best, list_max(c)), list_append(back, CAST(list_position(c, list_max(c)) AS BIGINT)) FROM (SELECT *, list_transform(best, lambda b, i: b + {_OPTION}) AS c FROM (SELECT region_id, v, j, best, back, {_STEP} FROM hd WHERE j < len(v)))"""),
    ("bt", "SELECT region_id, best[len(v) + 1] AS energy, back, CAST(len(v) AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS cuts FROM hd WHERE j = len(v) UNION ALL SELECT region_id, energy, back, back[pos + 1] - 1, CASE WHEN back[pos + 1] > 1 THEN list_prepend(back[pos + 1] - 1, cuts) ELSE cuts END FROM bt WHERE pos > 0"),
    ("fw", f"""SELECT region_id, d, v, 0 AS j, {_NONE}, CAST([0.0] AS DOUBLE[]) AS z FROM (SELECT region_id, 1 AS d, v FROM vs UNION ALL SELECT region_id, -1, list_reverse(v) FROM vs) UNION ALL
        SELECT region_id, d, v, j + 1, mx, mn, list_append(z, m + ln(list_sum(list_transform(c, lambda x: exp(x - m))))) FROM (SELECT *, list_max(c) AS m FROM (SELECT *, list_transform(z, lambda b, i: b + {_OPTION}) AS c FROM (SELECT region_id, d, v, j, z, {_STEP} FROM fw WHERE j < len(v))))"""),
    ("fe", "SELECT region_id, d, v, z, CAST(len(v) AS BIGINT) AS n FROM fw WHERE j = len(v)"),
]


def sequences(spark, sf_dir) -> DataFrame:
    """region_id, values of all statements of each sequence."""
    rows = read(spark, sf_dir, "events").groupBy(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("region_id"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"]).alias("v"))


def small_energy(v: np.ndarray) -> tuple[np.ndarray, segments.Source]:
    def block(first: int, last: int) -> np.ndarray:
        # from each start up to the ends of the block: the extremes before it, then with each further value
        high, low = (np.concatenate([f.accumulate(v[:first][::-1])[::-1] if first else v[:0], np.full(last + 1 - first, e)]) for f, e in ((np.maximum, -np.inf), (np.minimum, np.inf)))
        out = np.full((last - first + 1, last + 1), -np.inf)
        for e in range(first, last + 1):
            high[: e + 1], low[: e + 1] = np.maximum(high[: e + 1], v[e]), np.minimum(low[: e + 1], v[e])
            out[e - first, : e + 1] = 0.4 - 0.01 * (high[: e + 1] - low[: e + 1]) - 0.05 * np.arange(e + 1, 0, -1)
        return out

    return 0.004 * np.abs(np.diff(v)) - 0.3, segments.Source(len(v), block)


def solve(f, schema: str):
    def run(row):
        yield row["region_id"], *f(*small_energy(np.array(row["v"], float)))

    return lambda df: map_rows(df, run, f"region_id string, {schema}")


@register("q_hard_dp", chain("bt", "SELECT region_id, round(energy, 6) AS energy, array_to_string(cuts, ',') AS cuts FROM bt WHERE pos = 0", PROGRAMS))
def hard_dp(spark, sf_dir):
    run = solve(lambda b, s: ((r := energy.best_segmentation(b, s))[1], r[0]), "energy double, cuts array<int>")
    return flat(run(sequences(spark, sf_dir)))


@register("q_log_partition", chain("fe", "SELECT region_id, round(z[n + 1], 6) AS log_partition FROM fe WHERE d = 1", PROGRAMS))
def log_partition(spark, sf_dir):
    return flat(solve(lambda b, s: (energy.log_partition(b, s),), "log_partition double")(sequences(spark, sf_dir)))


@register("q_marginals", chain("fe", "SELECT region_id, boundary, round(exp(a[boundary + 1] + 0.004 * abs(v[boundary + 1] - v[boundary]) - 0.3 + r[n - boundary + 1] - a[n + 1]), 6) AS probability FROM (SELECT x.region_id, x.v, x.n, x.z AS a, y.z AS r, unnest(range(1, x.n)) AS boundary FROM fe x JOIN fe y ON y.region_id = x.region_id AND x.d = 1 AND y.d = -1)", PROGRAMS))
def marginals(spark, sf_dir):
    rows = solve(lambda b, s: (segments.marginals(b, s)[1].tolist(),), "p array<double>")(sequences(spark, sf_dir))
    return flat(rows.select("region_id", F.posexplode("p").alias("i", "probability")).select("region_id", (F.col("i") + 1).alias("boundary"), "probability"))


def split_of() -> Column:
    user = F.split("region_id", ":")[1].cast("long")
    return F.when(user % 5 < 3, "train").when(user % 5 == 3, "validation").otherwise("test")


def examples(spark, sf_dir, *splits: str) -> DataFrame:
    """Every user's sequence (of some splits, if given) with cuts after purchases where a cut is legal."""
    st = events(spark, sf_dir)
    st = st.where(split_of().isin(*splits)) if splits else st
    rows = energy.region_rows(st)
    legal = F.transform(F.filter("marks", lambda m: m["legal"]), lambda m: m["b"])
    bought = st.where("kind = 'purchase'").groupBy(*KEY).agg(F.collect_set("idx").alias("bought"))
    rows = rows.join(bought, KEY, "left").withColumn("cuts", F.array_sort(F.transform(F.array_intersect(legal, F.coalesce("bought", F.array().cast("array<int>"))), lambda b: b + 1)))
    user = F.split("region_id", ":")[1].cast("long")
    return rows.withColumn("cuts", F.coalesce("cuts", F.array().cast("array<int>"))).withColumn("sample_id", F.col("region_id")).withColumn("project", F.concat(F.lit("p"), (user % 5).cast("string"), F.lit("-"), F.floor(user / 50).cast("string"))).withColumn("split", split_of()).drop("bought")


_A, _TAU = "1.000001", "4.000001"


def _cosine(kind: str) -> str:
    """1 less the cosine of two count tables' rows at a boundary (SQL)."""
    return f"1.0 - coalesce({kind}_dot, 0) / (sqrt(coalesce({kind}_l, 0)) * sqrt(coalesce({kind}_r, 0)) + 1e-8)"


_DONE = f"1 / (1 + exp(-(1.0 - {_A} * coalesce(unfinished, 0.0) / {_TAU})))"
_DISTANCE = "CASE WHEN len(list_concat({l}, {r})) > 0 THEN 1.0 - len(list_intersect({l}, {r})) * 1.0 / len(list_distinct(list_concat({l}, {r}))) ELSE 0.0 END"
#: SQL of the learned features at the initial parameters, and the reliability that holds for each
_LEARNED = {
    "death": (f"1 - exp(-{_A} * dead_n / greatest(1, left_symbols))", "parse"),
    "birth": (f"1 - exp(-{_A} * born_n / greatest(1, right_symbols))", "parse"),
    "symbol_distance": ("1 - least(cross_n, left_symbols, right_symbols) * 1.0 / greatest(1, left_symbols + right_symbols - least(cross_n, left_symbols, right_symbols))", "parse"),
    "interface": (f"exp(-{_A} * (inputs_n + outputs_n))", "dependency"),
    "dependency_release": ("1 - least(1.0, cross_dep * 1.0 / greatest(1, nearby))", "dependency"),
    "reuse_release": (f"exp(-{_A} * coalesce(reuse, 0))", "dependency"),
    "span_release": (f"exp(-coalesce(span_mean, 0.0) / {_TAU})", "dependency"),
    "role_distance": (_cosine("role"), "role_reliability"),
    "call_distance": (_DISTANCE.format(l="left_call_list", r="right_call_list"), "call_resolution"),
    "effect_distance": (_DISTANCE.format(l="left_effects", r="right_effects"), "parse"),
    "completion": (_DONE, "dependency"),
    "compound_completion": (f"CASE WHEN compound THEN {_DONE} ELSE 0.0 END", "parse"),
    "access_distance": (_DISTANCE.format(l="access_l", r="access_r"), "parse"),
    "terminal": ("CASE WHEN terminal THEN 1.0 ELSE 0.0 END", "parse"),
    "call_kind_distance": (_cosine("calls"), "call_resolution"),
    "call_transition": ("transition", "callsite"),
    "handoff": ("handoff", "callsite"),
    "setup_done": ("1.0 - setup", "callsite"),
    "finalization_done": ("1.0 - finalization", "callsite"),
    "nonprimitive": ("1.0 - primitive_chain", "callsite"),
}
_CALL_KINDS = "[CASE WHEN v >= 5 THEN 'resolved_call' ELSE 'external_or_unresolved_call' END, CASE WHEN kind = 'click' AND v >= 50 THEN 'index_access' END]"


def _counted(name: str, values: str) -> list[tuple[str, str]]:
    """Tables {name}x: of the counts of values in a boundary's frames, the two sums of squares and the product (SQL)."""
    side = lambda f: f"SELECT region_id, b, x, count(*) AS c FROM (SELECT region_id, b, unnest({values}) AS x FROM {f}) WHERE x IS NOT NULL GROUP BY 1, 2, 3"
    return [(f"{name}cl", side("lw")), (f"{name}cr", side("rw")), (f"{name}x", f"SELECT coalesce(p.region_id, q.region_id) AS region_id, coalesce(p.b, q.b) AS b, sum(p.c * p.c) AS {name}_l, sum(q.c * q.c) AS {name}_r, sum(p.c * q.c) AS {name}_dot FROM {name}cl p FULL JOIN {name}cr q ON q.region_id = p.region_id AND q.b = p.b AND q.x = p.x GROUP BY 1, 2")]


_MODEL = [
    *_counted("role", "[role]"), *_counted("calls", _CALL_KINDS),
    ("acl", "SELECT region_id, b, list_distinct(list(s) FILTER (r)) AS access_l FROM lw GROUP BY 1, 2"), ("acr", "SELECT region_id, b, list_distinct(list(s) FILTER (r)) AS access_r FROM rw GROUP BY 1, 2"),
    ("le", f"""SELECT fx.region_id, fx.b, fx.constraints = '' AND fx.after_line <> fx.before_line AS legal, {', '.join(f'CAST({v} AS DOUBLE) AS {k}' for k, (v, _) in _LEARNED.items())}, parse, dependency, role_reliability, call_resolution, callsite
        FROM (SELECT fx.* EXCLUDE (left_effects, right_effects), fx.left_effects, fx.right_effects, reuse, span_mean, unfinished, coalesce(access_l, []) AS access_l, coalesce(access_r, []) AS access_r, bd.kind = 'error' AND bd.v >= 80 AS terminal, rolex.* EXCLUDE (region_id, b), callsx.* EXCLUDE (region_id, b), relx.parse, relx.dependency, relx.role_reliability, relx.call_resolution, relx.callsite
            FROM fx JOIN bd ON bd.region_id = fx.region_id AND bd.b = fx.b JOIN relx ON relx.region_id = fx.region_id AND relx.b = fx.b LEFT JOIN xst ON xst.region_id = fx.region_id AND xst.b = fx.b LEFT JOIN acl ON acl.region_id = fx.region_id AND acl.b = fx.b LEFT JOIN acr ON acr.region_id = fx.region_id AND acr.b = fx.b LEFT JOIN rolex ON rolex.region_id = fx.region_id AND rolex.b = fx.b LEFT JOIN callsx ON callsx.region_id = fx.region_id AND callsx.b = fx.b) fx"""),
    ("be", f"SELECT region_id, b + 1 AS i, legal, CASE WHEN legal THEN 0.1 * ({' + '.join(f'({r} * {k} + (1 - {r}) * 0.5)' for k, (_, r) in _LEARNED.items())}) - 0.5 ELSE CAST('-infinity' AS DOUBLE) END AS e FROM le"),
]
_SIZE = "(1 - exp(-len / 3.000001)) * exp(-greatest(0, len - 40) / 100.0)"
_LONE = "(1 / (1 + exp(-(len - 1.5) / 0.500001))) * (CASE WHEN len = 1 AND own = 0 THEN 0.0 ELSE 1.0 END)"
#: segment scores by their end and by their start, and the programs over them, statement by statement
_STRUCTURED = [
    *_MODEL, *catalog._QUALITY[:-1],
    ("sg", f"""SELECT region_id, s, e + 1 AS t, 0.27 * (internal * 1.0 / (internal + greatest(1, len - 1))) + 0.22 * (1.0 / (1.0 + 0.35 * (inputs + outputs))) + 0.18 * (CASE WHEN symbols > 0 THEN local * 1.0 / symbols ELSE 1.0 END) + 0.14 * greatest({_SIZE}, own) + 0.12 * (CASE WHEN compound THEN 1.0 / (1.0 + trail) ELSE 1.0 END) + 0.07 * greatest({_LONE}, own) AS e FROM mq"""),
    ("en", "SELECT sg.region_id, sg.t AS j, list(sg.e + CASE WHEN sg.s = 0 THEN 0.0 ELSE be.e END ORDER BY sg.s) AS o FROM sg LEFT JOIN be ON be.region_id = sg.region_id AND be.i = sg.s GROUP BY 1, 2"),
    ("st2", "SELECT sg.region_id, sg.s AS j, list(sg.e + CASE WHEN be.e IS NULL THEN 0.0 ELSE be.e END ORDER BY sg.t DESC) AS o FROM sg LEFT JOIN be ON be.region_id = sg.region_id AND be.i = sg.t GROUP BY 1, 2"),
    ("hb", """SELECT region_id, CAST(0 AS BIGINT) AS j, CAST([0.0] AS DOUBLE[]) AS best, CAST([0] AS BIGINT[]) AS back, CAST([0.0] AS DOUBLE[]) AS z FROM n UNION ALL
        SELECT region_id, j + 1, list_append(best, list_max(c)), list_append(back, CAST(list_position(c, list_max(c)) AS BIGINT)), list_append(z, m + ln(list_sum(list_transform(d, lambda x: exp(x - m))))) FROM (SELECT *, list_max(d) AS m FROM (SELECT hb.region_id, hb.j, hb.best, hb.back, hb.z, list_transform(hb.best, lambda x, i: x + en.o[i]) AS c, list_transform(hb.z, lambda x, i: x + en.o[i]) AS d FROM hb JOIN en ON en.region_id = hb.region_id AND en.j = hb.j + 1))"""),
    ("hw", """SELECT region_id, n AS j, CAST([0.0] AS DOUBLE[]) AS z FROM n UNION ALL
        SELECT region_id, j - 1, list_append(z, m + ln(list_sum(list_transform(d, lambda x: exp(x - m))))) FROM (SELECT *, list_max(d) AS m FROM (SELECT hw.region_id, hw.j, hw.z, list_transform(hw.z, lambda x, i: x + st2.o[i]) AS d FROM hw JOIN st2 ON st2.region_id = hw.region_id AND st2.j = hw.j - 1))"""),
    ("hv", "SELECT hb.region_id, n.n, hb.best[n.n + 1] AS best, hb.back, hb.z AS fz, hw.z AS bz FROM hb JOIN n ON n.region_id = hb.region_id AND hb.j = n.n JOIN hw ON hw.region_id = hb.region_id AND hw.j = 0"),
    ("hc", "SELECT region_id, back, back[n + 1] - 1 AS pos FROM hv UNION ALL SELECT region_id, back, back[pos + 1] - 1 FROM hc WHERE pos > 0"),
]


@register("q_structured_analysis", chain("be", """SELECT be.region_id, be.i AS boundary_index, CASE WHEN be.legal THEN round(be.e, 6) END AS energy, CASE WHEN be.legal THEN round(exp(hv.fz[be.i + 1] + be.e + hv.bz[hv.n - be.i + 1] - hv.fz[hv.n + 1]), 6) ELSE 0.0 END AS probability, hc.pos IS NOT NULL AS recommended,
    CASE WHEN hc.pos IS NOT NULL THEN NULL WHEN NOT be.legal THEN 'hard_constraint' ELSE 'not_in_structured_optimum' END AS reason, round(hv.best, 6) AS best_energy, round(hv.fz[hv.n + 1], 6) AS log_partition FROM be JOIN hv ON hv.region_id = be.region_id LEFT JOIN hc ON hc.region_id = be.region_id AND hc.pos = be.i AND hc.pos > 0""", _STRUCTURED))
def structured_analysis(spark, sf_dir):
    return flat(energy.structured_analysis(events(spark, sf_dir), energy.initial()).drop("path", "features"))


@register("q_train_epoch")
def train_epoch(spark, sf_dir):
    """The model's parameters after one epoch over the training split, as the protocol runs it."""
    done = training.train(examples(spark, sf_dir, "train", "validation"), training.TrainingConfig(epochs=1, minimum_epochs=1))
    return spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(training.theta_of(done))], "parameter long, value double")


_RAW = {"dead_symbol_count": "dead_n", "born_symbol_count": "born_n", "cross_symbol_count": "cross_n", "input_interface_count": "inputs_n", "output_interface_count": "outputs_n", "cross_dependency_count": "cross_dep", "local_cross_dependency_count": "near_cross", "nearby_dependency_count": "nearby", "left_internal_edge_count": "near_left", "right_internal_edge_count": "near_right", "left_call_count": "len(left_call_list)", "right_call_count": "len(right_call_list)", "left_effect_count": "len(left_effects)", "right_effect_count": "len(right_effects)", "control_followup_edge_count": "followups", "dependency_target_count": "targets", "raw_structural_completion": "CAST(compound AS INTEGER)", "unfinished_completion_chain": "CAST(chained AS INTEGER)", "unfinished_call_setup": "setup", "unfinished_call_finalization": "finalization", "primitive_call_chain": "primitive_chain"}


@register("q_raw_features", chain("fx", "SELECT region_id, b, " + ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in _RAW.items()) + " FROM fx"))
def raw_features(spark, sf_dir):
    from weftline.functions.features import raw_features as columns

    return flat(facts.boundary_facts(events(spark, sf_dir)).select("region_id", "b", *(c.alias(k) for k, c in columns().items())))


@register("q_learned_features", chain("le", "SELECT region_id, b + 1 AS boundary_index, " + ", ".join(f"round({k}, 6) AS {k}" for k in _LEARNED) + " FROM le", _MODEL))
def learned_features(spark, sf_dir):
    rows = energy.learned_features(events(spark, sf_dir), energy.initial())
    return flat(rows.select("region_id", "boundary_index", *(F.col("features")[energy.LEARNED.index(k)].alias(k) for k in _LEARNED)))


#: the stated cuts (legal boundaries after purchases), the pieces they leave, and the losses of both kinds
_LOSSES = [
    *_STRUCTURED,
    ("gt", "SELECT be.region_id, be.i, be.e FROM be JOIN st ON st.region_id = be.region_id AND st.idx = be.i - 1 WHERE be.legal AND st.kind = 'purchase'"),
    ("gp", "SELECT region_id, i AS s, lead(i) OVER (PARTITION BY region_id ORDER BY i) AS t FROM (SELECT region_id, i FROM gt UNION ALL SELECT region_id, 0 FROM n UNION ALL SELECT region_id, n FROM n)"),
    ("ge", "SELECT gp.region_id, sum(sg.e) AS e FROM gp JOIN sg ON sg.region_id = gp.region_id AND sg.s = gp.s AND sg.t = gp.t GROUP BY 1"),
    ("gc", "SELECT be.region_id, gt.i IS NOT NULL AS cut, avg(CASE WHEN gt.i IS NOT NULL THEN ln(1 + exp(-be.e)) ELSE ln(1 + exp(be.e)) END) AS loss FROM be LEFT JOIN gt ON gt.region_id = be.region_id AND gt.i = be.i WHERE be.legal GROUP BY 1, 2"),
    ("gs", "SELECT region_id, sum(e) AS e FROM gt GROUP BY 1"), ("gm", "SELECT region_id, avg(loss) AS loss FROM gc GROUP BY 1"),
]


@register("q_structured_loss", chain("hv", "SELECT hv.region_id, round(hv.fz[hv.n + 1] - ge.e - coalesce(gs.e, 0.0), 6) AS structured_loss, round(coalesce(gm.loss, 0.0), 6) AS balanced_loss FROM hv JOIN ge ON ge.region_id = hv.region_id LEFT JOIN gs ON gs.region_id = hv.region_id LEFT JOIN gm ON gm.region_id = hv.region_id", _LOSSES))
def structured_loss(spark, sf_dir):
    """Of the initial model, by sequence: the structured loss, and the mean over both classes of the logistic loss by class."""

    def run(r):
        e, cuts = energy.Energy(energy.initial(), energy.region_of(r)), [int(c) for c in r["cuts"]]
        yield r["region_id"], energy.nll(e, cuts)[0], energy.balanced_bce(e, cuts)[0]

    return flat(map_rows(examples(spark, sf_dir), run, "region_id string, structured_loss double, balanced_loss double"))


#: derivatives of a sequence's training loss at the initial parameters: by boundary scores (gd) and segment scores (gq), then
#: by parameters; a weight y that is kept as the inverse softplus of y has the slope 1 - exp(-y)
_RATED = {k: f"({r} * {k} + (1 - {r}) * 0.5)" for k, (_, r) in _LEARNED.items()}
_GRADIENT = [
    *_LOSSES,
    ("gb", "SELECT be.region_id, be.i, be.e, CASE WHEN gt.i IS NULL THEN 0 ELSE 1 END AS cut FROM be LEFT JOIN gt ON gt.region_id = be.region_id AND gt.i = be.i WHERE be.legal"),
    ("gl", "SELECT region_id, count(*) AS legal, sum(cut) AS cuts, count(DISTINCT cut) AS classes FROM gb GROUP BY 1"),
    ("gd", """SELECT gb.region_id, gb.i, (exp(hv.fz[gb.i + 1] + gb.e + hv.bz[hv.n - gb.i + 1] - hv.fz[hv.n + 1]) - cut) / legal + 0.5 * (1 / (1 + exp(-gb.e)) - cut) / (CASE WHEN cut = 1 THEN cuts ELSE legal - cuts END) / classes AS d
        FROM gb JOIN gl ON gl.region_id = gb.region_id JOIN hv ON hv.region_id = gb.region_id"""),
    ("gq", """SELECT sg.region_id, sg.s, sg.t, (exp(hv.fz[sg.s + 1] + CASE WHEN sg.s = 0 THEN 0.0 ELSE x.e END + sg.e + CASE WHEN sg.t = hv.n THEN 0.0 ELSE y.e END + hv.bz[hv.n - sg.t + 1] - hv.fz[hv.n + 1]) - CASE WHEN gp.s IS NULL THEN 0 ELSE 1 END) / greatest(1, coalesce(gl.legal, 0)) AS d
        FROM sg JOIN hv ON hv.region_id = sg.region_id LEFT JOIN be x ON x.region_id = sg.region_id AND x.i = sg.s LEFT JOIN be y ON y.region_id = sg.region_id AND y.i = sg.t LEFT JOIN gp ON gp.region_id = sg.region_id AND gp.s = sg.s AND gp.t = sg.t LEFT JOIN gl ON gl.region_id = sg.region_id"""),
    ("ga", f"""SELECT gd.region_id, unnest(['bias', 'cut', {", ".join(f"'weights.{k}', 'baseline.{k}'" for k in _LEARNED)}]) AS parameter, unnest([sum(d), -sum(d) * (1 - exp(-0.5)), {", ".join(f"sum(d * {_RATED[k]}) * (1 - exp(-0.1)), sum(d * (1 - {r})) * 0.1 * 0.25" for k, (_, r) in _LEARNED.items())}]) AS value
        FROM gd JOIN le ON le.region_id = gd.region_id AND le.b = gd.i - 1 GROUP BY 1"""),
    ("gz", f"""SELECT gq.region_id, unnest([{", ".join(f"'module.{k}'" for k in MODULE_WEIGHTS)}]) AS parameter, unnest([sum(d * internal / (internal + greatest(1, len - 1))) * (1 - exp(-0.27)), sum(d / (1.0 + 0.35 * (inputs + outputs))) * (1 - exp(-0.22)), sum(d * CASE WHEN symbols > 0 THEN local * 1.0 / symbols ELSE 1.0 END) * (1 - exp(-0.18)),
        sum(d * greatest({_SIZE}, own)) * (1 - exp(-0.14)), sum(d * CASE WHEN compound THEN 1.0 / (1.0 + trail) ELSE 1.0 END) * (1 - exp(-0.12)), sum(d * greatest({_LONE}, own)) * (1 - exp(-0.07))]) AS value FROM gq JOIN mq ON mq.region_id = gq.region_id AND mq.s = gq.s AND mq.e = gq.t - 1 GROUP BY 1"""),
]


@register("q_gradient", chain("ga", "SELECT region_id, parameter, round(value, 6) + 0.0 AS value FROM (SELECT * FROM ga UNION ALL SELECT * FROM gz)", _GRADIENT))
def gradient(spark, sf_dir):
    """What a training step adds up: each sequence's gradient at the initial parameters, by boundary, module and cut weights."""
    wanted = {"weights": list(_LEARNED), "baseline": list(_LEARNED), "module": list(MODULE_WEIGHTS)}

    def run(r):
        region = energy.region_of(r)
        slope = energy.unpack(energy.loss_and_gradient(energy.initial(), region, [int(c) for c in r["cuts"]])[1])
        named = [(f"{k}.{x}", v) for k, names in wanted.items() for x, v in zip(names, slope[k])] + [(k, float(slope[k])) for k in ("bias", "cut")]
        # without a legal boundary only the modules' weights have a slope
        yield from ((r["region_id"], k, v + 0.0) for k, v in named if k.startswith("module") or region.legal.any())

    return flat(map_rows(examples(spark, sf_dir), run, "region_id string, parameter string, value double")).withColumn("value", F.col("value") + 0.0)


#: predictions of the model against the stated cuts: matching within 0, 1 and 2, and the roll-up
_EVAL = [
    *_LOSSES,
    ("ps", "SELECT n.region_id, n.n, coalesce(p.c, []) AS p, coalesce(g.c, []) AS t, hv.fz[hv.n + 1] - ge.e - coalesce(gs.e, 0.0) AS nll FROM n JOIN hv ON hv.region_id = n.region_id JOIN ge ON ge.region_id = n.region_id LEFT JOIN gs ON gs.region_id = n.region_id LEFT JOIN (SELECT region_id, list(pos ORDER BY pos) AS c FROM hc WHERE pos > 0 GROUP BY 1) p ON p.region_id = n.region_id LEFT JOIN (SELECT region_id, list(i ORDER BY i) AS c FROM gt GROUP BY 1) g ON g.region_id = n.region_id"),
    ("gm2", """SELECT region_id, tol, p, len(t) AS nt, t AS free, 0 AS i, 0 AS hit FROM ps, (VALUES (0), (1), (2)) x(tol) UNION ALL
        SELECT region_id, tol, p, nt, CASE WHEN near IS NULL THEN free ELSE list_filter(free, lambda x: x <> near) END, i + 1, hit + CASE WHEN near IS NULL THEN 0 ELSE 1 END FROM (SELECT *, list_min(list_transform(list_filter(free, lambda x: abs(p[i + 1] - x) <= tol), lambda x: abs(p[i + 1] - x) * 1000000 + x)) % 1000000 AS near FROM gm2 WHERE i < len(p))"""),
    ("gr2", "SELECT region_id, tol, hit AS tp, len(p) - hit AS fp, nt - hit AS fn FROM gm2 WHERE i = len(p)"),
    ("ex", "SELECT ps.region_id, ps.nll, 'p' || (u % 5) || '-' || (u // 50) AS project, 'function' AS region_kind, CASE WHEN n < 30 THEN 'short_lt_30' WHEN n <= 80 THEN 'medium_30_80' ELSE 'long_gt_80' END AS bucket, a.tp, a.fp, a.fn, b.tp AS tp1, b.fp AS fp1, b.fn AS fn1, c.tp AS tp2, c.fp AS fp2, c.fn AS fn2 FROM (SELECT *, CAST(split_part(region_id, ':', 2) AS BIGINT) AS u FROM ps) ps JOIN gr2 a ON a.region_id = ps.region_id AND a.tol = 0 JOIN gr2 b ON b.region_id = ps.region_id AND b.tol = 1 JOIN gr2 c ON c.region_id = ps.region_id AND c.tol = 2"),
    *[(k, v.replace("FROM my", "FROM ex").replace("avg(n / 10.0)", "avg(nll)").replace("CAST(sum(n % 2) AS BIGINT)", "CAST(0 AS BIGINT)")) for k, v in _ALL[1:]],
]


@register("q_eval", chain("rfs", _rolled("stratum, name, samples", "", "violations", "") + " UNION ALL " + _rolled("'project_macro', 'all', count(*)", "avg", "CAST(sum(violations) AS BIGINT)", "WHERE stratum = 'project'"), _EVAL))
def evaluate(spark, sf_dir):
    return flat(metrics.rollup(metrics.evaluate(examples(spark, sf_dir), energy.initial())))
