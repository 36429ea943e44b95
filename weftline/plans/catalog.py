"""Registry of the engine's queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import features as feat
from weftline.operators import dependence, facts, quality, scoring
from weftline.plans.oracle import chain
from weftline.schema import KEY
from weftline.session import shipped
from weftline.sources.tables import conversation_statements, events_statements

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_statements(read(spark, sf_dir, "events"))


def flat(df: DataFrame, **rename: str) -> DataFrame:
    """Scalars only: counts as bigint, doubles rounded to six places, lists joined."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("int", "bigint", "smallint"):
            c = c.cast("bigint")
        elif kind == "double":
            c = F.round(c, 6)
        elif kind == "array<string>":
            c = F.array_join(c, ",")
        elif kind.startswith("array<struct<name:string"):
            c = F.array_join(F.transform(c, lambda x: F.concat(x["name"], F.lit(":"), x["count"].cast("string"))), ",")
        elif kind.startswith("array<int"):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
        out.append(c.alias(rename.get(name, name)))
    return df.select(*out)


def from_facts(spark: SparkSession, sf_dir: str, *cols: str, **rename: str) -> DataFrame:
    """Some facts of every boundary; groups of facts that none of them belongs to aren't computed."""
    edge = (*facts.COUNTS, "dependency_span_mean", "unfinished_work_mass", "input_symbols", "output_symbols")
    wanted = {"spans": ("dead_symbols", "born_symbols", "cross_symbols"), "edges": edge, "completion": ("completion_chain_length",)}
    parts = tuple(p for p in facts.PARTS if set(wanted[p]) & set(cols))
    return flat(facts.boundary_facts(events(spark, sf_dir), parts=parts).select("region_id", "b", *cols), **rename)


@register("q_statements_events", chain("stx", "SELECT region_id, idx, kind, line, CASE WHEN d THEN s ELSE '' END AS definitions, CASE WHEN r THEN s ELSE '' END AS reads, CASE WHEN m THEN s ELSE '' END AS mutations, coalesce(effect, '') AS effects, role AS roles, compound AS is_compound FROM stx"))
def statements_events(spark, sf_dir):
    return flat(events(spark, sf_dir).select("region_id", "idx", "kind", F.col("start_line").alias("line"), "definitions", "reads", "mutations", "effects", "roles", "is_compound"))


CONV = """WITH st AS (SELECT 'conv:' || conv_id AS region_id, CAST(turn AS BIGINT) AS idx, role, list_sort(list_distinct(list_filter(string_split(lower(text), ' '), lambda x: x <> ''))) AS w FROM conversations)"""


@register("q_statements_conv", f"{CONV} SELECT region_id, idx, role AS kind, CASE WHEN role = 'user' THEN array_to_string(w, ',') ELSE '' END AS definitions, CASE WHEN role = 'user' THEN '' ELSE array_to_string(w, ',') END AS reads FROM st")
def statements_conv(spark, sf_dir):
    return flat(conversation_statements(read(spark, sf_dir, "conversations")).select("region_id", "idx", "kind", "definitions", "reads"))


@register("q_occurrences", chain("st", "SELECT region_id, s AS symbol, min(idx) AS first, max(idx) AS last, string_agg(DISTINCT idx, ',' ORDER BY idx) AS indexes FROM st WHERE d OR r OR m GROUP BY 1, 2"))
def occurrences(spark, sf_dir):
    return flat(dependence.occurrences(events(spark, sf_dir)).drop("path"))


@register("q_linear_def_use", chain("ed", "SELECT region_id, src AS source, tgt AS target, s AS symbol FROM ed"))
def linear_def_use(spark, sf_dir):
    return flat(dependence.linear_def_use(events(spark, sf_dir)).drop("path"))


@register("q_dead_born_cross", chain("dbc", "SELECT region_id, b, dead AS dead_symbols, born AS born_symbols, crossing AS cross_symbols FROM dbc"))
def dead_born_cross(spark, sf_dir):
    return from_facts(spark, sf_dir, "dead_symbols", "born_symbols", "cross_symbols")


@register("q_frame_symbols", chain("lf", "SELECT region_id, b, left_symbols AS left_symbol_count, right_symbols AS right_symbol_count, array_to_string(left_list, ',') AS left_symbols, array_to_string(right_list, ',') AS right_symbols, left_size AS left_context_size, right_size AS right_context_size FROM lf JOIN rf USING (region_id, b)"))
def frame_symbols(spark, sf_dir):
    return from_facts(spark, sf_dir, "left_symbol_count", "right_symbol_count", "left_symbols", "right_symbols", "left_context_size", "right_context_size")


@register("q_cross_edges", chain("xe", "SELECT region_id, b, src AS source, tgt AS target, s AS symbol FROM xe"))
def cross_edges(spark, sf_dir):
    e = dependence.linear_def_use(events(spark, sf_dir))
    return flat(e.select("region_id", "source", "target", "symbol", F.explode(F.sequence(F.col("source"), F.col("target") - 1)).alias("b")))


@register("q_cross_edge_stats", chain("xst", "SELECT bd.region_id, bd.b, coalesce(cross_dep, 0) AS cross_dependency_count, round(coalesce(span_mean, 0.0), 6) AS dependency_span_mean, coalesce(span_max, 0) AS dependency_span_max, coalesce(targets, 0) AS dependency_target_count, CAST(coalesce(reuse, 0) AS BIGINT) AS dependency_reuse_mass, round(coalesce(unfinished, 0.0), 6) AS unfinished_work_mass FROM bd LEFT JOIN xst USING (region_id, b)"))
def cross_edge_stats(spark, sf_dir):
    return from_facts(spark, sf_dir, "cross_dependency_count", "dependency_span_mean", "dependency_span_max", "dependency_target_count", "dependency_reuse_mass", "unfinished_work_mass")


@register("q_nearby_edges", chain("nb", "SELECT bd.region_id, bd.b, coalesce(nearby, 0) AS nearby_dependency_count, coalesce(near_cross, 0) AS local_cross_dependency_count, coalesce(near_left, 0) AS left_internal_data_edge_count, coalesce(near_right, 0) AS right_internal_data_edge_count, coalesce(medium, 0) AS medium_dependency_count FROM bd LEFT JOIN nb USING (region_id, b)"))
def nearby_edges(spark, sf_dir):
    return from_facts(spark, sf_dir, "nearby_dependency_count", "local_cross_dependency_count", "left_internal_data_edge_count", "right_internal_data_edge_count", "medium_dependency_count")


@register("q_interface_symbols", chain("outp", "SELECT bd.region_id, bd.b, coalesce(inputs, '') AS input_symbols, coalesce(outputs, '') AS output_symbols FROM bd LEFT JOIN xst USING (region_id, b) LEFT JOIN outp USING (region_id, b)"))
def interface_symbols(spark, sf_dir):
    return from_facts(spark, sf_dir, "input_symbols", "output_symbols")


@register("q_followup", chain("xst", "SELECT bd.region_id, bd.b, coalesce(followups, 0) AS control_followup_edge_count FROM bd LEFT JOIN xst USING (region_id, b)"))
def followup(spark, sf_dir):
    return from_facts(spark, sf_dir, "control_followup_edge_count")


def _hist(expr: str, frame: str) -> str:
    return f"SELECT region_id, b, string_agg(x || ':' || c, ',' ORDER BY x) AS h FROM (SELECT region_id, b, x, count(*) AS c FROM (SELECT region_id, b, unnest({expr}) AS x FROM {frame}) GROUP BY 1, 2, 3) WHERE x IS NOT NULL GROUP BY 1, 2"


_KINDS = "[CASE WHEN v >= 5 THEN 'resolved_call' ELSE 'external_or_unresolved_call' END, CASE WHEN kind = ''click'' AND v >= 50 THEN 'index_access' END]".replace("''", "'")
_H = [("lk", _hist(_KINDS, "lw")), ("rk", _hist(_KINDS, "rw")), ("le", _hist("[effect]", "lw")), ("re", _hist("[effect]", "rw")), ("lr", _hist("[role]", "lw")), ("rr", _hist("[role]", "rw"))]


@register("q_histograms", chain("bd", "SELECT bd.region_id, bd.b, coalesce(lk.h, '') AS left_call_kind_histogram, coalesce(rk.h, '') AS right_call_kind_histogram, coalesce(le.h, '') AS left_effect_histogram, coalesce(re.h, '') AS right_effect_histogram, coalesce(lr.h, '') AS left_role_histogram, coalesce(rr.h, '') AS right_role_histogram FROM bd " + " ".join(f"LEFT JOIN {k} ON {k}.region_id = bd.region_id AND {k}.b = bd.b" for k, _ in _H), _H))
def histograms(spark, sf_dir):
    return from_facts(spark, sf_dir, *(f"{s}_{k}_histogram" for s in ("left", "right") for k in ("call_kind", "effect", "role")))


@register("q_constraints_risks", chain("fx", "SELECT region_id, b, constraints, risks FROM fx JOIN relx USING (region_id, b)"))
def constraints_risks(spark, sf_dir):
    return from_facts(spark, sf_dir, "constraints", "risks")


@register("q_reliability", chain("relx", "SELECT region_id, b, parse, round(call_resolution, 6) AS call_resolution, round(dependency, 6) AS dependency, round(role_reliability, 6) AS role, round(callsite, 6) AS callsite, codes AS reason_codes FROM relx"))
def reliability(spark, sf_dir):
    rows = facts.statement_facts(events(spark, sf_dir)).select("region_id", "b", *(F.col(f"reliability.{c}").alias(c) for c in ("parse", "call_resolution", "dependency", "role", "callsite", "reason_codes")))
    return flat(rows)


@register("q_callsite_facts", chain("cs", "SELECT region_id, b, transition AS standalone_call_transition, handoff AS artifact_handoff, setup AS unfinished_call_setup, finalization AS unfinished_call_finalization, primitive_chain AS primitive_call_chain FROM cs"))
def callsite_facts(spark, sf_dir):
    return from_facts(spark, sf_dir, "standalone_call_transition", "artifact_handoff", "unfinished_call_setup", "unfinished_call_finalization", "primitive_call_chain")


@register("q_frame_calls", chain("lf", "SELECT region_id, b, left_calls, right_calls FROM lf JOIN rf USING (region_id, b)"))
def frame_calls(spark, sf_dir):
    return from_facts(spark, sf_dir, "left_calls", "right_calls")


@register("q_access_domains", chain("bd", "SELECT bd.region_id, bd.b, coalesce(a.x, '') AS left_access_domains, coalesce(z.x, '') AS right_access_domains FROM bd LEFT JOIN (SELECT region_id, b, string_agg(DISTINCT 'props.' || s, ',' ORDER BY 'props.' || s) AS x FROM lw WHERE r GROUP BY 1, 2) a ON a.region_id = bd.region_id AND a.b = bd.b LEFT JOIN (SELECT region_id, b, string_agg(DISTINCT 'props.' || s, ',' ORDER BY 'props.' || s) AS x FROM rw WHERE r GROUP BY 1, 2) z ON z.region_id = bd.region_id AND z.b = bd.b"))
def access_domains(spark, sf_dir):
    return from_facts(spark, sf_dir, "left_access_domains", "right_access_domains")


@register("q_terminal_compound", chain("bd", "SELECT region_id, b, kind = 'error' AND v >= 80 AS terminal_control_left, compound AS compound_ends_here FROM bd"))
def terminal_compound(spark, sf_dir):
    return from_facts(spark, sf_dir, "terminal_control_left", "compound_ends_here")


@register("q_completion", chain("comp", "SELECT region_id, b AS boundary, through, roles, symbols FROM comp"))
def completion(spark, sf_dir):
    st = events(spark, sf_dir)
    return flat(dependence.completion(st, dependence.linear_def_use(st)).drop("path"))


_MILLIONTHS = "CAST(round(({}) * 1000000) AS BIGINT)".format
_NO = lambda c: f"coalesce({c}, 0)"
#: the facts that a fingerprint is made of, by SQL
_TOLD = {
    **{f"{side}_{name}_histogram": f"{side[0]}{name[0] if name != 'call_kind' else 'k'}.h" for side in ("left", "right") for name in ("call_kind", "effect", "role")},
    **{f"{side}_{name}": f"{t.format(side[0])}.{side}_{c}" for side in ("left", "right") for name, c, t in (("context_size", "size", "{}f"), ("symbol_count", "symbols", "{}f"), ("calls_count", "n_calls", "f{}"), ("access_domains_count", "n_domains", "d{}"))},
    "standalone_call_transition": _MILLIONTHS("cs.transition"), "artifact_handoff": _MILLIONTHS("cs.handoff"), "unfinished_call_setup": _MILLIONTHS("cs.setup"), "unfinished_call_finalization": _MILLIONTHS("cs.finalization"), "primitive_call_chain": _MILLIONTHS("cs.primitive_chain"),
    "terminal_control_left": "bd.kind = 'error' AND bd.v >= 80", "compound_ends_here": "bd.compound", "constraints": "fx.constraints", "risks": "relx.risks",
    **{f"reliability.{k}": _MILLIONTHS(v) for k, v in (("parse", "relx.parse"), ("call_resolution", "relx.call_resolution"), ("dependency", "relx.dependency"), ("role", "relx.role_reliability"), ("effect", "relx.parse"), ("callsite", "relx.callsite"), ("dynamic_workspace_risk", "CASE WHEN relx.shared THEN 1 ELSE 0 END"), ("alias_uncertainty", "CASE WHEN relx.ambiguous THEN 1 ELSE 0 END"))}, "reliability.reason_codes": "relx.codes",
    **{k: _NO(v) for k, v in (("cross_dependency_count", "xst.cross_dep"), ("nearby_dependency_count", "nb.nearby"), ("local_cross_dependency_count", "nb.near_cross"), ("left_internal_data_edge_count", "nb.near_left"), ("right_internal_data_edge_count", "nb.near_right"), ("medium_dependency_count", "nb.medium"), ("medium_cross_dependency_count", "nb.medium_cross"))},
    **{k: _NO(v) for k, v in (("dependency_span_max", "xst.span_max"), ("dependency_target_count", "xst.targets"), ("dependency_reuse_mass", "CAST(xst.reuse AS BIGINT)"), ("control_followup_edge_count", "xst.followups"), ("input_symbol_count", "xst.inputs_n"), ("output_symbol_count", "outp.outputs_n"), ("completion_chain_length", "comp.through - bd.b"))},
    "dependency_span_mean": _MILLIONTHS(_NO("xst.span_mean")), "unfinished_work_mass": _MILLIONTHS(_NO("xst.unfinished")), "completion_roles": "comp.roles", "dead_symbol_count": "dbc.dead_n", "born_symbol_count": "dbc.born_n", "cross_symbol_count": "dbc.cross_n",
}
_FRAMES = [("fl", "SELECT region_id, b, len(left_call_list) AS left_n_calls FROM lf"), ("fr", "SELECT region_id, b, len(right_call_list) AS right_n_calls FROM rf"), ("dl", "SELECT region_id, b, count(DISTINCT s) FILTER (r) AS left_n_domains FROM lw GROUP BY 1, 2"), ("dr", "SELECT region_id, b, count(DISTINCT s) FILTER (r) AS right_n_domains FROM rw GROUP BY 1, 2")]
_JOINED = " ".join(f"LEFT JOIN {k} ON {k}.region_id = bd.region_id AND {k}.b = bd.b" for k in ("lf", "rf", "fl", "fr", "dl", "dr", "lk", "rk", "le", "re", "lr", "rr", "fx", "relx", "cs", "xst", "nb", "outp", "comp", "dbc"))


@register("q_fingerprint", chain("bd", f"SELECT 'events' AS path, bd.region_id, bd.b + 1 AS boundary_index, sha256(concat_ws('|', {', '.join(f"'{k}=' || coalesce(CAST({_TOLD[k]} AS VARCHAR), '')" for k in sorted(_TOLD))})) AS fingerprint FROM bd {_JOINED}", [*_H, *_FRAMES]))
def fingerprint(spark, sf_dir):
    return facts.fingerprint(facts.boundary_facts(events(spark, sf_dir)))


@register("q_call_classification", chain("st", "SELECT a.region_id, a.idx, a.kind AS call, CASE WHEN w.f < a.idx THEN 'index' WHEN a.kind IN ('view', 'click') THEN 'resolved' ELSE 'unresolved' END AS verdict FROM st a LEFT JOIN (SELECT region_id, s, min(idx) AS f FROM st WHERE d OR m GROUP BY 1, 2) w ON w.region_id = a.region_id AND w.s = a.kind"))
def call_classification(spark, sf_dir):
    return flat(dependence.classify_calls(events(spark, sf_dir), ["view", "click"]).drop("path"))


@register("q_symbol_classification", chain("st", "SELECT a.region_id, a.idx, a.s AS call, CASE WHEN w.f < a.idx THEN 'index' WHEN a.s IN ('k1', 'k2') THEN 'resolved' ELSE 'unresolved' END AS verdict FROM st a LEFT JOIN (SELECT region_id, s, min(idx) AS f FROM st WHERE d OR m GROUP BY 1, 2) w ON w.region_id = a.region_id AND w.s = a.s"))
def symbol_classification(spark, sf_dir):
    st = events(spark, sf_dir).withColumn("calls", dependence.symbols_of())
    return flat(dependence.classify_calls(st, ["k1", "k2"]).drop("path"))


_F = ", ".join(f"round({k}, 6) AS {k}" for k in feat.FEATURES)


@register("q_features_heuristic", chain("ft", f"SELECT region_id, b, {_F} FROM ft"))
def features_heuristic(spark, sf_dir):
    return flat(feat.boundary_features(facts.boundary_facts(events(spark, sf_dir))).select("region_id", "b", *feat.FEATURES))


def scored(spark, sf_dir):
    return scoring.score(feat.boundary_features(facts.boundary_facts(events(spark, sf_dir))))


@register("q_score", chain("sc", "SELECT region_id, b, round(score, 6) AS score FROM sc"))
def score(spark, sf_dir):
    return flat(scored(spark, sf_dir).select("region_id", "b", "score"))


@register("q_peaks", chain("pk", "SELECT region_id, b, peak AS local_peak FROM pk"))
def peaks(spark, sf_dir):
    return flat(scoring.peaks(scored(spark, sf_dir)).select("region_id", "b", "local_peak"))


@register("q_prominence", chain("rj", "SELECT region_id, b, round(prominence, 6) AS prominence FROM rj"))
def prominence(spark, sf_dir):
    return flat(scoring.peaks(scored(spark, sf_dir)).select("region_id", "b", "prominence"))


@register("q_rejections", chain("rj", "SELECT region_id, b, reasons AS rejection_reasons, peak AND reasons = '' AS candidate FROM rj"))
def rejections(spark, sf_dir):
    return flat(scoring.reject(scoring.peaks(scored(spark, sf_dir))).select("region_id", "b", "rejection_reasons", "candidate"))


_QUALITY = [
    ("iv", "SELECT region_id, x.idx AS s, z.idx AS e FROM stx x JOIN stx z USING (region_id) WHERE z.idx >= x.idx"),
    ("ie", "SELECT iv.region_id, iv.s, iv.e, count(*) FILTER (ed.src >= iv.s AND ed.tgt <= iv.e) AS internal, count(DISTINCT ed.s) FILTER (ed.src < iv.s AND ed.tgt BETWEEN iv.s AND iv.e) AS inputs, count(DISTINCT ed.s) FILTER (ed.src BETWEEN iv.s AND iv.e AND ed.tgt > iv.e) AS outputs, count(DISTINCT ed.s) FILTER (ed.src = iv.e AND ed.tgt > iv.e) AS trail FROM iv LEFT JOIN ed ON ed.region_id = iv.region_id GROUP BY 1, 2, 3"),
    ("sy", "SELECT iv.region_id, iv.s, iv.e, count(DISTINCT st.s) AS symbols, count(DISTINCT st.s) FILTER (occ.f >= iv.s AND occ.l <= iv.e) AS local FROM iv JOIN st ON st.region_id = iv.region_id AND st.idx BETWEEN iv.s AND iv.e JOIN occ ON occ.region_id = st.region_id AND occ.s = st.s GROUP BY 1, 2, 3"),
    ("mq", """SELECT ie.*, sy.symbols, sy.local, e - s + 1 AS len, last.compound, CASE WHEN e = s THEN last.support ELSE 0.0 END AS own FROM ie JOIN sy USING (region_id, s, e) JOIN stx last ON last.region_id = ie.region_id AND last.idx = ie.e"""),
    ("ms", """SELECT region_id, s, e, internal, inputs, outputs, symbols, local, trail, 0.27 * (internal * 1.0 / (internal + greatest(1, len - 1))) + 0.22 * (1.0 / (1.0 + 0.35 * (inputs + outputs))) + 0.18 * (CASE WHEN symbols > 0 THEN local * 1.0 / symbols ELSE 1.0 END) + 0.14 * greatest(CASE len WHEN 1 THEN 0.0 WHEN 2 THEN 0.5 WHEN 3 THEN 0.75 ELSE CASE WHEN len <= 40 THEN 1.0 ELSE 1.0 / (1.0 + 0.002 * (len - 40)) END END, own) + 0.12 * (CASE WHEN compound THEN 1.0 / (1.0 + trail) ELSE 1.0 END) + 0.07 * (CASE WHEN len = 1 THEN own ELSE 1.0 END) AS score FROM mq"""),
]


_GRID = ("region_id", "start", "end", "internal_edge_count", "input_count", "output_count", "symbol_count", "local_symbol_count", "trailing_output_count", "score")


@register("q_module_grid", chain("ms", "SELECT region_id, s AS start, e AS \"end\", internal AS internal_edge_count, inputs AS input_count, outputs AS output_count, symbols AS symbol_count, local AS local_symbol_count, trail AS trailing_output_count, round(score, 6) AS score FROM ms", _QUALITY))
def module_grid(spark, sf_dir):
    """Every interval of every sequence, in one sweep over each sequence."""
    return flat(quality.module_grid(scoring.grid_input(events(spark, sf_dir))).select(*_GRID))


@register("q_interval_quality", ORACLES["q_module_grid"])
def interval_quality(spark, sf_dir):
    """The same intervals as a table that is joined with the sequences, which takes any table of intervals."""
    st = events(spark, sf_dir)
    return flat(quality.interval_quality(st, quality.windows(st)).select(*_GRID))


@register("q_adjacent_quality", chain("ms", "SELECT bd.region_id, bd.b + 1 AS split, round(l.score, 6) AS left_quality, round(r.score, 6) AS right_quality FROM bd JOIN ms l ON l.region_id = bd.region_id AND l.s = greatest(0, bd.b + 1 - 4) AND l.e = bd.b JOIN ms r ON r.region_id = bd.region_id AND r.s = bd.b + 1 AND r.e = least(bd.n - 1, bd.b + 4)", [(k, f"{v} AND z.idx <= x.idx + 3" if k == "iv" else v) for k, v in _QUALITY]))
def adjacent_quality(spark, sf_dir):
    return flat(quality.adjacent_quality(events(spark, sf_dir)).drop("path"))


#: candidates, interval values between them and the region's ends, and the program over them, candidate by candidate
_SELECTION = [
    ("cand", "SELECT region_id, b + 1 AS c, 0.85 * ((score - 0.58) + (prominence - 0.055)) - 0.03 AS w, row_number() OVER (PARTITION BY region_id ORDER BY b) AS k FROM rj WHERE peak AND reasons = ''"),
    ("ck", "SELECT region_id, max(k) AS last FROM cand GROUP BY 1"),
    ("pts", "SELECT region_id, 0 AS k, 0 AS c, 0.0 AS w FROM ck UNION ALL SELECT region_id, k, c, w FROM cand UNION ALL SELECT region_id, last + 1, n, 0.0 FROM ck JOIN n USING (region_id)"),
    ("iv", "SELECT x.region_id, x.c AS s, z.c - 1 AS e FROM pts x JOIN pts z ON z.region_id = x.region_id AND x.k < z.k"),
    *_QUALITY[1:],
    ("op", "SELECT z.region_id, z.k, any_value(z.w) AS w, list(ms.score * (ms.e - ms.s + 1) / n.n - 0.20 * greatest(0.0, 0.60 - ms.score) ORDER BY x.k) AS vals FROM pts z JOIN pts x ON x.region_id = z.region_id AND x.k < z.k JOIN n ON n.region_id = z.region_id JOIN ms ON ms.region_id = z.region_id AND ms.s = x.c AND ms.e = z.c - 1 GROUP BY 1, 2"),
    ("sl", """SELECT region_id, CAST(0 AS BIGINT) AS k, CAST([0.0] AS DOUBLE[]) AS best, CAST([0] AS BIGINT[]) AS back FROM ck UNION ALL
        SELECT region_id, k + 1, list_append(best, list_max(o) + w), list_append(back, CAST(list_position(o, list_max(o)) AS BIGINT)) FROM (SELECT sl.region_id, sl.k, sl.best, sl.back, op.w, list_transform(sl.best, lambda x, i: x + op.vals[i]) AS o FROM sl JOIN ck ON ck.region_id = sl.region_id AND sl.k < ck.last JOIN op ON op.region_id = sl.region_id AND op.k = sl.k + 1)"""),
    ("fin", "SELECT sl.region_id, sl.back, list_transform(sl.best, lambda x, i: x + op.vals[i]) AS f FROM sl JOIN ck ON ck.region_id = sl.region_id AND ck.last = sl.k JOIN op ON op.region_id = sl.region_id AND op.k = sl.k + 1"),
    ("bk", "SELECT region_id, back, CAST(list_position(f[2:], list_max(f[2:])) + 1 AS BIGINT) AS pos FROM fin WHERE list_max(f[2:]) > f[1] UNION ALL SELECT region_id, back, back[pos] FROM bk WHERE back[pos] > 1"),
]


@register("q_selection", chain("rj", """SELECT rj.region_id, rj.b, round(rj.score, 6) AS score, round(rj.prominence, 6) AS prominence, CASE WHEN cand.c IS NOT NULL AND bk.pos IS NULL THEN 'not_in_global_optimum' ELSE rj.reasons END AS rejection_reasons, bk.pos IS NOT NULL AS recommended
    FROM rj LEFT JOIN cand ON cand.region_id = rj.region_id AND cand.c = rj.b + 1 LEFT JOIN bk ON bk.region_id = cand.region_id AND bk.pos = cand.k + 1""", _SELECTION))
def selection(spark, sf_dir):
    st = events(spark, sf_dir)
    rows = scoring.select(scoring.reject(scoring.peaks(scored(spark, sf_dir))), st)
    return flat(rows.select("region_id", "b", "score", "prominence", "rejection_reasons", "recommended"))


@register("q_vocab_shift_conv", f"""{CONV}, fr AS (SELECT a.region_id, a.idx AS b, list_distinct(flatten(list(j.w) FILTER (j.idx <= a.idx))) AS l, list_distinct(flatten(list(j.w) FILTER (j.idx > a.idx))) AS r FROM st a JOIN st j ON j.region_id = a.region_id AND j.idx BETWEEN a.idx - 3 AND a.idx + 4 WHERE EXISTS (SELECT 1 FROM st z WHERE z.region_id = a.region_id AND z.idx = a.idx + 1) GROUP BY 1, 2)
    SELECT region_id, b, round(CASE WHEN len(list_concat(l, r)) > 0 THEN 1.0 - len(list_intersect(l, r)) * 1.0 / len(list_distinct(list_concat(l, r))) ELSE 1.0 END, 6) AS vocabulary_shift FROM fr""")
def vocab_shift_conv(spark, sf_dir):
    rows = facts.statement_facts(conversation_statements(read(spark, sf_dir, "conversations")))
    return flat(rows.select("region_id", "b", feat.expressions()["vocabulary_shift"].alias("vocabulary_shift")))


@register("q_role_cosine", chain("bd", """SELECT bd.region_id, bd.b, round(1.0 - coalesce(d.dot, 0) / (sqrt(a.q) * sqrt(z.q) + 1e-8), 6) AS role_distance FROM bd JOIN (SELECT region_id, b, sum(c * c) AS q FROM cl GROUP BY 1, 2) a ON a.region_id = bd.region_id AND a.b = bd.b JOIN (SELECT region_id, b, sum(c * c) AS q FROM cr GROUP BY 1, 2) z ON z.region_id = bd.region_id AND z.b = bd.b
    LEFT JOIN (SELECT cl.region_id, cl.b, sum(cl.c * cr.c) AS dot FROM cl JOIN cr ON cl.region_id = cr.region_id AND cl.b = cr.b AND cl.role = cr.role GROUP BY 1, 2) d ON d.region_id = bd.region_id AND d.b = bd.b""", [("cl", "SELECT region_id, b, role, count(*) AS c FROM lw GROUP BY 1, 2, 3"), ("cr", "SELECT region_id, b, role, count(*) AS c FROM rw GROUP BY 1, 2, 3")]))
def role_cosine(spark, sf_dir):
    rows = facts.statement_facts(events(spark, sf_dir))
    return flat(rows.select("region_id", "b", feat.cosine_distance("left_role_histogram", "right_role_histogram").alias("role_distance")))


def queries() -> dict[str, Query]:
    from weftline.plans import catalog_more, grammar  # noqa: F401  they register the rest

    return {k: shipped(f) for k, f in QUERIES.items()}


def oracles() -> dict[str, str]:
    queries()
    return dict(ORACLES)


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shipped(QUERIES["q_selection"])(spark, sf_dir)
