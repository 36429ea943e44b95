"""DuckDB SQL of the event-sequence queries: one chain of common table expressions, of which each query takes its end."""

from __future__ import annotations

import re

from weftline.operators.scoring import WEIGHTS

JOIN = "b.region_id = j.region_id"

CTES: list[tuple[str, str]] = [
    ("st", """SELECT 'user:' || user_id AS region_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS idx, event_type AS kind, value AS v,
        'k' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 12) AS s, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS line,
        event_type IN ('signup', 'view') AS d, event_type IN ('click', 'purchase') AS r, event_type = 'error' AS m FROM events"""),
    ("stx", """SELECT *, CASE WHEN v < 5 THEN 'unknown' WHEN kind = 'signup' THEN 'acquisition' WHEN kind = 'view' THEN 'transformation' WHEN kind = 'click' THEN 'aggregation' WHEN kind = 'purchase' THEN 'output' WHEN kind = 'error' THEN 'normalization' ELSE 'unknown' END AS role,
        CASE kind WHEN 'purchase' THEN 'output' WHEN 'signup' THEN 'file_read' END AS effect, kind = 'view' AND v >= 50 AS compound, CASE WHEN kind IN ('purchase', 'signup', 'error') AND v >= 20 THEN 1.0 ELSE 0.0 END AS support FROM st"""),
    ("n", "SELECT region_id, count(*) AS n FROM st GROUP BY 1"),
    ("occ", "SELECT region_id, s, min(idx) AS f, max(idx) AS l FROM st WHERE d OR r OR m GROUP BY 1, 2"),
    ("ed", """SELECT region_id, src, idx AS tgt, s FROM (SELECT *, max(CASE WHEN d OR m THEN idx END) OVER (PARTITION BY region_id, s ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS src FROM st WHERE d OR r OR m) WHERE (r OR m) AND src IS NOT NULL"""),
    ("bd", """SELECT a.*, a.idx AS b, n.n, z.line AS next_line, z.kind AS next_kind, z.s AS next_s, z.v AS next_v, z.support AS next_support, z.r AS next_r, z.m AS next_m FROM stx a JOIN n USING (region_id) JOIN stx z ON z.region_id = a.region_id AND z.idx = a.idx + 1"""),
    ("lw", f"SELECT b.b, j.* FROM bd b JOIN stx j ON {JOIN} AND j.idx BETWEEN b.b - 3 AND b.b"),
    ("rw", f"SELECT b.b, j.* FROM bd b JOIN stx j ON {JOIN} AND j.idx BETWEEN b.b + 1 AND b.b + 4"),
    ("dbc", f"""SELECT b.region_id, b.b, coalesce(string_agg(j.s, ',' ORDER BY j.s) FILTER (j.l = b.b), '') AS dead, coalesce(string_agg(j.s, ',' ORDER BY j.s) FILTER (j.f = b.b + 1), '') AS born, coalesce(string_agg(j.s, ',' ORDER BY j.s) FILTER (j.f <= b.b AND b.b < j.l), '') AS crossing,
        count(*) FILTER (j.l = b.b) AS dead_n, count(*) FILTER (j.f = b.b + 1) AS born_n, count(*) FILTER (j.f <= b.b AND b.b < j.l) AS cross_n FROM bd b JOIN occ j ON {JOIN} GROUP BY 1, 2"""),
    ("xe", f"SELECT b.b, b.n, j.* FROM bd b JOIN ed j ON {JOIN} AND j.src <= b.b AND b.b < j.tgt"),
    ("xs", "SELECT region_id, b, s, count(*) AS k FROM xe GROUP BY 1, 2, 3"),
    ("xst", """SELECT e.region_id, e.b, count(*) AS cross_dep, sum(tgt - src) * 1.0 / count(*) AS span_mean, max(tgt - src) AS span_max, count(DISTINCT tgt) AS targets, sum((1.0 + k) / greatest(1, tgt - e.b)) AS unfinished, sum(k) AS reuse, count(*) FILTER (src = e.b AND tgt <= e.b + 2) AS followups,
        string_agg(DISTINCT e.s, ',' ORDER BY e.s) AS inputs, count(DISTINCT e.s) AS inputs_n FROM xe e JOIN xs USING (region_id, b, s) GROUP BY 1, 2"""),
    ("outp", """SELECT x.region_id, x.b, string_agg(DISTINCT x.s, ',' ORDER BY x.s) AS outputs, count(DISTINCT x.s) AS outputs_n FROM xs x JOIN lw ON lw.region_id = x.region_id AND lw.b = x.b AND lw.s = x.s AND (lw.d OR lw.m) GROUP BY 1, 2"""),
    ("nb", f"""SELECT b.region_id, b.b, count(*) FILTER (j.src >= b.b - 3 AND j.tgt <= b.b + 4) AS nearby, count(*) FILTER (j.src >= b.b - 3 AND j.tgt <= b.b + 4 AND j.src <= b.b AND b.b < j.tgt) AS near_cross, count(*) FILTER (j.src >= b.b - 3 AND j.tgt <= b.b) AS near_left, count(*) FILTER (j.src > b.b AND j.tgt <= b.b + 4) AS near_right,
        count(*) FILTER (j.src >= b.b - 11 AND j.tgt <= b.b + 12) AS medium, count(*) FILTER (j.src >= b.b - 11 AND j.tgt <= b.b + 12 AND j.src <= b.b AND b.b < j.tgt) AS medium_cross FROM bd b JOIN ed j ON {JOIN} GROUP BY 1, 2"""),
    ("lf", """SELECT region_id, b, count(*) AS left_size, count(DISTINCT s) AS left_symbols, string_agg(DISTINCT kind, ',' ORDER BY kind) AS left_calls, list_sort(list_distinct(list(s))) AS left_list, list_distinct(list(kind)) AS left_call_list, list_distinct(list(effect) FILTER (effect IS NOT NULL)) AS left_effects FROM lw GROUP BY 1, 2"""),
    ("rf", """SELECT region_id, b, count(*) AS right_size, count(DISTINCT s) AS right_symbols, string_agg(DISTINCT kind, ',' ORDER BY kind) AS right_calls, list_sort(list_distinct(list(s))) AS right_list, list_distinct(list(kind)) AS right_call_list, list_distinct(list(effect) FILTER (effect IS NOT NULL)) AS right_effects FROM rw GROUP BY 1, 2"""),
    ("both_w", "SELECT * FROM lw UNION ALL SELECT * FROM rw"),
    ("rel", """SELECT region_id, b, min(CASE WHEN v >= 1 THEN 1.0 ELSE 0.0 END) AS parse, sum(CASE WHEN v >= 5 THEN 1 ELSE 0 END) + sum(CASE WHEN kind = 'click' AND v >= 50 THEN 1 ELSE 0 END) AS resolved, sum(CASE WHEN v < 5 THEN 1 ELSE 0 END) AS unresolved, bool_or(v < 5) AS ambiguous, bool_or(kind = 'error' AND v >= 90) AS shared,
        min(CASE WHEN v < 5 THEN 0.65 ELSE 1.0 END) AS site FROM both_w GROUP BY 1, 2"""),
    ("relx", """SELECT *, CASE WHEN resolved + unresolved > 0 THEN resolved * 1.0 / (resolved + unresolved) ELSE 1.0 END AS call_resolution, parse * (CASE WHEN shared THEN 0.35 ELSE 1.0 END) * (CASE WHEN ambiguous THEN 0.7 ELSE 1.0 END) AS dependency, parse * (CASE WHEN ambiguous THEN 0.7 ELSE 1.0 END) AS role_reliability, parse * site AS callsite,
        concat_ws(',', CASE WHEN parse < 1 THEN 'parse_error' END, CASE WHEN unresolved > 0 THEN 'unresolved_call' END, CASE WHEN ambiguous THEN 'ambiguous_call_index' END, CASE WHEN shared THEN 'dynamic_workspace' END, CASE WHEN shared THEN 'global_persistent_state' END, CASE WHEN ambiguous THEN 'unknown_role' END) AS codes,
        concat_ws(',', CASE WHEN ambiguous THEN 'ambiguous_call_or_index' END, CASE WHEN shared THEN 'global_state' END) AS risks FROM rel"""),
    ("tgt", """SELECT b.region_id, b.b, j.kind AS t_kind, j.s AS t_s FROM bd b JOIN stx j ON b.region_id = j.region_id AND j.idx BETWEEN b.b + 1 AND b.b + 3 AND j.support > 0 QUALIFY row_number() OVER (PARTITION BY b.region_id, b.b ORDER BY j.idx) = 1"""),
    ("cs", """SELECT b.region_id, b.b, least(b.support, b.next_support) AS transition,
        CASE WHEN b.support > 0 AND b.next_support > 0 THEN (CASE WHEN b.kind = 'signup' AND b.next_kind IN ('purchase', 'error') AND b.s = b.next_s THEN 1.0 ELSE 0.0 END) / greatest(1, CASE WHEN b.kind = 'signup' AND b.next_kind IN ('purchase', 'error') THEN (CASE WHEN b.s = b.next_s THEN 1 ELSE 2 END) WHEN b.kind = 'signup' OR b.next_kind IN ('purchase', 'error') THEN 1 ELSE 0 END) ELSE 0.0 END AS handoff,
        CASE WHEN b.support = 0 AND (b.d OR b.m) AND t.t_kind IN ('purchase', 'error') AND t.t_s = b.s THEN 1.0 ELSE 0.0 END AS setup,
        CASE WHEN b.support > 0 AND b.next_support = 0 AND b.kind = 'signup' AND (b.next_r OR b.next_m) AND b.s = b.next_s THEN 1.0 ELSE 0.0 END AS finalization,
        CASE WHEN b.kind = 'view' AND b.next_kind = 'view' THEN 1.0 ELSE 0.0 END AS primitive_chain FROM bd b LEFT JOIN tgt t ON t.region_id = b.region_id AND t.b = b.b"""),
    ("inc", "SELECT a.region_id, a.idx, a.role, a.s, e.src FROM stx a JOIN ed e ON e.region_id = a.region_id AND e.tgt = a.idx WHERE a.role IN ('aggregation', 'normalization', 'shaping')"),
    ("len", """SELECT p.region_id, p.idx AS p, CASE WHEN a.idx IS NULL THEN 0 WHEN c.idx IS NULL THEN 1 WHEN g.idx IS NULL THEN 2 WHEN h.idx IS NULL THEN 3 ELSE 4 END AS len FROM stx p
        LEFT JOIN inc a ON a.region_id = p.region_id AND a.idx = p.idx + 1 AND a.src >= p.idx LEFT JOIN inc c ON c.region_id = p.region_id AND c.idx = p.idx + 2 AND c.src >= p.idx
        LEFT JOIN inc g ON g.region_id = p.region_id AND g.idx = p.idx + 3 AND g.src >= p.idx LEFT JOIN inc h ON h.region_id = p.region_id AND h.idx = p.idx + 4 AND h.src >= p.idx WHERE p.compound"""),
    ("comp", """SELECT x.region_id, x.p, x.b, x.p + x.len AS through, string_agg(DISTINCT i.role, ',' ORDER BY i.role) AS roles, string_agg(DISTINCT i.s, ',' ORDER BY i.s) AS symbols FROM (SELECT *, p + k - 1 AS b FROM len, (VALUES (1), (2), (3), (4)) t(k) WHERE k <= len) x
        JOIN inc i ON i.region_id = x.region_id AND i.idx > x.b AND i.idx <= x.p + x.len GROUP BY 1, 2, 3, 4 QUALIFY row_number() OVER (PARTITION BY x.region_id, x.b ORDER BY x.p DESC) = 1"""),
    ("fx", """SELECT bd.region_id, bd.b, bd.line AS after_line, bd.next_line AS before_line, bd.compound, CASE WHEN bd.m AND NOT (bd.v >= 1 AND bd.next_v >= 1) THEN 'adjacent_parse_error,error_shared_state' WHEN bd.m THEN 'error_shared_state' WHEN NOT (bd.v >= 1 AND bd.next_v >= 1) THEN 'adjacent_parse_error' ELSE '' END AS constraints,
        dead_n, born_n, cross_n, left_size, right_size, left_symbols, right_symbols, left_list, right_list, left_call_list, right_call_list, coalesce(left_effects, []) AS left_effects, coalesce(right_effects, []) AS right_effects,
        coalesce(cross_dep, 0) AS cross_dep, coalesce(targets, 0) AS targets, coalesce(followups, 0) AS followups, coalesce(inputs_n, 0) AS inputs_n, coalesce(outputs_n, 0) AS outputs_n, coalesce(nearby, 0) AS nearby, coalesce(near_cross, 0) AS near_cross, coalesce(near_left, 0) AS near_left, coalesce(near_right, 0) AS near_right, coalesce(medium, 0) AS medium, coalesce(medium_cross, 0) AS medium_cross,
        comp.b IS NOT NULL AS chained, transition, handoff, setup, finalization, primitive_chain
        FROM bd JOIN dbc USING (region_id, b) JOIN lf USING (region_id, b) JOIN rf USING (region_id, b) JOIN cs USING (region_id, b) LEFT JOIN xst USING (region_id, b) LEFT JOIN outp USING (region_id, b) LEFT JOIN nb USING (region_id, b) LEFT JOIN comp USING (region_id, b)"""),
    ("ft", """SELECT region_id, b, after_line, before_line, constraints, CASE WHEN left_symbols > 0 THEN least(1.0, 2.0 * dead_n / left_symbols) ELSE 0.0 END AS variable_death, CASE WHEN right_symbols > 0 THEN least(1.0, 2.0 * born_n / right_symbols) ELSE 0.0 END AS variable_birth, 1.0 / (1.0 + 0.45 * cross_n) AS interface_compactness,
        CASE WHEN nearby > 0 THEN 1.0 - near_cross * 1.0 / nearby ELSE 0.5 END AS dependency_drop, CASE WHEN medium > 0 THEN 1.0 - medium_cross * 1.0 / medium ELSE 0.5 END AS medium_dependency_drop,
        1.0 - len(list_intersect(left_list, right_list)) * 1.0 / len(list_distinct(list_concat(left_list, right_list))) AS vocabulary_shift, CASE WHEN compound THEN 1.0 / (1.0 + followups) ELSE 0.0 END AS structural_completion, 1.0 / (1.0 + 0.35 * inputs_n) AS input_interface_compactness, 1.0 / (1.0 + 0.35 * outputs_n) AS output_interface_compactness,
        (near_left * 1.0 / (near_left + greatest(1, left_size - 1)) + near_right * 1.0 / (near_right + greatest(1, right_size - 1))) / 2.0 AS local_cohesion_support, 1.0 - len(list_intersect(left_call_list, right_call_list)) * 1.0 / len(list_distinct(list_concat(left_call_list, right_call_list))) AS call_set_change,
        CASE WHEN len(list_concat(left_effects, right_effects)) > 0 THEN 1.0 - len(list_intersect(left_effects, right_effects)) * 1.0 / len(list_distinct(list_concat(left_effects, right_effects))) ELSE 0.0 END AS effect_set_change, CASE WHEN compound THEN 1.0 / (1.0 + followups) ELSE 0.5 END AS control_followup_completion,
        CASE WHEN cross_dep > 0 THEN targets * 1.0 / cross_dep ELSE 1.0 END AS dependency_target_dispersion, CASE WHEN chained THEN 0.0 ELSE 1.0 END AS task_completion, transition AS standalone_call_transition, handoff AS artifact_handoff, 1.0 - setup AS call_setup_completion, 1.0 - finalization AS call_finalization_completion, 1.0 - primitive_chain AS nonprimitive_call_chain FROM fx"""),
    ("sc", f"SELECT *, CAST(({' + '.join(['CAST(0.0 AS DOUBLE)', *(f'CAST({w!r} AS DOUBLE) * {k}' for k, w in WEIGHTS.items())])}) / CAST({sum(WEIGHTS.values())!r} AS DOUBLE) AS DOUBLE) AS score FROM ft"),
    ("pk", """SELECT sc.*, score >= lag(score, 1, -1.0) OVER w AND score >= lead(score, 1, -1.0) OVER w AS peak, (SELECT greatest(0.0, sc.score - median(o.score)) FROM sc o WHERE o.region_id = sc.region_id AND o.b BETWEEN sc.b - 5 AND sc.b + 5 AND o.b <> sc.b) AS lift FROM sc WINDOW w AS (PARTITION BY region_id ORDER BY b)"""),
    ("rj", """SELECT *, coalesce(lift, 0.0) AS prominence, concat_ws(',', CASE WHEN constraints <> '' THEN 'hard_constraint' END, CASE WHEN after_line = before_line THEN 'same_line_boundary' END, CASE WHEN peak AND score < 0.58 THEN 'below_score_threshold' END, CASE WHEN peak AND coalesce(lift, 0.0) < 0.055 THEN 'low_prominence' END) AS reasons FROM pk"""),
]


def chain(end: str, select: str, more: list[tuple[str, str]] = []) -> str:
    """The expressions that `end` needs, and the query over them."""
    ctes = CTES + more
    known = dict(ctes)
    names = [k for k, _ in ctes]
    need, todo = set(), [end, *(x for x in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", select) if x in known)]
    while todo:
        k = todo.pop()
        if k not in need:
            need.add(k)
            todo += [x for x in names if x != k and re.search(rf"\b{x}\b", known[k]) and re.search(rf"(?:FROM|JOIN|,)\s+{x}\b", known[k])]
    recursive = {k for k in need if re.search(rf"(?:FROM|JOIN)\s+{k}\b", known[k])}
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(f"{k} AS {'' if k in recursive else 'MATERIALIZED '}({v})" for k, v in ctes if k in need) + f"\n{select}"
