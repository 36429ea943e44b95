"""Queries over programs that are derived from a small grammar, one for each conversation, whose facts follow from the
derivation: statements of every form with the sets and call sites they must have, and loops with jumps whose flow graph is
known. The SQL states those facts from the derivation; it never looks at a program's text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import flow
from weftline.plans.catalog import flat, read, register
from weftline.plans.catalog_more import CLOSURES, NEIGHBOURS, POSTDOMINATORS, neighbours
from weftline.schema import KEY, SETS
from weftline.sources import mlang

#: Statement forms: a text, and the sets it must have where they aren't empty. {t} is the statement's number; `base` and
#: `rec` are variables that each program defines first.
FORMS = (
    ("a{t} = base + 1;", {"definitions": "a{t}", "reads": "base"}),
    ("a{t} = rec.size;", {"definitions": "a{t}", "reads": "rec,size", "access_domains": "rec.size"}),
    ("rec.part{t} = base;", {"reads": "base,rec", "mutations": "rec", "access_domains": "rec.part{t}"}),
    ("base({t}) = rec;", {"reads": "base,rec", "mutations": "base"}),
    ("[p{t}, q{t}] = size(base);", {"definitions": "p{t},q{t}", "reads": "base", "calls": "size", "resolved_calls": "size", "effects": "call_or_index"}),
    ("h{t} = @helper;", {"definitions": "h{t}", "calls": "helper", "unresolved_calls": "helper", "effects": "function_handle", "risks": "indirect_call"}),
    ("g{t} = @(u) u + base;", {"definitions": "g{t}", "reads": "base", "effects": "function_handle", "risks": "indirect_call"}),
    ("clear old{t}", {"mutations": "old{t}", "calls": "clear", "resolved_calls": "clear", "effects": "workspace_write"}),
    ("load data{t}", {"calls": "load", "resolved_calls": "load", "effects": "file_read,workspace_write", "risks": "workspace_injection", "roles": "acquisition"}),
    ("run job{t}", {"calls": "run", "resolved_calls": "run", "effects": "file_read,workspace_read,workspace_write", "risks": "external_dependency,workspace_injection", "forbid_cut_before": "external_script_shared_workspace", "forbid_cut_after": "external_script_shared_workspace", "roles": "acquisition"}),
    ("a{t} = sum(abs(base));", {"definitions": "a{t}", "reads": "base", "calls": "abs,sum", "resolved_calls": "abs,sum", "effects": "call_or_index", "roles": "aggregation"}),
    ("disp(base);", {"reads": "base", "calls": "disp", "resolved_calls": "disp", "effects": "call_or_index,output", "roles": "output"}),
    ("a{t} = other{t}(base, rec);", {"definitions": "a{t}", "reads": "base,rec", "calls": "other{t}", "unresolved_calls": "other{t}", "effects": "call_or_index", "risks": "ambiguous_call_or_index"}),
    ("a{t} = base({t});", {"definitions": "a{t}", "calls": "base", "resolved_indexes": "base", "effects": "call_or_index"}),
    ("global s{t}", {"definitions": "s{t}", "effects": "workspace_write", "risks": "global_state"}),
    ("eval('1');", {"calls": "eval", "unresolved_calls": "eval", "effects": "call_or_index,workspace_read,workspace_write", "risks": "ambiguous_call_or_index,dynamic_evaluation,workspace_injection"}),
    ("a{t} = base / 2;", {"definitions": "a{t}", "reads": "base", "roles": "normalization"}),
    ("a{t} = reshape(base, 1, []);", {"definitions": "a{t}", "reads": "base", "calls": "reshape", "resolved_calls": "reshape", "effects": "call_or_index", "roles": "shaping"}),
)
#: Call sites of those forms in order: form's place, name, form, origin, abstraction, inputs, outputs, standalone, only, reliability.
SITES = (
    (3, "base", "direct_assignment", "unresolved", "unknown", "", "", True, True, 0.65),
    (4, "size", "direct_multi_output", "builtin", "primitive", "base", "p{t},q{t}", True, True, 1.0),
    (7, "clear", "command", "unresolved", "unknown", "", "", True, True, 0.65),
    (8, "load", "command", "unresolved", "unknown", "", "", True, True, 0.65),
    (9, "run", "command", "unresolved", "unknown", "", "", True, True, 0.65),
    (10, "sum", "direct_assignment", "builtin", "primitive", "base", "a{t}", True, False, 1.0),
    (10, "abs", "nested_expression", "builtin", "primitive", "base", "", False, False, 1.0),
    (11, "disp", "effect_only", "builtin", "primitive", "base", "", True, True, 1.0),
    (12, "other{t}", "direct_assignment", "unresolved", "unknown", "base,rec", "a{t}", True, True, 0.65),
    (13, "base", "direct_assignment", "index_access", "primitive", "", "a{t}", True, True, 1.0),
    (15, "eval", "effect_only", "unresolved", "unknown", "", "", True, True, 0.65),
    (17, "reshape", "direct_assignment", "builtin", "primitive", "base", "a{t}", True, True, 1.0),
)
STEP = 5  # a conversation's turns go through the forms in steps of that


def _programs(lines: DataFrame, first: str, part: str) -> DataFrame:
    """Regions of the programs of lines (conv_id, place, text), each after some first lines."""
    text = F.concat(F.lit(first), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n"), F.lit("\n"))
    made = lines.groupBy("conv_id").agg(F.encode(text, "UTF-8").alias("content"))
    return mlang.programs(made.select(F.concat(F.lit("made/"), F.col("conv_id").cast("string"), F.lit(".m")).alias("path"), "content"), (part,))


def _turns(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("t")).distinct()


def forms(spark, sf_dir) -> DataFrame:
    texts = F.array(*(F.lit(x) for x, _ in FORMS))
    text = F.replace(F.get(texts, F.pmod(F.col("conv_id") + STEP * F.col("t"), F.lit(len(FORMS))).cast("int")), F.lit("{t}"), F.col("t").cast("string"))
    return _programs(_turns(spark, sf_dir).select("conv_id", F.col("t").alias("place"), text.alias("text")), "base = 3;\nrec = 4;\n", "statements")


def _quote(v) -> str:
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def _values(rows) -> str:
    return ", ".join(f"({', '.join(map(_quote, r))})" for r in rows)


_KIND = {"clear": "command", "load": "command", "run": "command", "disp": "statement", "global": "statement", "eval": "statement"}
_BY_FORM = [(i, _KIND.get(text.split("(")[0].split()[0], "assignment"), *(({"roles": "unknown"} | sets).get(c, "") for c in SETS)) for i, (text, sets) in enumerate(FORMS)]
_TURNS = f"""WITH tu AS (SELECT DISTINCT conv_id AS c, CAST(turn AS BIGINT) AS t FROM conversations), pl AS (SELECT 'made/' || c || '.m' AS path, 'script:top-level' AS region_id, 1 + row_number() OVER (PARTITION BY c ORDER BY t) AS idx, t, (c + {STEP} * t) % {len(FORMS)} AS form FROM tu)"""
_FILLED = ", ".join(f"replace({c}, '{{t}}', CAST(t AS VARCHAR)) AS {c}" for c in SETS)


@register("q_parse_forms", f"""{_TURNS}, fo(form, kind, {", ".join(SETS)}) AS (VALUES {_values(_BY_FORM)}), fi(idx, kind, {", ".join(SETS)}) AS (VALUES {_values([(i, "assignment", *({"definitions": name, "roles": "unknown"}.get(c, "") for c in SETS)) for i, name in enumerate(("base", "rec"))])})
    SELECT path, region_id, idx, kind, idx + 1 AS line, {_FILLED} FROM pl JOIN fo USING (form) UNION ALL SELECT DISTINCT path, region_id, fi.idx, fi.kind, fi.idx + 1, {", ".join(f"fi.{c}" for c in SETS)} FROM pl, fi""")
def parse_forms(spark, sf_dir):
    """Every form of statement, target, expression and command: the sets of its facts."""
    return flat(mlang.statements(forms(spark, sf_dir)).select(*KEY, "idx", "kind", F.col("start_line").alias("line"), *SETS))


_SITE = ("name", "form", "origin", "abstraction", "inputs", "outputs", "standalone", "only", "reliability")


@register("q_call_sites", f"""{_TURNS}, si(form, place, {", ".join(f"s_{c}" for c in _SITE)}) AS (VALUES {_values([(s[0], sum(x[0] == s[0] for x in SITES[:k]), *s[1:]) for k, s in enumerate(SITES)])})
    SELECT path, region_id, idx, place, {", ".join(f"replace(s_{c}, '{{t}}', CAST(t AS VARCHAR)) AS {c}" if c in ("name", "inputs", "outputs") else f"s_{c} AS {c}" for c in _SITE)} FROM pl JOIN si USING (form)""")
def call_sites(spark, sf_dir):
    """The call sites of those programs."""
    rows = mlang.statements(forms(spark, sf_dir)).select(*KEY, "idx", F.posexplode("call_sites").alias("place", "s"))
    names = ("name", "form", "origin", "abstraction", "input_symbols", "output_symbols", "is_standalone_statement", "is_only_operation", "resolution_reliability")
    return flat(rows.select(*KEY, "idx", "place", *(F.col(f"s.{a}").alias(b) for a, b in zip(names, _SITE))))


#: Loops with jumps: conversation c's unit o reads x{p} (p = o) and makes x{t} and y{t} (t = o + 1). Which variants a unit has:
VARIANTS = {"head": ("for", "while"), "first": ("break", "continue", "return"), "second": ("", "break", "continue", "return"), "tail": ("", "plain", "inner")}
_PICK = {"head": "(c + o) % 2", "first": "(c + 2 * o) % 3", "second": "(3 * c + o) % 4", "tail": "(c + o // 2) % 3"}
#: A unit's lines: text, and when it is there (all lines without a condition are).
LINES = (
    ("for i = 1:x{p}", "head = 'for'"), ("while x{p} > 0", "head = 'while'"), ("  if x{p} > 1", ""), ("    {first};", ""), ("  elseif x{t} < 2", "second <> ''"), ("    {second};", "second <> ''"), ("  else", "tail <> ''"), ("    x{t} = x{p} * 2;", "tail = 'plain'"),
    ("    for j = 1:2", "tail = 'inner'"), ("      if x{p} > j", "tail = 'inner'"), ("        break;", "tail = 'inner'"), ("      end", "tail = 'inner'"), ("    end", "tail = 'inner'"), ("  end", ""), ("  x{t} = x{t} + x{p};", ""), ("end", ""), ("y{t} = x{t};", ""),
)


def jumps(spark, sf_dir) -> DataFrame:
    rows = _turns(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts")).select(F.col("conv_id").alias("c"), F.posexplode("ts").alias("o", "turn"))
    rows = rows.withColumns({k: F.get(F.array(*map(F.lit, v)), F.expr(_PICK[k].replace("//", "div")).cast("int")) for k, v in VARIANTS.items()})
    text = F.array(*(F.when(F.expr(when or "true"), F.lit(line)) for line, when in LINES))
    text = F.array_join(F.filter(text, lambda x: x.isNotNull()), "\n")
    for name, v in (("{p}", F.col("o").cast("string")), ("{t}", (F.col("o") + 1).cast("string")), ("{first}", F.col("first")), ("{second}", F.col("second"))):
        text = F.replace(text, F.lit(name), v)
    return _programs(rows.select(F.col("c").alias("conv_id"), F.col("o").alias("place"), text.alias("text")), "x0 = 9;\n", "graph")


#: Nodes by slot: 0 loop, 1 first condition, 2 its jump, 3 second condition, 4 its jump, 5 tail, 6 and 7 inner condition and
#: break, 8 the loop's last statement, 9 the statement after it. Edges lead to slots; 10 is the next unit's loop, -1 the exit.
_JUMP = "CASE {} WHEN 'break' THEN 9 WHEN 'continue' THEN 0 ELSE -1 END"
_TAIL = "CASE WHEN tail <> '' THEN 5 ELSE 8 END"
_EDGES = (
    (0, "1", ""), (0, "9", ""), (1, "2", ""), (1, f"CASE WHEN second <> '' THEN 3 ELSE {_TAIL} END", ""), (2, _JUMP.format("first"), ""), (3, "4", "second <> ''"), (3, _TAIL, "second <> ''"), (4, _JUMP.format("second"), "second <> ''"),
    (5, "8", "tail <> ''"), (5, "6", "tail = 'inner'"), (6, "7", "tail = 'inner'"), (6, "5", "tail = 'inner'"), (7, "8", "tail = 'inner'"), (8, "0", ""), (9, "10", ""),
)
#: written and read symbols by slot
_WRITES = ((0, "'i'", "head = 'for'"), (5, "'x' || (o + 1)", "tail = 'plain'"), (5, "'j'", "tail = 'inner'"), (8, "'x' || (o + 1)", ""), (9, "'y' || (o + 1)", ""))
_READS = ((0, "'x' || o", ""), (1, "'x' || o", ""), (3, "'x' || (o + 1)", "second <> ''"), (5, "'x' || o", "tail = 'plain'"), (6, "'x' || o", "tail = 'inner'"), (6, "'j'", "tail = 'inner'"), (8, "'x' || (o + 1)", ""), (8, "'x' || o", ""), (9, "'x' || (o + 1)", ""))


def _each(rows, name: str) -> str:
    return " UNION ALL ".join(f"SELECT graph_id, o, {slot} AS slot, {v} AS {name} FROM uv WHERE {when or 'true'}" for slot, v, when in rows)


_JUMPS = f"""WITH RECURSIVE un AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY t) - 1 AS o FROM (SELECT DISTINCT conv_id AS c, turn AS t FROM conversations)),
    uv AS MATERIALIZED (SELECT 'made/' || c AS graph_id, o, {", ".join(f"[{', '.join(map(_quote, v))}][{_PICK[k]} + 1] AS {k}" for k, v in VARIANTS.items())} FROM un),
    sl AS (SELECT graph_id, o, unnest([0, 1, 2, 8, 9] || CASE WHEN second <> '' THEN [3, 4] ELSE [] END || CASE tail WHEN 'plain' THEN [5] WHEN 'inner' THEN [5, 6, 7] ELSE [] END) AS slot FROM uv),
    nd AS MATERIALIZED (SELECT graph_id, o, slot, 2 + row_number() OVER (PARTITION BY graph_id ORDER BY o, slot) AS node, 2 * o + CASE WHEN slot = 9 THEN 2 ELSE 1 END AS idx FROM sl UNION ALL SELECT DISTINCT graph_id, -1, 9, 2, 0 FROM uv),
    se AS ({_each(_EDGES, "b")} UNION ALL SELECT DISTINCT graph_id, -1, 9, 10 FROM uv),
    fe AS MATERIALIZED (SELECT DISTINCT se.graph_id, x.node AS a, coalesce(y.node, 1) AS b FROM se JOIN nd x ON x.graph_id = se.graph_id AND x.o = se.o AND x.slot = se.slot LEFT JOIN nd y ON y.graph_id = se.graph_id AND y.o = se.o + CASE WHEN se.b = 10 THEN 1 ELSE 0 END AND y.slot = se.b % 10 UNION SELECT DISTINCT graph_id, 0, 2 FROM uv),
    wr AS MATERIALIZED (SELECT DISTINCT w.graph_id, nd.node, s FROM ({_each(_WRITES, "s")} UNION ALL SELECT DISTINCT graph_id, -1, 9, 'x0' FROM uv) w JOIN nd ON nd.graph_id = w.graph_id AND nd.o = w.o AND nd.slot = w.slot),
    ru AS MATERIALIZED (SELECT DISTINCT r.graph_id, nd.node, s FROM ({_each(_READS, "s")}) r JOIN nd ON nd.graph_id = r.graph_id AND nd.o = r.o AND nd.slot = r.slot), {CLOSURES}"""
_AT = "graph_id || '.m' AS path, 'script:top-level' AS region_id"


@register("q_flow_jumps", f"{_JUMPS} {NEIGHBOURS}")
def flow_jumps(spark, sf_dir):
    """Flow graphs of loops with break, continue, return, elseif and inner loops."""
    return neighbours(jumps(spark, sf_dir))


@register("q_reaching_jumps", f"{_JUMPS} SELECT {_AT}, source, target, symbol FROM rr")
def reaching_jumps(spark, sf_dir):
    return flat(flow.reaching_definitions(jumps(spark, sf_dir)))


@register("q_postdominators_jumps", f"{_JUMPS} {POSTDOMINATORS}")
def postdominators_jumps(spark, sf_dir):
    return flat(flow.postdominance(jumps(spark, sf_dir)))


@register("q_control_jumps", f"{_JUMPS} SELECT {_AT}, source, target FROM cd")
def control_jumps(spark, sf_dir):
    return flat(flow.control_dependence(jumps(spark, sf_dir)))


@register("q_pdg_jumps", f"{_JUMPS} SELECT {_AT}, source, target, kind, symbol FROM pg")
def pdg_jumps(spark, sf_dir):
    return flat(flow.projected(jumps(spark, sf_dir), include_internal=True))
