"""Frontend for ``.m`` files: statements with their facts, call sites, roles, and the flow graph of every region.

Files are read as binary rows and parsed where they lie; one row comes out for each region, with its statements, flow
nodes and edges as arrays. A file that can't be parsed yields one row with diagnostics, not a failed task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.pieces import map_rows
from weftline.schema import CALL_SITE_TYPE, KEY, SETS, STATEMENT
from weftline.sources.mparse import COMPOUND, Node, parse

#: Names that the language's semantics hang on.
BUILTIN = {
    "abs", "angle", "conv", "corrcoef", "detrend", "disp", "eig", "eps", "fft", "fftshift", "filter", "find", "floor", "fprintf", "ifft", "length", "linspace", "max",
    "mean", "median", "min", "mod", "numel", "ones", "plot", "rand", "randi", "randn", "reshape", "save", "size", "sort", "sqrt", "std", "sum", "zeros",
}
PRIMITIVE = {
    "abs", "angle", "double", "eps", "find", "floor", "length", "linspace", "max", "mean", "median", "min", "mod", "norm", "numel", "ones", "rand", "randi", "randn",
    "reshape", "size", "sort", "sqrt", "squeeze", "std", "sum", "zeros", "disp", "fprintf", "plot", "save",
}
PATH = ("addpath", "rmpath", "path", "cd")
#: What every call, and a call or command of a given name, adds to a statement: (set, values) pairs. OTHER: names not listed.
ANY_CALL = (("effects", {"call_or_index"}), ("risks", {"ambiguous_call_or_index"}))
CALL = {
    **dict.fromkeys(("eval", "evalin", "assignin"), (("effects", {"workspace_read", "workspace_write"}), ("risks", {"dynamic_evaluation", "workspace_injection"}))),
    **dict.fromkeys(("feval", "str2func"), (("risks", {"dynamic_evaluation", "indirect_call"}),)),
    **dict.fromkeys(PATH, (("effects", {"path_mutation"}), ("risks", {"path_dependency"}))),
    **dict.fromkeys(("disp", "fprintf"), (("effects", {"output"}),)),
}
OTHER = (("risks", {"external_dependency"}),)
COMMAND = {
    "load": (("effects", {"file_read", "workspace_write"}), ("risks", {"workspace_injection"})),
    "run": (
        ("effects", {"file_read", "workspace_read", "workspace_write"}), ("risks", {"workspace_injection", "external_dependency"}),
        ("forbid_cut_before", {"external_script_shared_workspace"}), ("forbid_cut_after", {"external_script_shared_workspace"}),
    ),
    "clear": (("effects", {"workspace_write"}),),
    "who": (("effects", {"workspace_read"}),),
    "whos": (("effects", {"workspace_read"}),),
    "save": (("effects", {"file_write"}),),
    **dict.fromkeys(PATH, CALL["path"]),
}
#: Commands whose arguments are variables: the set they belong to, and how many arguments come before them.
ARGUMENTS = {"clear": ("mutations", 0), "save": ("reads", 1)}
KNOWN_COMMANDS = {*COMMAND, "disp", "fprintf"}
#: Roles by a statement's calls, effects, characters and kind; characters of the roles in ASSIGNED count in assignments only.
ROLE_CALLS = {
    "acquisition": {"rand", "randi", "randn", "load", "readmatrix", "readtable"},
    "aggregation": {"sum", "mean", "median", "std", "max", "min", "norm"},
    "transformation": {"fft", "ifft", "eig", "filter", "conv", "detrend", "corrcoef"},
    "shaping": {"reshape", "transpose", "permute", "squeeze", "cat", "horzcat", "vertcat"},
    "decision": {"find", "sort", "max", "min"},
}
ROLE_EFFECTS = {"acquisition": {"file_read"}, "output": {"output", "file_write"}}
ROLE_CHARACTERS = {"shaping": (".'", "(:)"), "decision": (">", "<", "==", "~="), "normalization": ("/", "\\")}
ASSIGNED = {"normalization"}
DECLARES = {"global": (("risks", {"global_state"}), ("effects", {"workspace_write"})), "persistent": (("risks", {"persistent_state"}),)}
JUMPS = {"return", "break", "continue"}
DOMAIN = re.compile(r"[A-Za-z]\w*\.[A-Za-z]\w*")
QUIET = re.compile(r"'(?:[^'\n]|'')*'(?=[\s,;)\]}]|$)|\"[^\"\n]*\"|%[^\n]*")

#: Where a node stands: in the open (statements, conditions), in an expression, on the left of "=", or below such a target
#: as a whole name that is defined, an owner whose part is changed, or a name that is only read.
OPEN, VALUE, TARGET, DEFINED, OWNER, READ = "open", "value", "target", "defined", "owner", "read"
#: The sets that a name at a place belongs to; calls are names too where they can't be calls.
NAME_AT = {OPEN: ("reads",), VALUE: ("reads",), TARGET: ("definitions",), DEFINED: ("definitions",), OWNER: ("mutations", "reads"), READ: ("reads",)}
CALL_AT = {TARGET: ("mutations", "reads"), DEFINED: ("definitions",), OWNER: ("mutations", "reads"), READ: ("reads",)}


def named(nodes) -> list[Node]:
    return [x for x in nodes if x.kind in ("name", "call") and x.name]


def below(n: Node, at: str) -> list[tuple[Node, str]]:
    """The nodes under n that take part, with the places they stand at."""
    if at == OPEN and n.kind == "assignment":
        return [(n.kids[0], TARGET), (n.kids[1], VALUE)]
    if at == OPEN:
        return [(k, {"call": VALUE, "global": DEFINED, "persistent": DEFINED}.get(n.kind, OPEN)) for k in n.kids]
    if at == TARGET and n.kind == "field":
        return [(x, place) for x, place in ((n.extra["object"], OWNER), (n.extra["dynamic"], READ)) if x is not None]
    if at == TARGET:
        return [(k, {"outputs": DEFINED, "call": VALUE if n.name else READ}.get(n.kind, READ)) for k in n.kids]
    return [(k, at) for k in n.kids]


def mentions(root: Node, src: str, at: str = OPEN) -> Iterator[tuple[str, set[str]]]:
    """(set, names) pairs of all that a tree says, from one pass over its nodes and their places."""
    todo: list[tuple[Node, str, frozenset[str]]] = [(root, at, frozenset())]
    while todo:
        n, at, bound = todo.pop()
        if n.kind in ("function", "class"):
            continue
        inner = bound | n.extra["params"] if n.kind == "lambda" and at == VALUE else bound
        todo += [(k, place, inner) for k, place in below(n, at)]
        if n.kind == "name" and n.name not in bound:
            yield from ((c, {n.name}) for c in NAME_AT[at])
        elif n.kind == "call" and n.name and at in CALL_AT:
            yield from ((c, {n.name}) for c in CALL_AT[at])
        elif n.kind == "call" and n.name:
            yield from (("calls", {n.name}), *ANY_CALL, *CALL.get(n.name, ()))
        elif n.kind == "command":
            yield from (("calls", {n.name}), *COMMAND.get(n.name, OTHER))
            into, skip = ARGUMENTS.get(n.name, ("reads", len(n.kids)))
            words = {a.name.strip("'\"") for a in n.kids[skip:]}
            yield into, words if into == "mutations" else {w for w in words if w.isidentifier()}
        elif n.kind in ("handle", "lambda") and at == VALUE:
            yield from (("effects", {"function_handle"}), ("risks", {"indirect_call"}), ("calls", {n.name.split(".")[0]} if n.name else set()))
        yield from DECLARES.get(n.kind, ())
        if n.kind in JUMPS:
            yield "control_effects", {n.kind}
        if n.kind == "field" and at in (VALUE, TARGET):
            yield "access_domains", set(DOMAIN.findall(src[n.start : n.end])[:1])
        if at == TARGET and n.kind not in ("name", "outputs", "field") and not n.name and (parts := named(n.walk())):
            yield "mutations", {min(parts, key=lambda x: x.start).name}


def facts_of(root: Node, src: str, at: str = OPEN) -> dict[str, set[str]]:
    """A statement's (or flow node's) sets. Comments are no part of a tree, so they can't change a fact."""
    out: dict[str, set[str]] = {c: set() for c in SETS}
    for c, names in mentions(root, src, at):
        out[c] |= names
    return out


def roles_of(n: Node, f: dict[str, set[str]], src: str) -> set[str]:
    text = src[n.start : n.end] if n.kind == "command" else QUIET.sub(" ", src[n.start : n.end])
    found = {role for table, have in ((ROLE_CALLS, f["calls"]), (ROLE_EFFECTS, f["effects"])) for role, names in table.items() if names & have}
    found |= {role for role, marks in ROLE_CHARACTERS.items() if any(m in text for m in marks) and (role not in ASSIGNED or n.kind == "assignment")}
    return (found | ({"control_computation"} if n.kind in COMPOUND else set())) or {"unknown"}


def calls_of(root: Node) -> list[tuple[Node, int]]:
    """Calls of a statement from left to right, with the number of calls around each."""
    out, todo = [], [(root, 0)]
    while todo:
        n, depth = todo.pop()
        if n.kind not in ("function", "class"):
            if n.kind == "call":
                out.append((n, depth))
            todo += [(k, depth + (n.kind == "call")) for k in reversed(n.kids)]
    return out


def form_of(n: Node, depth: int) -> str:
    """How a call stands in its statement."""
    rules = [
        (n.kind == "command", "command"), (depth > 0, "nested_expression"), (n.kind == "assignment" and n.kids[0].kind == "outputs", "direct_multi_output"),
        (n.kind == "assignment", "direct_assignment"), (n.kind in ("call", "field"), "effect_only"), (True, "condition_call"),
    ]
    return next(form for holds, form in rules if holds)


def call_sites(n: Node, f: dict[str, set[str]]) -> list[dict]:
    every = [(n, 0)] if n.kind == "command" else calls_of(n)
    out = []
    for x, depth in every:
        if not x.name:
            continue
        given = [] if x is n and n.kind == "command" else [*x.extra["arguments"], *([x.extra["object"]] if x.extra["object"] is not None else [])]
        names = {y.name for a in given for y in named(a.walk())} - {y.name for y in named(x.walk()) if y.kind == "call" and y is not x}
        direct = depth == 0 and n.kind not in COMPOUND
        out.append({
            "name": x.name, "form": form_of(n, depth), "origin": "unresolved", "abstraction": "unknown", "input_symbols": sorted(f["reads"] if n.kind == "command" else names),
            "output_symbols": sorted(f["definitions"]) if direct and n.kind != "command" else [], "is_standalone_statement": direct, "is_only_operation": direct and len(every) == 1, "resolution_reliability": 0.65,
        })
    return out


class Flow:
    """Flow graph of a region, built in source order: node 0 is the entry, 1 the exit.

    `ends` are the (node, edge kind) pairs that wait for whatever comes next; a jump leaves none behind it.
    """

    def __init__(self, src: str):
        self.src, self.nodes, self.edges = src, [], []
        self.ends: list[tuple[int, str]] = []
        self.loops: list[tuple[int, list[tuple[int, str]]]] = []  # heads, and the ends that break out
        for _ in ("entry", "exit"):
            self.place(-1, dict.fromkeys(SETS, set()))
        self.edges, self.ends = [], [(0, "next")]

    def place(self, owner: int, f: dict[str, set[str]]) -> int:
        """A node that all ends lead to; the only end is then the node's own."""
        i = len(self.nodes)
        self.nodes.append({"node": i, "owner": owner} | {c: sorted(f[c]) for c in ("definitions", "reads", "mutations")})
        self.close(i)
        self.ends = [(i, "next")]
        return i

    def close(self, target: int) -> None:
        self.edges += [{"source": a, "target": target, "kind": kind} for a, kind in self.ends]
        self.ends = []

    def block(self, nodes: list[Node], owner: int) -> None:
        for n in nodes:
            if n.kind in ("for", "parfor", "while"):
                self.loop(n, owner)
            elif n.kind == "if":
                self.choice(n, owner)
            elif n.kind not in ("function", "class"):
                self.step(n, owner)

    def choice(self, n: Node, owner: int) -> None:
        done: list[tuple[int, str]] = []
        for condition, body in n.extra["clauses"]:
            at = self.place(owner, facts_of(condition, self.src, VALUE))
            self.ends = [(at, "true")]
            self.block(body, owner)
            done += self.ends
            self.ends = [(at, "false")]
        self.block(n.extra["other"] or [], owner)
        self.ends = done + self.ends

    def loop(self, n: Node, owner: int) -> None:
        f = facts_of(n.extra["head"], self.src, VALUE)
        f["definitions"] |= {x.name for x in named(n.extra["var"].walk())} if n.extra["var"] is not None else set()
        head = self.place(owner, f)
        self.loops.append((head, []))
        self.ends = [(head, "true")]
        self.block(n.extra["body"], owner)
        self.close(head)
        self.ends = [(head, "false"), *self.loops.pop()[1]]

    def step(self, n: Node, owner: int) -> None:
        f = facts_of(n, self.src)
        at = self.place(owner, f)
        jump = next((k for k in ("return", "break", "continue") if k in f["control_effects"]), "next")
        self.ends = [(at, jump)]
        if jump == "return":
            self.close(1)
        elif jump == "break" and self.loops:
            self.loops[-1][1].append(self.ends.pop())
        elif jump == "continue" and self.loops:
            self.close(self.loops[-1][0])

    def run(self, statements: list[Node]) -> None:
        for owner, n in enumerate(statements):
            self.block([n], owner)
        self.close(1)


PARTS = ("statements", "graph")


def analyze(src: str, path: str = "", parts: tuple[str, ...] = PARTS) -> dict:
    """Regions and diagnostics of one source."""
    tree, errors = parse(src)
    src = src.replace("\r\n", "\n")
    functions = [n for n in tree.walk() if n.kind == "function"]
    regions = [("script", None, [n for n in tree.kids if n.kind not in ("function", "class")], [], [])]
    regions = [r for r in regions if r[2]] + [("function", f.name, [n for n in f.kids if n.kind not in ("function", "class")], f.extra["params"], f.extra["outputs"]) for f in functions]
    local = {f.name for f in functions}
    out = []
    for kind, name, nodes, params, outputs in regions:
        flow = Flow(src)
        if "graph" in parts:
            flow.run(nodes)
        rows, known = [], set(params)
        for i, n in enumerate(nodes if "statements" in parts else ()):
            f = facts_of(n, src)
            broken = any(x.kind == "error" for x in n.walk())
            f["risks"] |= {"parse_error"} if broken else set()
            f["roles"] = roles_of(n, f, src)
            # a name that an earlier statement wrote is a variable, so what looks like a call indexes it
            rest = f["calls"] - known
            f["resolved_indexes"] = f["calls"] & known
            f["resolved_calls"] = rest & (BUILTIN | (KNOWN_COMMANDS if n.kind == "command" else local))
            f["unresolved_calls"] = rest - f["resolved_calls"]
            if not f["unresolved_calls"]:
                f["risks"].discard("ambiguous_call_or_index")
            origins = {
                **{x: ("same_file", "user_function") for x in local}, **{x: ("builtin", "library") for x in BUILTIN}, **{x: ("builtin", "primitive") for x in BUILTIN & PRIMITIVE}, **{x: ("index_access", "primitive") for x in f["resolved_indexes"]},
            }
            sites = [s | ({"origin": o[0], "abstraction": o[1], "resolution_reliability": 1.0} if (o := origins.get(s["name"])) else {}) for s in call_sites(n, f)]
            known |= f["definitions"] | f["mutations"]
            rows.append({"idx": i, "kind": "compound" if n.kind in COMPOUND else n.kind if n.kind in ("assignment", "command") else "statement", "start_line": n.line, "end_line": n.end_line, **{c: sorted(v) for c, v in f.items()}, "is_compound": n.kind in COMPOUND, "parse_reliable": not broken, "call_resolution_available": True, "call_sites": sites})
        out.append({"region_id": f"{kind}:{name or 'top-level'}", "kind": kind, "name": name, "parameters": params, "declared_outputs": outputs, "statements": rows if "statements" in parts else None, "nodes": flow.nodes if "graph" in parts else None, "edges": flow.edges if "graph" in parts else None})
    return {"regions": out, "diagnostics": [f"parse error at lines {a}-{b}" for a, b, _ in errors]}


TEXTS = T.ArrayType(T.StringType())
NODE = T.StructType([T.StructField("node", T.IntegerType()), T.StructField("owner", T.IntegerType()), *(T.StructField(c, TEXTS) for c in ("definitions", "reads", "mutations"))])
EDGE = T.StructType([T.StructField("source", T.IntegerType()), T.StructField("target", T.IntegerType()), T.StructField("kind", T.StringType())])
ROW = T.StructType([f for f in STATEMENT.fields if f.name not in KEY])
PROGRAM = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("language", T.StringType()), T.StructField("source_hash", T.StringType()), T.StructField("diagnostics", TEXTS)]
    + [T.StructField(c, T.StringType()) for c in ("region_id", "kind", "name")]
    + [T.StructField("parameters", TEXTS), T.StructField("declared_outputs", TEXTS), T.StructField("statements", T.ArrayType(ROW)), T.StructField("nodes", T.ArrayType(NODE)), T.StructField("edges", T.ArrayType(EDGE))]
)
assert CALL_SITE_TYPE is not None


def programs(sources: DataFrame, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """One row for each region of sources (path, content); files without a region, or that fail, have one with nulls.

    parts: what is wanted of statements and graph (nodes and edges); what isn't is null and costs nothing.
    """

    def run(row: dict) -> Iterator[tuple]:
        content = row["content"] or b""
        base = {"path": row["path"], "language": "m", "source_hash": hashlib.sha256(content).hexdigest()}
        try:
            found = analyze(content.decode("utf-8", "replace"), row["path"], parts)
        except Exception as e:  # one file's failure is that file's row
            found = {"regions": [], "diagnostics": [f"unparsed: {type(e).__name__}: {e}"]}
        for r in found["regions"] or [{}]:
            r = {**base, "diagnostics": found["diagnostics"], **r}
            yield tuple(map(r.get, PROGRAM.fieldNames()))

    # so many parts that adaptive execution doesn't put them together: sources are small, the work on each is not
    dealt = sources.select("path", "content").repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    # a region's row holds all its statements and nodes
    return map_rows(dealt, run, PROGRAM, out=64)


def statements(regions: DataFrame) -> DataFrame:
    return regions.where("region_id is not null").select(*KEY, F.explode("statements").alias("s")).select(*KEY, "s.*").select(*STATEMENT.fieldNames())


def flow_nodes(regions: DataFrame) -> DataFrame:
    return regions.where("region_id is not null").select(*KEY, F.explode("nodes").alias("x")).select(*KEY, "x.*")


def flow_edges(regions: DataFrame) -> DataFrame:
    return regions.where("region_id is not null").select(*KEY, F.explode("edges").alias("x")).select(*KEY, "x.*")


def read(spark: SparkSession, path: str) -> DataFrame:
    from weftline.sources.corpus import read_sources

    return statements(programs(read_sources(spark, path)))
