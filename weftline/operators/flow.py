"""Dependences over flow graphs: reaching definitions, post-dominators, control dependence, one region at a time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.pieces import map_rows
from weftline.schema import KEY

ENTRY, EXIT = 0, 1
SYMBOLS = ("definitions", "reads", "mutations")


def successors(n: int, edges: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(n)]
    for a, b in edges:
        if b not in out[a]:
            out[a].append(b)
    return out


def tree(ahead: list[list[int]], root: int) -> list[int | None]:
    """For each node the nearest of the others that all paths to it from root pass.

    A node that root doesn't lead to is taken as led to by it. Nodes are met in reverse postorder (Cooper, Harvey and
    Kennedy), so the work follows the edges, not pairs of nodes.
    """
    back: list[list[int]] = [[] for _ in ahead]
    for a, out in enumerate(ahead):
        for b in out:
            back[b].append(a)
    order, seen = [], [False] * len(ahead)
    for start in (root, *range(len(ahead))):
        if seen[start]:
            continue
        if start != root:
            back[start].append(root)
        seen[start], todo = True, [(start, iter(ahead[start]))]
        while todo:
            x, rest = todo[-1]
            y = next((y for y in rest if not seen[y]), None)
            if y is None:
                order.append(x)
                todo.pop()
            else:
                seen[y] = True
                todo.append((y, iter(ahead[y])))
    order.remove(root)
    rank = [len(order)] * len(ahead)
    for k, x in enumerate(order):
        rank[x] = k
    order.reverse()
    near: list[int | None] = [None] * len(ahead)
    near[root], changed = root, True
    while changed:
        changed = False
        for x in order:
            met = None
            for p in back[x]:
                if near[p] is None:
                    continue
                met = p if met is None else met
                while p != met:
                    if rank[p] < rank[met]:
                        p = near[p]
                    else:
                        met = near[met]
            if near[x] != met:
                near[x], changed = met, True
    near[root] = None
    return near


def reaching(nodes: list[dict], edges: list[tuple[int, int]]) -> set[tuple[int, int, str]]:
    """(definition, use, symbol) over all paths, until the symbol is written again.

    A symbol's values meet where paths from its writes do (the dominance frontiers of its writes). One walk down the tree
    of dominators then finds the write or the meeting that each use sees, so a write isn't followed through all that comes
    after it.
    """
    root = len(nodes)
    write = [set(n["definitions"]) | set(n["mutations"]) for n in nodes] + [set()]
    use = [set(n["reads"]) | set(n["mutations"]) for n in nodes] + [set()]
    both = set().union(*write) & set().union(*use)
    write, use = [s & both for s in write], [s & both for s in use]
    ahead = successors(root, edges) + [[ENTRY] if nodes else []]
    # what meets at the exit is read by nobody
    last = {x for x, out in enumerate(ahead) if not out and not use[x]}
    ahead = [[b for b in out if b not in last] for out in ahead]
    near = tree(ahead, root)
    frontier: list[set[int]] = [set() for _ in ahead]
    for a, out in enumerate(ahead):
        for b in out:
            x = a
            while x != near[b] and b not in frontier[x]:
                frontier[x].add(b)
                x = near[x]
    writers: dict[str, list[int]] = {}
    for d, symbols in enumerate(write):
        for s in symbols:
            writers.setdefault(s, []).append(d)
    meet: list[set[str]] = [set() for _ in ahead]
    for s, todo in writers.items():
        while todo:
            for b in frontier[todo.pop()]:
                if s not in meet[b]:
                    meet[b].add(s)
                    todo.append(b)
    below: list[list[int]] = [[] for _ in ahead]
    for x, up in enumerate(near):
        if up is not None:
            below[up].append(x)
    # a value is the node that wrote it, or ~x if it is what meets at x
    now: dict[str, int | None] = {}
    met: dict[tuple[int, str], set[int]] = {(~x, s): set() for x, symbols in enumerate(meet) for s in symbols}
    seen: list[tuple[int, int, str]] = []
    walk: list[tuple[int, dict | None]] = [(root, None)]
    while walk:
        x, before = walk.pop()
        if before is not None:
            now.update(before)
            continue
        walk.append((x, {s: now.get(s) for s in meet[x] | write[x]}))
        walk += [(k, None) for k in below[x]]
        now.update(dict.fromkeys(meet[x], ~x))
        seen += [(v, x, s) for s in use[x] if (v := now.get(s)) is not None]
        now.update(dict.fromkeys(write[x], x))
        for b in ahead[x]:
            for s in meet[b]:
                if (v := now.get(s)) is not None:
                    met[~b, s].add(v)
    known: dict[tuple[int, str], set[int]] = {}
    for v, _, s in seen:
        if v < 0 and (v, s) not in known:
            found, todo = {v}, [v]
            while todo:
                fresh = met[todo.pop(), s] - found
                found |= fresh
                todo += [w for w in fresh if w < 0]
            known[v, s] = {w for w in found if w >= 0}
    return {(d, x, s) for v, x, s in seen for d in (known[v, s] if v < 0 else (v,))}


def post_dominators(n: int, edges: list[tuple[int, int]]) -> list[int | None]:
    """For each node the nearest of the others that are on every path from it to the exit: the tree of post-dominators."""
    behind: list[list[int]] = [[] for _ in range(n)]
    for a, out in enumerate(successors(n, edges)):
        for b in out or ([EXIT] if a != EXIT else []):
            behind[b].append(a)
    return tree(behind, EXIT)


def control(n: int, edges: list[tuple[int, int]], near: list[int | None]) -> set[tuple[int, int]]:
    """(branch, dependent): nodes on one side of a branch up to where its sides meet; near: the tree of post-dominators."""
    out = set()
    for a, b in edges:
        x = b
        while x is not None and x != near[a]:
            out.add((a, x))
            x = near[x]
    return out


def _per_region(regions: DataFrame, schema: str, f, *facts: str) -> DataFrame:
    """What f makes of each region's nodes (with these facts of theirs) and edges; only those are sent to Python, as plain lists."""

    def run(r: dict) -> Iterator[tuple]:
        nodes = [dict(zip(facts, x)) for x in zip(*(r[c] for c in facts))] if facts else [{}] * r["n"]
        for x in f(nodes, list(zip(r["source"], r["target"]))):
            yield (r["path"], r["region_id"], *x)

    told = (*(F.col(f"nodes.{c}").alias(c) for c in facts), F.size("nodes").alias("n"), F.col("edges.source").alias("source"), F.col("edges.target").alias("target"))
    return map_rows(regions.where("region_id is not null").select(*KEY, *told), run, f"path string, region_id string, {schema}")


def reaching_definitions(regions: DataFrame) -> DataFrame:
    """key, source, target, symbol by flow node; regions: path, region_id, nodes, edges."""
    return _per_region(regions, "source int, target int, symbol string", lambda nodes, edges: sorted(reaching(nodes, edges)), *SYMBOLS)


def postdominance(regions: DataFrame) -> DataFrame:
    """key, node, dominators (sorted), nearest."""

    def f(nodes, edges):
        near = post_dominators(len(nodes), edges)
        for i, up in enumerate(near):
            x, found = up, [i]
            while x is not None:
                found.append(x)
                x = near[x]
            yield i, sorted(found), up

    return _per_region(regions, "node int, dominators array<int>, nearest int", f)


def control_dependence(regions: DataFrame) -> DataFrame:
    """key, source, target by flow node."""
    return _per_region(regions, "source int, target int", lambda nodes, edges: sorted(control(len(nodes), edges, post_dominators(len(nodes), edges))))


def dependences(nodes: list[dict], edges: list[tuple[int, int]]) -> list[tuple[int, int, str, str | None]]:
    n = len(nodes)
    return [(a, b, "DATA", s) for a, b, s in sorted(reaching(nodes, edges))] + [(a, b, "CONTROL", None) for a, b in sorted(control(n, edges, post_dominators(n, edges)))]


def dependence_graph(regions: DataFrame) -> DataFrame:
    """key, source, target, kind (DATA, CONTROL), symbol by flow node."""
    return _per_region(regions, "source int, target int, kind string, symbol string", dependences, *SYMBOLS)


def projected(regions: DataFrame, include_internal: bool = False) -> DataFrame:
    """The dependence graph between top-level statements.

    Nodes are put under their statements where the graph is made: a join with them would parse each program once more.
    """

    def f(nodes, edges):
        owner = [x["owner"] for x in nodes]
        found = {(owner[a], owner[b], kind, s) for a, b, kind, s in dependences(nodes, edges)}
        return (x for x in found if x[0] >= 0 and x[1] >= 0 and (include_internal or x[0] != x[1]))

    return _per_region(regions, "source int, target int, kind string, symbol string", f, "owner", *SYMBOLS).distinct()


def semantic_def_use(regions: DataFrame) -> DataFrame:
    """key, source, target, symbol between different top-level statements."""
    return projected(regions).where("kind = 'DATA'").select(*KEY, "source", "target", "symbol").distinct()
