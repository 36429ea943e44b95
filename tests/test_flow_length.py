import random
import sys

import pytest

from weftline.operators import flow
from weftline.sources import mlang

UNIT = "for i = 1:x{p}\n  if x{p} > 1\n    {jump};\n  elseif x{t} < 2\n    continue;\n  end\n  x{t} = x{t} + x{p};\nend\ny{t} = x{t};\n"


def graph(text):
    r = mlang.analyze(text, "", ("graph",))["regions"][0]
    return r["nodes"], [(e["source"], e["target"]) for e in r["edges"]]


def loops(n):
    return graph("x0 = 9;\n" + "".join(UNIT.format(p=o, t=o + 1, jump=("break", "return")[o % 2]) for o in range(n)))


def steps(f):
    """Lines that f runs."""
    n = 0

    def tell(*_):
        nonlocal n
        n += 1
        return tell

    before = sys.gettrace()
    sys.settrace(tell)
    try:
        f()
    finally:
        sys.settrace(before)
    return n


def by_paths(nodes, edges):
    succ, out = flow.successors(len(nodes), edges), set()
    for d, n in enumerate(nodes):
        for s in {*n["definitions"], *n["mutations"]}:
            seen, todo = set(), list(succ[d])
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    out |= {(d, x, s)} if s in nodes[x]["reads"] + nodes[x]["mutations"] else set()
                    todo += [] if s in nodes[x]["definitions"] + nodes[x]["mutations"] else succ[x]
    return out


def program(rng, depth):
    out = []
    for _ in range(rng.randint(1, 4)):
        v, w, k = rng.choice("abcd"), rng.choice("abcd"), rng.random()
        if depth and k < 0.45:
            head = f"if {v} > 1" if k < 0.25 else f"while {v} > 1" if k < 0.35 else f"for {w} = 1:{v}"
            out += [head, *program(rng, depth - 1), *(["else", *program(rng, depth - 1)] if k < 0.15 else []), "end"]
        else:
            out.append(rng.choice(("break;", "continue;", "return;", f"{v}(1) = {w};", f"{v} = {w} + {rng.choice('abcd')};", f"{w} = {v};")))
    return out


def test_reaching_definitions_are_those_of_all_paths():
    rng = random.Random(3)
    for _ in range(200):  # dead statements and loops among them
        nodes, edges = graph("\n".join(program(rng, 3)) + "\n")
        assert flow.reaching(nodes, edges) == by_paths(nodes, edges)
    for _ in range(500):  # graphs that no program has
        n = rng.randint(2, 8)
        edges = [(rng.choice([0, *range(2, n)]), rng.randrange(1, n)) for _ in range(rng.randint(0, 2 * n))]
        nodes = [{c: rng.sample("abc", rng.randint(0, 2)) if x > 1 else [] for c in flow.SYMBOLS} for x in range(n)]
        assert flow.reaching(nodes, edges) == by_paths(nodes, edges)


@pytest.mark.parametrize("name", ["reaching_definitions", "control_dependence", "postdominance"])
def test_work_follows_a_programs_length(name, monkeypatch):
    monkeypatch.setattr(flow, "_per_region", lambda regions, schema, f, *facts: f)
    f = getattr(flow, name)(None)
    short, long = (steps(lambda r=loops(n): list(f(*r))) for n in (40, 160))
    assert long < 6 * short
