import pytest
from pyspark.sql import functions as F

from weftline.operators import dependence, facts, flow, project
from weftline.sources import corpus, mlang

MERGE = """x = 1;
if c > 0
    x = 2;
else
    x = 3;
end
y = x;
while y < 9
    y = y + x;
    if y > 7, break, end
end
for k = 1:3
    if k == 2
        continue
    end
    z = k;
end
return
w = 1;
"""

PIPELINE = """% builds a report
clear old
load input.mat
raw = data(:, 1);
centered = raw - mean(raw);
acc = zeros(size(centered));
for k = 2:length(centered)
    acc(k) = acc(k - 1) + centered(k);
end
total = sum(acc);
scaled = total / norm(acc);
done = finish(scaled, 64);
save output.mat done
hold on
s.field(2) = done; [a, b] = max(s.field);
h = @(q) q + a; g = @sin; feval(g, b);
global G

function out = finish(v, n)
out = v(1:n)';
end
"""


def one(src):
    return mlang.analyze(src)


def statements(src, region="script:top-level"):
    return next(r for r in one(src)["regions"] if r["region_id"] == region)["statements"]


def frame(spark, *sources):
    rows = [(f"f{i}.m" if isinstance(s, str) else s[0], bytearray((s if isinstance(s, str) else s[1]).encode())) for i, s in enumerate(sources)]
    return spark.createDataFrame(rows, "path string, content binary")


def test_regions_and_facts():
    got = one(PIPELINE)
    assert not got["diagnostics"] and [r["region_id"] for r in got["regions"]] == ["script:top-level", "function:finish"]
    s = statements(PIPELINE)
    by = {x["start_line"]: x for x in s}
    assert by[2]["mutations"] == ["old"] and by[2]["effects"] == ["workspace_write"]
    assert by[3]["effects"] == ["file_read", "workspace_write"] and by[3]["risks"] == ["workspace_injection"] and by[3]["roles"] == ["acquisition"]
    assert by[4]["definitions"] == ["raw"] and by[4]["unresolved_calls"] == ["data"] and "ambiguous_call_or_index" in by[4]["risks"]
    assert by[5]["resolved_calls"] == ["mean"] and by[5]["risks"] == [] and by[5]["reads"] == ["raw"]
    assert by[7]["is_compound"] and by[7]["mutations"] == ["acc"] and "k" in by[7]["reads"] and by[7]["end_line"] == 9
    assert by[11]["roles"] == ["aggregation", "normalization"]
    assert by[12]["resolved_calls"] == ["finish"] and by[12]["call_sites"][0]["origin"] == "same_file"
    assert by[13]["effects"] == ["file_write"] and by[13]["reads"] == ["done"]
    assert by[14]["risks"] == ["external_dependency"] and by[14]["kind"] == "command"
    first, second = [x for x in s if x["start_line"] == 15]
    assert first["mutations"] == ["s"] and first["access_domains"] == ["s.field"] and second["definitions"] == ["a", "b"] and second["call_sites"][0]["form"] == "direct_multi_output"
    h, g, f = [x for x in s if x["start_line"] == 16]
    assert h["reads"] == ["a"] and h["effects"] == ["function_handle"] and g["calls"] == ["sin"] and {"dynamic_evaluation", "indirect_call"} <= set(f["risks"])
    assert by[17]["definitions"] == ["G"] and by[17]["risks"] == ["global_state"]
    assert statements(PIPELINE, "function:finish")[0]["resolved_indexes"] == ["v"]


def test_quotes_continuations_and_cells():
    s = statements("a = b' + [x' y'];\nc = {'p q', \"r\"};\nd = f(1, ...\n  2);\nm = [1 -2; 3 4]; n = z{2}.w(3);\n%{\nblock = 1;\n%}\ndisp('it''s % no comment');")
    assert [x["definitions"] for x in s] == [["a"], ["c"], ["d"], ["m"], ["n"], []]
    assert s[0]["reads"] == ["b", "x", "y"] and s[1]["reads"] == [] and s[2]["end_line"] == 4 and s[4]["calls"] == ["w", "z"] and s[5]["calls"] == ["disp"]


def test_run_bars_cuts_and_errors_stay_local():
    s = statements("run other\nx = 1;\n")
    assert s[0]["forbid_cut_before"] == s[0]["forbid_cut_after"] == ["external_script_shared_workspace"]
    got = one("x = 1;\ny = (2;\nz = x;\n")
    assert got["diagnostics"] and [x["parse_reliable"] for x in got["regions"][0]["statements"]] == [True, False, True]


def test_misleading_comments_change_nothing():
    noisy = "\n".join(x + "  % y = 3; if a == b / c" for x in PIPELINE.split("\n"))
    strip = lambda rows: [{k: v for k, v in r.items() if k not in ("start_line", "end_line")} for r in rows]
    assert strip(statements(noisy)) == strip(statements(PIPELINE))


def test_flow_graph_and_dependences(spark):
    regions = mlang.programs(frame(spark, MERGE))
    nodes = {(r.node): r for r in mlang.flow_nodes(regions).collect()}
    owner = {k: v.owner for k, v in nodes.items()}
    data = {(owner[r.source], owner[r.target], r.symbol) for r in flow.reaching_definitions(regions).collect()}
    assert (1, 2, "x") in data and (0, 2, "x") not in data  # both branches reach, the first write is dead
    assert (3, 3, "y") in data  # around the loop
    edges = {(owner[e.source], owner[e.target], e.kind) for e in mlang.flow_edges(regions).collect()}
    assert (3, 4, "break") in edges and (4, 4, "continue") in edges and (5, -1, "return") in edges
    assert all(r.nearest is not None or r.node == 1 for r in flow.postdominance(regions).collect())
    control = {(r.source, r.target) for r in flow.control_dependence(regions).collect()}
    writes = [k for k, v in nodes.items() if v.owner == 1 and v.definitions == ["x"]]
    test = next(k for k, v in nodes.items() if v.owner == 1 and "c" in v.reads)
    assert {(test, w) for w in writes} <= control
    top = flow.projected(regions).collect()
    assert all(r.source != r.target for r in top) and ("DATA", 1, 2) in {(r.kind, r.source, r.target) for r in top}
    inner = flow.projected(regions, include_internal=True).collect()
    assert any(r.kind == "CONTROL" and r.source == r.target == 1 for r in inner)


def test_control_dependence_against_its_definition(spark):
    """b depends on a: from one successor of a every path to the exit meets b, from another some path doesn't."""
    regions = mlang.programs(frame(spark, MERGE, PIPELINE)).where("region_id is not null").collect()
    for r in regions:
        edges = [(e.source, e.target) for e in r.edges]
        n = len(r.nodes)
        succ = flow.successors(n, edges)

        def avoids(start, b):
            if start == b:
                return False
            seen, todo = set(), [start]
            while todo:
                x = todo.pop()
                if x == flow.EXIT:
                    return True
                if x not in seen and x != b:
                    seen.add(x)
                    todo += [y for y in succ[x] if y != b]
            return False

        dom = flow.post_dominators(n, edges)
        want = {(a, b) for a in range(n) for b in range(n) if len(succ[a]) > 1 and any(not avoids(s, b) for s in succ[a]) and any(avoids(s, b) for s in succ[a]) and b != flow.EXIT}
        assert flow.control(n, edges, dom) == want


def test_completion_chain_after_a_loop(spark):
    st = mlang.statements(mlang.programs(frame(spark, "x = rand(9, 1);\nfor k = 1:9\n    x(k) = x(k) + 1;\nend\ns = sum(x);\nt = s / norm(x);\nu = rand(3, 1);\n")))
    got = {r.boundary: r for r in dependence.completion(st, dependence.linear_def_use(st)).collect()}
    assert sorted(got) == [1, 2] and got[1].through == 3 and got[1].roles == ["aggregation", "normalization"] and got[2].symbols == ["s", "x"]
    rows = {r.b: r for r in facts.boundary_facts(st).collect()}
    assert rows[1].completion_chain_length == 2 and rows[2].completion_chain_length == 1 and rows[3].completion_chain_length == 0


def test_project_resolution(spark):
    regions = mlang.programs(frame(spark, ("main.m", "a = helper(3);\nb = local(a);\nc = missing(b);\nfunction r = local(x)\nr = x;\nend\n"), ("lib/helper.m", "function y = helper(x)\ny = inner(x);\nend\nfunction z = inner(x)\nz = x;\nend\n")))
    summary = project.worker_summary(regions)
    index = {r.path: r for r in project.scan(summary).collect()}
    assert index["main.m"].kind == "mixed" and index["lib/helper.m"].kind == "function" and index["lib/helper.m"].primary_name == "helper"
    assert index["main.m"].resolved_project_calls == ["helper", "local"] and index["main.m"].unresolved_calls == ["local", "missing"]
    st = {r.start_line: r for r in project.enrich(mlang.statements(regions), project.scan(summary)).where("path = 'main.m' and region_id = 'script:top-level'").collect()}
    assert st[1].resolved_calls == ["helper"] and st[1].risks == [] and st[1].call_sites[0].origin == "project" and st[3].unresolved_calls == ["missing"]


def test_binary_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.m").write_text("x = 1;\ny = x;\n")
    (tmp_path / "sub" / "b.m").write_text("z = 2;\n")
    (tmp_path / "c.txt").write_text("no")
    got = corpus.read_sources(spark, str(tmp_path)).select("path", "sha256").collect()
    assert sorted(r.path for r in got) == ["a.m", "sub/b.m"] and all(len(r.sha256) == 64 for r in got)
    assert mlang.read(spark, str(tmp_path)).count() == 3


def test_unparsed_file_is_a_row(spark):
    got = mlang.programs(frame(spark, "")).collect()
    assert len(got) == 1 and got[0].region_id is None
    assert project.scan(project.worker_summary(mlang.programs(frame(spark, ("e.m", ""))))).first().kind == "function"


def test_renaming_keeps_fingerprints(spark):
    src = "alpha = rand(4, 1);\nbeta = alpha + 1;\ngamma = beta / norm(beta);\ndisp(gamma);\n"
    prints = []
    for s in (src, src.replace("alpha", "q1").replace("beta", "q2").replace("gamma", "q3")):
        st = mlang.statements(mlang.programs(frame(spark, s)))
        prints.append([r.fingerprint for r in facts.fingerprint(facts.boundary_facts(st)).orderBy("boundary_index").collect()])
    assert prints[0] == prints[1] and len(set(prints[0])) > 1


@pytest.mark.parametrize("language,path", [(None, "a.txt"), ("nope", "a.m")])
def test_registry(language, path):
    from weftline.sources.registry import Registry, default

    with pytest.raises(ValueError):
        default().select(path, language)
    r = Registry()
    r.register("x", (".x",), lambda s, p: None)
    for name, suffix in (("x", ".y"), ("z", ".x"), ("w", ".W")):
        with pytest.raises(ValueError):
            r.register(name, (suffix,), lambda s, p: None)
    assert default().select("dir/A.M") is mlang.read and F is not None


def test_region_semantics_bundle(spark, tmp_path):
    from weftline import api

    (tmp_path / "a.m").write_text(MERGE)
    got = api.region_semantics(spark, f"{tmp_path}/a.m")
    assert got["regions"].count() == 1 and {r.kind for r in got["graph"].select("kind").distinct().collect()} == {"DATA", "CONTROL"}
    assert got["facts"].count() == len(statements(MERGE)) - 1


JUMPY = """n = 3;
for i = 1:n
  if n > i
    break;
  elseif i == 2
    continue;
  else
    while n > 0
      n = n - 1;
      if n == 1
        return
      end
    end
  end
  n = n + i;
end
m = n;
"""


def test_jumps_lead_where_they_must():
    region = mlang.analyze(JUMPY)["regions"][0]
    # entry 0, exit 1, then by line: n = 3 (2), for (3), if (4), break (5), elseif (6), continue (7), while (8), n - 1 (9), if (10), return (11), n + i (12), m = n (13)
    got = {(e["source"], e["target"], e["kind"]) for e in region["edges"]}
    assert got == {
        (0, 2, "next"), (2, 3, "next"), (3, 4, "true"), (3, 13, "false"), (4, 5, "true"), (4, 6, "false"), (5, 13, "break"), (6, 7, "true"), (6, 8, "false"), (7, 3, "continue"),
        (8, 9, "true"), (8, 12, "false"), (9, 10, "next"), (10, 11, "true"), (10, 8, "false"), (11, 1, "return"), (12, 3, "next"), (13, 1, "next"),
    }
    assert [n["owner"] for n in region["nodes"]] == [-1, -1, 0, *[1] * 10, 2]
    # a jump outside of loops goes on, and what stands behind a jump still leads on
    loose = mlang.analyze("break\nwhile true\n  return\n  a = 1;\nend\n")["regions"][0]
    assert {(e["source"], e["target"], e["kind"]) for e in loose["edges"]} == {(0, 2, "next"), (2, 3, "break"), (3, 4, "true"), (4, 1, "return"), (5, 3, "next"), (3, 1, "false")}
