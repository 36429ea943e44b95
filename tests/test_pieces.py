"""Python work by pieces, flow graphs without joins."""

import pyarrow as pa
from pyspark.sql import functions as F

from weftline.operators import dependence, flow, pieces
from weftline.schema import KEY
from weftline.sources import mlang

LOOP = "x = 3;\nwhile x > 0\n  if x > 1\n    break;\n  end\n  x = x - 1;\nend\ny = x;\n"


def test_a_worker_holds_few_rows_at_a_time(spark):
    held = []

    class Batch:
        """Notes how many rows are asked for as Python objects."""

        num_rows = 1000

        def slice(self, i, n):
            held.append(min(n, self.num_rows - i))
            return pa.RecordBatch.from_pydict({"x": list(range(i, i + held[-1]))})

    got = pieces.records([Batch()])
    assert next(got) == {"x": 0} and held == [pieces.ROWS]
    assert [r["x"] for r in got] == list(range(1, 1000)) and max(held) == pieces.ROWS
    made = list(pieces.together(((i, [str(i)]) for i in range(10)), pieces.arrow_schema("i int, s array<string>"), out=4))
    assert [b.num_rows for b in made] == [4, 4, 2] and made[2].to_pylist()[1] == {"i": 9, "s": ["9"]}


def test_neighbours_take_one_grouping_and_no_join(spark):
    sources = spark.createDataFrame([("a.m", LOOP), ("e.m", "")], "path string, text string").select("path", F.encode("text", "UTF-8").alias("content"))
    r = mlang.programs(sources, ("graph",))
    found = dependence.neighbours(r)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = {x.node: (x.predecessors, x.successors) for x in found.collect()}
    both = mlang.programs(sources)
    pairs = [(x.source, x.target) for x in mlang.flow_edges(both).collect()]
    nodes = [x.node for x in mlang.flow_nodes(both).collect()]
    assert got == {n: (sorted({a for a, b in pairs if b == n}), sorted({b for a, b in pairs if a == n})) for n in nodes}


def test_statements_own_dependences_without_a_second_parse(spark):
    sources = spark.createDataFrame([("a.m", LOOP)], "path string, text string").select("path", F.encode("text", "UTF-8").alias("content"))
    r = mlang.programs(sources)
    nodes = mlang.flow_nodes(r).select(*KEY, "node", "owner")
    for internal in (False, True):
        found = flow.projected(r, internal)
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
        want = dependence.project(flow.dependence_graph(r), nodes, internal)
        assert sorted(map(str, found.collect())) == sorted(map(str, want.collect())) != []


def test_parts_that_are_not_wanted_are_null(spark):
    sources = spark.createDataFrame([("a.m", LOOP)], "path string, text string").select("path", F.encode("text", "UTF-8").alias("content"))
    (whole,), (st,), (g,) = (mlang.programs(sources, p).collect() for p in (mlang.PARTS, ("statements",), ("graph",)))
    assert (st.statements, st.nodes, st.edges) == (whole.statements, None, None)
    assert (g.statements, g.nodes, g.edges) == (None, whole.nodes, whole.edges)
