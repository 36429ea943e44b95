"""Symbol occurrences and def-use edges of statement sequences; projections of flow-graph dependences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.blocks import BLOCK, with_halo
from weftline.schema import COMPLETION_ROLES, KEY
from weftline.session import by_key


def symbols_of() -> F.Column:
    return F.array_union(F.array_union("definitions", "reads"), "mutations")


def accesses(st: DataFrame) -> DataFrame:
    """key, idx, symbol, writes, uses: one row for each symbol of each statement."""
    row = F.explode(F.transform(symbols_of(), lambda s: F.struct(s.alias("symbol"), (F.array_contains("definitions", s) | F.array_contains("mutations", s)).alias("writes"), (F.array_contains("reads", s) | F.array_contains("mutations", s)).alias("uses"))))
    return st.select(*KEY, "idx", row.alias("a")).select(*KEY, "idx", "a.*")


def occurrences(st: DataFrame) -> DataFrame:
    """key, symbol, first, last, indexes (sorted distinct)."""
    return accesses(st).groupBy(*KEY, "symbol").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.array_sort(F.collect_set("idx")).alias("indexes"))


def spans(st: DataFrame) -> DataFrame:
    """key, symbol, first, last: occurrences without the index lists (their partial sums are two numbers)."""
    return accesses(st).groupBy(*KEY, "symbol").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))


def linear_def_use(st: DataFrame) -> DataFrame:
    """key, source, target, symbol: each use of a symbol with the last earlier write of it."""
    before = Window.partitionBy(*KEY, "symbol").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = accesses(st).withColumn("source", F.last(F.when(F.col("writes"), F.col("idx")), ignorenulls=True).over(before))
    return rows.where("uses and source is not null").select(*KEY, "source", F.col("idx").alias("target"), "symbol")


def first_writes(st: DataFrame) -> DataFrame:
    """key, symbol, first_write."""
    return accesses(st).where("writes").groupBy(*KEY, "symbol").agg(F.min("idx").alias("first_write"))


def classify_calls(st: DataFrame, known: list[str]) -> DataFrame:
    """key, idx, call, verdict: index (written earlier in the region), resolved (a known name) or unresolved.

    A name counts as a variable once written: the test is first_write < idx, not a growing set.
    """
    calls = st.select(*KEY, "idx", F.explode("calls").alias("call"))
    written = first_writes(st).withColumnRenamed("symbol", "call")
    verdict = F.when(F.col("first_write") < F.col("idx"), "index").when(F.col("call").isin(*known), "resolved").otherwise("unresolved")
    return calls.join(written, [*KEY, "call"], "left").select(*KEY, "idx", "call", verdict.alias("verdict"))


def project(edges: DataFrame, nodes: DataFrame, include_internal: bool = False) -> DataFrame:
    """Flow-node edges (source, target, kind, symbol) as edges between top-level statements (nodes: node, owner)."""
    owner = lambda side: nodes.select(*KEY, F.col("node").alias(side), F.col("owner").alias(f"{side}_owner"))
    out = edges.join(owner("source"), [*KEY, "source"]).join(owner("target"), [*KEY, "target"]).where("source_owner >= 0 and target_owner >= 0")
    if not include_internal:
        out = out.where("source_owner <> target_owner")
    return out.select(*KEY, F.col("source_owner").alias("source"), F.col("target_owner").alias("target"), "kind", "symbol").distinct()


def neighbours(regions: DataFrame) -> DataFrame:
    """key, node, predecessors, successors (sorted) of flow graphs (key, nodes, edges), in one grouping.

    A join of nodes with their edges would be planned by the size of the files that the programs are made of, which says
    nothing about the graphs: at scale the driver would send whole graphs to all tasks.
    """
    none = F.lit(None).cast("int")
    told = lambda node, before, after: F.struct(node.alias("node"), before.alias("before"), after.alias("after"))
    rows = F.concat(F.transform("nodes", lambda x: told(x["node"], none, none)), F.transform("edges", lambda x: told(x["target"], x["source"], none)), F.transform("edges", lambda x: told(x["source"], none, x["target"])))
    each = regions.where("region_id is not null").select(*KEY, F.explode(rows).alias("x")).select(*KEY, "x.*")
    ends = lambda c, name: F.array_sort(F.collect_set(c)).alias(name)
    return each.groupBy(*KEY, "node").agg(ends("before", "predecessors"), ends("after", "successors"))


def completion(st: DataFrame, edges: DataFrame, steps: int = 4) -> DataFrame:
    """key, boundary, through, roles, symbols: unfinished chains of dependent completion after compound statements.

    From a compound statement b, each following statement joins the chain while it has a completion role, is fed by the
    chain so far, and more than half of its incoming symbols come from there. Boundary t - 1 before a member t sees the
    suffix from t on; of several chains over a boundary the one of the later producer holds.
    """
    incoming = edges.where("source < target").groupBy(*KEY, "target").agg(F.collect_set(F.struct("source", "symbol")).alias("inc"), F.size(F.collect_set("symbol")).alias("n_symbols"))
    wanted = F.array(*map(F.lit, COMPLETION_ROLES))
    rows = st.select(*KEY, "idx", "is_compound", F.array_sort(F.array_intersect("roles", wanted)).alias("done"))
    rows = rows.join(by_key(incoming), (rows["path"] == incoming["path"]) & (rows["region_id"] == incoming["region_id"]) & (rows["idx"] == incoming["target"]), "left").select(rows["*"], F.coalesce("inc", F.array().cast("array<struct<source:int,symbol:string>>")).alias("inc"), F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"))
    w = Window.partitionBy(*KEY, BLOCK).orderBy("idx")
    cur = with_halo(rows, steps)
    for k in range(1, steps + 1):
        cur = cur.withColumn(f"x{k}", F.lead(F.struct("done", "inc", "n_symbols"), k).over(w))
    cur = cur.where("own_ and is_compound")
    alive = F.lit(True)
    for k in range(1, steps + 1):
        x = F.col(f"x{k}")
        reach = F.lit(k - 1)
        fed = F.array_sort(F.array_distinct(F.transform(F.filter(x["inc"], lambda e: (e["source"] >= F.col("idx")) & (e["source"] <= F.col("idx") + reach)), lambda e: e["symbol"])))
        cur = cur.withColumn(f"fed{k}", fed)
        alive = alive & F.coalesce(x.isNotNull() & (F.size(x["done"]) > 0) & (F.size(f"fed{k}") * 2 > x["n_symbols"]), F.lit(False))
        cur = cur.withColumn(f"ok{k}", alive)
    length = sum((F.col(f"ok{k}").cast("int") for k in range(1, steps + 1)), F.lit(0))
    members = F.filter(F.array(*(F.when(F.col(f"ok{k}"), F.struct(F.lit(k).alias("k"), F.col(f"x{k}.done").alias("roles"), F.col(f"fed{k}").alias("symbols"))) for k in range(1, steps + 1))), lambda m: m.isNotNull())
    cur = cur.withColumn("length", length).where("length > 0").withColumn("chain", members)
    suffix = lambda field: F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter("chain", lambda m: m["k"] >= F.col("k")), lambda m: m[field]))))
    cur = cur.select(*KEY, "idx", "length", "chain", F.explode(F.sequence(F.lit(1), F.col("length"))).alias("k"))
    cur = cur.select(*KEY, F.col("idx").alias("producer"), (F.col("idx") + F.col("k") - 1).alias("boundary"), (F.col("idx") + F.col("length")).alias("through"), suffix("roles").alias("roles"), suffix("symbols").alias("symbols"))
    last = F.max_by(F.struct("through", "roles", "symbols"), "producer").alias("e")
    return cur.groupBy(*KEY, "boundary").agg(last).select(*KEY, "boundary", "e.through", "e.roles", "e.symbols")
