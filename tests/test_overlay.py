"""Paths over an overlay of cells against the search of a whole graph."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringfold.operators import graph, overlay
from ringfold.operators.components import connected_components
from ringfold.operators.kernels import Graph
from ringfold.queries import network
from ringfold.sources.derived import Derived


def random_streets(spark, n=160, seed=1):
    rng = np.random.default_rng(seed)
    xy = rng.uniform(0, 1000, (n, 2))
    nodes = [(f"n{i}", float(x), float(y)) for i, (x, y) in enumerate(xy)]
    edges = []
    for i in range(n):
        near = np.argsort(((xy - xy[i]) ** 2).sum(axis=1))[1 : 3 + i % 2]
        for j in near:
            if rng.random() < 0.75:
                edges.append((f"e{len(edges)}", f"n{i}", f"n{j}", float(np.hypot(*(xy[i] - xy[j])) * rng.uniform(1, 1.6))))
    edges += [("loop", "n0", "n0", 5.0), ("twin", edges[0][1], edges[0][2], edges[0][3] * 2)]
    e = spark.createDataFrame(edges, "edge string, a string, b string, length_m double")
    n = spark.createDataFrame(nodes, "node string, x double, y double")
    return n.join(connected_components(e.select("a", "b"), n.select("node")), "node"), e, nodes, edges


@pytest.mark.parametrize("cell_m,most", [(170.0, 2000), (400.0, 12), (5000.0, 2000)])
def test_overlay_equals_one_graph(spark, cell_m, most):
    nodes, edges, n, e = random_streets(spark)
    rng = np.random.default_rng(3)
    asked = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, len(n), (90, 2))] + [("n3", "n3"), ("n1", "nowhere"), ("n5", "n9"), ("n5", "n9")]
    got = overlay.overlay_paths(spark.createDataFrame(asked, "a string, b string"), nodes, edges, cell_m, most).collect()
    assert sorted((r.a, r.b) for r in got) == sorted(set(asked))
    plain = Graph(n, [(*x, []) for x in e])
    ends, length = {x[0]: set(x[1:3]) for x in e}, {x[0]: x[3] for x in e}
    some = 0
    for r in got:
        want = plain.shortest(r.a, r.b) if r.b != "nowhere" else None
        if want is None:
            assert r.length_m is None and r.edges is None
            continue
        assert r.length_m == pytest.approx(want[0], abs=1e-9)
        at = r.a  # the edges make a walk of that length
        for ident in r.edges:
            assert at in ends[ident]
            at = next(iter(ends[ident] - {at}), at)
        assert at == r.b and sum(length[i] for i in r.edges) == pytest.approx(r.length_m)
        some += len(r.edges) > 5
    assert some > 20


def test_cells_hold_few_nodes_and_split_the_regions(spark, sf):
    nodes, edges = network.lattice_graph(Derived(spark, sf))
    cells = overlay.node_cells(nodes, 5000.0, 12)
    assert cells.count() == nodes.count() and cells.groupBy("cell").count().agg(F.max("count")).first()[0] <= 12
    same = nodes.select("node", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    assert overlay.node_cells(same, 10.0, 3).select("cell").distinct().count() == 1
    # The lattice query's own pairs, once with each region's component in a task, once over cells.
    region = F.floor(F.col("node").cast("long") / 121)
    ids = nodes.select(F.col("node").alias("a"), region.alias("r"))
    pairs = ids.join(ids.withColumnRenamed("a", "b"), "r").where((F.col("a") * 7 + F.col("b")) % 10 == 0).select("a", "b")
    show = lambda df: sorted((r.a, r.b, r.length_m) for r in df.collect())
    whole = show(graph.shortest_paths(pairs, nodes, edges))
    assert show(graph.shortest_paths(pairs, nodes, edges, task_nodes=0, cell_m=350.0)) == whole and len(whole) > 500
