"""Queries without SQL, on whole tables against the plain versions."""

from graphloom.catalog import QUERIES
from graphloom.sources import codebase as cb
from tests import test_layout as tl
from tests import test_order as to

DATA = "/root/testdata/sf0.001"


def code_base(spark, most=3):
    files = cb.files(spark, DATA).collect()
    return files, {tuple(e) for e in cb.short_imports(spark, DATA, most).select("src", "dst").collect()}


def test_reading_order_and_onboarding_map(spark):
    files, edges = code_base(spark)
    want = to.queue_order([f.path for f in files], edges)
    got = QUERIES["reading_order"](spark, DATA).orderBy("pos").collect()
    assert [x.path for x in got] == want and any(x.round is None for x in got) and max(x.round or 0 for x in got) > 3
    phases = QUERIES["onboarding_map"](spark, DATA).orderBy("phase").collect()
    score = {f.path: f.pagerank for x in phases for f in x.files}
    assert [(x.name, x.module, x.rationale, [f.path for f in x.files]) for x in phases] == to.plain_phases(want, edges, {}, score)


def test_graph_layout(spark):
    files, edges = code_base(spark, 2)
    nodes, _ = tl.plain([f.path for f in files], edges, {})
    got = {x.id: (x.layer, x.place, x.x, x.y, None) for x in QUERIES["graph_layout"](spark, DATA).collect()}
    assert set(got) == set(nodes) and all(tl.close(got[v], nodes[v]) for v in nodes)
    assert max(n[0] for n in nodes.values()) > 1
