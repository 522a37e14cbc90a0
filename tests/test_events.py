"""Event and deadlock documents, odd ones included."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from opsmetrics.functions.xml import entry, explode_events, parse_events
from opsmetrics.plans import deadlocks as D
from opsmetrics.plans import events as E

SAMPLE = """<deadlock><victim-list><victimProcess id="p1"/></victim-list><process-list>
<process id="p1" spid="87" ecid="0" lockMode="X" clientapp="web" hostname="H1" loginname="a"><executionStack><frame procname="db.x" line="1">unknown</frame>
<frame procname="db.y" line="2">UPDATE t</frame></executionStack><inputbuf>EXEC y</inputbuf></process>
<process id="p2" spid="61" ecid="3" lockMode="S" hostname="H2"><executionStack/><inputbuf>SELECT 1</inputbuf></process></process-list>
<resource-list><keylock id="l1" objectname="o" indexname="i" mode="X"><owner-list><owner id="p2" mode="S"/></owner-list><waiter-list><waiter id="p1" mode="X" requestType="wait"/></waiter-list></keylock>
<pagelock id="l2" objectname="o" mode="X"><owner-list><owner id="p1" mode="X"/></owner-list><waiter-list><waiter id="p2" mode="S"/></waiter-list></pagelock>
<objectlock id="l3"><owner-list/><waiter-list><waiter id="gone" mode="S"/></waiter-list></objectlock></resource-list></deadlock>"""


@pytest.fixture(scope="module")
def tables(spark):
    wrapped = f'<event name="xml_deadlock_report" timestamp="2024-01-01T00:00:00Z"><data name="xml_report"><value>{SAMPLE}</value></data></event>'
    old = '<deadlock-list><deadlock victim="q1"><process-list><process id="q1" spid="5"/></process-list><resource-list/></deadlock></deadlock-list>'
    docs = [("plain", SAMPLE), ("event", wrapped), ("old", old), ("none", "<event/>"), ("bad", "<deadlock><process-list><process id=</deadlock>"), ("empty", "<deadlock/>")]
    return D.deadlock_tables(spark.createDataFrame(docs, "doc string, xml string"), "doc", "xml")


def test_shapes(tables):
    n = lambda df: {r.doc: r["count"] for r in df.groupBy("doc").count().collect()}
    assert n(tables.processes) == {"plain": 2, "event": 2, "old": 1}
    assert n(tables.resources) == {"plain": 3, "event": 3} and n(tables.edges) == {"plain": 5, "event": 5}
    errors = {r.doc: r.error for r in tables.graphs.collect()}
    assert errors["plain"] is None and errors["none"] == "no deadlock element" and errors["bad"] and errors["empty"]


def test_processes(tables):
    got = {(r.doc, r.id): (r.is_victim, r.primary_sql) for r in tables.processes.collect()}
    assert got[("plain", "p1")] == (True, "UPDATE t") and got[("plain", "p2")] == (False, "SELECT 1") and got[("old", "q1")] == (True, "")


def test_summary_and_edges(tables):
    s = {r.doc: r for r in D.deadlock_summary(tables, "doc").collect()}
    assert (s["plain"].processes, s["plain"].resources, s["plain"].edges) == (2, 3, 5)
    assert s["plain"].summary == ("Victim process(es): SPID 87. Participants: 2; resources involved: 3. Applications seen: web. Hosts seen: H1, H2. Lock modes seen: S, X.")
    assert s["bad"].summary is None
    pairs = sorted((r.waiter, r.resource, r.owner) for r in D.deadlock_edges(tables, "doc").where("doc = 'plain'").collect())
    assert pairs == [("SPID 61 / ECID 3", "pagelock • o", "SPID 87"), ("SPID 87", "keylock • o • i", "SPID 61 / ECID 3")]


def test_filter(tables):
    ids = lambda text="", role="all": sorted(r.id for r in D.deadlock_filter(tables, "doc", text, role).where("doc = 'plain'").collect())
    assert ids() == ["p1", "p2"] and ids("update T") == ["p1"] and ids(role="victims") == ["p1"] and ids("select", "owners") == ["p2"] and ids("nothing") == []


def test_events_keep_what_does_not_parse(spark):
    good = '<event name="e" timestamp="2024-01-01T10:00:00.5Z"><data name="d"><value>7</value><text>seven</text></data><data name="d"><value>8</value></data></event>'
    df = spark.createDataFrame([(1, good), (2, "not xml <"), (3, None)], "id int, x string")
    rows = {r.id: r for r in parse_events(df, "x").select("id", "event_name", entry("data", "d", "int").alias("d"), F.col("labels")["d"].alias("t"), entry("actions", "a").alias("a"), "event_time").collect()}
    assert (rows[1].event_name, rows[1].d, rows[1].t, rows[1].a) == ("e", 7, "seven", None) and rows[2].event_name is None and len(rows) == 3


def test_ring_buffer(spark):
    doc = '<RingBufferTarget><event name="xml_deadlock_report" timestamp="2024-01-02T00:00:00"><data name="xml_report"><value><deadlock victim="a"/></value></data></event><event name="other"/><event name="xml_deadlock_report" timestamp="2024-01-03T00:00:00"><data name="xml_report"><value><deadlock victim="b"/></value></data></event></RingBufferTarget>'
    df = spark.createDataFrame([(doc,)], "target_data string")
    assert explode_events(df, "target_data").count() == 3
    got = [(r.deadlock_time, r.deadlock_graph) for r in E.deadlocks(df, n=1).collect()]
    assert got == [(dt.datetime(2024, 1, 3), '<deadlock victim="b"/>')]


def test_resources_of_any_kind_in_document_order(spark):
    xml = ('<deadlock><victim-list/><process-list><process id="p1" spid="1" priority="5"/><process id="p2" spid="2"/></process-list><resource-list>'
           '<ridlock id="r" subresource="S"><owner-list><owner id="p1" mode="X"/></owner-list><waiter-list><waiter id="p2" mode="U"/></waiter-list></ridlock>'
           '<newlock id="n" note="a>b"><owner id="p2" mode="X"/><waiter id="p1" mode="S"/></newlock><threadpool id="t"/></resource-list></deadlock>')
    from opsmetrics.plans.deadlocks import deadlock_tables

    t = deadlock_tables(spark.createDataFrame([(1, xml)], "d int, x string"), "d", "x")
    assert [(r["resource_index"], r["kind"], r["id"], r["subresource"]) for r in t.resources.orderBy("resource_index").collect()] == [
        (0, "ridlock", "r", "S"), (1, "newlock", "n", None), (2, "threadpool", "t", None)]
    assert sorted((r["resource_index"], r["role"], r["process_id"]) for r in t.edges.collect()) == [
        (0, "owner", "p1"), (0, "waiter", "p2"), (1, "owner", "p2"), (1, "waiter", "p1")]


def test_documents_that_do_not_parse_are_reported(spark):
    from opsmetrics.functions.xml import explode_events

    docs = spark.createDataFrame([(1, "<r><event name='a'/><event name='b'/></r>"), (2, "<r><event name="), (3, "<r/>")], "i int, x string")
    got = sorted((r["i"], r["event"]["_name"] if r["event"] else None, r["corrupt"]) for r in explode_events(docs, "x").collect())
    assert got == [(1, "a", None), (1, "b", None), (2, None, "<r><event name=")]


def test_every_deadlock_of_a_document(spark):
    """Several deadlocks, one malformed, one without processes, resources with any attributes."""
    from opsmetrics.plans.deadlocks import deadlock_edges, deadlock_filter, deadlock_summary, deadlock_tables

    one = ('<deadlock victim="p1"><process-list><process id="p1" spid="1"/><process id="p2" spid="2"/></process-list><resource-list>'
           '<oddlock id="a" Note="x&lt;&quot;y&amp;gt;" other=\'say "no"\'/><keylock id="k"><owner-list><owner id="p1" mode="X"/></owner-list>'
           '<waiter-list><waiter id="p2" mode="U"/></waiter-list></keylock></resource-list></deadlock>')
    two = one.replace('"p1"', '"q1"').replace('spid="1"', 'spid="7"')
    docs = [(1, f"<r>{one}<x/>{two}<deadlock><process-list></deadlock></r>"), (2, "<deadlock/>"), (3, "none"), (4, None), (5, one)]
    t = deadlock_tables(spark.createDataFrame(docs, "d int, x string"), "d", "x")
    assert sorted((r.d, r.deadlock_no, r.error) for r in t.graphs.collect()) == [
        (1, 0, None), (1, 1, None), (1, 2, "malformed document"), (2, 0, "no process list"), (3, 0, "no deadlock element"), (4, 0, "no deadlock element"), (5, 0, None)]
    assert sorted((r.d, r.deadlock_no, r.id, r.is_victim) for r in t.processes.where("d = 1").collect()) == [
        (1, 0, "p1", True), (1, 0, "p2", False), (1, 1, "p2", False), (1, 1, "q1", True)]
    odd = [r.attributes for r in t.resources.where("d = 5").orderBy("resource_index").collect()]
    assert odd == [{"id": "a", "Note": 'x<"y&gt;', "other": 'say "no"'}, {"id": "k"}]
    assert sorted((r.deadlock_no, r.waiter, r.owner) for r in deadlock_edges(t, "d").where("d = 1").collect()) == [(0, "SPID 2", "SPID 1"), (1, "SPID 2", "SPID 7")]
    assert sorted((r.deadlock_no, r.victims) for r in deadlock_summary(t, "d").where("d = 1 and error is null").collect()) == [(0, "SPID 1"), (1, "SPID 7")]
    assert sorted((r.d, r.deadlock_no, r.id) for r in deadlock_filter(t, "d", role="owners").collect()) == [(1, 0, "p1"), (1, 1, "q1"), (5, 0, "p1")]


def test_tables_that_parse_only_what_they_show(spark):
    """The same rows as from one whole parse, odd documents included, and both sides of the resources from one parse."""
    whole = ('<deadlock victim="p1"><victim-list/><process-list><process id="p1"><executionStack><frame>s{0}</frame></executionStack><inputbuf>run{1}</inputbuf></process></process-list>'
             '<resource-list><keylock id="l"{2}><owner-list><owner id="p1" mode="X"/>{3}</owner-list><waiter id="p2" mode="S"/></keylock>{4}</resource-list></deadlock>')
    odd = ["", "<b/>", "t<b>u</b>t", "<b", "<!-- c -->", "<![CDATA[<q>]]>", "<x y='a/>b'/>", '<x y="]]>"/>', '<x y="open/>', "<inputbuf>1<c/>2</inputbuf>", '<owner id="z"/>', "<a/ b='1'>", "<x/ >"]
    values = ["", ' n="1"', ' n="a/>b"', " n='x\"y'", ' n="1" n="2"', " n=1", ' n="]]>"', " n"]
    docs = [whole.format(*[x if i == k else "" for k in range(5)]) for i in (0, 1, 3, 4) for x in odd]
    docs += [whole.format("", "", x, "", "") for x in values]
    df = spark.createDataFrame(list(enumerate(docs)), "d int, x string")
    apart, kept = (D.deadlock_tables(df, "d", "x", keep) for keep in (False, True))
    for name in ("graphs", "processes", "resources", "edges"):
        got, want = (sorted(map(repr, getattr(t, name).collect())) for t in (apart, kept))
        assert got == want, name
    errors = [r.error for r in kept.graphs.collect()]
    assert errors.count(None) > 20 and errors.count("malformed document") > 10
    plan = apart.edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml(") == 1 and "clientapp" not in plan
