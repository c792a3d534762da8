"""Sections, edges and probes of small Markdown documents."""

from pyspark.sql import functions as F

from recollect.operators import graph

A = """# Title of doc

intro **ABC-001** — first; see [b](../x/b.md#part) and [own](a.md)
## Cache Eviction Policy!
uses ABC-001, not xABC-001 nor ABC-0011 or ABC-001-x
### Cache -- eviction policy
**ABC-001** again

## 
## Blank next
### 

## Café über alles and much more text that is longer than forty
NO-12 TOOLONGX-123 AB-123"""
B = "\n\n## Storage Engine Layout\nRefers to ABC-001 [to c](c.md"
C = "preamble of c about giraffes\n## Storage Tuning Guide\n[b](b.md) AB-123 **AB-123**"


def docs(spark):
    return spark.createDataFrame([("a", A), ("b", B), ("c", C), ("n", None), ("e", "")], "doc string, text string")


def test_sections_and_their_labels(spark):
    got = {r.label: (r.section, r.heading) for r in graph.split_sections(docs(spark)).collect()}
    assert got == {
        "a::00-preamble": (0, "Title of doc"), "a::cache-eviction-policy": (1, "Cache Eviction Policy!"), "a::cache-eviction-policy-2": (2, "Cache -- eviction policy"),
        "a::": (3, ""), "a::blank-next": (4, "Blank next"), "a::-2": (5, ""),
        "a::caf-ber-alles-and-much-more-text-that-is": (6, "Café über alles and much more text that is longer than forty"),
        "b::storage-engine-layout": (1, "Storage Engine Layout"), "c::00-preamble": (0, "preamble of c about giraffes"), "c::storage-tuning-guide": (1, "Storage Tuning Guide"),
    }
    (cut,) = graph.split_sections(docs(spark).where("doc = 'c'"), 5).where("section = 0").collect()
    assert cut.text == "pream"


def test_edges_of_requirements_and_links(spark):
    got = {tuple(r) for r in graph.mine_edges(graph.split_sections(docs(spark))).select("subject", "predicate", "object").collect()}
    assert got == {
        ("a::cache-eviction-policy", "derived_from", "a::00-preamble"), ("a::cache-eviction-policy-2", "derived_from", "a::00-preamble"),
        ("b::storage-engine-layout", "derived_from", "a::00-preamble"), ("b::storage-engine-layout", "depends_on", "c::00-preamble"),
        ("a::caf-ber-alles-and-much-more-text-that-is", "derived_from", "c::storage-tuning-guide"),
    }  # fmt: skip  b has no preamble, so links to it count for nothing


def test_probes_by_kind(spark):
    sections = spark.createDataFrame(
        [("s1", "Cache Eviction", "## Cache Eviction"), ("s2", "x", "giraffes here"), ("s3", "Disk Layout", "disk words"), ("s4", "y", "layout talk"), ("s5", "z", "nothing shared"), ("s6", "That With", "none"), ("s7", "Lone Heading", "no links"), ("s8", "Query Planner", "planner"), ("s9", "w", "query here")],
        "label string, heading string, text string",
    )
    edges = spark.createDataFrame([("s1", "s2"), ("s1", "s9"), ("s3", "s4"), ("s4", "s5"), ("s4", "s3"), ("s6", "s2"), ("s8", "s9"), ("s8", "s9")], "subject string, object string")
    got = {r.name: (r.query, r.gold, r.seeds, r.min_depth) for r in graph.mine_probes(sections, edges).collect()}
    assert got == {
        "s1::d1": ("Cache Eviction", ["s2", "s9"], ["s1"], 1), "s3::d2": ("Disk Layout", ["s5"], ["s3", "s4"], 2), "s8::lex": ("Query Planner", ["s9"], ["s8"], 0),
    }
    assert graph.mine_probes(sections, edges.where(F.lit(False))).collect() == []


def test_a_walk_joins_no_edges_beyond_its_budget(spark, monkeypatch):
    from recollect.operators import graph as g

    sizes, keep = {}, g.saved

    def spied(df, label):
        out = keep(df, label)
        sizes[label] = max(sizes.get(label, 0), out.count())
        return out

    monkeypatch.setattr(g, "saved", spied)
    first = [("s", "supports", f"a{i:02}") for i in range(12)]
    beyond = [(f"a{i:02}", "supports", f"b{j:02}") for i in range(12) for j in range(20)]
    edges = spark.createDataFrame(first + beyond, "subject string, predicate string, object string")
    nodes, stats = g.traverse(edges, spark.createDataFrame([("s",)], "id string"), 2, "out", 100, 40)
    found = {(r.node, r.depth): r.path for r in nodes.collect()}
    # 12 edges from the seed, 20 of a00, then 8 of a01, which lead to nodes that a00 has led to
    assert set(found) == {("s", 0)} | {(f"a{i:02}", 1) for i in range(12)} | {(f"b{j:02}", 2) for j in range(20)}
    assert all(found[f"b{j:02}", 2] == ["s|supports|a00", f"a00|supports|b{j:02}"] for j in range(20))
    assert [tuple(r) for r in stats.collect()] == [("s", 33, 40, 2, ["edges"])]
    assert max(n for label, n in sizes.items() if label != "steps") <= 40


def test_edges_are_mined_from_sections_that_are_made_once(spark):
    from recollect.operators import graph as g

    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        made.add(1)
        return text

    rows = [("a", 0, "a::00-preamble", "**REQ-001** here"), ("b", 0, "b::00-preamble", "see REQ-001 in [it](x/a.md#y)"), ("b", 1, "b::one", "nothing")]
    sections = spark.createDataFrame(rows, "doc string, section long, label string, text string").select("doc", "section", "label", told("text").alias("text"))
    got = {tuple(r) for r in g.mine_edges(sections).collect()}
    assert got == {("b::00-preamble", "derived_from", "a::00-preamble"), ("b::00-preamble", "depends_on", "a::00-preamble")}
    assert made.value == len(rows)


def test_only_words_of_linked_sections_are_held(spark, monkeypatch):
    from recollect.operators import graph as g

    sizes, keep = {}, g.saved

    def spied(df, label):
        out = keep(df, label)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(g, "saved", spied)
    rows = [("a", "green leaves", "green leaves grow"), ("b", "other heading", "leaves fall")] + [(f"c{i}", "", "green leaves again") for i in range(30)]
    sections = spark.createDataFrame(rows, "label string, heading string, text string")
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "subject string, object string")
    got = {r.label: (r["name"], r.gold, r.seeds) for r in g.mine_probes(sections, edges).collect()}
    assert got == {"a": ("a::lex", ["b"], ["a"]), "b": ("b::d1", ["a"], ["b"])}
    assert sizes["held"] <= 4
