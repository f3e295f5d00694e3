"""The join's prefix length is the same whatever the corpus holds."""

from spinel.llm import forest


def test_depth_is_not_estimated(spark, monkeypatch):
    """Close copies would call for long prefixes; the links near the threshold among them must not pay for it."""
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*base, *[f"c{k}"] * (k % 2)])) for k in range(12)] + [(20, " ".join(f"v{k}" for k in range(40))), (21, " ".join([*[f"v{k}" for k in range(40)], "x"]))]
    used = []
    nodes = forest.nodes_at
    monkeypatch.setattr(forest, "nodes_at", lambda classes, depth, trees: used.append(depth) or nodes(classes, depth, trees))
    found = forest.join_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert set(used) == {forest.prefix_depth()}
    assert {r.doc_id: r.class_id for r in found} == {**{k: 0 for k in range(12)}, 20: 20, 21: 20}
