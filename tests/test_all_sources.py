"""The d11 queries over all sources against brute force."""

from collections import Counter, defaultdict

from factloom.plans import demo

SF = "/root/testdata/sf0.001"


def walks(edges, sources, depth):
    """(source, name, least depth) by breadth-first search from each source."""
    after = defaultdict(set)
    for a, b in edges:
        after[a].add(b)
    out = set()
    for s in sources:
        seen, front = set(), {s}
        for d in range(1, depth + 1):
            front = {y for x in front for y in after[x]} - seen
            seen |= front
            out |= {(s, y, d) for y in front}
    return out


def test_all_sources(spark):
    edges = {tuple(r) for r in demo.call_edges(spark, SF).collect()}
    sources = {a for a, _ in edges}
    assert any(s >= 3 for s in sources)
    run = lambda name: [tuple(r) for r in demo.QUERIES[name](spark, SF).collect()]
    assert sorted(run("d11_reachable_all")) == sorted(walks(edges, sources, 8))
    assert sorted(run("d11_truncated_all")) == sorted({(s,) for s, y, d in walks(edges, sources, 2) if d == 2 and y in sources})
    into = Counter(b for _, b in edges)
    few = {(a, b) for a, b in edges if into[b] <= 12}
    assert sorted(run("d11_unambiguous_all")) == sorted(walks(few, sources, 8))
