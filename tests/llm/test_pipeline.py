import importlib.util

import corpus_pipeline as p
from factloom.llm import queries
from factloom.llm.common import staged
from tests.llm.helpers import SF, edge_docs, edge_rows, empty_docs, odd_docs


def test_stages_keep_the_columns(spark):
    docs = edge_docs(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in p.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "simhash_near_dedup":
            ids = [r["doc_id"] for r in docs.collect()]
            assert 1 in ids and 2 not in ids and 8 in ids and 9 in ids and None in ids
    assert p.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_stages_keep_columns_of_any_name(spark):
    docs = odd_docs(spark)
    for name, stage in p.STAGES[1:-1]:
        out = staged(stage(spark, docs, SF), name)
        assert out.schema.names == docs.schema.names and [f.dataType.simpleString() for f in out.schema] == [f.dataType.simpleString() for f in docs.schema]
        assert {(r["n_bytes"], r["kept"], r["_id"], tuple(r["row"]), r["carried"]) for r in out.collect()} == {(7, "kept", 1.5, (1,), True)}


def test_stages_against_brute_force(spark):
    """Near duplicates, repeats and copies of each stage's own input, by plain Python."""
    from tests.llm.test_near_duplicates import brute_groups
    from tests.llm.test_operators import SPACE, brute_repeats

    docs = staged(edge_docs(spark).select("doc_id", "text", "lang", "source", "n_chars"), "in")
    groups, _ = brute_groups([(i, t or "") for i, t, *_ in edge_rows() if i is not None])
    near = staged(p.drop_near_duplicates(spark, docs, SF), "near")
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, near.collect())) == sorted(key(r) for r in docs.collect() if r["doc_id"] is None or groups[r["doc_id"]] == r["doc_id"])
    rows = [tuple(r) for r in near.collect()]
    bare = staged(p.drop_repeats(spark, near, SF), "bare")
    removed = {(i, n): gone for i, n, gone, *_ in brute_repeats(rows)}
    got = bare.collect()
    assert sorted(len(r["text"].encode()) for r in got) == sorted(len((t or "").encode()) - removed[i, len((t or "").encode())] for i, t, *_ in rows)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    mixed = p.mix_sources(spark, bare, SF).collect()
    sizes = {r["doc_id"]: len([w for w in SPACE.split(r["text"]) if w]) for r in got}
    taken = {}
    for r in p.mixing.mix(bare).collect():
        taken.setdefault(r["doc_id"], []).append(int(r["taken"] / r["size"] + 0.5) if r["size"] else 0)
    assert {i: sum(x) for i, x in taken.items() if sum(x)} == {i: sum(r["doc_id"] == i for r in mixed) for i in {r["doc_id"] for r in mixed}}
    assert all(0 <= n <= 3 for x in taken.values() for n in x) and all(sizes[r["doc_id"]] > 0 for r in mixed)


def test_stages_take_an_empty_table(spark):
    docs = empty_docs(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in p.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_run_on_the_smallest_tables(spark):
    out = p.run(spark, SF)
    assert out.count() > 0 and "n_tokens" in out.columns


def test_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    spec = importlib.util.find_spec("__spark_entry__")
    assert spec is not None
