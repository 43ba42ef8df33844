"""The stages chain: columns stay, decisions take effect, and packing holds what was kept."""

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    import corpus_pipeline

    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], DATA).write.parquet(f"{root}/{name}")
        out.append(spark.read.parquet(f"{root}/{name}"))
    return out


def test_columns_and_counts(stages):
    docs, *kept, packed = stages
    assert all(d.columns == docs.columns for d in kept)
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in (docs, *kept)]
    assert all(b <= a for a, b in zip(ids, ids[1:])) and ids[1] == ids[2]
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == ids[-1]


def test_stages_match_brute_force(spark, stages):
    from .test_documents import brute_components, brute_hits, brute_lines

    import hashlib

    rows = lambda df: [(r["doc_id"], r["text"], None) for r in df.select("doc_id", "text").collect()]
    _, toxic, lines, near, clean, _ = stages
    want = {d: h for d, _, _, h in brute_lines(rows(toxic))}
    assert {d: hashlib.sha256((t or "").encode()).hexdigest() for d, t, _ in rows(lines)} == want
    assert {d for d, _, _ in rows(near)} == {d for d, _, _, kept in brute_components(rows(lines), 80) if kept}
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    assert {d for d, _, _ in rows(clean)} == {x[0] for x in brute_hits(rows(near), items) if not x[5]}


def test_run(spark, stages):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, DATA)
    assert got.count() == stages[-1].count() and got.columns == stages[-1].columns
