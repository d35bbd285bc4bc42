"""The pipeline stage by stage against plain versions, and the registered SQL."""

import brute
import corpus_pipeline
import duckdb
import pytest

from vitrine.llm import decontaminate
from vitrine.llm.common import table
from vitrine.llm.queries import ORACLES, QUERIES
from vitrine.session import materialize


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), name)
        after[name] = docs
        if name != "pack":
            assert docs.columns == columns, name
    ids = {n: {r[0] for r in d.select("doc_id").collect()} for n, d in after.items()}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in ids["quality"] for d in good) >= 0.95 * len(good)
    bad = [d for d, q in labels.items() if q == 0]
    assert sum(d in ids["quality"] for d in bad) <= 0.3 * len(bad)
    texts = {r["doc_id"]: r["text"] for r in after["quality"].collect()}
    classes = brute.near_classes([(d, t) for d, t in texts.items() if len(t) < 3000])
    for d, c in classes.items():
        if d != c:
            assert d not in ids["near_copies"]
        elif c not in [x for k, x in classes.items() if k != d]:
            assert d in ids["near_copies"] or len(texts[d]) > 2000
    shard = decontaminate.Benchmark([tuple(r) for r in table(spark, sf, "benchmark").collect()], 5)
    assert ids["decontaminate"] == {d for d in ids["near_copies"] if not shard.hits(texts[d], 0.5)}
    assert ids["pii"] == ids["decontaminate"] == ids["pack"]
    assert not any(sum(brute.pii(r["text"])[0]) for r in after["pii"].collect())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    got = sorted((tuple(r) for r in QUERIES[name](spark, sf).select(*names).collect()), key=repr)
    assert got == sorted(want.fetchall(), key=repr)
