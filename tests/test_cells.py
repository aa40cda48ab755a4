"""The registered search through cells against exact search, on a table with more cells."""

from __future__ import annotations

import numpy as np

from quillstrata.plans import catalogue


def test_recall_at_30_for_all_queries_of_the_larger_table(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    found = catalogue.QUERIES["vector_cells"](spark, sf_dir).collect()
    want = {(int(i), int(ids[k])) for i, q in zip(ids, x, strict=True) if i % 100 == 0 for k in np.argsort(1 - x @ q, kind="stable")[:30]}
    assert len(found) == len(want) == 30 * (ids % 100 == 0).sum()
    hit = len(want & {(r.query_id, r.vec_id) for r in found}) / len(want)
    print("recall", hit)
    assert hit >= 0.9
