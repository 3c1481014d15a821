"""The pipeline's stages, each against a brute-force version on its own input; and what the driver sees without it."""

import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline as P
from tests.conftest import DATA, ROOT
from tests.llm.test_operators import base, blocks_by_hand, linked


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for _, stage in P.STAGES:
        out.append(P.stored(stage(spark, out[-1], DATA)))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_filters_keep_clean_documents(spark, steps):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    first, scored, ruled = (texts(s) for s in steps[:3])
    assert set(ruled) <= set(scored) <= set(first)
    good = [i for i in first if labels.get(i) == 1 and base(first[i])[0] >= 50]
    assert sum(i in ruled for i in good) >= 0.95 * len(good)
    assert all(base(t)[0] >= 50 and 2 * base(t)[4] <= base(t)[0] for t in ruled.values())


def test_line_dedup_stage(steps):
    before, after = texts(steps[2]), texts(steps[3])
    want = {i: t for i, (t, n) in blocks_by_hand(before, 50).items() if not n or t.split()}
    assert after == want
    assert all(r.n_chars == len(r.text) for r in steps[3].collect() if r.text != before[r.doc_id])


def test_near_dedup_stage(steps):
    before = texts(steps[3])
    assert texts(steps[4]) == {i: before[i] for i, (_, _, kept) in linked(before, 5, 80).items() if kept}


def test_packing_stage(steps):
    ends = {}
    for r in steps[5].collect():
        ends[r.doc_id] = ends.get(r.doc_id, 0) + r.length
        assert ends[r.doc_id] <= r.doc_tokens
    assert set(ends) == set(texts(steps[4]))


def test_shapes(spark, steps):
    assert all(s.columns == P.COLUMNS for s in steps[:-1]) and P.ORACLE_SQL is None
    assert P.run(spark, DATA).count() == steps[-1].count()


def test_the_rest_works_without_this(tmp_path):
    for p in ("mnemospark", "__spark_entry__.py"):
        (tmp_path / p).symlink_to(ROOT / p)
    code = "import sys\nsys.modules['mnemospark.llm'] = None\nimport __spark_entry__ as e\nassert not [q for q in e.queries() if q.startswith('op')] and 'pipeline' not in e.queries() and len(e.queries()) > 50"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": str(Path(sys.executable).parent)}, check=True)
