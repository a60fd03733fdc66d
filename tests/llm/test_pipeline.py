"""The pipeline against each stage's operator run by hand, and the entry without it."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest

import corpus_pipeline as P
from loomgrid.llm import decontaminate, langid
from loomgrid.llm.queries import queries
from tests.llm.test_decontaminate import similarity
from tests.llm.test_near_dedup import brute as groups
from tests.llm.test_near_dedup import planted
from tests.llm.corpus import tokens

ROOT = Path(__file__).parent.parent.parent


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = docs
    before = docs.collect()
    for (name, stage), check in zip(P.STAGES, (_language, _near, _clean, _mixed, _sharded)):
        kept = stage(spark, kept, sf)
        after = kept.collect()
        if check is not _sharded:
            assert kept.columns == docs.columns, name
        check(spark, before, after, bench)
        kept, before = spark.createDataFrame(after, kept.schema), after


def test_one_of_each_linked_pair_goes_on(spark, monkeypatch):
    docs = planted(spark, monkeypatch, 3000, 400)
    kept = P.near_copies(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(3000))


def _language(spark, before, after, bench):
    model = langid.train(spark.createDataFrame(before))
    r = langid.spans_of(pa.array([d.text for d in before]), model)
    want = sum(n > 0 and s >= langid.MIN_SHARE for n, s in zip(r["letters"], r["share"]))
    assert len(after) == want >= 0.95 * len(before)


def _near(spark, before, after, bench):
    live, root = groups([(d.doc_id, d.text) for d in before])
    assert len({d.doc_id for d in after}) == len(after)
    kept = {d.doc_id for d in after}
    by = {}
    for d, r in zip(live, root):
        by.setdefault(r, []).append(d[0])
    ok = sum(sum(i in kept for i in ids) == 1 and min(ids) in kept for ids in by.values())
    assert ok >= 0.97 * len(by)


def _clean(spark, before, after, bench):
    kept = {d.doc_id for d in after}
    for d in before:
        w = tokens(d.text)
        exact = any(" ".join(tokens(t)) in " ".join(w) for _, t in bench if len(tokens(t)) >= 5)
        assert not (exact and d.doc_id in kept)
        if d.doc_id not in kept and not exact:
            best = max(similarity(w[k : k + len(tokens(t))], tokens(t)) for _, t in bench for k in range(max(1, len(w) - len(tokens(t)) + 1)))
            assert best >= decontaminate.THRESHOLD - 1e-9


def _mixed(spark, before, after, bench):
    texts = {d.doc_id: d for d in before}
    assert all(texts[d.doc_id] == d for d in after) and 0.5 * len(before) < len(after) < 1.1 * len(before)


def _sharded(spark, before, after, bench):
    assert sorted(d.doc_id for d in after) == sorted(d.doc_id for d in before)


def test_run_is_the_stages(spark, sf):
    out = P.run(spark, sf)
    assert {"shard", "position"} <= set(out.columns) and out.count() > 0 and P.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(n for n in queries() if n.startswith("op")))
def test_query_has_rows(spark, sf, name):
    assert queries()[name](spark, sf).count() > 0 or name == "op8_secret_scan"


def test_entry_without_the_subpackage(tmp_path):
    """Without the llm folders and the pipeline the entry imports and has the other queries."""
    import shutil

    shutil.copytree(ROOT / "loomgrid", tmp_path / "loomgrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q_pivot' in q and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
