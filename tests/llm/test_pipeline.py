"""The stages of the pipeline, each on its predecessor's rows, against brute force."""

import os
import shutil

import pytest

import corpus_pipeline
from fleetsense.llm import common, quality_classifier

from . import helpers as H

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(common.stored(f(spark, out[-1], SF), "test-stage"))
    return out


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_quality_stage(spark, stages):
    model = quality_classifier.fit(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality_classifier.score(stages[0], model).where("predicted = 1").collect()}
    assert {r.doc_id for r in stages[1].collect()} == good


def test_dedup_stages(stages):
    before, one, near = ([(r.doc_id, r.text) for r in s.collect()] for s in stages[1:4])
    assert sorted(i for i, _ in one) == sorted(k for k, _ in H.exact(before).values())
    assert sorted(i for i, _ in near) == sorted({c for _, c in H.components(one).values()})


def test_mix_and_pack(stages):
    words = lambda s: sum(len(H.WORD.findall(r.text)) for r in s.collect())
    assert words(stages[4]) == pytest.approx(1.5 * words(stages[3]), abs=30)
    pieces = stages[5].collect()
    total = {}
    for p in pieces:
        total.setdefault(p.sequence_id, 0)
        total[p.sequence_id] += p.length
    assert all(n <= 4096 and n & (n - 1) == 0 for n in total.values())


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_entry_without_this_subpackage(tmp_path):
    """The rest of the library and the driver's contract work when these folders are gone."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(f"{root}/fleetsense", tmp_path / "fleetsense", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
