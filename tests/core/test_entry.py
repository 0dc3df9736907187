import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]


def test_contract():
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 35 and all(callable(q) for q in queries.values())


@pytest.mark.parametrize("with_pipeline", [False, True])
def test_without_the_training_data_operators(tmp_path, with_pipeline):
    """The rest imports and registers its queries when the subpackage is gone, with or without the pipeline's module."""
    for p in ("__spark_entry__.py", *(["corpus_pipeline.py"] if with_pipeline and (ROOT / "corpus_pipeline.py").exists() else [])):
        (tmp_path / p).write_text((ROOT / p).read_text())
    for p in (ROOT / "assaylake").rglob("*.py"):
        if "llm" not in p.parts:
            to = tmp_path / p.relative_to(ROOT)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(p.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'global_knn_scores' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_scratch_is_cleared(spark):
    from assaylake.sources import scratch

    kept = scratch.materialize(spark.range(3), "kept")
    root = scratch.scratch_root(spark).removeprefix("file://")
    assert kept.count() == 3 and Path(root).exists()
    scratch.clear(spark)
    assert not Path(root).exists() and scratch.materialize(spark.range(2), "again").count() == 2
