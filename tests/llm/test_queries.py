"""Named queries against their SQL, the pipeline stage by stage, and what is left when the package is deleted."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import compare, duck
from tests.llm.helpers import frame, prose, words
from texelmill.llm.queries import CHECKS, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_sql(spark, name):
    assert compare(spark, duck(FOLDER), name, QUERIES[name], CHECKS[name], FOLDER) is None


def test_every_operator_has_one_query():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    docs, seen = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame((out := stage(spark, docs, FOLDER)).collect(), out.schema)
        seen.append(docs)
    assert all(d.columns == corpus_pipeline.COLUMNS for d in seen[:-1])
    given = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    language, cleaned, single, mixed, tokens = ([r.asDict() for r in d.collect()] for d in seen)
    assert len(language) == len(given) and all(r["lang"] in {"en", "de", "fr", "es"} for r in language)
    assert {r["doc_id"] for r in cleaned} == set(given)
    from tests.llm.test_operators import expected_components

    groups = expected_components({r["doc_id"]: r["text"] for r in cleaned})
    assert {r["doc_id"] for r in single} == {c for _, c in groups.values()} and len(single) == len({r["doc_id"] for r in single}) < len(cleaned)
    size = {r["doc_id"]: len(words(r["text"])) for r in single}
    total, took = sum(size.values()), sum(size[r["doc_id"]] for r in mixed)
    assert abs(took - 1.5 * total) < 0.05 * total
    assert len(tokens) == len(mixed) and all(r["exact"] and r["n_tokens"] == len(r["ids"]) for r in tokens)


def test_pipeline_of_odd_tables(spark):
    import random

    rng = random.Random(1)
    texts = [None, "", " ", "same text of five words", "same text of five words", prose(rng, 3000)]
    for docs in (frame(spark, texts), frame(spark, texts).withColumn("doc_id", F.lit(3).cast("long")), frame(spark, texts).limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame((out := stage(spark, docs, FOLDER)).collect(), out.schema)
        assert docs.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "exact"]


def test_one_row_of_each_group(spark):
    """Rows kept of null, shared and repeated ids."""
    import random

    rng = random.Random(4)
    clean = [prose(rng, 60, 10**6) for _ in range(8)]
    near = lambda t: " ".join([*words(t)[:-1], "changed"])
    rows = [(None, t) for t in clean[:3]] + [(None, near(clean[0])), (None, None), (None, None), (None, "")]  # null ids
    rows += [(1, clean[3]), (2, near(clean[3])), (2, clean[4]), (3, clean[5]), (3, clean[6])]  # an id with two texts
    rows += [(4, clean[7])] * 3 + [(None, near(clean[7])), (5, near(clean[7])), (6, " "), (6, " ")]  # repeated rows
    docs = spark.createDataFrame([(i, t, "en", "a", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.one_of_each_group(spark, docs, FOLDER)
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert out.columns == corpus_pipeline.COLUMNS
    sure = [(None, clean[1]), (None, clean[2]), (None, None), (None, None), (None, ""), (1, clean[3]), (2, clean[4]), (3, clean[5]), (3, clean[6]), (4, clean[7]), (6, " "), (6, " ")]
    order = lambda x: sorted(x, key=repr)
    assert order(got) in (order([*sure, (None, clean[0])]), order([*sure, (None, near(clean[0]))]))


def test_one_row_of_each_group_gives_its_disk_back(spark):
    """When the stage's result is read, no texts, shingles or signatures of its search are left in the shared folder."""
    import random

    from texelmill.session import checkpoint_folder

    folder = Path(checkpoint_folder(spark).removeprefix("file:")) / "texelmill"
    tables = lambda: set(folder.iterdir()) if folder.exists() else set()
    rng, before = random.Random(6), tables()
    texts = [prose(rng, 60, 10**6) for _ in range(6)]
    texts += [" ".join([*words(t)[:-1], "changed"]) for t in texts[:3]]
    docs = spark.createDataFrame([(i, t, "en", "a", None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.one_of_each_group(spark, docs, FOLDER)
    left = {c for path in tables() - before for c in spark.read.parquet(str(path)).columns}
    assert left and not left & {"text", "shingles", "signature", "signatures"}
    assert sorted(r.doc_id for r in out.collect()) == list(range(6))


def test_the_rest_stands_alone(tmp_path):
    """Without the package and the pipeline, the entry still imports and keeps the other queries."""
    import shutil

    root = Path(corpus_pipeline.__file__).parent
    shutil.copytree(root / "texelmill", tmp_path / "texelmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
