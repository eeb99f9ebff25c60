"""The pipeline's stages against brute force, one after the other."""

import importlib
import os
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spoofscope.llm import quality
from test_decontaminate import brute as leaks
from test_decontaminate import words as bench_words
from test_packing import check as check_pieces
from test_quality import brute as base_counts
from test_simhash import brute_components, brute_print

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def stages(spark):
    """What comes out of every stage, the input first."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.staged(stage(spark, out[-1], SF)))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_quality_rules_keep_clean_documents(spark, stages):
    before, after = rows(stages[0]), rows(stages[1])
    counts = {i: base_counts(r.text) for i, r in before.items()}
    failed = {i for i, c in counts.items() if c[0] < 10 or 100 * c[4] > 20 * c[0]}
    assert not failed & set(after) and set(after) <= set(before)
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()} - failed
    assert len(clean - set(after)) <= quality.ALPHA * len(clean)
    assert all(after[i] == before[i] for i in after)


def test_line_dedup(stages):
    before, after = rows(stages[1]), rows(stages[2])
    seen, want = set(), {}
    for i in sorted(before):
        every = (before[i].text or "").split("\n")
        full = [k for k, x in enumerate(every) if re.search(r"[^\x20\x09-\x0D]", x)]
        gone = set()
        for k in range(len(full) - 2):
            w = tuple(every[x] for x in full[k:k + 3])
            if w in seen:
                gone |= set(full[k:k + 3])
            seen.add(w)
        want[i] = "\n".join(x for k, x in enumerate(every) if k not in gone)
    assert {i: r.text for i, r in after.items()} == want
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_one_document_of_each_group_stays(stages):
    before, after = rows(stages[2]), rows(stages[3])
    prints = {i: brute_print(r.text) for i, r in before.items()}
    groups = brute_components(set(prints.values()), 4)
    low = {}
    for i, p in prints.items():
        low[groups[p]] = min(low.get(groups[p], i), i)
    assert set(after) == set(low.values()) and all(after[i] == before[i] for i in after)


def test_benchmark_passages_go(spark, stages):
    before, after = rows(stages[3]), rows(stages[4])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(after) == set(before)
    for i, r in before.items():
        _, covered, _ = leaks(r.text, items, 10)
        assert bench_words(after[i].text) == [w for k, w in enumerate(bench_words(r.text)) if k not in covered]
        if not covered:
            assert after[i] == r


def test_packing(stages):
    check_pieces(stages[5], [(i, r.text) for i, r in rows(stages[4]).items()], 2048)


def test_all_but_the_last_return_the_columns_of_documents(stages):
    assert all(s.columns == stages[0].columns and s.dtypes == stages[0].dtypes for s in stages[1:5])


def test_run_equals_its_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, stages[5].select(key).collect()))


def test_nulls_repeats_extra_columns_and_empty_tables(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, rid int, covered string, items string"
    text = " ".join(f"w{i}" for i in range(30))
    odd = [(None, text, None, None, None, 1, "c", "x"), (1, text, "en", None, None, 1, None, "x"), (1, text, "en", "s", 5, 2, None, "x"),
           (2, None, "en", "s", 0, 3, "c", None), (3, "", None, "s", 0, 3, "c", None), (4, " ".join(f"v{i}" for i in range(60_000)), "en", "s", 1, 4, "c", "i")]
    for given in (odd, []):
        docs = spark.createDataFrame(given, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.staged(stage(spark, docs, SF))
            assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
        left = docs.select("doc_id").collect()
        assert sorted(r.doc_id for r in left) == ([1, 4] if given else [])
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()


def test_the_entry_works_without_the_corpus_folders(tmp_path):
    """A copy of the repository without the two folders (the pipeline's file
    stays) imports, keeps the other queries and runs one."""
    import shutil

    for name in ("spoofscope", "__spark_entry__.py", "corpus_pipeline.py"):
        src = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / name, **({"ignore": shutil.ignore_patterns("llm", "__pycache__")} if os.path.isdir(src) else {}))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'window_features' in q and not [k for k in q if k.startswith('op') or k == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    code += f"\nfrom spoofscope.session import get_session; assert q['corpus_counts'](get_session('local[2]', 2), {SF!r}).count()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)


def test_every_operator_is_registered():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
    assert {n for n in entry.oracle_sql() if n.startswith("op")} == {"op4_quality_rules", "op5_license_scan", "op8_line_dedup", "op12_prefix_trie", "op13_hard_negatives"}
