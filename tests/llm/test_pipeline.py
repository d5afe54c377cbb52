import collections
import os
import subprocess
import sys

import corpus_pipeline as pipeline
from tests.llm import rows
from tests.llm.test_near_duplicates import shingles, smallest
from tests.llm.test_packing import TOKENIZER
from tests.llm.test_spans import SECRET, plain_secrets


def by_name(name):
    return dict(pipeline.STAGES)[name]


def test_stages_on_cases(spark, folder):
    frame = rows.documents(spark, SECRET)
    docs = frame
    for name, stage in pipeline.STAGES:
        assert stage(spark, rows.empty(spark), folder).collect() == []
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.dtypes == rows.empty(spark).dtypes
            docs = spark.createDataFrame(out.collect(), rows.DOCUMENTS)


def test_language_keeps_clean_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert by_name("language")(spark, docs, folder).count() == docs.count()
    kept = collections.Counter(r.doc_id for r in by_name("language")(spark, rows.documents(spark), folder).collect())
    assert not {6, 7, 8, 10} & set(kept) and {1, 2, 3, 4, 5, 11, 13} <= set(kept)


def test_near_copies_against_brute_force(spark, folder):
    docs = rows.documents(spark)
    given = [(r.doc_id, shingles(r.text, 5)) for r in docs.collect()]
    links = [(a, b) for k, (a, x) in enumerate(given) for b, y in given[:k]
             if None not in (a, b) and x and 100 * len(x & y) >= 80 * len(x | y)]
    label = smallest({i for i, _ in given if i is not None}, links)
    got = collections.Counter(r.doc_id for r in by_name("near_copies")(spark, docs, folder).collect())
    assert got == collections.Counter([*set(label.values()), None, None])


def test_secrets_are_gone(spark, folder):
    frame = rows.documents(spark, SECRET)
    got = by_name("secrets")(spark, frame, folder).collect()
    assert len(got) == frame.count() and all(not plain_secrets(r.text or "") for r in got)
    clean = {r.doc_id: r.text for r in got}
    assert clean[1] == rows.PROSE and clean[6] is None
    assert "[SECRET]" in clean[201] and all(r.n_chars == len(r.text) for r in got if r.text and "[SECRET]" in r.text)


def test_run(spark, folder):
    got = pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(*pipeline.COLUMNS)
    for name, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), rows.DOCUMENTS)
    lengths = collections.Counter()
    for r in docs.collect():
        lengths[r.doc_id] += len(TOKENIZER.encode(r.text or "", add_special_tokens=False).ids) + 1
    tokens = collections.Counter()
    for r in got:
        tokens[r.doc_id] += r.length
    assert tokens == lengths


def test_library_without_llm(tmp_path):
    """The rest imports and lists its queries when the folder and the pipeline are gone."""
    root = os.path.dirname(os.path.abspath(pipeline.__file__))
    for name in os.listdir(root):
        if name not in ("trackloom", "corpus_pipeline.py", ".git"):
            os.symlink(f"{root}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "trackloom")
    for name in os.listdir(f"{root}/trackloom"):
        if name != "llm":
            os.symlink(f"{root}/trackloom/{name}", tmp_path / "trackloom" / name)
    os.remove(tmp_path / "__spark_entry__.py")
    with open(f"{root}/__spark_entry__.py") as source, open(tmp_path / "__spark_entry__.py", "w") as copy:
        copy.write(source.read())
    code = "import __spark_entry__ as e; n = e.queries(); assert 'pipeline' not in n and len(n) > 200; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
