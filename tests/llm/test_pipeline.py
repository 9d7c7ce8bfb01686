"""Every stage of the pipeline against the plain version of what it decides."""

import shutil
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import hard
import test_contamination
import test_secrets
import test_simhash
from conftest import FOLDER

import __spark_entry__ as entry
from plumbline.llm import contamination, language


def test_stages_in_turn(spark, tmp_path):
    shutil.copy(f"{FOLDER}/benchmark.parquet", tmp_path / "benchmark.parquet")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        after = stage(spark, docs, FOLDER)
        kept = {r.doc_id: r for r in after.collect()}
        assert len(kept) == after.count()
        if name == "language ID":
            unclear = [i for i, r in before.items() if not any(language.letter_runs(w) for w in language.raw_words(r.text))]
            assert set(before) - set(kept) == set(unclear)
        elif name == "SimHash near-dedup":
            rows = [(i, test_simhash.plain_print(r.text)) for i, r in before.items()]
            groups = test_simhash.plain_components(rows)
            assert set(kept) == {i for (i, _), c in zip(rows, groups, strict=True) if i == c}
        elif name == "benchmark decontamination":
            items = [contamination.normal_words(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
            words = {i: contamination.normal_words(r.text) for i, r in before.items() if len(r.text) < 8000}
            held = {
                i for i, w in words.items() if any(test_contamination.plain_distance(x, w) <= len(x) // 5 for x in items if set(x) & set(w))
            } if len(words) < 30 else None
            exact = {i for i, w in words.items() if any(b" ".join(x) in b" ".join(w) for x in items)}
            assert exact and not exact & set(kept) and (held is None or held == set(before) - set(kept))
        elif name == "secret scans":
            assert set(kept) == set(before)
            for i, r in kept.items():
                masked = list(before[i].text)
                for start, _, _, end in test_secrets.plain(before[i].text):
                    masked[start:end] = "*" * (end - start)
                assert r.text == "".join(masked)
        else:
            assert set(kept) == set(before) and all(r.restored for r in kept.values())
            break
        assert after.columns == columns
        folder = str(tmp_path / f"after-{len(kept)}-{name.split()[0]}")
        after.write.parquet(folder)
        docs = spark.read.parquet(folder)
    rows = entry.queries()["pipeline"](spark, FOLDER)
    assert {r.doc_id for r in rows.collect()} == set(kept)


def test_stages_on_hard_and_empty_tables(spark):
    docs = hard.documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, FOLDER)
        assert after.schema.simpleString() == docs.schema.simpleString() and 0 < after.count() <= docs.count()
        assert stage(spark, hard.none(spark), FOLDER).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, FOLDER).count() == docs.count() and last(spark, hard.none(spark), FOLDER).count() == 0


def test_the_rest_does_without_this_subpackage(tmp_path):
    root = Path(entry.__file__).parent
    target = tmp_path / "repo"
    shutil.copytree(root, target, ignore=lambda folder, names: [n for n in names if n in (".git", "llm", "__pycache__", "corpus_pipeline.py")])
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') and n[2].isdigit() for n in e.queries()))"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=target, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    number, some = said.stdout.split()
    assert int(number) >= 57 and some == "False"
