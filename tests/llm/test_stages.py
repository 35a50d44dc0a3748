"""Each stage of the pipeline on the whole smallest table, against a plain version of its rule."""

import os
import subprocess
import sys
from itertools import combinations
from pathlib import Path

from test_pairs import roots, slow_lines
from test_pii_bootstrap import slow_spans
from test_tokens_and_packing import check_pieces, ids_of

import corpus_pipeline
from inkmill.llm import common, kneser_ney, near_copies, packing

STAGE = dict(corpus_pipeline.STAGES)


def _run(spark, sf_dir, name):
    docs = common.table(spark, sf_dir, "documents")
    return common.written(STAGE[name](spark, docs, sf_dir), f"{common.workspace(spark)}/{name}").collect()


def test_quality(spark, sf_dir, texts):
    """The stage keeps what the operator's verdicts keep (held against a plain version in test_kneser_ney), and nothing else."""
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    kept = {r.i for r in kneser_ney.verdicts(docs, labels, common.workspace(spark)).where("kept").collect()}
    assert {r.doc_id: r.text for r in _run(spark, sf_dir, "quality")} == {k: texts[k] for k in kept} and kept < set(texts)


def test_lines(spark, sf_dir, texts):
    removed, _ = slow_lines(sorted(texts.items()))
    gone = {}
    for k, n in removed:
        gone.setdefault(k, set()).add(n)
    want = {k: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(k, ())) for k, t in texts.items()}
    assert removed and {r.doc_id: r.text for r in _run(spark, sf_dir, "lines")} == want


def test_near_duplicates(spark, sf_dir, texts):
    """Five-word shingles, Jaccard 0.8 or more, by comparing all pairs."""
    sets = {k: set(near_copies.shingles(t).tolist()) for k, t in texts.items()}
    root = roots(texts, [(a, b) for a, b in combinations(sorted(texts), 2) if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))])
    assert {r.doc_id: r.text for r in _run(spark, sf_dir, "near-duplicates")} == {k: texts[k] for k, v in root.items() if k == v}


def test_personal_data(spark, sf_dir, texts):
    def redacted(text, spans):
        out, at = [], 0
        for kind, a, b in (x.split(":") for x in spans.split(",") if x):
            if int(a) >= at:
                out += [text[at : int(a)], f"[{kind.upper()}]"]
            at = max(at, int(b))
        return "".join(out) + text[at:]

    want = slow_spans(texts)
    got = {r.doc_id: r for r in _run(spark, sf_dir, "personal-data")}
    assert {k: r.text for k, r in got.items()} == {k: redacted(t, want[k]) for k, t in texts.items()}
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_packing(spark, sf_dir, texts):
    fills = check_pieces(_run(spark, sf_dir, "packing"), {k: ids_of(t, 2) for k, t in texts.items()}, 4096)
    assert sum(f < 4096 for f in fills) <= 1


ODD = "doc_id long, text string, lang string, source string, n_chars long, `a b` string, `a.b` string, row string, k long"


def test_stages_of_an_empty_table_and_of_odd_names(spark, sf_dir, tmp_path):
    rows = [(k, f"Some words of text number {k} that nobody else has, mail a{k}@example.com today.", "en", "s", 1, "x", "y", "z", k) for k in range(6)] + [(None, None, None, None, None, None, None, None, None)]
    spark.createDataFrame(rows, ODD).write.parquet(f"{tmp_path}/odd")
    spark.createDataFrame([], ODD).write.parquet(f"{tmp_path}/none")
    for name, stage in corpus_pipeline.STAGES:
        odd, none = (common.written(stage(spark, spark.read.parquet(f"{tmp_path}/{x}"), sf_dir), f"{tmp_path}/{name}-{x}") for x in ("odd", "none"))
        assert none.count() == 0 and odd.count() > 0, name
        if name != "packing":
            assert odd.columns == none.columns == [f.name for f in spark.createDataFrame([], ODD).schema], name
            assert odd.where("`a.b` = 'y' AND `a b` = 'x' AND row = 'z'").count() == odd.where("doc_id IS NOT NULL").count(), name


def test_a_run_leaves_other_frames_alone(spark, sf_dir):
    """A frame of another query, made before the pipeline, can be read after it."""
    other = packing.op4_packing(spark, sf_dir)
    assert corpus_pipeline.run(spark, sf_dir).count() > 0 and other.count() > 0


def test_operators_in_a_fresh_session_without_the_package_on_the_path(tmp_path):
    """An operator runs first in a session of its own: Python workers, where it has them, get the package from it."""
    program = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', 2).config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', sys.argv[3]).getOrCreate()\n"
        "import inkmill.llm.queries as q\n"
        "frames = {n: f(spark, '/root/testdata/sf0.001') for n, f in q.queries().items() if n.startswith(sys.argv[2])}\n"
        "assert frames and all(df.count() >= 200 for df in frames.values())\n"
    )
    root = str(Path(corpus_pipeline.__file__).resolve().parent)
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for op in ("op4_", "op9_"):
        subprocess.run([sys.executable, "-c", program, root, op, str(tmp_path / op)], check=True, env=clean, cwd=str(tmp_path), timeout=300)
