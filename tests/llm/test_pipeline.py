"""The pipeline, stage by stage, against brute force on the small tables."""

import numpy as np

import corpus_pipeline as pipeline
from doorflux.llm import decontaminate, secret_scan
from doorflux.llm.common import table
from doorflux.llm.queries import QUERIES
from tests.llm.test_documents import check_packing, plain_components, plain_fingerprint


def test_stages(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    held = []
    for name, stage in pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        held.append((before, docs.collect()))
    assert [set(r.doc_id for r in held[k][1]) for k in range(4)] == [set(r.doc_id for r in held[k + 1][0]) for k in range(4)]
    assert all(after[0].__fields__ == list(pipeline.COLUMNS) for _, after in held[:4])

    before, after = held[0]
    rejected = {r.doc_id for r in QUERIES["op8_toxicity"](spark, sf_dir).collect() if r.predicted}
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == rejected

    before, after = held[1]
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in sorted(before)]
    assert sorted(r.doc_id for r in after) == sorted(set(plain_components(prints)))

    before, after = held[2]
    items = [b" " + b" ".join(decontaminate.words_of(r.text)) + b" " for r in table(spark, sf_dir, "benchmark").collect()]
    leaking = {r.doc_id for r in before if any(i in b" " + b" ".join(decontaminate.words_of(r.text)) + b" " for i in items)}
    assert leaking == {r.doc_id for r in before} - {r.doc_id for r in after}

    before, after = held[3]
    assert sorted(r.doc_id for r in before) == sorted(r.doc_id for r in after)
    spans = {r.doc_id: r.found for r in secret_scan.scan(spark.createDataFrame(before)).collect()}
    texts = {r.doc_id: r.text for r in before}
    for r in after:
        text = texts[r.doc_id]
        for s in reversed(spans[r.doc_id]):
            if not any(o.start <= s.start < o.stop and o != s for o in spans[r.doc_id] if o.start < s.start):
                end = max(o.stop for o in spans[r.doc_id] if o.start < s.stop and o.stop > s.start)
                text = text[:s.start] + "[SECRET]" + text[end:]
        assert (r.text, r.n_chars) == (text, len(text))

    before, after = held[4]
    assert check_packing(after, {r.doc_id: r.text for r in before}) < 0.05


def test_run_and_empty_input(spark, sf_dir):
    assert pipeline.run(spark, sf_dir).count() > 0
    docs = table(spark, sf_dir, "documents").where("false")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_benchmark_stage_is_fitted_on_all_documents(spark, tmp_path):
    """Each subject is in one long text; of a space fitted on two million words some are missing, and so are their paraphrases."""
    asked = [[f"s{k}w{n}" for n in range(40)] for k in range(30)]
    texts = []
    for item in asked:
        passage = list(item)
        passage[2:30:2] = ["other"] * 14  # 26 of 40 words are left, the last ones among them
        texts.append(passage + [item[0], item[0], item[1], "none"] * 30_000)
    texts += [[asked[0][0], asked[0][0], asked[0][1], "none"] * 50, *([f"m{k}"] * 40 for k in range(100))]
    rows = [(k, " ".join(t), "en", "made", len(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    items = [(k, " ".join(t)) for k, t in enumerate([*asked, [f"m{k}" for k in range(100)]])]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = pipeline.without_benchmark(spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in kept) == list(range(30, 131))


def test_toxicity_stage_learns_from_all_labelled_rows(spark, tmp_path):
    """Each subject has 18 rows, about 9 to count: enough for a feature, but too few in a sample of 10,000 rows of a label."""
    rng = np.random.default_rng(30)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    subjects = ["".join(x) for x in rng.choice(letters, (5000, 12))]
    common = ["".join(x) for x in rng.choice(letters, (300, 3))]
    rows = [(k, f"{common[rng.integers(300)]} {subjects[k % 5000]} {common[rng.integers(300)]}") for k in range(90_000)]
    docs = spark.createDataFrame([(k, t, "en", "made", len(t)) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = np.array([r.doc_id for r in pipeline.without_toxic(spark, docs, str(tmp_path)).select("doc_id").collect()])
    assert np.sum(kept % 2) < 0.05 * 45_000 and np.sum(kept % 2 == 0) > 0.95 * 45_000
