from __future__ import annotations

import corpus_pipeline
from meridian.llm import decontaminate, packing, quality, secret_scan, simhash

from test_brute import plain_leaks


def plain_near(texts, similarity=0.8):
    """Components of texts by exact Jaccard similarity of their sets of five-word shingles, all pairs that share one."""
    sets = {k: simhash.shingles(t) for k, t in texts.items()}
    by: dict = {}
    for k, s in sets.items():
        for x in s or {None}:
            by.setdefault(x, []).append(k)
    up = {k: k for k in sets}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    met = {(a, b) for ks in by.values() if len(ks) > 1 for i, a in enumerate(ks) for b in ks[:i]}
    close = [(a, b) for a, b in met if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    for a, b in close:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {k: top(k) for k in sets}, close


def test_run_against_plain_stages(spark):
    """run() on a small table: near copies by exact similarity, leaks by loops, secrets by expressions, pieces by the tokenizer."""
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r.doc_id for r in quality.classify(docs, quality.grades(spark.read.parquet(f"{sf}/labels.parquet"))).where("kept").collect()}
    t = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id in good}
    component, _ = plain_near(t)
    marks = lambda d: {r[0]: r[1].split(" ") for r in d.select(d.columns[0], decontaminate.marked(d["text"])).collect() if r[1]}
    leaked = {k for k, _ in plain_leaks({k: w for k, w in marks(docs).items() if k in good}, marks(spark.read.parquet(f"{sf}/benchmark.parquet")))}
    want = {k for k in t if component[k] == k} - leaked
    rows = corpus_pipeline.run(spark, sf).collect()
    tok = Tokenizer.from_file(packing.tokenizer_path())
    left = {r.doc_id: r.text or "" for r in secret_scan.redacted(docs.where(docs.doc_id.isin(list(want)))).collect()}
    assert {r.doc_id for r in rows} == want
    size: dict = {}
    for r in rows:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.length
    assert size == {k: len(tok.encode(x, add_special_tokens=False).ids) + 1 for k, x in left.items()}


def test_stages_against_their_definitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = docs
    kept, seen = [], {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, sf_dir)
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out = spark.createDataFrame(out.toPandas(), out.schema)
        seen[name] = out
        kept.append((name, {r[0] for r in out.select("doc_id").distinct().collect()}))
    rows = dict(kept)
    good = {r.doc_id for r in quality.classify(docs, quality.grades(spark.read.parquet(f"{sf_dir}/labels.parquet"))).where("kept").collect()}
    assert rows["quality"] == good
    component, close = plain_near({r.doc_id: r.text for r in seen["quality"].collect()})
    gone = good - rows["near_dedup"]
    assert gone <= {k for k in good if component[k] != k}
    assert len(gone) >= 0.95 * sum(component[k] != k for k in good) and close
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaked = {r.doc_id for r in decontaminate.leaks(docs, bench).collect()}
    assert rows["decontaminate"] == rows["near_dedup"] - leaked
    assert rows["secrets"] == rows["decontaminate"] == rows["packing"]


def test_secrets_leave_the_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = secret_scan.redacted(docs)
    assert out.count() == docs.count()
    left = secret_scan.report(out)
    assert left.agg({"n_live": "sum"}).first()[0] == 0
    assert packing.tokenizer_path()
