from __future__ import annotations

import base64
import hashlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from rubato.llm import byte_bpe, common, mixing, quality_classifier, quality_rules

from .test_mixing import brute_targets
from .test_near_copies import brute_groups


def test_pipeline_equals_its_parts(spark, small_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    fine = {r.doc_id for r in quality_rules.op6_quality_rules(spark, small_dir).where("kept").collect()}
    fine &= {r.doc_id for r in quality_classifier.op9_quality_classifier(spark, small_dir).where("predicted = 1").collect()}
    left = set(brute_groups({d: docs[d].text for d in fine}).values())
    kept = spark.createDataFrame([docs[d] for d in sorted(left)], spark.read.parquet(f"{small_dir}/documents.parquet").schema)
    times = {r.doc_id: r.repeats for r in mixing.mix_documents(kept).collect()}
    sizes, taken, most = defaultdict(int), defaultdict(int), 0
    for d in left:
        n = len(docs[d].text.split())
        sizes[docs[d].source] += n
        taken[docs[d].source] += n * times[d]
        most = max(most, n)
    targets = brute_targets(sizes)
    assert all(abs(taken[s] - targets[s]) <= most for s in sizes)

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(byte_bpe.VOCABULARY), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = corpus_pipeline.run(spark, small_dir).collect()
    assert Counter(r.doc_id for r in rows) == Counter({d: n for d, n in times.items() if n})
    for r in rows:
        text = docs[r.doc_id].text
        assert r.ids == library.encode_ordinary(text)
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_stages_keep_the_columns(spark, small_dir, awkward, no_rows):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, awkward, small_dir).columns == awkward.columns
        assert stage(spark, no_rows, small_dir).count() == 0


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 and toxic = 0").select("doc_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        kept = stage(spark, docs, sf)
        assert kept.join(good, "doc_id").count() >= 0.95 * docs.join(good, "doc_id").count()


def test_texts_go_to_python_once_and_come_back_in_slices(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:2]:
        plan = stage(spark, docs, small_dir)._jdf.queryExecution().optimizedPlan().toString()
        sent = [line for line in plan.splitlines() if "MapInArrow" in line]
        assert sent and all("text#" not in line for line in sent), name
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000))], ["i"])
    parts = list(common.sent_back(batch))
    assert [p.num_rows for p in parts] == [256, 256, 256, 232] and pa.concat_arrays([p["i"] for p in parts]).equals(batch["i"])
