"""The pipeline against brute force, stage by stage, each on what the stage before kept."""

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_texts import brute_classes, edited, prose, table


def removed(rows, length=100):
    """Texts without bytes that a string of ``length`` bytes covers which starts earlier too."""
    seen, out = set(), {}
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            gram = raw[i : i + length]
            if gram in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(gram)
        left = bytes(c for c, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
        if not any(gone):
            out[doc_id] = text
        elif left:
            out[doc_id] = left
    return out


def test_stages_and_run_equal_brute_force(spark, tmp_path):
    test_items = [prose(n, 9000 + n) for n in (24, 40)]
    shared = prose(60, 4242)
    texts = [prose(120, i, 30) for i in range(50)]
    texts += [" ".join(w + "$$$" for w in prose(120, i, 30).split()) for i in range(20)]
    texts += [edited(texts[i], 2, i) for i in range(5)] + [texts[7], texts[7], None, ""]
    texts += [prose(80, 500 + i) + " " + shared + " é" * 30 for i in range(3)] + [prose(150, 600) + " " + t for t in test_items]
    folder = str(tmp_path)
    table(spark, texts).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 50), 0) for i in range(70)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(test_items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "minhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "bpe_encoding"]

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k < 4:
            assert docs.columns == columns, name
            kept.append({r.doc_id: r.text for r in docs.collect()})
    quality, near, repeats, clean = kept
    # the junk goes and nothing else does
    assert not any(50 <= i < 70 for i in quality) and len(quality) >= len(texts) - 20 - 2
    assert all(quality[i] == texts[i] for i in quality)
    order = sorted(quality)
    classes = brute_classes([quality[i] for i in order])
    assert near == {i: quality[i] for k, i in enumerate(order) if classes[k] == k}
    assert repeats == removed(sorted(near.items()))
    leak = [" ".join(t.lower().split()) for t in test_items]
    assert clean == {i: t for i, t in repeats.items() if not any(x in " ".join((t or "").lower().split()) for x in leak)}
    assert len(repeats) - len(clean) == 2
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    expected = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in clean.items()}
    assert {r.doc_id: r.token_ids for r in docs.collect()} == expected
    assert {r.doc_id: r.token_ids for r in corpus_pipeline.run(spark, folder).collect()} == expected
    assert docs.where(F.size("token_ids") != F.col("n_tokens")).count() == 0
    assert docs.agg(F.sum("n_tokens")).first()[0] == sum(map(len, expected.values()))


def test_pipeline_of_an_empty_table(spark, tmp_path):
    folder = str(tmp_path)
    table(spark, []).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
