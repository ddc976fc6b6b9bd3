"""The whole corpus pipeline, each stage against what it promises."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, text_key string, node long, size int, score double"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    say = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**5)}" for _ in range(n))
    texts = [say(rng.randrange(5, 120)) for _ in range(60)]
    texts += [f"{say(20)} vileword awfulword {say(10)}" for _ in range(20)]
    near = texts[3].split() + say(80).split()
    texts += [texts[0], texts[0], " ".join(near), " ".join([*near[:-1], "other"]), f"{say(12)} write to Ann.Lee@mail.example.com {say(5)}", "", None, say(20_000)]
    rows = [(i, t, "en", "abc"[i % 3] if i % 7 else None, None if t is None else len(t), "k", "t", 1, 2, 0.5) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(60 <= i < 80)) for i in range(len(rows))], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, {r[0]: r[1] for r in rows}


def test_stages(spark, folder, tmp_path):
    path, texts = folder
    docs = corpus_pipeline.table(spark, path, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, path).write.parquet(str(tmp_path / name))
        docs = seen[name] = spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or docs.columns == before.columns
    kept = {r.doc_id: r.text for r in seen["toxicity"].collect()}
    assert set(range(60)) | set(range(80, 88)) <= set(kept) and len(set(range(60, 80)) & set(kept)) <= 2 and all(texts[i] == t for i, t in kept.items())
    single = {r.doc_id for r in seen["near_duplicates"].collect()}
    assert set(kept) - single == {80, 81, 83}
    hidden = {r.doc_id: r.text for r in seen["pii"].collect()}
    assert set(hidden) == single and "Ann.Lee" not in hidden[84] and all(hidden[i] == texts[i] for i in single - {84})
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in seen["pii"].collect())
    mixed = [(r.doc_id, r.text, r.source) for r in seen["mixing"].collect()]
    assert mixed and all(t == hidden[i] or hidden[i].split()[: len(t.split())] == t.split() for i, t, _ in mixed)
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    lengths = {}
    for r in seen["packing"].collect():
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    wanted = {}
    for i, t, _ in mixed:
        wanted[i] = wanted.get(i, 0) + len(encode(t, add_special_tokens=False).ids) + 1
    assert lengths == wanted


def test_empty_tables(spark, folder, tmp_path):
    path, _ = folder
    for name in ("documents", "labels"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
