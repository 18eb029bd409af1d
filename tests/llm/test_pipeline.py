"""The whole run against a plain version of its stages."""

import collections
import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from residua.llm import pii, toxicity
from tests.llm.conftest import odd_rows, prose
from tests.llm.test_operators import plain_components, plain_lines


def corpus():
    bad, rows = ["idiot", "moron", "scum", "trash"], []
    for i in range(160):
        words = prose(i // 2 * 2 + 300, 50 + i % 30).split()
        if i % 5 == 0:
            words[i % 30], words[10 + i % 20], words[31] = bad[i % 4], bad[(i + 1) % 4], bad[(i + 2) % 4]
        if i % 9 == 0:
            words[5] = f"who{i}.99@mail{i % 4}.example.com"
        if i % 7 == 0:
            words[8] = "\n" + prose(999, 12) + "\n"
        rows.append((1000 + i, " ".join(words), "en", "s", 1, int(i % 5 == 0)))
    odd = [(i, t, lang, s, n, None) for i, t, lang, s, n, *_ in odd_rows() if i not in (9, None)]
    return rows + odd


def test_pipeline_equals_plain_stages(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumn("score", docs.n_chars).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows if r[5] is not None], "doc_id long, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))

    network = toxicity.fit(docs, labels)
    words = [toxicity.words_of(r[1]) for r in rows]
    found = toxicity.logits(network.word_table(), network, words) - network.thresholds[[toxicity.language_of(w) for w in words]]
    clean = [(r[0], r[1]) for r, z in zip(rows, found) if z < 0]
    assert np.mean([(z >= 0) == bool(r[5]) for r, z in zip(rows, found) if r[5] is not None]) > 0.85

    gone = {p[:2] for p in plain_lines(clean)}
    cut = [(i, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)) for i, t in clean]
    kept = {i for i, _, _, keep in plain_components(cut, 5) if keep}
    keyed = pii._keyed(corpus_pipeline.PII_KEY, 0)
    final = {i: pii.replaced(t, keyed)[0] for i, t in cut if i in kept}
    assert not any(re.search(r"who\d+\.99@", t or "") for t in final.values()) and len(final) < len(clean)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    lengths = collections.Counter({i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in final.items()})
    assert pieces.groupby("doc_id").length.sum().to_dict() == dict(lengths)
    assert np.all(pieces.groupby("sequence_id").length.sum() <= 4096)


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra int, score double"
    docs = spark.createDataFrame([], schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.COLUMNS and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0
