"""What a Python worker holds stays bounded."""

import numpy as np
import public_tokenizers

from spendlens.llm import queries, token_store, tokens


def test_encoder_memory_is_shared(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 60)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        encode = tokens.Encoder(open(path).read())
        plain = tokens.Tokenizer.from_file(path)
        for k in range(300):
            text = f"ab{k} word{k}, cd{k}x (ef{k}) gh{k}"
            assert np.frombuffer(encode(text), encode.dtype).tolist() == plain.encode(text, add_special_tokens=False).ids
            # a word being encoded may add its own parts meanwhile
            assert sum(len(w) + len(w.old) for w in (encode.lone, encode.first, encode.later)) <= 70


def test_texts_are_written_in_one_pass(spark, tmp_path, monkeypatch):
    rows = [(k, f"some text {k}, and {k * k} more") for k in range(700)] + [(5, "again"), (6, None), (None, "no id"), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    path = public_tokenizers.path("word_bpe_49k.json")
    token_store.write_ids(token_store.encode_texts(docs, path, 2), f"{tmp_path}/two")
    two = sorted(map(str, token_store.read_ids(spark, f"{tmp_path}/two").collect()))
    steps, real = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, *a, **b: steps.append(a) or real(self, *a, **b))
    one = sorted(map(str, queries.op7_token_store(spark, str(tmp_path)).collect()))
    assert one == two and len(one) == len(rows)
    assert len(steps) == 2  # one writes, one reads
