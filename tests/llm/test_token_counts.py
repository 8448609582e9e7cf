from tokenizers import Tokenizer

from siftline.llm.token_counts import count_tokens, op3_token_counts, tokenizer_path

HARD = [None, "", "   ", "Hello, WORLD!!", "a<|endoftext|>b <|startoftext|> <| endoftext |>", "it's 'sam ''s don't x y", "İstanbul ΣΣ é é", "x" * 30_000, "\U0001f600\U0001f600 ok\x1c\x1dz\x85q", "12345 6,7", "a\tb\n\nc\x0bd"]


def test_equals_library(spark):
    rows = [(i, t, "extra") for i, t in enumerate(HARD)] + [(3, "Hello, WORLD!!", "extra"), (None, "z z", "extra")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    t = Tokenizer.from_file(tokenizer_path())
    want = sorted((str(i), len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False)), n > 2048) for i, x, _ in rows)
    assert sorted((str(r[0]), *r[1:]) for r in count_tokens(docs).collect()) == want


def test_empty(spark):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_whole_table_equals_library(spark):
    sf = "/root/testdata/sf0.001"
    t = Tokenizer.from_file(tokenizer_path())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op3_token_counts(spark, sf).collect():
        assert r.n_tokens == len(t.encode(texts[r.doc_id], add_special_tokens=False))
