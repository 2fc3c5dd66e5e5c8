import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import queries
from graphloom.llm.tokenize import DEFAULT_VOCABULARY, PATTERN, TrieEncoder, encode

ENCODER = TrieEncoder.load(DEFAULT_VOCABULARY)
PUBLIC = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ENCODER.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.binary(min_size=1, max_size=60) | st.text(alphabet="aeinrst -=_0é日本\n", min_size=1, max_size=60).map(str.encode))
def test_words_equal_the_public_encoder(word):
    assert ENCODER.encode_words([word])[word] == PUBLIC._core_bpe.encode_single_piece(word)


def test_shared_prefixes_do_not_disturb_each_other():
    words = [w.encode() for w in ("in", "inter", "interest", "interested", "internal", "i", "", "international")]
    got = ENCODER.encode_words(words)
    assert all(got[w] == (PUBLIC._core_bpe.encode_single_piece(w) if w else []) for w in words)


def test_whole_table(spark, small):
    got = {r["doc_id"]: list(r["ids"]) for r in queries.p6_ids(spark, small).collect()}
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert got == {r["doc_id"]: PUBLIC.encode_ordinary(r["text"]) if r["text"] else [] for r in rows}


def test_unusual_texts(spark):
    texts = [None, "", " ", "\n\n  x", "<|endoftext|>", "a" * 20_000, "日本語" * 3000, "é​👩‍👧", "a" * 50, "a" * 50]
    df = spark.createDataFrame([(i if i else None, t, "x", []) for i, t in enumerate(texts)], "doc_id bigint, text string, ids string, id array<int>")
    got = [list(r["ids"]) for r in encode(df).collect()]
    assert sorted(got) == sorted(PUBLIC.encode_ordinary(t) if t else [] for t in texts)
    assert encode(df.limit(0)).count() == 0
