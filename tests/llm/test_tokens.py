import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pointspark.llm import packing, tokenize

PIECES = st.lists(st.sampled_from(["a", "'", "l", "ll", "'ve", " ", "  ", "\n", "\r\n", "é", "日本", "😀", "1", "2!", "<|endoftext|>", "the", "aaaa", "ſ", "-", "x" * 40]), max_size=40).map("".join)


@settings(max_examples=150, deadline=None)
@given(PIECES, st.integers(1, 60))
def test_tree_of_joins_equals_the_whole(text, width):
    bpe = tokenize.load()
    if text:
        assert tokenize.concatenate(bpe, [tokenize.Encoded.of(bpe, text[i : i + width]) for i in range(0, len(text), width)]).ids() == bpe.encode(text)


def test_unsplit_runs():
    bpe, r = tokenize.load(), random.Random(1)
    for n in (1000, 5000):
        text = "".join(r.choice("abcdeion") for _ in range(n))
        assert tokenize.concatenate(bpe, [tokenize.Encoded.of(bpe, text[i : i + 333]) for i in range(0, n, 333)]).ids() == bpe.encode(text)


def test_corpus_with_nulls_and_long_texts(spark):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    other.encode_special_tokens = True
    texts = [None, "", "  ", "It's <|endoftext|> 3 l’été\r\n", "word " * 7000, "z" * 20_000, "日本" * 6000, "same", "same"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in tokenize.encode_corpus(docs).collect()}
    assert got == {i: other.encode(t, add_special_tokens=False).ids if t else [] for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["n"] for r in tokenize.count_tokens(docs).collect()} == {k: len(v) for k, v in got.items()}
    assert tokenize.encode_corpus(docs.limit(0)).count() == 0


def _pack(spark, sizes, **options):
    df = spark.createDataFrame([(i, n, i % 3 > 0) for i, n in enumerate(sizes)], "doc_id long, n long, bears boolean")
    return packing.pack(df, "doc_id", F.col("n"), F.col("bears"), len(sizes), **options).toPandas()


@pytest.mark.parametrize("limits", [{}, {"max_segments": 5}, {"max_loss": 900}])
def test_everything_is_placed_within_all_limits(spark, limits):
    r = random.Random(5)
    sizes = [r.choice([0, 1, 3, 40, 200, 700, 2048, 2049, 9000]) for _ in range(500)]
    out = _pack(spark, sizes, group_items=200, **limits)
    out["size"] = out.token_to - out.token_from
    for i, n in enumerate(sizes):
        spans = sorted(zip(out[out.doc_id == i].token_from, out[out.doc_id == i].token_to))
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert n > 2048 or len(spans) == 1 or limits.get("max_loss")
    boxes = out.groupby("container_id")
    assert boxes["size"].sum().max() <= 2048 and boxes.size().max() <= limits.get("max_segments", 256)
    assert out[out.doc_id % 3 > 0].groupby("container_id")["size"].sum().max() <= limits.get("max_loss", 2048)
    spans = out[out["size"] > 0].sort_values(["container_id", "at"])
    assert ((spans["at"] + spans["size"]).groupby(spans.container_id).shift(fill_value=0) <= spans["at"]).all()


def test_little_space_is_left(spark):
    r = random.Random(6)
    sizes = [min(2048, int(r.lognormvariate(4.5, 1))) for _ in range(3000)]
    out = _pack(spark, sizes)
    assert out.container_id.nunique() <= sum(sizes) // 2048 + 3
    assert len(_pack(spark, [])) == 0


def test_masked_items_are_only_split_beyond_the_capacity(spark):
    r = random.Random(8)
    sizes = [r.choice([5, 60, 300, 1900, 2048, 5000]) for _ in range(400)]
    limits = {"max_segments": 8, "max_loss": 1200}
    df = spark.createDataFrame([(i, n, i % 3 > 0) for i, n in enumerate(sizes)], "doc_id long, n long, bears boolean").cache()
    out = packing.pack(df, "doc_id", F.col("n"), F.col("bears"), len(sizes), masked=True, **limits)
    got = packing.audit(out, df, "doc_id", F.col("bears"), **limits, slack=0.3).first()
    assert (got["items"], got["whole"], got["beyond_limits"]) == (400, 400, 0)
    assert all(len(g) == 1 or sizes[i] > 2048 for i, g in out.toPandas().groupby("doc_id"))
    closed = packing.closed_by(out, df, "doc_id", F.col("bears"), **limits).agg(*[F.count_if(c).alias(c) for c in ("by_tokens", "by_segments", "by_loss")]).first()
    assert min(closed) > 0


def test_long_texts_are_counted_by_the_tree(spark):
    text = "word " * 700 + "ä" * 90 + "\n" * 40 + "x" * 3000
    df = spark.createDataFrame([(1, text, "a"), (2, "short", "b"), (3, None, None)], "doc_id long, text string, kind string")
    short = {r["doc_id"]: (r["kind"], r["n"]) for r in tokenize.count_tokens(df, carry=["kind"], long_chars=1 << 30).collect()}
    assert {r["doc_id"]: (r["kind"], r["n"]) for r in tokenize.count_tokens(df, carry=["kind"], long_chars=100).collect()} == short
