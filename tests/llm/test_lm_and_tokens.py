import math
from collections import Counter

import public_tokenizers
import pytest
from corpus import LONG, awkward, documents, empty
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerspark.llm import lm_scores
from ledgerspark.llm.token_counts import TokenCounter, count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute_scores(texts):
    words = {i: [w.decode() for w in (t or "").lower().encode().split()] for i, t in texts.items()}
    one, two = Counter(), Counter()
    for w in words.values():
        one.update(w)
        two.update(zip(w, w[1:]))
    out = {}
    for i, w in words.items():
        mine, pairs, score = Counter(w), Counter(zip(w, w[1:])), 0.0
        for k, x in enumerate(w):
            single = math.log(max(one[x] - mine[x], 0.5)) - math.log(max(1, sum(one.values()) - len(w)))
            both = two[w[k - 1], x] - pairs[w[k - 1], x] if k else 0
            if k and both:
                score += math.log(both) - math.log(max(1, one[w[k - 1]] - mine[w[k - 1]]))
            else:
                score += single + (math.log(0.4) if k else 0)
        out[i] = (len(w), score)
    return out


@pytest.mark.parametrize("block,part", [(12 << 20, 32 << 20), (30_000, 100_000)])
def test_scores_match_brute_force(spark, block, part):
    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    expected = brute_scores(texts)
    rows = lm_scores.backoff_scores(documents(spark), block_bytes=block, part_bytes=part).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.n_words == expected[r.doc_id][0] and r.log_score == pytest.approx(expected[r.doc_id][1])


def test_scores_of_awkward_and_empty(spark):
    rows = lm_scores.backoff_scores(awkward(spark), block_bytes=50_000).collect()
    assert len(rows) == 9
    assert all((r.n_words, r.log_score, r.mean_log_score) == (0, 0.0, None) for r in rows if r.doc_id in (1, 2, 3))
    assert len({r.log_score for r in rows if r.doc_id in (4, 5)}) == 1
    assert lm_scores.backoff_scores(empty(spark)).collect() == []


counter = TokenCounter(PATH, encode_bytes=50, remembered=20)
library = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "B", " ", "  ", "\n", "\t", "1", "'s", "é", "漢", "\x1c", "_", "-", "<|endoftext|>", "😀", "²", " the", " "]), max_size=30).map("".join), max_size=4))
def test_cut_texts_count_like_whole_ones(texts):
    assert counter.splits
    assert counter.lengths(texts) == [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(spark, name):
    path = public_tokenizers.path(name)
    texts = {r.doc_id: r.text for r in documents(spark).limit(40).collect()}
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        expected = {i: len(model.encode(t)) for i, t in texts.items()}
    else:
        tokenizer = Tokenizer.from_file(path)
        expected = {i: len(tokenizer.encode(t, add_special_tokens=False)) for i, t in texts.items()}
    df = documents(spark)
    df = df.filter(df.doc_id.isin(list(texts)))
    for r in count_tokens(df, path).collect():
        assert r.n_tokens == expected[r.doc_id] and r.n_bytes == len(texts[r.doc_id].encode())
        assert r.over_limit == (r.n_tokens > 512)


def test_batches_hold_about_equal_bytes():
    """Characters of one byte and of four weigh what they are; a long text is a batch of its own."""
    small = TokenCounter(PATH, encode_bytes=400)
    sizes = []
    small.encode = lambda texts: sizes.append(sum(len(t.encode()) for t in texts)) or [len(t) for t in texts]
    texts = ["a" * 40] * 30 + ["😀" * 10] * 30 + ["é" * 3_000] + ["b"] * 5
    assert small._encode_balanced(texts) == [len(t) for t in texts]
    assert sizes[:6] == [400] * 6 and sizes[6] == 6_000 and sum(sizes) == sum(len(t.encode()) for t in texts)


def test_tokens_of_awkward_and_empty(spark):
    rows = count_tokens(awkward(spark), PATH).collect()
    assert len(rows) == 9
    assert {(r.n_bytes, r.n_tokens) for r in rows if r.doc_id in (1, 2)} == {(0, 0)}
    assert next(r.n_tokens for r in rows if r.doc_id == 6) == len(library.encode(LONG))
    assert count_tokens(empty(spark), PATH).collect() == []
