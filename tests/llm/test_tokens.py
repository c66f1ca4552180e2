import base64
import hashlib
import random
import struct

import public_tokenizers
import tiktoken
from text_cases import HARD, frame, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortspark.llm import byte_bpe, token_count

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
PLAIN = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
OWN = Tokenizer.from_file(WORDS)
PARTS = [" ", "  ", "\n", "\t", "'ll", "'", "ab", "Zebra", "12", "!!", "é", "ß", "́", " ", " ", "\x1c", "日本", "<|endoftext|>", "s"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=60), st.integers(1, 12), st.integers(1, 5))
def test_tree_equals_library(parts, leaf, window):
    text = "".join(parts)
    tree = byte_bpe.TreeEncoder(RANKS, public_tokenizers.PATTERN, leaf, window)
    ids = tree.encode(text)
    assert ids == PLAIN.encode_ordinary(text)
    assert tree.decode(ids) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=60), st.integers(1, 12), st.integers(1, 5))
def test_overlap_counts_equal_library(parts, chunk, overlap):
    text = "".join(parts)
    assert token_count.OverlapCounter(WORDS, chunk, overlap).count(text) == len(OWN.encode(text, add_special_tokens=False).ids)


def test_encoded_rows(spark):
    texts = [*HARD, prose(3, 30_000)]
    got = byte_bpe.encode_documents(frame(spark, texts), RANKS, public_tokenizers.PATTERN, True, leaf_chars=1000).collect()
    for r in got:
        ids = PLAIN.encode_ordinary(texts[r.doc_id] or "")
        assert r.token_ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert len(got) == len(texts)


def test_counted_rows(spark):
    texts = [*HARD, "x <|startoftext|> y<|endoftext|>z", " ".join(str(random.Random(5).random()) for _ in range(9000))]
    got = token_count.count_tokens(frame(spark, texts), WORDS, limit=10, chunk=500, overlap=20).collect()
    for r in got:
        n = len(OWN.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.over_limit, r.n_bytes) == (n, n > 10, len((texts[r.doc_id] or "").encode()))
    none = frame(spark, ["a"]).filter("false")
    assert token_count.count_tokens(none, WORDS).count() == 0
    assert byte_bpe.encode_documents(none, RANKS, public_tokenizers.PATTERN).count() == 0
