import hashlib
import random

import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from riskloom.llm import bpe_transducer as bt


@pytest.fixture(scope="module")
def ranks():
    return bt.load_ranks(bt.vocabulary_path())


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ALPHABET = ["a", "aa", "é", "th", "the", "ing", " ", "  ", "\n", "1", "12", "日本", "ß", "😀", "'s", "!!", "..", "́", "x", "<|endoftext|>"]


@pytest.mark.parametrize("max_states", [40, 100_000])
def test_ids_equal_the_reference(reference, max_states):
    own = bt.Codec(bt.vocabulary_path(), public_tokenizers.PATTERN, max_states=max_states, max_memo=50)
    rng = random.Random(7)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice((rng.randint(32, 127), rng.randint(0xA0, 0x17F), rng.randint(0x4E00, 0x9FFF))))
                      for _ in range(30)) for _ in range(500)] + ["", "a" * 20_000, "ab" * 3000, "\n" * 500]
    for t in texts:
        ids = own.encode(t)
        assert ids == reference.encode_ordinary(t)
        assert "".join(bt.decode_stream(ids, own.bytes_of, chunk=3)) == t
    assert max_states > 40 or own.transducer.resets > 0


def test_unreachable_and_tied_tokens():
    single = {bytes([b]): b for b in range(256)}
    extra = [b"aa", b"ab", b"aab", b"abcd", b"ba", b"baab", b"aaaa"]          # abcd has no merges
    ranks = single | {t: 256 + i for i, t in enumerate(extra)}
    own = bt.Transducer(ranks)
    reference = tiktoken.Encoding("t", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    for _ in range(4000):
        t = "".join(rng.choice("abcd" if rng.random() < .3 else "ab") for _ in range(rng.randint(1, 14)))
        assert own.encode(t.encode()) == reference.encode_ordinary(t)
        if t.encode() not in ranks:
            assert list(own.stream(t.encode())) == reference.encode_ordinary(t)


def test_utf8_machine_in_any_chunks():
    data = "aé日😀́z".encode()
    for size in (1, 2, 3, 4, 7):
        m = bt.Utf8Machine()
        out = [m.feed(data[i:i + size]) for i in range(0, len(data), size)] + [m.feed(b"", last=True)]
        assert "".join(out) == data.decode()
    m = bt.Utf8Machine()
    assert m.feed(b"a\xff\xe6") + m.feed(b"", last=True) == "a��"


def test_query_shape(make_docs, reference):
    pairs = [(1, "The cat"), (2, None), (3, ""), (1, "The cat"), (None, "über\n\n 12"), (4, "x " * 50_000)]
    docs = make_docs(pairs, extra=True).withColumn("ids", F.lit(1))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((str(i), len(e := reference.encode_ordinary(t or "")), sha(",".join(map(str, e))), sha(t or "")) for i, t in pairs)
    got = bt.digest_documents(docs).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    full = {r.doc_id: r for r in bt.encode_documents(docs).collect()}
    assert full[1].ids == reference.encode_ordinary("The cat") and full[1].decoded == "The cat" and full[2].ids == []
    assert bt.digest_documents(make_docs([])).count() == 0
