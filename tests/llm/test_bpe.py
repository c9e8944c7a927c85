import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from helpers import by_id, documents, prose
from hypothesis import example, given, settings
from hypothesis import strategies as st

from quillmesh.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "a", "It's  we'll\n\n x", "日本語テキスト 🙂🙂", "<|endoftext|>", "a" * 5000, " " * 3000 + "b", "né" * 900, "1234567890" * 300, "\x00\x01\t", prose(4000, 1)]


def test_encodes_as_the_library_does_and_decodes_back(spark, library):
    rows = [*enumerate(TEXTS), (None, "null id"), (99, None), (0, "")]
    found = bpe.encode_documents(documents(spark, rows), PATH, P.PATTERN, chunk_chars=512, overlap=64, keep_ids=True).collect()
    assert len(found) == len(rows)
    for i, t in rows:
        want = library.encode_ordinary(t or "")
        got = [r for r in found if r["doc_id"] == i]
        assert len(got) == (2 if i == 0 else 1)
        for r in got:
            assert r["ids"] == want and r["n_tokens"] == len(want)
            assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_empty_table_and_production_chunks(spark, library):
    assert bpe.encode_documents(documents(spark, []), PATH, P.PATTERN).count() == 0
    text = prose(9000, 2) + "x" * 3000 + "   \n" * 500 + prose(2000, 3)
    got = by_id(bpe.encode_documents(documents(spark, [(1, text)]), PATH, P.PATTERN))[1]
    assert got["n_tokens"] == len(library.encode_ordinary(text))


def test_a_text_of_many_chunks_is_gathered_in_order(spark, library):
    text = " ".join(prose(3000, 40 + k) for k in range(60))
    rows = [(1, text), (1, text), (2, text[:-5])]
    found = bpe.encode_documents(documents(spark, rows), PATH, P.PATTERN, keep_ids=True).collect()
    for r in found:
        want = library.encode_ordinary(dict(rows)[r["doc_id"]])
        assert r["ids"] == want and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    assert len(found) == 3


@example("111111 \n1a11", 11)
@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab '\n\t1é.日", max_size=160), st.integers(6, 40))
def test_stitched_pieces_end_where_pre_tokens_end(text, size):
    v = bpe.vocabulary(PATH, P.PATTERN)
    overlap = size // 3
    chunks = [(at, text[at : at + size], bpe.starts(v.split, text[at : at + size], at)) for at in range(0, max(1, len(text) - overlap), size - overlap)]
    pieces = bpe.stitch(v.split, chunks)
    assert "".join(pieces) == text
    assert [t for p in pieces for t in v.split.findall(p)] == v.split.findall(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=60))
def test_both_ways_to_merge_agree(raw):
    v = bpe.vocabulary(PATH, P.PATTERN)
    many = [raw, raw[::-1], raw[:1], raw + raw[:7]]
    assert v.merge_many(many) == [tuple(v.merge(x)) for x in many]
