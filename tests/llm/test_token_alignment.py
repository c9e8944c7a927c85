import hashlib
import json
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from helpers import documents, prose
from tokenizers import Tokenizer

from quillmesh.llm import token_alignment as ta

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  two", "a", "It's  we'll\n\n x\t\ty ", "日本語テキスト 🙂🙂 und Straße", "<|endoftext|> and <s> <unk>", "ｆｕｌｌ", "éa b▁c", "a" * 3000, " " * 500 + "b", "né" * 300,
    "1234567890" * 50, "\x00\x01\t", prose(4000, 1), *[prose(60, k) for k in range(20)], "naïve café " * 40, "x\r\ny z",
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    alphabet = ta.byte_alphabet()
    names = {i: bytes(alphabet[c] for c in t) for t, i in json.load(open(A))["model"]["vocab"].items() if i != 50256}
    b = sentencepiece.SentencePieceProcessor(model_file=B)

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    return (lambda t: [(i, names[i]) for i in a.encode(" " + t, add_special_tokens=False).ids]), (lambda t: [(i, piece(i)) for i in b.encode(t)])


def brute(rows, libraries):
    made = []
    for i, t in rows:
        a, b = [], []
        if t:
            a, b = libraries[0](t), libraries[1](t)
            if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + t).encode():
                a, b = [], []
        sides = []
        for s in (a, b):
            end, out = 0, []
            for k, x in s:
                end += len(x)
                out.append((end, k))
            sides.append(out)
        cuts = [e for e, _ in sides[0] if e in {e for e, _ in sides[1]}]
        groups, links, at = [], [], 0
        for e in cuts:
            groups.append("|".join(",".join(str(k) for f, k in s if at < f <= e) for s in sides))
            links += [(x, y) for f, x in sides[0] if f == e for g, y in sides[1] if g == e]
            at = e
        made.append((i, len(a), len(b), groups, links))
    counts = Counter(x for *_, links in made for x in links)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return sorted(
        (repr(i), a, b, len(g), len(s), sum(counts[x] == most[x[1]] for x in s), sum(counts[x] for x in s), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, a, b, g, s in made
    )


@pytest.mark.parametrize("most", [0, 20, ta.FREQUENT])
def test_groups_links_and_counts_agree_with_brute_force(spark, libraries, most):
    rows = [*enumerate(TEXTS), (None, "null id"), (3, TEXTS[5]), (3, TEXTS[5])]
    docs = documents(spark, rows).withColumnsRenamed({"set_id": "key", "h": "a_ends", "links": "b", "spans": "cuts", "root": "n"})
    got = ta.align_documents(docs, A, B, most)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert all(kind == "bigint" for name, kind in got.dtypes if name != "groups_sha256")
    assert sorted((repr(r[0]), *r[1:]) for r in got.collect()) == brute(rows, libraries)


def test_both_ways_to_encode_agree(libraries):
    """The library of ranks gives what the file's own library gives, on every character up to the supplementary planes."""
    fast = ta.ByteLevel(A)
    assert fast.encode.__name__ == "encode_ordinary"
    for c in [*range(0x3100), *range(0xA000, 0xAC00), *range(0xF900, 0x10500), *range(0x1F300, 0x1F700)]:
        t = f"a{chr(c)}b 1{chr(c)} {chr(c)}{chr(c)} \n{chr(c)} \n x"
        assert fast.encode(" " + t) == [i for i, _ in libraries[0](t)], hex(c)


def test_other_vocabularies_use_their_own_library(tmp_path):
    spec = json.load(open(A))
    spec["model"]["ignore_merges"] = True
    (tmp_path / "v.json").write_text(json.dumps(spec))
    own = ta.ByteLevel(str(tmp_path / "v.json"))
    assert own.encode(" <|endoftext|> the cat") == ta.ByteLevel(A).encode(" <|endoftext|> the cat")


def test_empty_table_and_real_outputs(spark):
    assert ta.align_documents(documents(spark, []), A, B).count() == 0
    (r,) = ta.align(ta.tokenize(documents(spark, [(1, "the cat")]), A, B)).collect()
    assert r["groups"] == ["262|272", "3797|5255"] and [tuple(x) for x in r["links"]] == [(262, 272), (3797, 5255)]


def test_no_function_is_evaluated_for_each_token(spark):
    """Spark interprets lambdas for each token and cut: that was half of the whole query's CPU seconds."""
    plan = ta.align(ta.tokenize(documents(spark, [(1, "the cat")]), A, B))._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "lambda" not in plan


@pytest.mark.parametrize("size", [0, 40, 1 << 20])
def test_texts_that_are_not_kept_leave_their_neighbours_alone(spark, libraries, monkeypatch, size):
    monkeypatch.setattr(ta, "SLICE", size)
    rows = list(enumerate(["b▁c", "the cat", None, "x▁", "", "▁", "naïve café", *[prose(30, k) for k in range(5)], "▁a", ""]))
    got = ta.align_documents(documents(spark, rows).coalesce(1), A, B)
    assert sorted((repr(r[0]), *r[1:]) for r in got.collect()) == brute(rows, libraries)


def test_groups_are_spelled_from_places(libraries):
    a, b = np.array([7, 50000, 3, 12]), np.array([1, 22, 333, 4444, 5])
    a_cuts, b_cuts = ta.cut(a, np.array([1, 4, 6, 9]), b, np.array([2, 4, 5, 6, 9]))
    assert (a_cuts.tolist(), b_cuts.tolist()) == ([1, 2, 3], [1, 3, 4])
    (_, digits) = ta.both_sides(A, B)
    text, ends = ta.spelled(digits, a, a_cuts, b, b_cuts, np.array([0, 0, 7, 9]))  # texts of no tokens before and behind
    assert [text.tobytes()[x:y].decode() for x, y in zip(ends, ends[1:])] == ["", "7,50000|1,22;3|333,4444", "12|5", ""]
