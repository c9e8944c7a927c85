import random

import pytest
import structured
from pyspark.sql import functions as F

from quillmesh.operators import chunking as C
from quillmesh.operators.documents import normalize


def chunks(spark, rows, **more):
    raw = spark.createDataFrame([(k, p, t) for k, p, t in rows], "id string, path string, content string")
    docs = normalize(raw, F.lit("src"), "now", "sync")
    out = {}
    for r in C.chunk_documents(docs, **more).orderBy("document_id", "chunk_index").collect():
        out.setdefault(r["document_id"], []).append((r["text"], r["line_start"], r["line_end"]))
    return out


def plain(text, size, overlap):
    """The plain rule step by step."""
    text, out, at = text.strip(), [], 0
    while at < len(text):
        piece = text[at : at + size]
        if piece.strip():
            line = 1 + text.count("\n", 0, at)
            out.append((piece.strip(), line, line + piece.strip().count("\n")))
        if at + size >= len(text):
            break
        at += size - overlap
    return out


def test_plain_windows(spark):
    texts = {"a": "", "b": " \n ", "c": "one", "d": "word " * 100, "e": "l\n\n\n" * 60, "f": "\n\n  lead　" + "x y\n" * 77, "g": "é🙂 " * 120}
    found = chunks(spark, [(k, "t.txt", t) for k, t in texts.items()], max_chars=80, overlap=10)
    assert found == {k: plain(t, 80, 10) for k, t in texts.items() if t.strip()}
    assert found == chunks(spark, [(k, "t.txt", t) for k, t in texts.items()], max_chars=80, overlap=10)


def test_identity_prefers_the_external_id(spark):
    raw = spark.createDataFrame([("raw", "doc", "ext", "text")], "id string, document_id string, external_id string, content string")
    row = C.chunk_documents(normalize(raw, F.lit("s"), "now", "x")).first()
    assert row["document_id"] == "ext" and row["chunk_id"].startswith("ext:chunk:0:") and row["line_start"] == 1


def test_markdown_sections(spark):
    found = chunks(spark, [
        ("atx", "a.md", "# One\ntext\n## Two\nmore"), ("setext", "b.md", "intro\n\nTitle\nof two lines\n====\nbody\nNext\n---\nend"), ("fence", "c.md", "# A\n```\n# not\n```\n# B\nx"),
        ("tilde", "d.md", "# A\n~~~~\n~~~\n# not\n~~~~\n# B"), ("info", "e.md", "# A\n``` a`b\n# B\nx"), ("none", "f.md", "no heading\n```\n# x\n```"), ("deep", "g.md", "    # code\n####### seven\n#hash"), ("empty", "h.md", "\n\n# T\n\n\ntext\n\n"),
    ])
    assert found["atx"] == [("# One\ntext", 1, 2), ("## Two\nmore", 3, 4)]
    assert found["setext"] == [("intro", 1, 1), ("Title\nof two lines\n====\nbody", 3, 6), ("Next\n---\nend", 7, 9)] or found["setext"] == [("intro", 1, 1), ("Title\nof two lines\n====", 3, 5), ("body\nNext\n---\nend", 6, 9)]
    assert found["fence"] == [("# A\n```\n# not\n```", 1, 4), ("# B\nx", 5, 6)]
    assert found["tilde"] == [("# A\n~~~~\n~~~\n# not\n~~~~", 1, 5), ("# B", 6, 6)]
    assert found["info"] == [("# A\n``` a`b", 1, 2), ("# B\nx", 3, 4)]
    assert len(found["none"]) == 1 and len(found["deep"]) == 1
    assert found["empty"] == [("# T\n\n\ntext", 3, 6)]


def test_code_packing(spark):
    text = "\n\ndef a():\n    pass\n\n\ndef b():\n    return 1\n" + "x" * 95 + "\nend\n"
    found = chunks(spark, [("code", "a.py", text)], max_chars=40, overlap=5)["code"]
    assert found[0][1] == 3 and all(len(t) <= 40 for t, _, _ in found)
    long = [x for x in found if set(x[0]) == {"x"}]
    assert [x[1:] for x in long] == [(9, 9)] * 3 and long[1][0] == "x" * 40
    assert found[-1] == ("end", 10, 10)


LINES = ["# h", "text", "", "```", "~~~", "===", "---", "   ## x", "    code", "``` `", "````", " ~~~~ x", "#no", "####### 7", "\u3000", "  == ", "- ", "x" * 45, "y " * 30, "#\tt", "~~~ `", "long " * 9, "a\x0bb", "\xa0"]


@pytest.mark.parametrize(("end", "sizes"), [(".md", (40, 5)), (".MDX", (1200, 120)), (".py", (40, 5)), (".json", (90, 0))])
def test_rules_step_by_step(spark, end, sizes):
    """Random texts of lines that matter, against the rules as a plain program."""
    r, texts = random.Random(len(end) + sizes[0]), {}
    for k in range(300):
        pick = r.sample(LINES, r.randrange(1, 9))
        texts[f"k{k:03d}"] = r.choice(["\n", "\n", "\r\n", "\u2028"]).join(r.choice(pick) for _ in range(r.randrange(16))) + r.choice(["", "\n", "\n\n"])
    found = chunks(spark, [(k, f"f{end}", t) for k, t in texts.items()], max_chars=sizes[0], overlap=sizes[1])
    for k, t in texts.items():
        if end in (".py", ".json"):
            want = structured.code_parts(t, *sizes)
        else:
            want = structured.markdown_parts(t, *sizes) if structured.has_heading(t) else plain(t, *sizes)
        assert found.get(k, []) == (want if t.strip() else []), (k, t)


def test_structured_chunks_take_no_python_workers(spark):
    docs = normalize(spark.createDataFrame([("a", "a.md", "# h"), ("b", "b.py", "x")], "id string, path string, content string"), F.lit("src"), "now", "sync")
    plan = C.chunk_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_sizes_are_checked():
    for bad in ((0, 0), (10, 10), (10, -1)):
        with pytest.raises(ValueError):
            C.check(*bad)
