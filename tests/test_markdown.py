from __future__ import annotations

from hypothesis import given
from hypothesis import strategies as st

from notalith.sources import markdown as M

LONG = "This sentence has more than enough characters to stay."


def test_frontmatter():
    m = M.parse_frontmatter("tags: [#search, #vector, indexing]\naliases:\n  - One Name\n  - Two\ncanonical_ref: \"[[CanonicalTarget]]\"\n")
    assert m["tags"] == ["search", "vector", "indexing"] and m["aliases"] == ["One Name", "Two"] and m["canonical_ref"] == "CanonicalTarget"
    m = M.parse_frontmatter("tags: #AI, #ML, #knowledge-base\npriority: 1\ntype: 5\ncanonical: no\n# note\nproject: 7")
    assert m["tags"] == ["ai", "ml", "knowledge-base"] and m["custom"] == {"priority": "1", "type": "5"} and m["canonical"] is True and m["project"] == "7"
    assert M.parse_frontmatter(None)["tags"] == []


def test_split_and_title():
    assert M.split_frontmatter("---\ntitle: A\n---\n\nbody") == ("title: A", "body")
    assert M.split_frontmatter("---\nno end") == ("", "---\nno end")
    assert M.extract_title({}, "x\n# Head\n", "a/b.md") == "Head"
    assert M.extract_title({}, "x", "a/b.markdown") == "b"


def chunks(text, most=1200):
    return M.chunk_blocks(M.parse_blocks(text), most)


def test_headings_and_fences():
    atx = chunks(f"# A\n\n{LONG}\n\n## B\n\n{LONG}\n")
    setext = chunks(f"A\n===\n\n{LONG}\n\nB\n---\n\n{LONG}\n")
    assert [c["heading_path"] for c in atx] == [c["heading_path"] for c in setext] == [["A"], ["A", "B"]]
    fenced = chunks(f"# A\n\n```\n# not a heading\n```\n\n{LONG}\n")
    assert [c["heading_path"] for c in fenced] == [["A"]]


def test_lines():
    got = chunks(f"# A\n\n{LONG}\nmore\n\n# B\n\n{LONG}\nmore\n")
    assert [(c["start_line"], c["end_line"]) for c in got] == [(3, 4), (8, 9)]


def test_oversized():
    code = "```py\n" + "\n".join(f"line_{i} = {i} * 1000" for i in range(60)) + "\n```"
    parts = chunks(code, 300)
    assert len(parts) > 1 and all(p["text"].startswith("```py") and p["text"].endswith("```") for p in parts)
    table = "| name | value |\n|---|---|\n" + "\n".join(f"| row {i} | {i} |" for i in range(60))
    parts = chunks(table, 300)
    assert len(parts) > 1 and all(p["text"].startswith("| name | value |\n|---|---|") for p in parts)
    assert all(len(p) <= 50 for p in M.split_block("word " * 100, 50, "paragraph"))


def test_quotes_and_small_chunks():
    assert [b["type"] for b in M.parse_blocks("> a\nlazy\n\npara\n| t |\n")] == ["blockquote", "paragraph", "table"]
    assert chunks("# A\n\ntiny\n") == []
    assert M.chunk_budget(None) == 1200 and M.chunk_budget(10) == 100 and M.chunk_budget(9999) == 8192


@given(st.text("ab #>|-=`\n", max_size=300))
def test_blocks_cover_lines_in_order(text):
    blocks = M.parse_blocks(text)
    assert all(a["end_line"] < b["start_line"] for a, b in zip(blocks, blocks[1:], strict=False))
    assert all(b["start_line"] <= b["end_line"] for b in blocks)
    covered = {i for b in blocks for i in range(b["start_line"], b["end_line"] + 1)}
    assert all(i + 1 in covered for i, s in enumerate(text.split("\n")) if s.strip())


def test_scan(spark, tmp_path):
    for f, text in {"a.md": "# A", "x/B.MARKDOWN": "# B", "x/c.txt": "no", ".hid/d.md": "no", "skip/e.md": "no", "x/sp ace+é.md": "# S"}.items():
        p = tmp_path / f
        p.parent.mkdir(exist_ok=True)
        p.write_text(text)
    got = {r.file for r in M.scan_notes(spark, str(tmp_path), ["skip"]).collect()}
    assert got == {"a.md", "x/B.MARKDOWN", "x/sp ace+é.md"}


def test_blocks_at_lists_and_rules():
    kinds = lambda text: [(b["type"], b["text"]) for b in M.parse_blocks(text)]
    assert kinds("text\n- item\n---") == [("paragraph", "text"), ("paragraph", "- item\n---")]
    assert kinds("1) Title\n===") == [("setext_heading", "1) Title\n===")]
    assert kinds("> quote\n1) item") == [("blockquote", "> quote\n1) item")]
    assert kinds("> quote\n1. item") == [("blockquote", "> quote"), ("paragraph", "1. item")]


def test_hashes_end_paragraphs_and_quotes_even_without_a_title():
    kinds = lambda s: [(b["type"], b["text"]) for b in M.parse_blocks(s)]
    assert kinds("text\n# \nmore") == [("paragraph", "text"), ("paragraph", "# \nmore")]
    assert kinds("text\n    # more") == [("paragraph", "text\n    # more")]
    assert kinds("> quote\n    # more") == [("blockquote", "> quote"), ("paragraph", "    # more")]
    assert kinds("text\n- item\n---") == [("paragraph", "text"), ("paragraph", "- item\n---")]
    assert kinds("1) Title\n===") == [("setext_heading", "1) Title\n===")]
