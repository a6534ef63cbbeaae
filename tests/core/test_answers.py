"""Structure and listed citations of answers against a plain reading of each line."""

from brandlens.operators import answers as A

TEXT = """# Best tools
Intro with [Acme](https://www.acme.com/x) and globex.io.
1. **Acme** - the best
   really good
2) Globex
- Initech
\tindented too
not indented
   indented paragraph
Sources:
[1] [Review](https://g2.com/acme) and https://other.org/a.
- capterra.com list
2. Plain words only

## Notes
See https://g2.com/acme, https://new.dev/q! and globex.io
**References**
https://end.net/z)"""


def blocks(spark, text):
    r = A.answer_blocks(spark.createDataFrame([("r", text)], "response_id string, text string")).first()
    return [(b.kind, b.text, b["index"], b.ordered) for b in r.blocks], (r.list_items, r.ordered_list, r.has_source_list)


def test_blocks_latch_sources_count_items_and_join_continuations(spark):
    got, flags = blocks(spark, TEXT)
    assert got == [
        ("heading", "Best tools", None, False),
        ("paragraph", "Intro with Acme and globex.io.", None, False),
        ("item", "Acme - the best really good", 1, True),
        ("item", "Globex", 2, True),
        ("item", "Initech indented too", 3, False),
        ("paragraph", "not indented", None, False),
        ("paragraph", "indented paragraph", None, False),
        ("source", "[Review](https://g2.com/acme) and https://other.org/a.", 1, False),
        ("source", "capterra.com list", 2, False),
        ("source", "Plain words only", 3, False),
        ("heading", "Notes", None, False),
        ("paragraph", "See https://g2.com/acme, https://new.dev/q! and globex.io", None, False),
        ("source", "https://end.net/z)", 4, False),
    ]
    assert flags == (3, True, True)


def test_blocks_of_odd_texts(spark):
    assert blocks(spark, None) == ([], (0, False, False))
    assert blocks(spark, " \n\t\r\n") == ([], (0, False, False))
    assert blocks(spark, "Further Reading\r\n# sources\n") == ([("heading", "sources", None, False)], (0, False, True))
    assert blocks(spark, "a - b\x0c c")[0] == [("paragraph", "a", None, False), ("item", "b c", 1, False)]
    assert len(blocks(spark, "- x\n" * 400)[0]) == 400


def test_listed_citations_in_order_each_once(spark):
    rows = spark.createDataFrame([("r", TEXT), ("n", None), ("d", "Only Globex.IO here"), ("e", "Sources\n")], "response_id string, text string")
    got = [(r.response_id, r.citation_no, r.url, r.domain, r.anchor_text, r.citation_position, r.citation_type) for r in A.listed_citations(rows).orderBy("response_id", "citation_no").collect()]
    assert got == [
        ("d", 1, None, "globex.io", None, None, "domain_reference"),
        ("r", 1, "https://g2.com/acme", "g2.com", "Review", 1, "source_list"),
        ("r", 2, None, "capterra.com", "capterra.com list", 2, "source_list"),
        ("r", 3, None, None, "Plain words only", 3, "source_list"),
        ("r", 4, "https://end.net/z", "end.net", "https://end.net/z)", 4, "source_list"),
        ("r", 5, "https://www.acme.com/x", "acme.com", "Acme", None, "markdown_link"),
        ("r", 6, "https://new.dev/q", "new.dev", None, None, "explicit_url"),
        ("r", 7, None, "globex.io", None, None, "domain_reference"),
    ]
