"""Wikitext marks against a plain recursive reader, hard texts and single evaluation."""

import random
import time

import pytest

from lorekeep.functions import markup as M
from lorekeep.operators import extract as X


def generated(rng, depth):
    """Text, and the links and templates in it as (place, name), built from the inside out."""
    parts, links, names, at = [], [], [], 0

    def put(text):
        nonlocal at
        parts.append(text)
        at += len(text)

    for _ in range(rng.randrange(1, 5)):
        kind = rng.choice("LLTTPHWW" if depth else "WWH")
        if kind == "W":
            put(rng.choice(["word ", "= x ", "] ", "[ ", "a}b ", "{ ", "''i'' ", "&amp; "]))
        elif kind == "H":
            put(rng.choice(["<!-- [[gone]] -->", "<nowiki>{{gone}} [[</nowiki>", "<pre>]]</pre>", "<nowiki/>", "<nowiki />"]))
        else:
            inner, more_links, more_names = generated(rng, depth - 1)
            if kind == "P":
                put("{{{p| ")
            else:
                name = f"n{rng.randrange(1000)}"
                (links if kind == "L" else names).append((at, name))
                put(f"[[{name}| " if kind == "L" else "{{" + name + "| ")
            links += [(at + p, n) for p, n in more_links]
            names += [(at + p, n) for p, n in more_names]
            put(inner + {"L": " ]]", "T": " }}", "P": " }}}"}[kind])
        put(" ")
    return "".join(parts), links, names


def test_nested_marks_match_what_was_built():
    rng = random.Random(4)
    for _ in range(400):
        text, links, names = generated(rng, 5)
        assert [x["target"] for x in M.links_in(text)] == [n for _, n in sorted(links)], text
        assert M.transclusions_in(text) == [n for _, n in sorted(names)], text


def test_hidden_parts():
    assert [x["target"] for x in M.links_in("a<nowiki/> [[Lost]] b <nowiki>x [[no]]</nowiki>")] == ["Lost"]
    assert [x["target"] for x in M.links_in("<!-- [[a]] [[b]] <nowiki>[[c]]")] == ["a", "b", "c"]
    assert M.transclusions_in("<pre>{{a}}</pre><math>{{b}}</math>{{c}}<NOWIKI>{{d}}</nowiki >") == ["c"]
    assert M.links_in("[[Fo<!-- x -->o|b<nowiki/>ar]]") == [{"target": "Foo", "label": "bar"}]
    assert M.visible_text("a<precious>b</precious>") == "a<precious>b</precious>"


def test_targets_and_labels():
    assert M.links_in("[[AT&amp;T|R&#38;D]] [[a&b]] [[x{y}]] [[p\nq]] [[]] [[|z]]") == [
        {"target": "AT&T", "label": "R&D"}, {"target": "a&b", "label": None}]
    deep = M.links_in("[[File:a|thumb|x [[b|c [[d]] ]] [http://x y]]] [[Open|never [[in|out]]")
    assert [(x["target"], x["label"]) for x in deep] == [("File:a", None), ("b", None), ("d", None), ("in", "out")]


def test_braces():
    assert M.transclusions_in("{{Box|{{{name}}}|y={{Inside}}}} {{Gone {{{{{1}}}}} {{\nNl\n|x}} {{{p|{{q}}}}}") == [
        "Box", "Inside", "Nl", "q"]


@pytest.mark.parametrize("text,urls", [
    ("http://x.org/a_(b)", ["http://x.org/a_(b)"]), ("(http://x.org/a).", ["http://x.org/a"]),
    ("[http://y.org/a, b]", ["http://y.org/a,"]), ("http://z.org''i'' http://q.org/'", ["http://z.org", "http://q.org/"]),
    ("<nowiki>http://n.org</nowiki>http://s.org<!-- -->t", ["http://s.org"]),
])
def test_urls(text, urls):
    assert M.urls_in(text) == urls


def test_headings_between_protected_parts():
    text = "== A ==\n<!--\n== no ==\n-->\n== B ==<!-- c -->\n<pre>\n== no ==\n</pre>\n<nowiki>\n== no ==\n</nowiki>\n== C <nowiki>==</nowiki> ==  \n=x="
    assert [(h["level"], h["title"]) for h in M.headings_in(text)] == [(2, "A"), (2, "B"), (2, "C <nowiki>==</nowiki>"), (1, "x")]


def test_section_anchors(spark):
    titles = [
        "Section with ''wikicode''", "Section with <i>tag</i>", "Section with HTML entities &Sigma;, &#931;, and &#x3a3;",
        "Section with [[Main page|wikilink]]", "Section with <nowiki><nowiki></nowiki>", "#section starting with hash",
        "foo bar", "Foo Bar", "foo bar 2",
    ]
    pages = spark.createDataFrame([(1, "\n".join(f"== {t} ==" for t in titles)), (2, None), (3, "")], "page_id long, body string")
    rows = X.sections(pages).orderBy("sec_number").collect()
    assert [r.sec_title for r in rows] == titles
    assert [r.sec_anchor for r in rows] == [
        "Section_with_wikicode", "Section_with_tag", "Section_with_HTML_entities_.CE.A3.2C_.CE.A3.2C_and_.CE.A3",
        "Section_with_wikilink", "Section_with_.3Cnowiki.3E", ".23section_starting_with_hash", "foo_bar", "Foo_Bar_2", "foo_bar_2_2",
    ]


def test_partial_transclusion():
    cases = [
        ("<noinclude>p<noinclude>q</noinclude>r</noinclude>s", "s", "pqrs"),
        ("<noinclude>foo</noinclude><includeonly>bar</includeonly>", "bar", "foo"),
        ("<noinclude>foo <includeonly>bar</includeonly></noinclude>", "", "foo "),
        ("foo <onlyinclude>bar</onlyinclude>", "bar", "foo bar"),
        ("<noinclude>foo</noinclude><includeonly>bar</includeonly><onlyinclude>baz</onlyinclude>", "baz", "foobaz"),
        ("<noinclude><includeonly><onlyinclude>1<onlyinclude>2</onlyinclude></onlyinclude></includeonly>x</noinclude>",
         "1<onlyinclude>2</onlyinclude>", "x"),
        ("a<noinclude>b", "a", "ab"), ("a</noinclude>b", "a</noinclude>b", "a</noinclude>b"), ("a<noinclude/>b", "ab", "ab"),
        ("a<includeonly>b<includeonly>c</includeonly>d</includeonly>e", "abcde", "ae"),
    ]
    assert [(M.transcluded_in(t), M.viewed_in(t)) for t, _, _ in cases] == [(a, b) for _, a, b in cases]


def test_unique_anchors_match_plain_search():
    rng = random.Random(1)
    for _ in range(200):
        anchors = [rng.choice(["a", "A", "a_2", "b", "a_2_2", "b_3"]) for _ in range(rng.randrange(15))]
        done = []
        for x in anchors:
            taken = {y.lower() for y in done}
            tries = [x, *(f"{x}_{k}" for k in range(2, 40))]
            done.append(next(t for t in tries if t.lower() not in taken))
        assert M.unique_in(anchors) == done


def test_hard_texts_are_read_in_linear_time():
    size = 1_000_000
    hard = ["[[", "[[a|", "{{", "{{a|[[", "<nowiki>", "<!--", "<noinclude>", "</noinclude>", "== a ==\n", "=", "http://x(..", "&#"]
    texts = [(x * (size // len(x)))[:size] for x in hard]
    texts += ["[[a|" * (size // 8) + "]]" * (size // 8), "{{a|" * (size // 8) + "}}" * (size // 8), "http:" + "." * size]
    for text in texts:
        for read in (M.links_in, M.transclusions_in, M.urls_in, M.headings_in, M.transcluded_in, M.viewed_in):
            started = time.process_time()
            read(text)
            assert time.process_time() - started < 15, (text[:12], read.__name__)
    started = time.process_time()
    assert M.unique_in(["a"] * 10_000)[-1] == "a_10000"
    assert time.process_time() - started < 1


def test_pages_are_read_once(spark, sample):
    pages = spark.createDataFrame([(1, 0, "T", "x")], "page_id long, page_namespace int, page_title string, body string")
    for df in (X.external_links(pages), X.sections(pages), X.transclusions(sample, pages), X.wikilinks(sample, pages)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("step(body") == 1, plan
