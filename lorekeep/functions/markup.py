"""Wikitext marks of any depth: links, transclusions, URLs, headings and partial transclusion.

Brackets and braces that nest to any depth are beyond regular expressions, and folding an array of
marks in the JVM copies it at every step. So these columns are Arrow UDFs next to the scan: nothing
is shuffled, and every function reads a text once, in time linear in its length, keeping a stack of
the marks that are open.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# fixed values: tags whose content is no wikitext
_LITERAL_TAGS = ("nowiki", "pre", "source", "syntaxhighlight", "math")
_HIDING = re.compile(r"<!--|<(" + "|".join(_LITERAL_TAGS) + r")(?:\s[^<>]*|/)?>", re.I)
_MARK = re.compile(r"\[\[|\]\]|\{\{+|\}\}+")
_TARGET = re.compile(r"[^\[\]{}|\n]+")
_PLAIN = re.compile(r"[^\[\]]*")
_NAME = re.compile(r"\s*([^{}|\[\]\n<>]+)")
_ENTITY = re.compile(r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")
_URL = re.compile(r"(?:https?|ftp|ircs?|mailto):[^\s\[\]<>\"{}|]+")
_HEADING = re.compile(r"(={1,6})[^\S\n]*([^\n]+?)[^\S\n]*\1[^\S\n]*")
_PART_TAG = re.compile(r"<(/?)(noinclude|includeonly|onlyinclude)\s*(/?)>", re.I)


def hidden(text: str) -> list[tuple[int, int, str]]:
    """(start, end, tag) of comments (tag "") and of tags that protect their content.

    A tag or comment without an end is text; a tag closed in itself protects nothing but itself.
    """
    out, at, endless = [], 0, set()
    while found := _HIDING.search(text, at):
        tag, at = (found[1] or "").lower(), found.end()
        if tag and found[0].endswith("/>"):
            out.append((found.start(), at, tag))
        elif tag not in endless:
            if tag:
                end = re.compile(rf"</{tag}\s*>", re.I).search(text, at)
                stop = end.end() if end else -1
            else:
                stop = text.find("-->", at)
                stop = stop + 3 if stop >= 0 else -1
            if stop < 0:
                endless.add(tag)
            else:
                out.append((found.start(), stop, tag))
                at = stop
    return out


def visible_text(text: str, instead: str = "") -> str:
    """The text with ``instead`` for every hidden part."""
    if "<" not in text:
        return text
    out, at = [], 0
    for start, end, _ in hidden(text):
        out += [text[at:start], instead]
        at = end
    return "".join([*out, text[at:]])


def decoded(text: str) -> str:
    """HTML entities to characters; ``&`` without name and semicolon stays."""
    return _ENTITY.sub(lambda m: html.unescape(m[0]), text) if "&" in text else text


def closed_spans(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(start, end) between the marks of all closed links, and of all closed transclusions.

    A closing mark belongs to the nearest open one of its kind; what was opened in between and never
    closed is text. Of runs of braces three are a parameter and two a transclusion.
    """
    links, templates = [], []
    stack: list[list] = []  # [kind, end of the mark, braces left]
    n_open = {"[": 0, "{": 0}
    for mark in _MARK.finditer(text):
        kind, run = mark[0][0], len(mark[0])
        if kind in n_open:
            stack.append([kind, mark.end(), run])
            n_open[kind] += 1
            continue
        kind = "[" if kind == "]" else "{"
        left = run
        while left > 1 and n_open[kind]:
            while stack[-1][0] != kind:
                n_open[stack.pop()[0]] -= 1
            top = stack[-1]
            if kind == "[":
                links.append((top[1], mark.start()))
                used = 2
            else:
                used = min(top[2], left, 3)
                if used == 2:
                    templates.append((top[1], mark.start() + run - left))
                top[1] -= used
                top[2] -= used
            left -= used
            if kind == "[" or top[2] < 2:
                stack.pop()
                n_open[kind] -= 1
    return sorted(links), sorted(templates)


def links_in(text: str) -> list[dict]:
    """Target and label of all links in order of their beginnings."""
    text = visible_text(text)
    out = []
    for start, end in closed_spans(text)[0]:
        target = _TARGET.match(text, start, end)
        if not target or (target.end() < end and text[target.end()] != "|"):
            continue
        label = None
        if target.end() < end:
            # only up to the next bracket is read, so that deep nesting stays linear
            plain = _PLAIN.match(text, target.end() + 1)
            label = decoded(plain[0]) if plain.end() == end else None
        out.append({"target": decoded(target[0]), "label": label})
    return out


def transclusions_in(text: str) -> list[str]:
    text = visible_text(text)
    names = (_NAME.match(text, start, end) for start, end in closed_spans(text)[1])
    return [name[1].strip() for name in names if name and name[1].strip()]


def urls_in(text: str) -> list[str]:
    """URLs in order; those outside brackets without the punctuation of the sentence around them."""
    text = visible_text(text, " ")
    out = []
    for found in _URL.finditer(text):
        url = found[0]
        if not text.startswith("[", found.start() - 1) or not found.start():
            url = url.partition("''")[0]
            url = url.rstrip(",;.:!?'" if "(" in url else ",;.:!?')")
        if url:
            out.append(decoded(url))
    return out


def headings_in(text: str) -> list[dict]:
    """Level, title and ``shown``: the title with the marks of protected text as entities.

    Comments are dropped first. Protected text keeps its place on the line, but not its line breaks,
    so it can be part of a heading and never holds one.
    """
    protected: list[str] = []
    if "<" in text:
        out, at = [], 0
        text = text.replace("\0", "")
        for start, end, tag in hidden(text):
            out.append(text[at:start])
            if tag:
                out.append(f"\0{len(protected)}\0")
                protected.append(text[start:end])
            at = end
        text = "".join([*out, text[at:]])

    def marked(part: str) -> str:
        inside = part[part.index(">") + 1 : max(part.rfind("</"), part.index(">") + 1)]
        return re.sub(r"[^\w\s&;#]", lambda m: f"&#{ord(m[0])};", inside)

    def restored(title: str, how: Callable[[str], str]) -> str:
        return re.sub("\0([0-9]+)\0", lambda m: how(protected[int(m[1])]), title) if protected else title

    found = (_HEADING.fullmatch(line) for line in text.split("\n") if line.startswith("="))
    return [
        {"level": len(h[1]), "title": restored(h[2], str).strip(" "), "shown": restored(h[2], marked).strip(" ")}
        for h in found if h
    ]


def _parts(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, tag, depth within its kind) of partial-transclusion tags; depth is negative for ends.

    An end without a beginning is left out.
    """
    depth = {"noinclude": 0, "includeonly": 0, "onlyinclude": 0}
    out = []
    for found in _PART_TAG.finditer(text):
        tag = found[2].lower()
        if found[3]:
            out.append((found.start(), found.end(), tag, 0))
        elif not found[1]:
            depth[tag] += 1
            out.append((found.start(), found.end(), tag, depth[tag]))
        elif depth[tag]:
            out.append((found.start(), found.end(), tag, -depth[tag]))
            depth[tag] -= 1
    return out


def _without(text: str, drop: str, unwrap: tuple[str, ...]) -> str:
    """Without the outermost ``drop`` parts, to the end if they are not closed, and without tags of ``unwrap``."""
    out, at, dropping = [], 0, False
    for start, end, tag, depth in _parts(text):
        if tag == drop:
            if depth in (0, 1) and not dropping:
                out.append(text[at:start])
                at, dropping = end, depth == 1
            elif depth == -1:
                at, dropping = end, False
        elif tag in unwrap and not dropping:
            out.append(text[at:start])
            at = end
    return "".join(out if dropping else [*out, text[at:]])


def transcluded_in(text: str) -> str:
    """What a page contributes where it is transcluded: the first ``onlyinclude`` part if there is one."""
    if "<" not in text:
        return text
    begin = None
    for start, end, tag, depth in _parts(text):
        if tag == "onlyinclude" and depth == 1 and begin is None:
            begin = end
        elif tag == "onlyinclude" and depth == -1:
            text = text[begin:start]
            break
    return _without(text, "noinclude", ("includeonly",))


def viewed_in(text: str) -> str:
    """What a page shows on itself."""
    return _without(text, "includeonly", ("noinclude", "onlyinclude")) if "<" in text else text


def unique_in(anchors: list[str]) -> list[str]:
    """Each anchor takes the first of ``a, a_2, a_3, ...`` that no earlier final one equals, in any case."""
    taken: set[str] = set()
    following: dict[str, int] = {}
    out = []
    for anchor in anchors:
        key, final = anchor.lower(), anchor
        if key in taken:
            # smaller numbers were taken before and stay so
            number = following.get(key, 2)
            while f"{key}_{number}" in taken:
                number += 1
            final, following[key] = f"{anchor}_{number}", number + 1
        taken.add(final.lower())
        out.append(final)
    return out


def _column(run: Callable, kind: T.DataType) -> Callable[[Column], Column]:
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def step(cells: pa.Array) -> pa.Array:
        return pa.array((None if (cell := x.as_py()) is None else run(cell) for x in cells), arrow)

    # otherwise the optimizer copies the step into filters that it infers, and texts are read twice
    return step.asNondeterministic()


def _struct(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(name, kind) for name, kind in fields.items()]))


_TEXT = T.StringType()
wikilinks = _column(links_in, _struct(target=_TEXT, label=_TEXT))
transclusions = _column(transclusions_in, T.ArrayType(_TEXT))
external_urls = _column(urls_in, T.ArrayType(_TEXT))
headings = _column(headings_in, _struct(level=T.IntegerType(), title=_TEXT, shown=_TEXT))
transcluded_part = _column(transcluded_in, _TEXT)
viewed_part = _column(viewed_in, _TEXT)
unique_anchors = _column(unique_in, T.ArrayType(_TEXT))
