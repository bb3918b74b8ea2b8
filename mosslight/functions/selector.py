"""Parts of pages by CSS selectors: tags, classes, ids and attributes, joined as descendants or children, in groups."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.S | re.I)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SIMPLE = re.compile(r"\*|[#.]?[A-Za-z_][\w-]*|\[\s*([\w-]+)\s*(?:=\s*[\"']?([^\"'\]]*)[\"']?\s*)?\]")
#: Elements without content, and those that end one of their own kind that is open.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
REPLACED = {"p": "p", "li": "ul ol", "tr": "table", "td": "tr", "th": "tr", "option": "select", "dt": "dl", "dd": "dl"}


def parse_selector(selector: str) -> list[list[tuple[str, list[tuple[str, str, str | None]]]]]:
    """Alternatives of steps; a step is (how it follows the one before, its conditions)."""
    out = []
    for group in re.split(r",(?![^\[]*\])", selector):
        steps, how = [], " "
        for part in re.findall(r">|(?:\[[^\]]*\]|[^\s>\[])+", group):
            if part == ">":
                how = ">"
                continue
            found, at = [], 0
            while at < len(part):
                m = _SIMPLE.match(part, at)
                if not m:
                    raise ValueError(f"not a selector that is known here: {selector!r}")
                x = m[0]
                if x[0] == "[":
                    found.append(("attribute", m[1].lower(), m[2]))
                elif x[0] in "#.":
                    found.append(("id" if x[0] == "#" else "class", x[1:], None))
                elif x != "*":
                    found.append(("tag", x.lower(), None))
                at = m.end()
            steps.append((how, found))
            how = " "
        if not steps or how == ">":
            raise ValueError(f"not a selector that is known here: {selector!r}")
        out.append(steps)
    return out


def _fits(conditions: list[tuple[str, str, str | None]], tag: str, attributes: dict[str, str]) -> bool:
    for kind, name, value in conditions:
        if kind == "tag" and tag != name or kind == "id" and attributes.get("id") != name or kind == "class" and name not in attributes.get("class", "").split():
            return False
        if kind == "attribute" and (name not in attributes or value is not None and attributes[name] != value):
            return False
    return True


def selected(html: str, alternatives: list) -> list[str]:
    """The matched elements as they stand in a page, outermost ones only, in one pass over its tags.

    Each open element knows which steps it completes and which its line of ancestors does, one bit for each step.
    Elements without an end tag end with the one that holds them.
    """
    wanted = {name for steps in alternatives for _, found in steps for kind, name, _ in found if kind == "tag"}
    # (tag, start if a match begins here, steps of it, steps of it and its ancestors) for each alternative
    stack: list[tuple[str, int, tuple[int, ...], tuple[int, ...]]] = [("", -1, (0,) * len(alternatives), (0,) * len(alternatives))]
    spans, inside = [], 0

    def close(n: int, end: int) -> None:
        nonlocal inside
        while len(stack) > n:
            _, start, _, _ = stack.pop()
            if start >= 0:
                inside -= 1
                if not inside:
                    spans.append((start, end))

    for m in _TOKEN.finditer(html):
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:
            at = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            if at:
                close(at + 1, m.start())
                close(at, m.end())
            continue
        if tag in REPLACED:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k, m.start())
                    break
                if tag != "p" and stack[k][0] in REPLACED[tag].split():
                    break
        _, _, above, line = stack[-1]
        own, found = [], False
        attributes = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTRIBUTE.findall(m[4])} if m[4].strip(" /") else {}
        for steps, up, all_ in zip(alternatives, above, line, strict=True):
            bits = 0
            for k, (how, conditions) in enumerate(steps):
                if (k == 0 or (up if how == ">" else all_) >> k - 1 & 1) and _fits(conditions, tag, attributes):
                    bits |= 1 << k
            own.append(bits)
            found |= bool(bits >> len(steps) - 1 & 1)
        if tag in VOID or m[4].endswith("/") and tag not in wanted:
            if found and not inside:
                spans.append((m.start(), m.end()))
            continue
        inside += found
        stack.append((tag, m.start() if found else -1, tuple(own), tuple(a | b for a, b in zip(own, line, strict=True))))
    close(1, len(html))
    return [html[a:b] for a, b in sorted(spans)]


def selected_html(html: Column, selector: str) -> Column:
    """The matched elements of a column of pages, one after another; empty where there is none, null for a null page."""
    alternatives = parse_selector(selector)

    @F.pandas_udf("string")
    def run(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in pages:
            yield series.map(lambda page: None if page is None else " ".join(selected(page, alternatives)))

    return run(html)
