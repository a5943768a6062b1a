"""Markdown line helpers of the readers; the Column forms are in functions.markdown."""

from __future__ import annotations

import re

WS = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACES = re.compile(f"[{WS}]+")


def escape_inline(text: str) -> str:
    return re.sub(r"([\\`*_\[\]{}<>])", r"\\\1", text)


def escape_cell(text: str) -> str:
    return re.sub(r"\r\n|\r|\n", "<br>", text.replace("|", "\\|"))


def heading(level: int, text: str) -> str:
    return "#" * min(max(level, 1), 6) + " " + text


def squash(text: str) -> str:
    return re.sub("[ \t\u00a0]+", " ", text).strip(WS)


def join_blocks(lines: list[str]) -> str:
    out: list[str] = []
    for line in lines:
        if line.strip(WS) or (out and out[-1]):
            out.append(line if line.strip(WS) else "")
    while out and not out[-1]:
        out.pop()
    return "\n".join(out)


def table(rows: list[list[str]]) -> list[str]:
    width = max(map(len, rows), default=0)
    if not width:
        return []
    shown = ["| " + " | ".join(escape_cell(c) for c in r + [""] * (width - len(r))) + " |" for r in rows]
    return [shown[0], "| " + " | ".join(["---"] * width) + " |", *shown[1:]]


def opening_heading(lines: list[str]) -> str | None:
    first = next((x for x in lines if x.strip(WS)), "")
    m = re.match(r"#{1,6}\s+(.*)", first.split("\n")[0])
    return re.sub(r"[*_`]", "", re.sub(r"\\(.)", r"\1", m[1])).strip(WS) if m else None


def titled(lines: list[str], title: str | None) -> list[str]:
    """The lines with the title as first heading, unless they open with it."""
    if not title or (opening_heading(lines) or "").lower() == title.strip(WS).lower():
        return lines
    return [heading(1, escape_inline(title)), "", *lines]


def fence(text: str, language: str = "") -> list[str]:
    mark = "`" * max(3, 1 + max(map(len, re.findall("`+", text)), default=0))
    return [mark + language, *text.rstrip("\n").split("\n"), mark]
