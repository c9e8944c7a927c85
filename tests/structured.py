"""The rules for Markdown and code step by step, for the tests to compare with."""

import re
from collections.abc import Iterator

_HEADING = re.compile(r" {0,3}#{1,6}(?:\s|$)")
_UNDERLINE = re.compile(r" {0,3}(?! )\s*(?:=+|-+)\s*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$", re.DOTALL)


class Fence:
    """Whether a line stands in a fenced block, and whether it opened or closed one."""

    def __init__(self) -> None:
        self.open = ""

    def feed(self, line: str) -> bool:
        """True if the line belongs to a fence: its opener, its closer or what is between them."""
        m = _FENCE.match(line)
        if self.open:
            if m and m[1][0] == self.open[0] and len(m[1]) >= len(self.open) and not m[2].strip():
                self.open = ""
            return True
        if m and not (m[1][0] == "`" and "`" in m[2]):
            self.open = m[1]
            return True
        return False


def titles_paragraph(line: str) -> bool:
    """Whether a line can be the text of an underlined heading."""
    shallow = len(line) - len(line.lstrip(" ")) <= 3
    return bool(line.strip()) and shallow and not _HEADING.match(line) and not _UNDERLINE.match(line) and not Fence().feed(line)


def has_heading(content: str) -> bool:
    fence, paragraph = Fence(), []
    for line in content.splitlines():
        if not fence.open:
            if _HEADING.match(line) or paragraph and _UNDERLINE.match(line) and all(map(titles_paragraph, paragraph)):
                return True
        fenced = fence.feed(line)
        paragraph = [] if fenced or not line.strip() else [*paragraph, line]
    return False


def markdown_sections(content: str) -> list[tuple[int, str]]:
    """First line and text of each section; blank lines at a section's ends are left out."""
    fence, held, first, boundary, out = Fence(), [], 1, 0, []

    def close(lines: list[str], at: int) -> None:
        solid = [k for k, x in enumerate(lines) if x.strip()]
        if solid:
            out.append((at + solid[0], "\n".join(lines[solid[0] : solid[-1] + 1])))

    for number, line in enumerate(content.splitlines(), 1):
        if not held and not line.strip():
            continue
        if not held:
            first, boundary = number, 0
        inside = bool(fence.open)
        if not inside and held and _UNDERLINE.match(line) and titles_paragraph(held[-1]):
            close(held[:boundary], first)
            held, first = [*held[boundary:], line], first + boundary
            boundary = len(held)
            continue
        heading = not inside and bool(_HEADING.match(line))
        if heading and held:
            close(held, first)
            held, first = [], number
        held.append(line)
        if fence.feed(line) or heading or not line.strip():
            boundary = len(held)
    close(held, first)
    return out


def windows(text: str, max_chars: int, overlap: int) -> Iterator[tuple[int, str]]:
    at = 0
    while at < len(text):
        yield at, text[at : at + max_chars]
        if at + max_chars >= len(text):
            return
        at += max_chars - overlap


def markdown_parts(content: str, max_chars: int, overlap: int) -> list[tuple[str, int, int]]:
    out = []
    for line, text in markdown_sections(content):
        last, ahead = 0, 0  # line breaks before the window, counted on from those before the last one
        for at, raw in windows(text, max_chars, overlap):
            ahead, last = ahead + text.count("\n", last, at), at
            kept = raw.strip()
            if kept:
                first = line + ahead + raw.count("\n", 0, len(raw) - len(raw.lstrip()))
                out.append((kept, first, first + kept.count("\n")))
    return out


def code_parts(content: str, max_chars: int, overlap: int) -> list[tuple[str, int, int]]:
    """Lines packed while they fit; blank lines before a chunk are skipped; a line that is too long is cut with overlap."""
    out, held, size, first = [], [], 0, 1

    def close() -> None:
        if any(x.strip() for x in held):
            out.append(("\n".join(held), first, first + len(held) - 1))
        held.clear()

    for number, line in enumerate(content.splitlines(), 1):
        if held and size + 1 + len(line) > max_chars:
            close()
        elif not held and not line.strip():
            continue
        if held:
            held.append(line)
            size += 1 + len(line)
        elif len(line) > max_chars:
            out += [(raw, number, number) for _, raw in windows(line, max_chars, overlap) if raw.strip()]
        else:
            held, size, first = [line], len(line), number
    close()
    return out
