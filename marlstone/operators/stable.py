"""Content-defined chunks: borders depend on the lines near them, so an edit moves few.

A line whose digest falls on a divisor may end a chunk. By lines alone (``line_chunks``), or with an eye
to Markdown (``markdown_chunks``): fenced blocks and lists are zones, an interval list over the lines, in which no chunk
ends. Zones that are too long have split points, blank lines in fences and items at the margin in lists, at
which a chunk that is full gives way. Front matter goes with the first chunk. Joined, the chunks are the text.
"""

from __future__ import annotations

import hashlib
import re

CHUNK_SIZE, LINE_WIDTH, HARD_LIMIT, SNAP = 2000, 80, 3, 100
_FENCE = re.compile(r"(`{3,}|~{3,})\w*\s*$")
_ITEM = re.compile(r"(\s*)(?:[-*+]|\d+\.)\s")
_BLANKS = re.compile(r"[ \t]+")
_END = re.compile(r"[.!?]")

# Abbreviations after which a stop ends no sentence.
ABBREVIATIONS = frozenset("Dr Mr Mrs Ms Jr Sr Prof e.g i.e etc vs Fig No Inc Ltd Co Corp St Ave Blvd Rd apt cf al et".split())


def digest(text: str) -> str:
    return hashlib.sha256(_BLANKS.sub(" ", text.strip()).encode("utf-8", "surrogatepass")).hexdigest()


def falls_on(line: str, size: int) -> bool:
    return int(digest(line)[:8], 16) % max(2, size // LINE_WIDTH) == 0


def ends_sentence(text: str, at: int) -> bool:
    """Whether the mark at ``at`` ends a sentence: what follows is nothing, a line's end or blanks and a capital, and no abbreviation comes before."""
    start = at
    while start and text[start - 1].isalpha():
        start -= 1
    if text[start:at] in ABBREVIATIONS:
        return False
    rest = text[at + 1 : at + 2]
    if not rest or rest == "\n":
        return True
    following = re.compile(r"\s*").match(text, at + 1).end()
    return rest.isspace() and (following == len(text) or text[following].isupper())


def sentence_end(text: str, start: int, window: int) -> int:
    """The end of the first sentence that ends within ``window`` characters, or else ``start``."""
    marks = (m.start() for m in _END.finditer(text, start, min(len(text), start + window)))
    return next((at + 1 for at in marks if ends_sentence(text, at)), start)


def _pieces(line: str, most: int) -> list[str]:
    """A line that is too long, cut after the last sentence that fits, or where it must be."""
    out = []
    while len(line) > most:
        cut = next((m.end() for m in reversed(list(_END.finditer(line, 0, most))) if ends_sentence(line, m.start())), most)
        out.append(line[:cut])
        line = line[cut:]
    return [*out, line] if line else out


def line_chunks(text: str, size: int = CHUNK_SIZE, hard: int | None = None, sentences: bool = True) -> list[str]:
    """A chunk ends at a line whose digest falls on the divisor if it is longer than a quarter of ``size``, at any line that
    is not blank if it is longer than ``size``, and before a line with which it would be longer than ``hard`` (three sizes).
    Longer lines are cut after sentences, or with ``sentences`` off every ``hard`` characters."""
    hard = HARD_LIMIT * size if hard is None else hard
    out, held, length = [], [], 0
    for line in text.splitlines(keepends=True):
        n, blank = len(line), not line.strip()
        over = not blank and (length + n > hard or n > hard)
        if over and held:
            out.append("".join(held))
            held, length = [], 0
        if not blank and n > hard:
            out.extend(_pieces(line, hard) if sentences else [line[at : at + hard] for at in range(0, n, hard)])
            continue
        held.append(line)
        length += n
        if not blank and not over and (length > size or length > size // 4 and falls_on(line, size)):
            out.append("".join(held))
            held, length = [], 0
    return [*out, "".join(held)] if held else out


def zones(lines: list[str], size: int, hard: int) -> tuple[list[bool], set[int]]:
    """(whether each line is in a zone, lines before or after which a full chunk may end in a zone that is too long)."""
    inside, splits = [False] * len(lines), set()
    fenced = [False] * len(lines)
    i = 0
    while i < len(lines):  # fences first: what looks like a list in them is none
        mark = _FENCE.match(lines[i])
        if not mark:
            i += 1
            continue
        close = next((j for j in range(i + 1, len(lines)) if (m := _FENCE.match(lines[j])) and m[1][0] == mark[1][0] and len(m[1]) >= len(mark[1])), len(lines) - 1)
        for j in range(i, close + 1):
            inside[j] = fenced[j] = True
        if sum(map(len, lines[i : close + 1])) > hard:
            splits |= {j + 1 for j in range(i + 1, close + 1) if not lines[j].strip()}
        i = close + 1
    i = 0
    while i < len(lines):
        if fenced[i] or not _ITEM.match(lines[i]):
            i += 1
            continue
        end = i
        while end < len(lines) and not fenced[end] and (_ITEM.match(lines[end]) or not lines[end].strip()):
            end += 1
        for j in range(i, end):
            inside[j] = True
        if sum(map(len, lines[i:end])) > size:
            margin = [j for j in range(i, end) if (m := _ITEM.match(lines[j])) and not m[1]]
            splits |= set(margin[1:])
        i = end
    return inside, splits


def markdown_chunks(text: str, size: int = CHUNK_SIZE, hard: int | None = None, snap: int = SNAP) -> list[str]:
    """As the module says. Where a digest ends a chunk, whole lines go with it up to the end of the sentence, if that is near."""
    hard = HARD_LIMIT * size if hard is None else hard
    front = re.match(r"---\s*\n.*?\n---\s*\n", text, re.S)
    front_text, body = (front[0], text[front.end() :]) if front else ("", text)
    lines = body.splitlines(keepends=True)
    if not body.strip():
        return [front_text + body] if text else []
    inside, splits = zones(lines, size, hard)
    ends = [0]
    for line in lines:
        ends.append(ends[-1] + len(line))
    borders, begin, i = [], 0, 0  # numbers of lines before which a chunk ends
    while i < len(lines):
        if inside[i]:
            if ends[i] - ends[begin] > size and (i in splits or i + 1 in splits):
                borders.append(i)
                begin = i
        elif ends[i + 1] - ends[begin] >= size // 4:
            cut = falls_on(lines[i], size)
            if cut:
                stop = sentence_end(body, ends[i + 1], snap)
                while i + 1 < len(lines) and ends[i + 2] <= stop:
                    i += 1
            if cut or ends[i + 1] - ends[begin] > size:
                borders.append(i + 1)
                begin = i + 1
        i += 1
    cuts = [0, *borders, len(lines)]
    out = [body[ends[a] : ends[b]] for a, b in zip(cuts, cuts[1:]) if a < b]
    return [front_text + out[0], *out[1:]]
