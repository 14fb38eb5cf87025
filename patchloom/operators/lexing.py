"""Where blocks, literals and comments of a source text lie, language by language.

A lexer is a pattern per mode, tried from one place of interest to the next, and a stack
of modes: an interpolated literal enters code again and is left where that code ends.
What a pattern cannot count (raw-string marks, nested comments, here-documents) is found
from the place where it opens. Only places are returned; texts never leave their row.

Quoted literals end with their line in languages where they must; one that never ends
masks the rest of its line, or of the file where it may hold newlines.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np

# Kinds are the group names of the patterns: ``skip`` is a finished literal or comment,
# ``cut`` one that never ends, ``open`` and ``close`` are block marks, the others name a handler.
_LINE = r"(?P<skip1>//[^\n]*+)"
_BLOCK = r"(?P<skip2>/\*[\s\S]*?\*/)"
_MARKS = r"(?P<open>\{)|(?P<close>\})"
# One line only, and over lines; a backslash guards what follows it.
_DOUBLE, _SINGLE = r'"(?:[^"\\\n]|\\[\s\S])*+"', r"'(?:[^'\\\n]|\\[\s\S])*+'"
_LONG_DOUBLE, _LONG_SINGLE = r'"(?:[^"\\]|\\[\s\S])*+"', r"'(?:[^'\\]|\\[\s\S])*+'"
_TRIPLE_DOUBLE, _TRIPLE_SINGLE = (rf"{3 * q}(?:[^{q}\\]|\\[\s\S]|{q}(?!{2 * q}))*+{3 * q}" for q in (chr(34), chr(39)))
_QUOTED = rf"(?P<skip3>{_DOUBLE}|{_SINGLE})|(?P<cutline>[\"'])"
_CUT = r"(?P<cut>/\*)"


def _rules(*parts: str) -> re.Pattern:
    return re.compile("|".join(parts), re.MULTILINE)


_SCRIPT = [_LINE, _BLOCK, _CUT, _QUOTED, r"(?P<template>`)", r"(?P<slash>/)", _MARKS]
_C = [_LINE, _BLOCK, _CUT, r"(?P<skip4>(?<=\d)(?<!\bu8)'(?=[0-9a-fA-F]))", _QUOTED, _MARKS]
_RUBY_WORDS = r"class|module|def|begin|case|do|if|unless|while|until|for|end"
RULES = {
    "javascript": {"code": _rules(*_SCRIPT), "template": _rules(r"(?P<skip1>\\[\s\S])", r"(?P<hole>\$\{)", r"(?P<leave>`)")},
    "java": {"code": _rules(_LINE, _BLOCK, _CUT, r'(?P<skip4>"""(?:[^"\\]|\\[\s\S]|"(?!""))*+""")|(?P<cut2>""")', _QUOTED, _MARKS)},
    "c": {"code": _rules(*_C)},
    "cpp": {"code": _rules(r'(?P<raw>\b(?:u8|[uUL])?R"(?P<mark>[^()\\\s"]{0,16})\()', *_C)},
    "go": {"code": _rules(_LINE, _BLOCK, _CUT, r"(?P<skip4>`[^`]*+`)|(?P<cut2>`)", _QUOTED, _MARKS)},
    "rust": {"code": _rules(
        _LINE, r"(?P<deep>/\*)", r'(?P<raw>\b(?:b|c)?r(?P<mark>#*)")', r"(?P<skip4>'(?:\\[^\n]{1,9}?|[^'\\\n])')",
        r"(?P<skip5>'[^\W\d]\w*)", rf'(?P<skip3>{_LONG_DOUBLE})|(?P<cut>")', _MARKS)},
    "php": {
        "code": _rules(
            r"(?P<html>\?>)", r"(?P<skip1>(?://|#(?!\[))(?:(?!\?>)[^\n])*+)", _BLOCK, r"(?P<here><<<[ \t]*(?P<quote>[\"']?)(?P<mark>\w+)(?P=quote)\n)",
            rf"(?P<skip3>{_LONG_DOUBLE}|{_LONG_SINGLE}|`[^`]*+`)|(?P<cut>[\"'`]|/\*)", _MARKS),
        "page": _rules(r"(?P<leave><\?(?:php\b|=))")},
    "python": {"code": _rules(
        r"(?P<skip1>#[^\n]*+)", rf"(?P<skip2>{_TRIPLE_DOUBLE}|{_TRIPLE_SINGLE})", rf"(?P<cut>{3 * chr(34)}|{3 * chr(39)})",
        _QUOTED, r"(?P<join>\\\n)", r"(?P<open>[(\[{])|(?P<close>[)\]}])")},
    "ruby": {
        "code": _rules(
            r"(?P<skip1>#[^\n]*+)", r"(?P<skip2>^=begin\b[\s\S]*?^=end\b[^\n]*|^__END__$[\s\S]*)", r"(?P<here><<[~-]?(?P<quote>[\"'`]?)(?P<mark>[A-Z_]\w*)(?P=quote))",
            r'(?P<string>")|(?P<shell>`)', rf"(?P<skip3>{_LONG_SINGLE})|(?P<cut>')", r"(?P<percent>%[qQwWiI]?(?P<fence>[(\[{<|!/]))",
            r"(?P<slash>/)", r"(?P<hash>\{)|(?P<unhash>\})", rf"(?P<word>(?<![\w.:@$])(?:{_RUBY_WORDS})(?![\w?!=]|:(?!:)))"),
        "string": _rules(r"(?P<skip1>\\[\s\S])", r"(?P<hole>#\{)", r'(?P<leave>")'),
        "shell": _rules(r"(?P<skip1>\\[\s\S])", r"(?P<hole>#\{)", r"(?P<leave>`)")},
}
RULES["typescript"] = RULES["javascript"]
LANGUAGES = sorted(RULES)
# Modes of a literal that code can interrupt.
_LITERALS = ("template", "string", "shell")

_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*")
_WORD_BEFORE = re.compile(r"[\w$]+\Z")
# Words after which a slash begins a pattern and not a division.
_BEFORE_REGEX = {
    "return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "if", "unless", "while", "until", "when", "and", "or", "not"}
_RUBY_STARTS = {"then", "else", "do", "begin", "and", "or", "not", "in", "ensure", "rescue"}
_ENDLESS = re.compile(r"def\s+(?:[\w.]+[?!]?|[^\s\w(]+)\s*(?:\([^)\n]*\))?\s+=(?![=~>])\s")
_FENCES = {"(": ")", "[": "]", "{": "}", "<": ">"}
_DEEP = re.compile(r"/\*|\*/")


class Lexed(NamedTuple):
    """Places of block marks with +1 or -1, spans of literals and comments, whether one never ends."""

    at: np.ndarray
    step: np.ndarray
    spans: np.ndarray
    open: bool


def _before(text: str, at: int) -> str:
    """What stands before a place on its line, without trailing blanks."""
    return text[text.rfind("\n", 0, at) + 1 : at].rstrip(" \t")


def _regex_end(text: str, at: int) -> int:
    """End of the pattern that a slash at ``at`` begins, or of the slash where it divides."""
    before = _before(text, at)
    word = _WORD_BEFORE.search(before)
    if before and (word and word.group() not in _BEFORE_REGEX or before[-1] in ")]\"'`"):
        return at + 1
    found = _REGEX.match(text, at)
    return found.end() if found else at + 1


def _fenced(text: str, at: int, fence: str) -> int:
    """End of a literal between fences, which nest where they are a pair; -1 if it never ends."""
    close, depth = _FENCES.get(fence, fence), 1
    for found in re.compile(rf"\\[\s\S]|[{re.escape(fence + close)}]").finditer(text, at):
        mark = found.group()
        if len(mark) == 1:
            depth += 1 if mark == fence != close else -1
            if not depth:
                return found.end()
    return -1


def _deep_end(text: str, at: int) -> int:
    depth = 0
    for found in _DEEP.finditer(text, at):
        depth += 1 if found.group() == "/*" else -1
        if not depth:
            return found.end()
    return -1


def lex(language: str, text: str) -> Lexed:
    rules = RULES[language]
    at: list[int] = []
    step: list[int] = []
    spans: list[tuple[int, int]] = []
    mode, stack = "code", []  # suspended (mode, where its literal began, blocks open in the code inside it)
    begun, depth, loop = 0, 0, -1
    pos, end, later = 0, len(text), []  # later: (end of line, where a here-document on it ends)
    never = False
    if language == "php" and re.search(r"<\?(?:php\b|=)", text):
        mode = "page"

    while pos < end:
        stop = later[0][0] if later else end
        found = rules[mode].search(text, pos, stop)
        if found is None:
            if not later:
                break
            spans.append((stop, later[0][1]))
            pos = later.pop(0)[1]
            continue
        kind, start, pos = found.lastgroup, found.start(), found.end()
        if kind.startswith("skip"):
            if mode == "code":
                spans.append((start, pos))
        elif kind == "open":
            at.append(start)
            step.append(1)
            depth += 1
        elif kind in ("close", "unhash"):
            if stack and depth == 0:
                mode, _, depth = stack.pop()
                begun = start
            else:
                depth -= 1
                if kind == "close":
                    at.append(start)
                    step.append(-1)
        elif kind == "join":
            spans.append((start, pos + 1))  # the line behind belongs to this one
        elif kind == "hash":
            depth += 1
        elif kind in _LITERALS:
            stack.append((mode, start, depth))
            mode, begun = kind, start
        elif kind == "hole":
            spans.append((begun, pos))
            stack.append((mode, pos, depth))
            mode, depth = "code", 0
        elif kind == "leave":
            if mode == "page":
                mode = "code"
            else:
                spans.append((begun, pos))
                mode, begun, depth = stack.pop()
        elif kind == "html":
            mode = "page"
        elif kind == "cutline":
            never = True
            line = text.find("\n", pos)
            pos = end if line < 0 else line
            spans.append((start, pos))
        elif kind == "slash":
            pos = _regex_end(text, start)
            if pos > start + 1:
                spans.append((start, pos))
        elif kind == "word":
            loop, change = _ruby_step(text, found, loop)
            if change:
                at.append(start)
                step.append(change)
            if change == 1 and _ENDLESS.match(text, start):
                line = text.find("\n", start)
                at.append(end if line < 0 else line)  # the body ends with its line
                step.append(-1)
        else:
            if kind == "raw":
                closing = ")" + found["mark"] + '"' if language == "cpp" else '"' + found["mark"]
                there = text.find(closing, pos)
                pos = there + len(closing) if there >= 0 else -1
            elif kind == "here":
                first = later[-1][1] if later else text.find("\n", pos if language == "ruby" else pos - 1) + 1
                there = re.compile(rf"^[ \t]*{found['mark']}\b", re.MULTILINE).search(text, first) if first else None
                if there and language == "ruby":
                    line = text.find("\n", pos)
                    later.append((line, there.end()))
                    continue
                if language == "ruby":
                    continue  # no such end: a shift
                pos = there.end() if there else -1
            elif kind == "percent":
                pos = _fenced(text, pos, found["fence"])
            elif kind == "deep":
                pos = _deep_end(text, start)
            else:
                pos = -1
            never, pos = never or pos < 0, end if pos < 0 else pos
            spans.append((start, pos))
    if mode in _LITERALS or any(m in _LITERALS for m, _, _ in stack):
        never = True
        if mode != "code":
            spans.append((begun, end))
    order = np.argsort(np.array(at, np.int64), kind="stable")
    return Lexed(np.array(at, np.int64)[order], np.array(step, np.int64)[order], np.array(sorted(spans), np.int64).reshape(-1, 2), never)


def _ruby_step(text: str, found: re.Match, loop: int) -> tuple[int, int]:
    """Whether a keyword opens or ends a block; ``loop`` is the end of a loop's line, whose ``do`` is its own."""
    word, start = found.group(), found.start()
    if word == "end":
        return loop, -1
    if word == "do" and start < loop:
        return -1, 0
    if word in ("if", "unless", "while", "until"):
        before = _before(text, start)
        last = _WORD_BEFORE.search(before)
        if before and before[-1] not in "=([{,;|&!" and not (last and last.group() in _RUBY_STARTS):
            return loop, 0
    if word in ("while", "until", "for"):
        line = text.find("\n", start)
        loop = len(text) if line < 0 else line
    return loop, 1


def partners(step: np.ndarray) -> np.ndarray:
    """For each opening mark the index of its closing one, else -1.

    Both stand on the level that the excess of openings has after the first; the
    partner is the next mark on that level."""
    excess = np.cumsum(step)
    level = np.where(step > 0, excess, excess + 1)
    order = np.argsort(level, kind="stable")
    found = np.full(len(step), -1, np.int64)
    if len(step) > 1:
        here, there = order[:-1], order[1:]
        pair = (level[here] == level[there]) & (step[here] > 0) & (step[there] < 0)
        found[here[pair]] = there[pair]
    return found


def line_starts(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate([[0], np.flatnonzero(codes == 10) + 1])


def continued_lines(language: str, text: str) -> np.ndarray:
    """For each line whether it begins inside a literal, between marks of a pair, or as the rest of
    the line before. Marks without a partner hold nothing together."""
    found, starts = lex(language, text), line_starts(text)
    inside = np.zeros(len(starts), bool)
    if len(found.spans):
        held = np.searchsorted(found.spans[:, 0], starts) - 1
        inside = (held >= 0) & (np.maximum.accumulate(found.spans[:, 1])[held] > starts)
    pair = partners(found.step)
    opens = np.flatnonzero(pair >= 0)
    change = np.zeros(len(found.at) + 1, np.int64)
    np.add.at(change, opens + 1, 1)
    np.add.at(change, pair[opens] + 1, -1)
    # pairs that are open before each line
    return inside | (np.cumsum(change)[np.searchsorted(found.at, starts)] > 0)


def bodies(language: str, text: str, lines: list[int]) -> list[tuple[int | None, bool, bool]]:
    """For units that begin on ``lines`` (from 1, ascending): the line on which their block
    ends, whether the unit lies inside an earlier one, and whether its line begins inside a
    literal or comment. The block is the first one that opens on the line or after it."""
    if not lines:
        return []
    found = lex(language, text)
    starts = line_starts(text)
    place = starts[np.asarray(lines, np.int64) - 1]
    opens = np.flatnonzero(found.step > 0)
    pair = partners(found.step)
    nth = np.searchsorted(found.at[opens], place)
    out, reached = [], 0
    inside = np.zeros(len(place), bool)
    if len(found.spans):
        # spans come in order of their starts; the furthest end so far covers what is nested
        held = np.searchsorted(found.spans[:, 0], place) - 1
        inside = (held >= 0) & (np.maximum.accumulate(found.spans[:, 1])[held] > place)
    for k, masked in zip(nth.tolist(), inside.tolist()):
        close = int(pair[opens[k]]) if k < len(opens) else -1
        if close < 0:
            out.append((None, False, masked))
            continue
        line = int(np.searchsorted(starts, found.at[close], side="right"))
        out.append((line, not masked and line <= reached, masked))
        if not masked:
            reached = max(reached, line)
    return out
