"""Levels of the marks in a rule's text: (a), (1), (A), (i) and a second (1) under a capital, by looking at all that follow.

A mark such as (i) can be the ninth letter or the first roman number, and a line that begins with (2) can be the middle
of a sentence that was wrapped. So the marks of a rule are read together: a reading places each mark on a level, where it
is the next of its list, or keeps its line as plain text, and costs something where a line's indentation doesn't fit or
where a mark stays unplaced. The cheapest reading of the whole rule counts; the deeper place where two cost the same, and
then the other one is reported. Readings are followed side by side, at most ``BEAM`` of them, cheapest first: they part
only at a mark that can be read in two ways, and join again where they agree on what is open.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import accumulate

#: Levels from the outside in, and those that a level's list can hang on (none: on the rule itself).
LETTER, NUMBER, CAPITAL, ROMAN, INNER = range(5)
ABOVE = {LETTER: (), NUMBER: (LETTER,), CAPITAL: (NUMBER, LETTER), ROMAN: (CAPITAL, NUMBER, LETTER), INNER: (CAPITAL,)}
#: Levels that open only under one of others.
NEEDS = {ROMAN: (CAPITAL, NUMBER), INNER: (CAPITAL,)}
UNPLACED, MISFIT = 8, 1
BEAM = 64
#: Marks of a rule up to which it is remembered, and so many such rules.
SHORT, REMEMBERED = 64, 2048

#: Where Java's '$' holds too: before one last sign of a line's end.
_END = r"[\r\x85\u2028\u2029]?\Z"
RULE = re.compile(rf"Rule ([0-9]+(?:[.][0-9]+)?)[.]?(?: |{_END})", re.A)
MARKS = re.compile(r"\(([0-9]{1,3}|[A-Z]{1,2}|[a-z]{1,7})\)(?:\s*\(([0-9]{1,3}|[A-Z]{1,2}|[a-z]{1,7})\))?", re.A)
DOTTED = re.compile(rf"([0-9]{{1,2}}[.]|[A-Z][.]|[a-z][.]|[ivx]{{2,4}}[.]|\((?:[0-9]{{1,2}}|[A-Z]{{1,2}}|[a-z]{{1,5}})\))(?=\s|{_END})", re.A)
#: A line of a contents page: dot leaders and a page number.
LEADER = re.compile(rf"([.] ?){{4,}}\s*[0-9ivxlc]+{_END}", re.A)
_BREAK = re.compile(r"[\n\f]")

_ROMAN = re.compile(r"(?=.)c{0,1}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
_DIGITS = {"c": 100, "l": 50, "x": 10, "v": 5, "i": 1}

#: A level's state: the number of its last item and the indentation of its list; None: no list is open.
Levels = tuple[tuple[int, int] | None, ...]
EMPTY: Levels = (None,) * 5


@lru_cache(4096)
def roman_value(mark: str) -> int | None:
    """1 to 199 in lower-case roman numbers."""
    if not _ROMAN.fullmatch(mark):
        return None
    values = [_DIGITS[c] for c in mark]
    return sum(-v if v < max(values[i + 1 :], default=0) else v for i, v in enumerate(values))


@lru_cache(4096)
def letter_value(mark: str) -> int | None:
    """a is 1, z 26, aa 27, bb 28."""
    return (len(mark) - 1) * 26 + ord(mark[0].lower()) - 96 if len(set(mark)) == 1 else None


def _readings(mark: str, levels: Levels) -> list[tuple[int, int]]:
    """(level, number) of each list that the mark continues or opens, outermost first."""
    if mark.isdigit():
        options = [(NUMBER, int(mark)), (INNER, int(mark))]
    elif mark.isupper():
        options = [(CAPITAL, letter_value(mark))]
    else:
        options = [(LETTER, letter_value(mark)), (ROMAN, roman_value(mark))]
    out = []
    for level, n in options:
        if n is not None and (level not in NEEDS or any(levels[a] for a in NEEDS[level])) and n == (levels[level][0] if levels[level] else 0) + 1:
            out.append((level, n))
    return out


def _misfit(level: int, indent: int, levels: Levels) -> int:
    """Nothing where the indentation is the list's, or a new list stands further in than what it hangs on."""
    if levels[level]:
        return MISFIT * (indent != levels[level][1])
    holder = next((levels[a] for a in ABOVE[level] if levels[a]), None)
    return MISFIT * (holder is not None and indent <= holder[1])


def _placed(levels: Levels, level: int, n: int, indent: int) -> Levels:
    return (*levels[:level], (n, indent), *(None,) * (4 - level))


def place(marks: list[tuple[str, int]]) -> list[tuple[tuple[str, ...] | None, list[tuple[str, ...]]]]:
    """For each (mark, indentation) of a rule in order: its path of marks from the outermost level, None for plain text,
    and the paths that it has in other readings of the same cost."""
    # A reading: cost, levels, the marks open on each, the level of each mark so far (-1: text), other choices at that cost.
    readings = [(0, EMPTY, ("",) * 5, (), frozenset())]
    last = {mark: k for k, (mark, _) in enumerate(marks)}
    for k, (mark, indent) in enumerate(marks):
        again = last[mark] > k
        if len(readings) == 1:  # the usual case: one reading, which the mark goes on with in one way that costs nothing
            cost, levels, names, taken, others = readings[0]
            ways = _readings(mark, levels)
            if len(ways) == 1 and not _misfit(level := ways[0][0], indent, levels):
                readings = [(cost, _placed(levels, *ways[0], indent), (*names[:level], mark, *("",) * (4 - level)), (*taken, level), others)]
                continue
        found: dict[tuple, tuple] = {}
        for cost, levels, names, taken, others in readings:
            options = []
            for level, n in _readings(mark, levels):
                own = (*names[:level], mark, *("",) * (4 - level))
                options.append((cost + _misfit(level, indent, levels), _placed(levels, level, n, indent), own, (*taken, level), others))
            if not options or (again and all(o[0] > cost for o in options)):
                options.append((cost + UNPLACED, levels, names, (*taken, -1), others))
            for o in options:
                # What is open decides all that follows: of readings that agree on it only the cheapest is followed on.
                seen = found.get((o[1], o[2]))
                if seen is None or (o[0], _shallow(o[3])) < (seen[0], _shallow(seen[3])):
                    if seen is not None and seen[0] == o[0]:
                        o = (*o[:4], o[4] | seen[4] | _differences(seen[3], o[3]))
                    found[o[1], o[2]] = o
                elif seen[0] == o[0]:
                    found[o[1], o[2]] = (*seen[:4], seen[4] | o[4] | _differences(o[3], seen[3]))
        readings = sorted(found.values(), key=lambda r: (r[0], _shallow(r[3])))[:BEAM]
    best = readings[0]
    others = set(best[4])
    for r in readings[1:]:
        if r[0] == best[0]:
            others |= _differences(r[3], best[3])
    paths = _paths(marks, best[3])
    out: list[tuple[tuple[str, ...] | None, list[tuple[str, ...]]]] = []
    for k, path in enumerate(paths):
        wrong = [_paths(marks[: k + 1], (*best[3][:k], level))[k] for at, level in sorted(others) if at == k]
        out.append((path, [p for p in wrong if p is not None and p != path]))
    return out


def _shallow(taken: tuple[int, ...]) -> tuple[int, ...]:
    """Sorts the deeper of two readings first, at the first mark in which they differ."""
    return tuple(-x for x in taken)


def _differences(other: tuple[int, ...], own: tuple[int, ...]) -> frozenset[tuple[int, int]]:
    """Where another reading first parts from this one, and its level there."""
    return frozenset(next(([(k, a)] for k, (a, b) in enumerate(zip(other, own, strict=True)) if a != b), []))


def _paths(marks: list[tuple[str, int]], taken: tuple[int, ...]) -> list[tuple[str, ...] | None]:
    names, out = [""] * 5, []
    for (mark, _), level in zip(marks, taken, strict=False):
        if level < 0:
            out.append(None)
            continue
        names[level:] = [mark, *[""] * (4 - level)]
        out.append(tuple(x for x in names if x))
    return out


def _joined(marks: list[tuple[str, int]]) -> list[tuple[str | None, list[str]]]:
    """``place``, with each path as one string."""
    return [("-".join(path) if path else None, ["-".join(p) for p in others]) for path, others in place(marks)]


@lru_cache(REMEMBERED)
def _remembered(marks: tuple[tuple[str, int], ...]) -> list[tuple[str | None, list[str]]]:
    """The same for a rule that is marked as one before was: many are."""
    return _joined(list(marks))


#: A list in an outline of dots: how its marks are written (with a dot, or in brackets) and what they count in.
Style = tuple[bool, str]


def _styles(dot: bool, mark: str) -> list[tuple[Style, int]]:
    if mark.isdigit():
        return [((dot, "number"), int(mark))]
    if mark.isupper():
        return [((dot, "capital"), letter_value(mark))] if len(mark) == 1 else []
    out = [((dot, "letter"), letter_value(mark))] if len(mark) == 1 else []
    return out + ([((dot, "roman"), n)] if (n := roman_value(mark)) else [])


def place_dotted(marks: list[tuple[bool, str]]) -> list[tuple[tuple[str, ...] | None, list[tuple[str, ...]]]]:
    """Paths of the marks of an outline ('A.', '1.', 'a.', 'i.', and marks in brackets under them), given as (dot, mark). A
    mark goes on with an open list of its style whose next it is, the deepest one if several, or opens a list one level
    deeper if it is a first one and no open list has its style. The reading that places most marks counts; indentation
    plays no part, as outlines are often indented unevenly."""
    # A reading: marks unplaced, the open lists as (style, number, mark), the paths so far.
    readings: list[tuple[int, tuple, tuple]] = [(0, (), ())]
    for dot, mark in marks:
        found: dict[tuple, tuple] = {}
        for lost, open_, paths in readings:
            moves = []
            for style, n in _styles(dot, mark):
                moves += [(-d, (*open_[:d], (style, n, mark))) for d, (s, last, _) in enumerate(open_) if s == style and last + 1 == n]
                if n == 1 and all(s != style for s, *_ in open_):
                    moves.append((1, (*open_, (style, 1, mark))))
            for _, after in sorted(moves, key=lambda m: m[0]):
                found.setdefault(after, (lost, after, (*paths, tuple(m for *_, m in after))))
            if not moves:
                found.setdefault(open_, (lost + 1, open_, (*paths, None)))
        readings = sorted(found.values(), key=lambda r: r[0])[:BEAM]
    best = readings[0]
    rivals = [r for r in readings[1:] if r[0] == best[0]]
    return [(path, sorted({r[2][k] for r in rivals if r[2][k] and r[2][k] != path and r[2][:k] == best[2][:k]})) for k, path in enumerate(best[2])]


def openings(lines: list | None, dotted: bool = False) -> list[list[dict] | None]:
    """For each line's (rule, mark, sub, indent), null if it has none: the sections that it opens, outermost first, as
    anchor and other readings. A rule's number must be higher than the last one's: a line that begins with an earlier rule
    is a cross-reference. A second mark, as in '(A)(i)', opens a section of its own if it begins a list under the first."""
    out: list[list[dict] | None] = [None] * len(lines or [])
    rule, last = None, ()
    own: list[int] = []

    def close() -> None:
        if dotted:
            read = place_dotted([(lines[i]["mark"].endswith("."), lines[i]["mark"].strip("().")) for i in own])
            for i, (path, others) in zip(own, read, strict=True):
                out[i] = [{"anchor": "-".join([rule, *path]), "others": ["-".join([rule, *p]) for p in others]}] if path else None
            own.clear()
            return
        marks: list[tuple[str, int]] = []
        for i in own:
            x = lines[i]
            marks.append((x["mark"], x["indent"]))
            if x["sub"] and _begins(x["mark"], x["sub"]):
                marks.append((x["sub"], x["indent"] + 1))
        found = iter((_remembered(tuple(marks)) if len(marks) <= SHORT else _joined(marks)) if marks else ())
        for i in own:
            opened = []
            for _ in range(2 if lines[i]["sub"] and _begins(lines[i]["mark"], lines[i]["sub"]) else 1):
                path, others = next(found)
                if path:
                    opened.append({"anchor": f"{rule}-{path}", "others": [f"{rule}-{p}" for p in others]})
            out[i] = opened or None
        own.clear()

    for i, x in enumerate(lines or []):
        if x is None:
            continue
        if x["rule"] and (number := tuple(map(int, x["rule"].split(".")))) > last:
            close()
            rule, last = x["rule"], number
            out[i] = [{"anchor": rule, "others": []}]
        elif x["mark"] and rule:
            own.append(i)
    close()
    return out


def feature(raw: str, dotted: bool) -> dict | None:
    """rule, mark, sub and indent of a line; None if it has neither rule nor mark."""
    line = raw.replace("\t", " ").strip(" ")
    if not dotted and line[:1] not in ("(", "R"):
        return None
    mark = (DOTTED if dotted else MARKS).match(line)
    rule = RULE.match(line) if line.startswith("Rule ") and not LEADER.search(line) else None
    if not rule and not mark:
        return None
    wide = raw.replace("\t", " " * 8)
    return {"rule": rule and rule[1], "mark": mark and mark[1], "sub": mark[2] if mark and not dotted else None, "indent": len(wide) - len(wide.lstrip(" "))}


def opened(text: bytes | None, dotted: bool = False) -> dict | None:
    """Of a rules text: how many of its lines up to each one open sections, and what those lines open, with the other readings."""
    if text is None:
        return None
    # Bytes that aren't UTF-8 are no marks.
    found = openings([feature(x, dotted) for x in _BREAK.split(bytes(text).decode(errors="replace"))], dotted)
    own = [o for o in found if o]
    return {"upto": list(accumulate(1 if o else 0 for o in found)), "opens": [[y["anchor"] for y in o] for o in own], "others": [[z for y in o for z in y["others"]] for o in own]}


def ends(depths: list[int] | None) -> list[dict]:
    """For each of a list of depths its place (i) and that of the next one that is as deep or less (j)."""
    out = [{"i": i, "j": None} for i in range(len(depths or []))]
    open_: list[int] = []
    for i, d in enumerate(depths or []):
        while open_ and depths[open_[-1]] >= d:
            out[open_.pop()]["j"] = i
        open_.append(i)
    return out


def first_ends(anchors: list[str] | None) -> list[dict]:
    """The same for a text's anchors in order, the first of each alone."""
    first: dict[str, int] = {}
    for i, a in enumerate(anchors or []):
        first.setdefault(a, i)
    at = list(first.values())
    return [{"i": at[x["i"]], "j": None if x["j"] is None else at[x["j"]]} for x in ends([a.count("-") for a in first])]


def _begins(mark: str, sub: str | None) -> bool:
    """Whether the second of two marks begins a list that can hang right under the first."""
    if not sub:
        return False
    if mark.isdigit():
        return sub in ("A", "i")
    return sub in ("1", "i") if mark.isupper() else sub in ("1", "A")
