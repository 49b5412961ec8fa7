"""Facts of Go files, a file at a time.

The tokens are those of ``lexis.LEXIS``; see ``rust`` for the three passes.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache
from itertools import accumulate, repeat
from typing import NamedTuple

from cartograph.operators.files import FAR, TRIVIA, before, behind, class_of, is_trivia

# Words that are never the name of a called function.
KEYWORDS = (
    "break case chan const continue default defer else fallthrough for func go goto if import "
    "interface map package range return select struct switch type var"
).split()

_NEVER = frozenset(KEYWORDS)
_CLOSING = frozenset(")]}")
_OPEN_P, _OPEN_S, _OPEN_B, _CLOSE, _END, _FUNC, _TYPED, _MARKED, _NAMED = range(9)
_SORTS = {
    "(": _OPEN_P, "[": _OPEN_S, "{": _OPEN_B, ")": _CLOSE, "]": _CLOSE, "}": _CLOSE, ";": _END, "func": _FUNC,
    "struct": _TYPED, "interface": _TYPED, "type": _MARKED, "var": _MARKED, "const": _MARKED, "import": _MARKED,
}

# ------------------------------------------------------------------ lexing


@cache
def _lexis(plain: bool) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """The tokens of ``lexis.LEXIS['go']``, a whole name, and what type arguments start with.

    ``plain`` is for texts of ASCII alone, where the classes of letters are short. What is most
    frequent stands first: blanks, names, and signs that begin no other token.
    """
    letters, numbers, digits = ("a-zA-Z", "0-9", "0-9") if plain else map(class_of, ("L", "N", "Nd"))
    name = rf"[{letters}_$][{letters}{numbers}_$]*+"
    word = "[a-zA-Z0-9_]"
    rules = [
        r"[ \t\n\x0B\f\r\ufeff]++",
        name,
        r"[(){}\[\];,.#?@+*%^~\\]",
        r'"[\s\S]*?(?<!\\)(?:\\\\)*+(?:"|(?<!\\\r)(?=\r?\n)|\Z)',
        r"`[^`]*+(?:`|\Z)",
        r"'(?:[^'\\\r\n]|\\[^\r\n][^'\r\n]{0,10})'",
        r"//[^\r\n]*+",
        r"/\*[\s\S]*?(?:\*/|\Z)",
        rf"[{digits}]{word}*+(?:\.[{digits}]{word}*+)?+",
        r":=|<-|<=|>=|==|!=|&&|\|\|",
        r"[\s\S]",
    ]
    return re.compile("|".join(rules)), re.compile(rf"(?:r#)?{name}"), re.compile(rf"[{letters}_*\[]")


def lexed(text: str) -> tuple[list[str], Callable, Callable]:
    """The tokens of a text, and the tests whether one is an identifier or keyword, or a type's start."""
    tokens, name, type_start = _lexis(text.isascii())
    return tokens.findall(text), name.fullmatch, type_start.match


# ------------------------------------------------------------------ rules


class _Mark(NamedTuple):
    """The latest word that decides how later tokens read, and its neighbours."""

    pos: int
    line: int
    tok: str
    depth: int
    n1: str | None
    # The type parameters behind the name that is declared.
    generic: bool


def file_facts(path: str, text: str) -> list[tuple]:
    """Values of ``files.OWN`` for each declaration, call and import of a file, in the order of the text."""
    toks, is_name, starts_type = lexed(text)
    lines = list(accumulate(map(str.count, toks, repeat("\n")), initial=1))

    def word(place: int | None) -> str | None:
        return toks[place] if place is not None and place >= 0 else None

    def breaks(place: int) -> bool:
        """A line break before: comments that have none are passed over."""
        place -= 1
        while place >= 0 and toks[place][0] in TRIVIA and is_trivia(toks[place]):
            if "\n" in toks[place]:
                return toks[place][0] != "/"
            place -= 1
        return place < 0

    def marked(k: int, depth: int) -> _Mark:
        n1, generic = behind(toks, k), False
        if toks[k] == "type" and n1 is not None:
            n2 = behind(toks, n1)
            if word(n2) == "[":
                n3 = behind(toks, n2)
                if n3 is not None and is_name(toks[n3]):
                    n4 = behind(toks, n3)
                    generic = word(n4) != "]"
        return _Mark(k, lines[k], toks[k], depth, word(n1), generic)

    def method(k: int, at1: int, depth: int, mark: _Mark | None) -> bool:
        """Whether a name that a parenthesis follows stands behind a receiver."""
        return (
            at1 >= 0 and toks[at1] == ")" and lines[k] == lines[at1]
            and mark is not None and mark.tok == "func" and mark.n1 == "(" and mark.depth == depth
        )

    def type_head(k: int, at1: int, depth: int, mark: _Mark | None) -> bool:
        """Whether ``struct`` or ``interface`` is the body of a declared type."""
        if mark is None or mark.tok != "type" or at1 < 0:
            return False
        p1, at2 = toks[at1], before(toks, at1)
        p2 = word(at2)
        if p2 == "type" or (p1 == "]" and mark.depth == depth and mark.generic):
            return True
        return (
            mark.n1 == "(" and depth == mark.depth + 1 and is_name(p1) is not None
            and (p2 == "(" or p2 == ";" or breaks(at1))
        )

    # Rows (sort, place, depth, mark, more), in the order of the text.
    rows: list[tuple] = []
    add = rows.append
    depth, mark, imported = 0, None, set()
    for k, sort in enumerate(map(_SORTS.get, toks)):
        if sort is None:
            if imported and k in imported:
                add((_NAMED, k, depth, mark, (None, toks[k], mark.line, False, True, False)))
            continue
        if sort == _CLOSE:
            depth -= 1
            add((_CLOSE, k, depth, mark, None))
        elif sort <= _OPEN_B:
            at1, more = before(toks, k), None
            if at1 >= 0:
                p1 = toks[at1]
                if sort == _OPEN_B:
                    more = p1 in ("interface", "struct")
                elif p1 not in _SORTS and is_name(p1):
                    at2 = before(toks, at1)
                    p2 = word(at2)
                    head = "go_method" if sort == _OPEN_P and method(at1, at2, depth, mark) else None
                    call = p2 != "." and p2 != "func" and lines[k] == lines[at1] and p1 not in _NEVER
                    if call and sort == _OPEN_S:
                        n2 = behind(toks, k)
                        call = p2 != "type" and n2 is not None and starts_type(toks[n2]) is not None
                    if head or call:
                        start = mark.line if mark else None
                        add((_NAMED, at1, depth, mark, (head, p1, start, call, False, sort == _OPEN_S)))
                elif sort == _OPEN_P and p1 == "type":
                    more = lines[at1]
            add((sort, k, depth, mark, more))
            depth += 1
        elif sort == _END:
            add((_END, k, depth, mark, None))
        else:
            if sort != _TYPED:
                mark = marked(k, depth)
            tok, n1 = toks[k], behind(toks, k)
            if tok == "import" and n1 is not None:
                n2 = behind(toks, n1)
                if toks[n1][0] == '"':
                    imported.add(n1)
                if n2 is not None and toks[n1] != "(" and toks[n2][0] == '"':
                    imported.add(n2)
            if sort == _FUNC and n1 is not None and is_name(toks[n1]):
                add((_NAMED, k, depth, mark, ("go_func", toks[n1], mark.line, False, False, False)))
                continue
            at1 = before(toks, k)
            if word(n1) == "(" and method(k, at1, depth, mark):
                name = toks[n1] if tok == "func" else tok
                start = mark.line
                if sort == _TYPED:
                    name = mark.n1 if word(at1) == "]" else word(at1)
                    start = None if tok == "struct" else lines[at1]
                add((_NAMED, k, depth, mark, ("go_method", name, start, False, False, False)))
            elif sort == _TYPED and word(n1) == "{" and type_head(k, at1, depth, mark):
                bracket = toks[at1] == "]"
                name = mark.n1 if bracket else toks[at1]
                if tok == "struct":
                    # In a type group it takes the group's lines.
                    head, start = "go_struct", None if mark.n1 == "(" else mark.line
                else:
                    head, start = "go_iface", mark.line if bracket else lines[at1]
                add((_NAMED, k, depth, mark, (head, name, start, False, False, False)))

    # Backwards: the nearest of each sort behind a row at its depth.
    pairs: dict[int, int] = {}
    lists: dict[int, tuple] = {}
    squares: dict[int, int] = {}
    stops: dict[int, tuple] = {}
    nothing = (None, None)
    following = None
    kept: list[tuple] = []
    for sort, k, depth, mark, more in reversed(rows):
        if sort == _CLOSE:
            pairs[depth] = k
        elif sort == _OPEN_P:
            pair = pairs.get(depth)
            if more is not None:
                kept.append((k, more, pair))
            lists[depth] = (k, pair)
        elif sort == _OPEN_S:
            if depth in pairs:
                squares[depth] = pairs[depth]
        elif sort == _OPEN_B:
            if not more:
                stops[depth] = ("{", pairs.get(depth))
        elif sort == _END:
            stops[depth] = (";", k)
        else:
            head, name, start, call, imports, indexed = more
            what, end = stops.get(depth, nothing)
            opened, closed = lists.get(depth, nothing)
            valid = head
            if head == "go_struct" or head == "go_iface":
                end = pairs.get(depth)
            elif head is not None and what != "{":
                valid = None
            if call and head is None and indexed:
                square = squares.get(depth)
                then = None
                if square is not None and toks[square] != "}":
                    then = word(behind(toks, square))
                call = then == "("
            if valid is not None or imports or (call and head is None):
                call = call and head is None
                kept.append((k, None, valid, name, start, call, imports, mark, opened, closed, following, end))
            if head is not None:
                stops[depth] = ("head", k)
            if valid is not None:
                following = k

    # Forwards: the type group before.
    out, group = [], None
    for k, *fact in reversed(kept):
        if len(fact) == 2:
            group = fact
            continue
        _, head, name, start, call, imports, mark, opened, closed, following, end = fact
        line, last = lines[k], None
        if head is None:
            end, last = None, lines[k + 1]
        elif head == "go_struct" and start is None:
            if group is not None:
                start, last = group[0], None if group[1] is None else lines[group[1]]
        elif head == "go_iface":
            last = start
        if last is None and end is not None:
            last = lines[end]
        if last is None:
            last = line if following is None else max(line, lines[following] - 1)
        if end is None:
            end = FAR if following is None else following - 1
        function = head == "go_func" or head == "go_method"
        params = "".join(toks[opened : closed + 1]) if function and closed is not None else None
        out.append(
            (path, k, toks[k], head, name, call, imports, mark.pos if mark else None, line, start, last,
             closed if function else k, end, opened, closed, params)
        )
    return out
