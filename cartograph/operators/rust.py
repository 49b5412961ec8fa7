"""Facts of Rust files, a file at a time.

The tokens are those of ``lexis.LEXIS``. Each file is lexed and read in its Python task: once forwards for depths, once
backwards, where what follows a token at its depth is known, and once more over the few rows that
are left for what encloses them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache
from itertools import accumulate, repeat

from cartograph.functions.lexis import COMMENT_DEPTH
from cartograph.operators.files import FAR, before, behind, class_of

# Words that are never the name of a called function.
KEYWORDS = (
    "as break const continue crate else enum extern fn for if impl in let loop match mod move "
    "mut pub ref return self static struct super trait type unsafe use where while async await "
    "dyn box yield"
).split()

_NEVER = frozenset(KEYWORDS)
_ARM = frozenset(",{}|")
_CLOSING = frozenset(")]}")
_NOT_CALLED_AFTER = frozenset((".", "::", "fn", "!"))
_OPEN_P, _OPEN_S, _OPEN_B, _CLOSE, _END, _DECLARED, _LET, _FOR, _IN, _EQUAL, _LESS, _MORE, _CALLED = range(13)
_SORTS = {
    "(": _OPEN_P, "[": _OPEN_S, "{": _OPEN_B, ")": _CLOSE, "]": _CLOSE, "}": _CLOSE, ";": _END, "fn": _DECLARED,
    "struct": _DECLARED, "let": _LET, "for": _FOR, "in": _IN, "=": _EQUAL, "<": _LESS, ">": _MORE,
}

# ------------------------------------------------------------------ lexing


def _nested_comment() -> str:
    plain = r"[^*/]++|\*(?!/)|/(?!\*)"
    inner = rf"/\*(?:{plain})*+(?:\*/|\Z)"
    for _ in range(COMMENT_DEPTH - 1):
        inner = rf"/\*(?:{plain}|{inner})*+(?:\*/|\Z)"
    return inner


@cache
def _lexis(plain: bool, raw: bool) -> tuple[re.Pattern, re.Pattern]:
    """The tokens of ``lexis.LEXIS['rust']`` and a whole name.

    ``plain`` is for texts of ASCII alone, where the classes of letters are short; ``raw`` for texts
    with raw strings, whose rule has the one group. What is most frequent stands first: blanks, names
    that can't begin a literal, and signs that begin no other token.
    """
    letters, numbers, digits = ("a-zA-Z", "0-9", "0-9") if plain else map(class_of, ("L", "N", "Nd"))
    some = "ad-qs-zA-Z" if plain else f"(?![bcr])[{letters}_$]"
    first = f"[{some}_$]" if plain else some
    name = rf"[{letters}_$][{letters}{numbers}_$]*+"
    word = "[a-zA-Z0-9_]"
    rules = [
        r"[ \t\n\x0B\f\r\ufeff]++",
        rf"{first}[{letters}{numbers}_$]*+",
        r"[(){}\[\];,#?@+*%^~`\\]",
        *([r'[bc]?r(#{0,255})"[\s\S]*?(?:"\1|\Z)'] if raw else []),
        r'[bc]?+"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+(?:"|\Z)',
        r"b?'(?:[^'\\\r\n]|\\(?:u\{[0-9a-fA-F_]*+\}|x[0-9a-fA-F]{2}|[^ux\r\n]))'",
        rf"'[{letters}_]{word}*+",
        r"//[^\r\n]*+",
        _nested_comment(),
        rf"(?:r#)?+{name}",
        rf"[{digits}]{word}*+(?:\.[{digits}]{word}*+)?+",
        r"->|=>|::|<=|>=|==|!=|&&|\|\||\.\.",
        r"[\s\S]",
    ]
    return re.compile("|".join(rules)), re.compile(rf"(?:r#)?{name}")


def lexed(text: str) -> tuple[list[str], Callable]:
    """The tokens of a text, and the test whether one is an identifier or keyword."""
    raw = 'r"' in text or '#"' in text
    tokens, name = _lexis(text.isascii(), raw)
    toks = [m.group() for m in tokens.finditer(text)] if raw else tokens.findall(text)
    return toks, name.fullmatch


# ------------------------------------------------------------------ rules


def file_facts(path: str, text: str) -> list[tuple]:
    """Values of ``files.OWN`` for each declaration and call of a file, in the order of the text."""
    toks, is_name = lexed(text)
    lines = list(accumulate(map(str.count, toks, repeat("\n")), initial=1))

    # Rows (sort, place, depth, mark, flag), in the order of the text. The flag is that of a macro for
    # a bracket, with 2 added for one that can't open a list; of a match arm for a call; the place of
    # its name for a declaration.
    rows: list[tuple] = []
    add = rows.append
    depth = angle = 0
    mark = mark_depth = mark_angle = None
    for k, sort in enumerate(map(_SORTS.get, toks)):
        if sort is None:
            continue
        if sort == _CLOSE:
            depth -= 1
            add((_CLOSE, k, depth, mark, 0))
        elif sort <= _OPEN_B:
            flag, at1 = 0, before(toks, k)
            if at1 >= 0:
                p1 = toks[at1]
                if p1 == "!":
                    at2 = before(toks, at1)
                    if at2 >= 0:
                        p2 = toks[at2]
                        flag = int(is_name(p2) is not None and p2 not in _NEVER or sort == _OPEN_S and p2 == "#")
                elif sort == _OPEN_S:
                    flag = int(p1 == "#")
                elif sort == _OPEN_P and p1 not in _NEVER and is_name(p1):
                    at2 = before(toks, at1)
                    p2 = toks[at2] if at2 >= 0 else None
                    if p2 not in _NOT_CALLED_AFTER:
                        add((_CALLED, at1, depth, mark, p2 in _ARM))
                if not flag and p1 not in _NEVER and is_name(p1):
                    # The body of a macro's definition stands behind its name.
                    at2 = before(toks, at1)
                    if at2 >= 0 and toks[at2] == "!":
                        at3 = before(toks, at2)
                        flag = int(at3 >= 0 and toks[at3] == "macro_rules")
            if sort == _OPEN_P and mark_depth == depth and angle > mark_angle:
                flag += 2
            add((sort, k, depth, mark, flag))
            depth += 1
        elif sort == _DECLARED:
            name = behind(toks, k)
            declares = name is not None and is_name(toks[name])
            add((_DECLARED, k, depth, mark, name if declares else None))
            if toks[k] == "fn" and name is not None:
                after = behind(toks, name)
                if after is not None and toks[after] == "<":
                    # Type parameters behind the name of a function.
                    mark, mark_depth, mark_angle = name, depth - (toks[name] in _CLOSING), angle
        elif sort == _LESS:
            angle += 1
        elif sort == _MORE:
            angle -= 1
        else:
            add((sort, k, depth, mark, 0))

    # Backwards: the nearest of each sort behind a row at its depth.
    pairs: dict[int, int] = {}
    lists: dict[int, tuple] = {}
    stops: dict[int, tuple] = {}
    let_ends: dict[int, tuple] = {}
    for_ends: dict[int, tuple] = {}
    nothing = (None, None)
    following = None
    kept: list[tuple] = []
    for sort, k, depth, mark, flag in reversed(rows):
        if sort == _CLOSE:
            pairs[depth] = k
        elif sort <= _OPEN_B:
            pair = pairs.get(depth)
            if flag & 1 and pair is not None:
                kept.append((k, pair))
            if sort == _OPEN_P:
                if flag < 2:
                    lists[depth] = (k, pair)
            elif sort == _OPEN_B:
                stops[depth] = ("{", pair)
                for_ends[depth] = (k, False)
        elif sort == _CALLED:
            opened, closed = lists.get(depth, nothing)
            if flag and closed is not None and toks[closed] != "}":
                then = behind(toks, closed)
                if then is not None and toks[then] in ("=>", "if"):
                    # A pattern: neither it nor what it holds is a call.
                    kept.append((k, closed))
                    continue
            kept.append((k, None, None, mark, opened, closed, following, None, None))
        elif sort == _END:
            stops[depth] = (";", k)
            let_ends[depth] = for_ends[depth] = (k, False)
        elif sort == _EQUAL:
            let_ends[depth] = (k, True)
        elif sort == _IN:
            for_ends[depth] = (k, True)
        elif sort != _DECLARED:
            end, hides = (let_ends if sort == _LET else for_ends).get(depth, nothing)
            if hides:
                kept.append((k, end))
        elif flag is not None:
            what, end = stops.get(depth, nothing)
            function = toks[k] == "fn"
            if what == "{" or what == ";" and not function:
                opened, closed = lists.get(depth, nothing)
                head = "rs_fn" if function else "rs_struct"
                kept.append((k, None, head, mark, opened, closed, following, end, flag))
                following = k
            stops[depth] = ("head", k)

    # Forwards: a position lies in a macro or pattern when one that starts before it ends behind it.
    out, hidden_to = [], -1
    for k, hides, *fact in reversed(kept):
        if hides is not None:
            hidden_to = max(hidden_to, hides)
            continue
        if hidden_to >= k:
            continue
        head, mark, opened, closed, following, end, named = fact
        line = last = lines[k]
        if end is not None:
            last = lines[end]
        elif following is not None:
            end = following - 1
            if head is not None:
                last = max(line, lines[following] - 1)
        else:
            end = FAR
        function = head == "rs_fn"
        params = "".join(toks[opened : closed + 1]) if function and closed is not None else None
        name = "(" if named is None else toks[named]
        out.append(
            (path, k, toks[k], head, name, head is None, False, mark, line, line, last, closed if function else k,
             end, opened, closed, params)
        )
    return out
