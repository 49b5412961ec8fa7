"""Facts of Python files, a file at a time.

The tokens are those of ``lexis.LEXIS``. A pass runs forwards for brackets and
logical lines, one backwards for what ends a block, and one over the rows left for the class around them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache
from itertools import accumulate, repeat

from cartograph.operators.files import BLANKS, FAR, class_of

# Words that are never the name of a called function.
KEYWORDS = (
    "and as assert async await break class continue def del elif else except finally for from "
    "global if import in is lambda nonlocal not or pass raise return try while with yield "
    "True False None"
).split()

_NEVER = frozenset(KEYWORDS)
_TRIVIA = frozenset(BLANKS + "#\\")
_OPENING, _CLOSING = frozenset("([{"), frozenset(")]}")
_BLOCKS = frozenset(("def", "class", "async"))
_IMPORTING = frozenset(("import", "from"))
_NOT_CALLED_AFTER = frozenset((".", "def", "class"))

# ------------------------------------------------------------------ lexing

_HIDDEN_BREAK = re.compile(r"\\\r?\n").match
_STRING = re.compile("[A-Za-z]{0,2}[\"'`]").match
# The text before a string's first expression, and all texts of one with expressions.
_HELD = re.compile(r"(?:[fFtT][rR]?|[rR][fFtT])[\"'](?:[^{]++|\{\{)*+\{(?!\{)").match
_TEXTS = r"\A[a-zA-Z]{1,2}[\"'](?:[^{]++|\{\{)*+\{|\}(?:[^{}]++|\{\{|\}\})*+(?:\{|\Z)"
_OPENS_TEXT = re.compile(r"[a-zA-Z]{1,2}[\"']|\}[^\n\r\u0085\u2028\u2029]").match


@cache
def _lexis(plain: bool) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """The tokens of ``lexis.LEXIS['python']``, those inside a string with expressions, and a whole name.

    ``plain`` is for texts of ASCII alone, where the classes of letters are short. What is most
    frequent stands first: blanks, names that are no prefix of a string, and signs that begin no other token.
    """
    letters, numbers, digits = ("a-zA-Z", "0-9", "0-9") if plain else map(class_of, ("L", "N", "Nd"))
    name = rf"[{letters}_$][{letters}{numbers}_$]*+"
    word, even, end = "[a-zA-Z0-9_]", r"(?<!\\)(?:\\\\)*+", r"(?<!\\\r)(?=\r?\n)"
    strings = [rf"{q}[\s\S]*?{even}(?:{q}|\Z)" for q in ('"""', "'''")]
    strings += [rf"{q}[\s\S]*?{even}(?:{q}|{end}|\Z)" for q in "\"'"]
    rules = [
        r"[ \t\n\x0B\f\r\ufeff]++",
        rf"(?![rRbBuUfFtT]{{1,2}}[\"']){name}",
        r"[(){}\[\];,.?@+*/%^~&|<>`]",
        r"(?:[rRbBuUfFtT]{1,2}(?=[\"']))?+(?:" + "|".join(strings) + ")",
        r"#[^\r\n]*+",
        r"\\\r?\n",
        name,
        rf"[{digits}]{word}*+(?:\.[{digits}]{word}*+)?+",
        "->|:=|==|!=",
        r"[\s\S]",
    ]
    tokens = "|".join(rules)
    return re.compile(tokens), re.compile(f"{_TEXTS}|{tokens}"), re.compile(rf"(?:r#)?{name}")


def lexed(text: str) -> tuple[list[str], Callable]:
    """The tokens of a text, and the test whether one is an identifier or keyword."""
    tokens, inner, name = _lexis(text.isascii())
    toks = tokens.findall(text)
    held = [i for i, t in enumerate(toks) if "{" in t and _HELD(t)]
    for i in reversed(held):
        toks[i : i + 1] = inner.findall(toks[i])
    return toks, name.fullmatch


def _interpolation(tok: str) -> int:
    """1 for the text before a string's first expression, -1 for that behind its last, else 0."""
    closes = tok[0] == "}" and len(tok) > 1
    opens = tok[-1] == "{" and _OPENS_TEXT(tok) is not None
    return int(opens) - int(closes) if opens != closes else 0


# ------------------------------------------------------------------ rules


def file_facts(path: str, text: str) -> list[tuple]:
    """Values of ``files.OWN``, docstring and place for each declaration, call and token of an import."""
    toks, is_name = lexed(text)
    lines = list(accumulate(map(str.count, toks, repeat("\n")), initial=1))

    # (place, token, depth, margin of a token that starts a logical line).
    own: list[tuple] = []
    depth, raw = 0, None
    for k, tok in enumerate(toks):
        if tok[0] in _TRIVIA and (tok[0] == "#" or not tok.lstrip(BLANKS) or _HIDDEN_BREAK(tok)):
            if "\n" in tok:
                raw = tok
            continue
        margin = None
        closes = tok in _CLOSING
        if depth == 0 and not closes:
            if raw is None:
                margin = 0
            elif "\n" in raw and not raw.lstrip(BLANKS):
                indent = raw[raw.rindex("\n") + 1 :]
                margin = len(indent) + 7 * indent.count("\t")
        raw = tok
        if closes:
            depth -= 1
            own.append((k, tok, depth, None))
        else:
            own.append((k, tok, depth, margin))
            if tok in _OPENING:
                depth += 1
            elif "{" in tok or "}" in tok:
                depth += _interpolation(tok)

    # Rows (place, token, depth, margin, what serves later), in the order of the text.
    rows: list[tuple] = []
    cur = prev = mark = None
    count = len(own)
    for j, (k, tok, depth, margin) in enumerate(own):
        fresh = margin is not None
        p1 = own[j - 1][1] if j else None
        if fresh:
            cur, prev = (tok, margin), cur
        if fresh or (p1 == ";" and depth == 0) or (p1 == ":" and tok in _IMPORTING):
            mark = (k, tok)
        n1, _n1_at, n1_margin = (own[j + 1][1], *own[j + 1][2:]) if j + 1 < count else (None, None, None)
        n2 = own[j + 2][1] if j + 2 < count else None
        named = n1 is not None and is_name(n1) is not None
        head = None
        if fresh:
            if (tok == "def" and named and (n2 == "(" or n2 == "[")) or (tok == "async" and n1 == "def"):
                head = "py_def"
            elif tok == "class" and named:
                head = "py_class"
        call = (
            n1 == "(" and n1_margin is None and tok not in _NEVER and p1 not in _NOT_CALLED_AFTER
            and is_name(tok) is not None
        )
        imports = mark is not None and mark[1] in _IMPORTING
        last = n1 is None
        lone = (
            (fresh or (p1 == ":" and depth == 0 and cur is not None and cur[0] in _BLOCKS))
            and (last or n1_margin is not None or n1 == ";" or n1 == ",")
            and _STRING(tok) is not None
        )
        serves = None
        if head or call or imports or fresh or last or lone:
            ended = lines[own[j - 1][0] + 1] if j else None
            # The logical line before, and the level that the last one stands on.
            serves = (head, n2 if tok == "async" else n1, call, imports, lone, mark, prev if fresh else None, ended,
                      cur if last else None)
        elif tok not in _OPENING and tok not in _CLOSING:
            continue
        rows.append((k, tok, depth, margin, serves))

    # Backwards: the nearest bracket at a depth, end of a level and string alone in a block.
    pairs: dict[int, int] = {}
    lists: dict[int, tuple] = {}
    closers: dict[int, tuple] = {}
    docs: dict[int, tuple] = {}
    next_indent = following = None
    kept: list[tuple] = []
    for k, tok, depth, margin, serves in reversed(rows):
        if serves is not None:
            head, name, call, imports, lone, mark, prev, before_line, end_of = serves
            if end_of is not None:
                for level in range(end_of[1] + 1):
                    closers[level] = (lines[k + 1], k + 1)
            opened, closed = lists.get(depth, (None, None))
            doc = end = end_line = None
            if head is not None:
                end_line, end = closers.get(margin, (None, None))
                end = None if end is None else end - 1
                deeper = next_indent is not None and next_indent > margin
                at, found = docs.get(next_indent if deeper else -1 - mark[0], (None, None))
                if at is not None and end is not None and at <= end:
                    doc = found
            if head is not None or call or imports:
                top = margin == 0 or (prev is not None and prev == ("@", margin))
                kept.append((k, tok, head, name, call, imports, mark, opened, closed, following, end, end_line, doc, top))
            if head is not None:
                following = k
            if lone:
                docs[margin if margin is not None else -1 - mark[0]] = (k, tok)
            if margin is not None:
                if prev is not None:
                    for level in range(margin, prev[1] + (prev[0] in _BLOCKS)):
                        closers[level] = (before_line, k)
                next_indent = margin
        if tok in _CLOSING:
            pairs[depth] = k
        elif tok == "(":
            lists[depth] = (k, pairs.get(depth))

    # Forwards: a position lies in a class when one that starts before it ends behind it.
    out, class_end = [], -1
    for k, tok, head, name, call, imports, mark, opened, closed, following, end, last, doc, top in reversed(kept):
        line = lines[k]
        if last is None:
            last = lines[k + 1]
            if head is not None and end is None:
                last = line if following is None else max(line, lines[following] - 1)
        in_class = class_end >= k
        if head == "py_class" and end is not None:
            class_end = max(class_end, end)
        if end is None:
            end = FAR if following is None else following - 1
        function = head == "py_def"
        params = "".join(toks[opened : closed + 1]) if function and closed is not None else None
        out.append(
            (path, k, tok, head, name, call, imports, mark[0] if mark else None, line, line, last,
             closed if function else k, end, opened, closed, params, doc, in_class, top)
        )
    return out
