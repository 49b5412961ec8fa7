"""Plain versions of the operators, row by row, to compare with."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text: str | None) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text: str | None) -> list[str]:
    return SPACED.findall(text or "")


def counts(text: str | None) -> dict[str, int]:
    w, t = words(text), text or ""
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(grams)
    lines = [x for x in t.split("\n") if SPACED.search(x)]
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", t)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len({i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}),
        "n_upper_words": sum(len(x) > 1 and x.isupper() for x in w),
    }


def base_failed(c: dict) -> bool:
    return c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]


def rule_failed(c: dict) -> bool:
    return base_failed(c) or 100 * c["n_symbols"] > 10 * c["n_words"] or 100 * c["n_upper_words"] > 30 * c["n_words"]


def bad_hosts(rows: list[tuple[str | None, bool]]) -> set:
    n, bad = Counter(h for h, _ in rows), Counter(h for h, f in rows if f)
    docs = sum(n.values())
    if not docs:
        return set()
    mean = sum(bad.values()) / docs
    variance = mean * (1 - mean)
    if variance <= 0:
        weight = 1.0
    else:
        between = sum(n[h] * (bad[h] / n[h] - mean) ** 2 for h in n) - (len(n) - 1) * variance
        spread = between / max(docs - sum(x * x for x in n.values()) / docs, 1e-9) if len(n) > 1 else 0
        weight = 1 / min(max(spread / variance, 1e-3), 0.5) - 1
    return {h for h in n if (bad[h] + mean * weight) / (n[h] + weight) > 0.5}


def fingerprint(text: str | None) -> int:
    w = words(fold(text))
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n: int, pairs) -> list[int]:
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def simhash_roots(texts: list[str | None], bits: int = 3) -> list[int]:
    """For each text the first one of its group."""
    fp = [fingerprint(t) for t in texts]
    near = ((a, b) for a in range(len(fp)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= bits)
    return roots(len(fp), near)


def kept_words(texts: list[str | None], window: int = 20) -> list[tuple[list[str], list[bool]]]:
    """Per text, in order of the ids, its words and whether each goes."""
    seen, out = set(), []
    for t in texts:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out.append((w, gone))
    return out


def sha(parts: list[str]) -> str:
    return hashlib.sha256(" ".join(parts).encode()).hexdigest()


def tiling(doc: list[str], item: list[str], least: int) -> int:
    """Covered words of the item by greedy string tiling, as in its first description."""
    in_doc, in_item, covered = set(), set(), 0
    while True:
        best, found = least - 1, []
        for a in range(len(doc)):
            for b in range(len(item)):
                k = 0
                while (
                    a + k < len(doc) and b + k < len(item) and doc[a + k] == item[b + k]
                    and a + k not in in_doc and b + k not in in_item
                ):
                    k += 1
                if k > best:
                    best, found = k, [(a, b)]
                elif k == best and k >= least:
                    found.append((a, b))
        if best < least:
            return covered
        for a, b in found:
            spots, marks = range(a, a + best), range(b, b + best)
            if in_doc.isdisjoint(spots) and in_item.isdisjoint(marks):
                in_doc.update(spots)
                in_item.update(marks)
                covered += best


def contaminated(text: str | None, item: str | None, least: int = 5, coverage: float = 0.5) -> bool:
    doc, test = ALNUM.findall((text or "").lower()), ALNUM.findall((item or "").lower())
    grams = {tuple(test[i : i + least]) for i in range(len(test) - least + 1)}
    if not any(tuple(doc[i : i + least]) in grams for i in range(len(doc) - least + 1)):
        return False
    return tiling(doc, test, least) >= coverage * len(test)


def check_packing(rows: list[dict], docs: list[dict], capacity: int) -> None:
    """Replay: no bin is over-full or in conflict, all words are there, and each rest was put into
    the tightest bin that took it. ``rows`` are of one shard; documents have unique ids."""
    size = {d["doc_id"]: len(words(d["text"])) + 1 for d in docs}
    about = {d["doc_id"]: (d["source"], " ".join(words(fold(d["text"])))) for d in docs}
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["size"]))
        bins[r["bin_id"]].append(r)
    assert {d: sum(p[2] for p in ps) for d, ps in pieces.items()} == size
    for ps in pieces.values():
        at = 0
        for i, (piece, start, n) in enumerate(sorted(ps)):
            assert (piece, start) == (i, at)
            at += n
    for members in bins.values():
        assert sum(r["size"] for r in members) <= capacity
        for k in (0, 1):
            assert len({about[r["doc_id"]][k] for r in members}) == len(members)
    rests = [r for r in rows if r["size"] < capacity]
    order = {r["doc_id"]: i for i, r in enumerate(rows)}
    state: dict[int, list[dict]] = {}
    # Equal sizes may be put in any order: take them as the bins grew.
    for n in sorted({r["size"] for r in rests}, reverse=True):
        for r in sorted((r for r in rests if r["size"] == n), key=lambda r: order[r["doc_id"]]):
            def fits(members: list[dict], r=r) -> bool:
                return capacity - sum(m["size"] for m in members) >= r["size"] and all(
                    about[m["doc_id"]][k] != about[r["doc_id"]][k] for m in members for k in (0, 1)
                )

            rooms = [capacity - sum(m["size"] for m in members) for members in state.values() if fits(members)]
            chosen = state.setdefault(r["bin_id"], [])
            if rooms:
                assert chosen and capacity - sum(m["size"] for m in chosen) == min(rooms)
            else:
                assert not chosen
            chosen.append(r)
