"""Plain versions of the operators, to compare with."""

from __future__ import annotations

import hashlib
import math
import re

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _valid(kind: str, m: str) -> bool:
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and _luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def pii(text: str | None) -> tuple[list[int], list[tuple[str, int, int]], str]:
    spans = [(k, m.start(), m.end()) for k, p in KINDS.items() for m in re.finditer(p, text or "") if _valid(k, m.group())]
    counts = [sum(s[0] == k for s in spans) for k in KINDS]
    joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    return counts, spans, hashlib.sha256(joined.encode()).hexdigest()


PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def licenses(text: str | None, templates, at: float = 0.8):
    """n_words, n_base, first, last, base labels, all labels, score."""
    low = (text or "").translate(UPPER)
    words = WORDS.findall(low)
    hits = []
    for p, label in PHRASES.items():
        q = p.split()
        hits += [(i, label) for i in range(len(words) - len(q) + 1) if words[i : i + len(q)] == q]
    labels, best = {label for _, label in hits}, 0.0
    for line in low.split("\n"):
        have = set(WORDS.findall(line))
        for label, t in templates:
            ts = set(t.replace(".", " ").split())
            share = len(ts & have) / len(ts)
            if share >= at - 1e-12:
                labels.add(label)
                best = max(best, share)
    places = [i for i, _ in hits]
    return (
        len(words),
        len(hits),
        min(places, default=None),
        max(places, default=None),
        ",".join(sorted({x for _, x in hits})),
        ",".join(sorted(labels)),
        1.0 if hits else best,
    )


def repeats(docs: list[tuple[int | None, str | None]], width: int = 13) -> list[tuple]:
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    first: dict[tuple, int] = {}
    for d, w in split:
        for i in range(len(w) - width + 1 if d is not None else 0):
            k = tuple(w[i : i + width])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - width + 1 if d is not None else 0):
            if first[tuple(w[i : i + width])] < d:
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def edit_distance(a: list, b: list) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def near_classes(docs: list[tuple[int, str | None]], least: float = 0.8) -> dict[int, int]:
    """Smallest id joined by links of at least ``least`` word edit similarity; all pairs."""
    split = [(d, (t or "").lower().split()) for d, t in docs]
    root = {d: d for d, _ in split}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, a) in enumerate(split):
        for e, b in split[:i]:
            longer = max(len(a), len(b))
            if a and b and abs(len(a) - len(b)) <= (1 - least) * longer and find(d) != find(e):
                if edit_distance(a, b) <= (1 - least) * longer + 1e-9:
                    x, y = find(d), find(e)
                    root[max(x, y)] = min(x, y)
    return {d: find(d) for d, _ in split}


def url(u: str | None, rules) -> tuple[str, str, str | None, str | None]:
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
    host, path = (m[1].translate(UPPER), m[2]) if m else ("", "")
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best and best[0]


def runs(words: list, exponent: int, least: int) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every maximal run, by comparing all pairs of words."""
    n, best = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, exponent * q):
                best.setdefault((i, length), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in best.items())


def collapsed(words: list[str], found: list[tuple[int, int, int]]) -> str:
    out = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in out)


def hard_negatives(rows, anchors, positives: int, negatives: int, low: int, high: int, scale: int):
    """rows: id to (label, vector of floats) of those that take part."""
    whole = {i: (label, [math.floor(scale * x) for x in v]) for i, (label, v) in rows.items()}
    out = []
    for a in (i for i in whole if anchors(i)):
        label, vec = whole[a]
        scored = sorted((-sum(x * y for x, y in zip(vec, v)), i, other == label) for i, (other, v) in whole.items() if i != a and len(v) == len(vec))
        for s, pos in [(-s, i) for s, i, same in scored if same][:positives]:
            fit = [(-t, i) for t, i, same in scored if not same and low * s <= -100 * t <= high * s]
            out += [(a, pos, n + 1, i, s, t) for n, (t, i) in enumerate(fit[:negatives])]
    return sorted(out)


ID_LIKE = re.compile(r"^([0-9]+|[0-9a-f]{8,}|[^0-9]*[0-9].*)$")


def url_tree(pages, depth: int = 5, most: int = 20, share: float = 0.05, doubt: float = 0.05, z: float = 1.96):
    """(template, purity, label count) of each (host, path, label) by the tree's rules, host by host."""
    from collections import Counter, defaultdict

    def segments(path):
        segs = [re.sub(r"^[^.]*[0-9][^.]*", "*", s) if ID_LIKE.match(s) else s for s in path.split("/") if s]
        return tuple(segs if len(segs) <= depth + 1 else [*segs[:depth], "/".join(segs[depth:])])

    count, labels = Counter(), defaultdict(list)
    for host, path, label in pages:
        key = (host, segments(path))
        count[key] += 1
        if label is not None:
            labels[key].append(label)
    kids = defaultdict(Counter)
    for (host, segs), n in count.items():
        for i, s in enumerate(segs):
            kids[host, i, segs[:i]][s] += n

    def general(host, segs):
        out = []
        for i, s in enumerate(segs):
            own = kids[host, i, segs[:i]]
            out.append("*" if len(own) > most and own[s] < share * sum(own.values()) else s)
        return tuple(out)

    now = {key: general(*key) for key in count}
    for d in range(depth - 1, -1, -1):
        spread, marks = defaultdict(lambda: defaultdict(Counter)), defaultdict(lambda: defaultdict(list))
        for key, segs in now.items():
            if len(segs) > d + 1:
                spread[key[0], segs[:d]][segs[d]][segs[d + 1 :]] += count[key]
                marks[key[0], segs[:d]][segs[d]] += labels[key]
        twins = set()
        for node, children in spread.items():
            pool = sum(children.values(), Counter())
            said = [x for c in children for x in marks[node][c]]
            for child, own in children.items():
                nc, mine = sum(own.values()), marks[node][child]
                common = sum(min(n / nc, pool[r] / sum(pool.values())) for r, n in own.items())
                fits = 1 - common <= math.sqrt(len(pool) / (4 * nc)) + math.sqrt(math.log(1 / doubt) / 2 / nc)
                if mine:
                    rate = sum(said) / len(said)
                    fits = fits and (sum(mine) - len(mine) * rate) ** 2 <= z * z * len(mine) * rate * (1 - rate)
                if len(children) > 1 and fits:
                    twins.add((*node, child))
        now = {
            k: (*s[:d], "{*}", *s[d + 1 :]) if len(s) > d + 1 and (k[0], s[:d], s[d]) in twins else s for k, s in now.items()
        }
    held, hosts, every = defaultdict(list), defaultdict(list), []
    for key, segs in now.items():
        held[key[0], segs] += labels[key]
        hosts[key[0]] += labels[key]
        every += labels[key]
    out = []
    for host, path, _ in pages:
        segs = now[host, segments(path)]
        own, at = held[host, segs], hosts[host]
        prior = (sum(at) + 4 * (sum(every) + 1) / (len(every) + 2)) / (len(at) + 4)
        out.append(("/" + "/".join(segs), round((sum(own) + 4 * prior) / (len(own) + 4), 6), len(own)))
    return out
