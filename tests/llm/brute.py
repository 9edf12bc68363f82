"""Plain single-process versions of the operators, written from their contracts."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text, short=True):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < 5:
        return {tuple(w)} if w and short else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def near_duplicates(docs, percent=85):
    """doc_id -> (n_shingles, component_id, kept)."""
    sets = {d: shingles(x) for d, x in docs}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            parent[d] = parent[parent[d]]
            d = parent[d]
        return d

    by_set = {}
    for d in sorted(sets):
        if sets[d]:
            parent[d] = by_set.setdefault(frozenset(sets[d]), d)
    post = defaultdict(list)
    reps = sorted(by_set.values(), key=lambda d: (len(sets[d]), d))
    df = Counter(s for d in reps for s in sets[d])
    for d in reps:
        n = len(sets[d])
        order = sorted(sets[d], key=lambda s: (df[s], s))
        prefix = order[: n - -(-percent * n // 100) + 1]
        for o in {o for s in prefix for o in post[s]}:
            m = len(sets[o])
            if 100 * m >= percent * n and root(o) != root(d):
                both = len(sets[o] & sets[d])
                if 100 * both >= percent * (n + m - both):
                    a, b = sorted((root(o), root(d)))
                    parent[b] = a
        for s in prefix:
            post[s].append(d)
    return {d: (len(sets[d]), root(d), root(d) == d) for d in sets}


def leaks(docs, items, percent=80):
    """{(doc_id, item_id): shared shingles}."""
    items = {i: shingles(x, False) for i, x in items}
    where = defaultdict(set)
    for i, s in items.items():
        for x in s:
            where[x].add(i)
    out = {}
    for d, x in docs:
        shared = Counter(i for s in shingles(x, False) for i in where.get(s, ()))
        out |= {(d, i): n for i, n in shared.items() if 100 * n >= percent * len(items[i])}
    return out


def line_dedup(docs, min_chars=40, min_docs=5):
    """doc_id -> (n_lines, n_dropped, kept text)."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = defaultdict(set)
    for d, x in docs:
        for line in (x or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(d)
    out = {}
    for d, x in docs:
        lines = (x or "").split("\n")
        keep = [a for a in lines if len(key(a)) < min_chars or len(held[key(a)]) < min_docs or d == max(held[key(a)])]
        out[d] = (len(lines), len(lines) - len(keep), "\n".join(keep))
    return out


ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    """(n_assign, n_access, n_hex, base list)."""
    text = text or ""
    a = [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    k = [m.span() for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    h = [m.span() for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    rows = sorted([(s, r, e, n) for r, (n, x) in enumerate((("assign", a), ("access", k), ("hex", h))) for s, e in x])
    return len(a), len(k), len(h), ",".join(f"{n}:{s}:{e}" for s, _, e, n in rows)


def quality_counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    w = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = {x for x, n in Counter(tri).items() if n > 1}
    covered = {j for i, x in enumerate(tri) if x in often for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def fold(doc_id, mod):
    return zlib.crc32(str(doc_id).encode()) % mod


def katz_discounts(of, top=5):
    """d(1..top) from the counts of counts 1..top+1."""
    n = [0, *of]
    cut = (top + 1) * n[top + 1] / n[1] if n[1] else 1
    if all(x > 0 for x in of) and cut < 1:
        d = [((r + 1) * n[r + 1] / n[r] / r - cut) / (1 - cut) for r in range(1, top + 1)]
        if all(0 < x <= 1 for x in d) and min(d) < 1:
            return [1, *d]
    share = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return [1, *(1 - share / r for r in range(1, top + 1))]


class Katz:
    """A backoff model over token lists; `prob(history, word)` recurses over plain dictionaries."""

    def __init__(self, texts, order, top=5):
        self.top, self.order = top, order
        self.counts = [Counter() for _ in range(order + 1)]
        for text in texts:
            w = ["<s>", *text]
            for i in range(1, len(w)):
                self.counts[1][(w[i],)] += 1
                for k in range(2, order + 1):
                    self.counts[k][tuple(w[max(0, i - k + 1) : i + 1])] += 1
        self.d = [None] + [katz_discounts([sum(c == r for c in x.values()) for r in range(1, top + 2)]) for x in self.counts[1:]]
        self.n = sum(self.counts[1].values())
        kept = sum(self.disc(1, c) for c in self.counts[1].values())
        self.over = self.n if kept < self.n - 1e-9 else self.n + 1
        self.unknown = 1 - kept / self.over if self.n else 1.0
        self.after = [defaultdict(dict) for _ in range(order + 1)]
        for k in range(2, order + 1):
            for g, c in self.counts[k].items():
                self.after[k][g[:-1]][g[-1]] = c
        self.memo = {}

    def disc(self, k, c):
        return c * (self.d[k][c] if c <= self.top else 1)

    def prob(self, k, history, word):
        if k == 1:
            c = self.counts[1].get((word,), 0)
            return self.disc(1, c) / self.over if c else self.unknown
        h = history[max(0, len(history) - k + 1) :]
        lower = lambda w: self.prob(k - 1, history, w)
        seen = self.after[k].get(h)
        if not seen:
            return lower(word)
        total = sum(seen.values())
        kept = sum(self.disc(k, c) for c in seen.values())
        over = total if any(c <= self.top for c in seen.values()) else total + 1
        if word in seen:
            return self.disc(k, seen[word]) / over
        if (k, h) not in self.memo:
            self.memo[k, h] = (1 - kept / over) / (1 - sum(map(lower, seen)))
        return self.memo[k, h] * lower(word)
