"""The operators' contracts, restated plainly for small tables."""

import hashlib
import re
from collections import Counter, defaultdict


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c)
        total += (2 * x - 9 if x > 4 else 2 * x) if i % 2 else x
    return total % 10 == 0


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
)


def digest(spans):
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


def pii(text):
    spans, counts = [], []
    for kind, pattern, ok in PII:
        mine = [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text or "") if ok(m[0])]
        counts.append(len(mine))
        spans += mine
    return counts, digest(spans)


def secrets(text):
    kinds = (
        ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), lambda m: len(m[2]) >= 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    )
    found = sorted((m.start(), k, m.end()) for k, (_, rx, ok) in enumerate(kinds) for m in rx.finditer(text or "") if ok(m))
    return [sum(x[1] == k for x in found) for k in range(3)], digest([f"{kinds[k][0]}:{s}:{e}" for s, k, e in found])


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(rows, n, percent):
    """n_shingles and component of each row (id, text), ids unique."""
    sets = {i: shingles(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where, first = defaultdict(list), {}
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    for i, s in sets.items():
        if s in first:
            a, b = find(i), find(first[s])
            parent[max(a, b)] = min(a, b)
        elif s:
            first[s] = i
            for j, k in Counter(j for g in s for j in where[g] if j != i).items():
                if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def rare_components(rows, n, percent):
    """``components`` for many rows: sets that link share one of the rarest shingles that either cannot do without."""
    sets = [shingles(t, n) for _, t in rows]
    often = Counter(g for s in set(sets) for g in s)
    kinds = sorted(set(sets) - {frozenset()}, key=len)
    where, parent = defaultdict(list), list(range(len(kinds)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in enumerate(kinds):
        rare = sorted(s, key=lambda g: (often[g], g))[: len(s) + 1 - -(-len(s) * percent // 100)]
        near = {j for g in rare for j in where[g]}
        for j in near:
            both = len(s & kinds[j])
            if 100 * both >= percent * (len(s) + len(kinds[j]) - both):
                a, b = find(j), find(k)
                parent[max(a, b)] = min(a, b)
        for g in rare:
            where[g].append(k)
    number, least = {s: k for k, s in enumerate(kinds)}, {}
    for (i, _), s in zip(rows, sets):
        if s:
            c = find(number[s])
            least[c] = min(i, least.get(c, i))
    return {i: least[find(number[s])] if s else i for (i, _), s in zip(rows, sets)}


def quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    tri = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    cover, seen, dup = set(), set(), 0
    for i in range(len(words) - 2):
        if tri[tuple(words[i : i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover), n < 50 or 100 * len(cover) > 50 * n


def removed(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    starts = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if starts[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def leaks(docs, items, n=5, percent=80):
    wanted = {i: shingles(t, n) for i, t in items}
    out = set()
    for d, t in docs:
        s = shingles(t, n)
        out |= {(d, i, len(w & s), len(w)) for i, w in wanted.items() if w and 100 * len(w & s) >= percent * len(w)}
    return out


def earliest_deadlines(blocks, weights):
    """(source, block) of each slot: in each phase, of the live sources' released blocks the one due first, the first source of equal ones."""
    out, done = [], [0] * len(blocks)
    while any(d < b for d, b in zip(done, blocks)):
        live = [i for i in range(len(blocks)) if done[i] < blocks[i]]
        total, taken, t = sum(weights[i] for i in live), dict.fromkeys(live, 0), 0
        while all(done[i] < blocks[i] for i in live):
            released = [i for i in live if taken[i] * total // weights[i] <= t]
            i = min(released, key=lambda i: (-(-(taken[i] + 1) * total // weights[i]), i))
            out.append((i, done[i]))
            taken[i], done[i], t = taken[i] + 1, done[i] + 1, t + 1
    return out


IBAN_LENGTHS = {"DE": 22, "GB": 22, "FR": 27, "NO": 15, "CH": 21, "ES": 24, "IT": 27, "NL": 18, "PL": 28}


def ibans(text):
    """(start, end) of each start of an IBAN with the longest end at a word's end that has its country's length and leaves 1 modulo 97."""
    out = []
    for m in re.finditer(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})", text or "", re.A):
        for n in range(68, 14, -1):
            value = text[m.start() : m.start() + n]
            bare = value.replace(" ", "")
            after = text[m.start() + n : m.start() + n + 1]
            if len(value) < n or value[-1] == " " or re.fullmatch("[A-Za-z0-9]", after) or not re.fullmatch(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}", value):
                continue
            if bare[:2] in IBAN_LENGTHS and len(bare) != IBAN_LENGTHS[bare[:2]]:
                continue
            if int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1:
                out.append((m.start(), m.start() + n))
                break
    return out


def entropy(rows, owners=3):
    """Of rows (id, text, owner) the (start, end) of long mixed tokens that fewer than ``owners`` owners hold, and of all hashed values the owners."""
    rx = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_=-])")
    held, found = defaultdict(set), []
    for i, text, owner in rows:
        mine = [m for m in rx.finditer(text or "") if re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[0-9].*[0-9]", m[0])]
        found.append((i, mine, owner))
        values = [m[0] for m in mine] + [m[0] for m in re.finditer("AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", text or "")]
        values += [m[2] for m in re.finditer(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text or "", re.A) if len(m[2]) >= 6]
        for v in values:
            held[v].add(owner)
    return {i: [(m.start(), m.end()) for m in mine if len(held[m[0]]) < owners] for i, mine, _ in found}
