"""Plain versions of the contracts, over lists of rows."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def op1(rows):
    out = {}
    for i, t in rows:
        w = words(t)
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        n = Counter(grams)
        hit = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
        out[i] = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit), failed)
    return out


def op2(rows):
    """By row number; the component is the smallest id of its rows."""
    sets = []
    for _, t in rows:
        w = words(lower(t))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_gram = {}
    for i, s in enumerate(sets):
        for g in s:
            by_gram.setdefault(g, []).append(i)
    pairs = Counter()
    for ids in by_gram.values():
        for a in range(len(ids)):
            for b in range(a + 1, len(ids)):
                pairs[ids[a], ids[b]] += 1
    for (a, b), n in pairs.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return {k: (len(s), least.get(find(i))) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))}


def op3(rows):
    bodies = {i: (h or "").encode() for i, h in rows}
    last = {}
    for i, b in bodies.items():
        if len(b) >= 1000:
            last[b] = max(i, last.get(b, i))
    return {i: (len(b), hashlib.sha1(b).hexdigest(), "revisit" if last.get(b, i) != i else "response", last[b] if last.get(b, i) != i else None) for i, b in bodies.items()}


NAMES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
KINDS = (("assign", rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32))


def op6(rows):
    out = {}
    for i, t in rows:
        found = sorted((m.start(), k, kind, m.end()) for k, (kind, p, g, n) in enumerate(KINDS) for m in re.finditer(p, t or "") if len(m[g]) >= n)
        said = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in found)
        c = Counter(x[2] for x in found)
        out[i] = (c["assign"], c["access"], c["hex"], hashlib.sha256(said.encode()).hexdigest(), said)
    return out


def op8(rows, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = word.findall(lower(t))
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    sizes = sorted({len(w) for w in windows})
    out = {}
    for i, t in rows:
        w = word.findall(lower(t))
        hit, got = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[k : k + n]))) is not None:
                    got |= x
                    hit.update(range(k, k + n))
        out[i] = (len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(map(str, got))).encode()).hexdigest(), bool(hit))
    return out


def op7(rows):
    """Turns of (conversation, position, text) rows: the best path is kept whole for each state, line by line."""
    from quarry.llm import chat_format as c

    by = {}
    for conv, pos, text in rows:
        by.setdefault(conv, []).append((pos is not None, pos or 0, text is not None, text or "", pos))
    out = []
    for conv, parts in by.items():
        lines = []
        for *_, text, pos in sorted(parts, key=lambda x: x[:4]):
            blank = False
            for x in text.split("\n"):
                if x.strip():
                    lines.append((x, blank, pos))
                blank = not x.strip()
        best = {s: (c.START[s], (s,)) for s in range(3)}  # score, states with the latest first
        for x, blank, _ in lines:
            of, step = c.scores(*c.features(x)), c.STEP_MARKED if c.MARK.match(x) else c.STEP_BLANK if blank else c.STEP
            best = {j: max(((v + step[i][j] + of[j], [-k for k in p], p) for i, (v, p) in best.items()), key=lambda z: z[:2]) for j in range(3)}
            best = {j: (v, (j, *p)) for j, (v, _, p) in best.items()}
        states = max(best.values(), key=lambda z: (z[0], [-k for k in z[1]]))[1][-2::-1] if lines else ()
        turns = []
        for (x, _, pos), s in zip(lines, states, strict=True):
            m = c.MARK.match(x)
            plain = (x[m.end() :] if m else x).strip()
            if turns and turns[-1][1] == c.ROLES[s] and not m:
                turns[-1][2].append(plain)
            else:
                turns.append((pos, c.ROLES[s], [plain]))
        out += [(conv, k, pos, role, "\n".join(t)) for k, (pos, role, t) in enumerate(turns)]
    return sorted(out, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def isotonic(points):
    """Least squares that never fall: each value is the largest, over beginnings, of the least mean of what follows it."""
    n = len(points)
    mean = lambda a, b: sum(v * w for v, w in points[a:b]) / sum(w for _, w in points[a:b])
    return [max(min(mean(a, b) for b in range(i + 1, n + 1)) for a in range(i + 1)) for i in range(n)]


def within_one(a, b):
    """Equal up to one insertion, deletion, replacement or swap of neighbours."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    p, q = a[k:], b[k:]
    return p[1:] == q[1:] or p[1:] == q or p == q[1:] or (p[:2] == q[:2][::-1] and p[2:] == q[2:] and len(p) > 1)


def op9_sums(text, weights, clean, t):
    """Weights of plain, misspelled, quoted and quoted misspelled hits, word by word against the whole lexicon."""
    tokens = t.TOKEN.findall((text or "").lower())
    words = {w: v for w, v in weights.items() if not w.endswith("*")}
    stems = {w[:-1]: v for w, v in weights.items() if w.endswith("*")}
    memo = {}

    def match(w):
        if w in words:
            return words[w], 0
        if heads := [s for s in stems if w.startswith(s)]:
            return stems[max(heads, key=len)], 0
        if len(w) < t.FUZZY_FROM - 1 or w in clean:
            return 0.0, 0
        near = [v for x, v in words.items() if len(x) >= t.FUZZY_FROM and within_one(w, x)]
        near += [v for x, v in stems.items() if len(x) >= t.FUZZY_FROM and any(within_one(w[:k], x) for k in ([*range(len(x) - 1, len(x) + 2)] if len(x) > t.FUZZY_FROM else [len(w)]) if k <= len(w))]
        return (max(near), 1) if near else (0.0, 0)

    out = [0.0] * 4
    for i, w in enumerate(tokens):
        if w not in memo:
            memo[w] = match(w)
        v, edits = memo[w]
        if v:
            before, after = tokens[max(0, i - t.CONTEXT) : i], tokens[i + 1 : i + 1 + t.CONTEXT]
            quoted = any(x in t.QUOTES for x in before) and any(x in t.QUOTES for x in after) or any(x in t.REPORTING for x in before + after)
            out[edits + 2 * quoted] += v
    return out
