"""Plain versions that several tests share."""

import re

import xxhash

from driftjobs.llm.secrets import weak_spans


def groups_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_simhash(text):
    words = [w.encode() for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_shingles(text, size=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def near_copies(texts, least=0.8):
    """Pairs of texts of equal words or of a Jaccard similarity of ``least`` over five-word runs; empty ones are alike."""
    sets = {i: plain_shingles(t) for i, t in texts.items()}
    ids = sorted(texts)
    alike = lambda a, b: a == b or bool(a and b) and len(a & b) >= least * len(a | b)
    return [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if alike(sets[a], sets[b])]


#: The patterns of the contract, as written there.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def plain_base(text):
    """Base spans by walking from place to place: at each, the kind's pattern, and on from its end; short matches are passed over."""
    out = []
    for kind, pattern, fits in (
        ("assign", re.compile(ASSIGN, re.I | re.A), lambda m: len(m[2]) >= 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ):
        at = 0
        while at < len(text):
            m = pattern.match(text, at)
            if m and fits(m):
                out.append((m.start(), ("assign", "access", "hex").index(kind), m.end()))
            at = m.end() if m else at + 1
    return sorted(out)


def plain_spans(text, scope=200):
    """Base spans, and weak parts beside a complementary one, pair by pair."""
    base = plain_base(text or "")
    weak = [w for w in weak_spans(text or "") if not any(b[0] < w[2] and w[0] < b[2] for b in base)]
    role = {0: "s", 1: "i", 2: "s", 3: "i", 4: "s", 5: "e"}
    needs = {3: "s", 4: "ie", 5: "s"}
    apart = lambda a, b: max(a[0], b[0]) - min(a[2], b[2])
    return sorted(base + [w for w in weak if any(role[o[1]] in needs[w[1]] and 0 <= apart(w, o) <= scope for o in base + weak if o is not w)])
