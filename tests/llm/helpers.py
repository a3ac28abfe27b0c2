"""Small tables with the awkward cases, and plain versions of what the operators compute."""

import random
import zlib

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{min(r.randrange(vocabulary), r.randrange(vocabulary))}" for _ in range(n))


def rows():
    """Documents: plain, near and exact copies, null and empty texts, null ids and groups, repeated rows, a very long text."""
    out = [(k, prose(k, 20 + 13 * (k % 17)), ("en", "de")[k % 2], f"s{k % 3}") for k in range(120)]
    for k in range(40):
        words = out[k][1].split()
        words[len(words) // 2] = f"changed{k}"
        out.append((1000 + k, " ".join(words), "en", "s0"))
        out.append((2000 + k, out[k][1], "en", "hot"))
    long = prose(5, 30_000)
    out += [(3000, None, "en", "s1"), (3001, "", "en", "s1"), (3002, " \n\t ", None, None), (None, prose(3, 30), "en", "s1"), (None, None, None, None)]
    out += [(3003, "one two", "en", "s1"), (3004, "One TWO", "en", "s1"), (3005, long, "en", "s2"), (3006, long + " more", "en", "s2")]
    out += [(3007, out[7][1], "en", "s1")] * 2
    return [(i, t, lang, s, len(t) if t else 0) for i, t, lang, s in out]


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, width):
    w = words(text)
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def near_groups(rows, width, percent):
    """doc_id -> smallest reachable doc_id, by comparing all pairs."""
    sets = [(i, shingles(t, width)) for i, t in rows if i is not None]
    top = {i: i for i, _ in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            n = len(a & b)
            if a and b and 100 * n >= percent * (len(a) + len(b) - n):
                p, q = sorted((find(i), find(j)))
                top[q] = p
    return {i: find(i) for i, _ in sets}


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
