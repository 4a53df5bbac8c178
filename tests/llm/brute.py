"""Plain Python answers, one document at a time."""

import hashlib
import re
import zlib

WORDS9 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WHITE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def op9(docs, bench):
    windows = {}
    for item, text in bench:
        w = WORDS9.findall(lower(text))
        for k in range(max(1, len(w) - 7) if w and item is not None else 0):
            windows.setdefault(tuple(w[k : k + 8]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w = WORDS9.findall(lower(text))
        hit, items = set(), set()
        for k in range(len(w)):
            for n in sizes:
                if k + n <= len(w) and (found := windows.get(tuple(w[k : k + n]))):
                    hit.update(range(k, k + n))
                    items |= found
        out.append((doc, len(w), len(hit), len(items), sha(",".join(sorted(map(str, items)))), len(items) >= 2))
    return out


def op8(docs):
    first, rows = {}, []
    for doc, text in docs:
        w = WHITE.findall(text or "")
        rows.append((doc, w))
        for k in range(len(w) - 12):
            t = tuple(w[k : k + 13])
            first[t] = min(first.get(t, doc), doc)
    out = []
    for doc, w in rows:
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < doc:
                gone.update(range(k, k + 13))
        out.append((doc, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def shingles(text, n=2):
    w = WHITE.findall(lower(text))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def op10(docs, n=2):
    sets = [(d, shingles(t, n)) for d, t in docs]
    root = {d: d for d, _ in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and min(len(s), len(t)) * 100 >= 80 * max(len(s), len(t)):
                m = len(s & t)
                if 100 * m >= 80 * (len(s) + len(t) - m):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return [(d, len(s), find(d), find(d) == d) for d, s in sets]


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (2 if k % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text or ""):
            s, digits = m[0], re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in s.split(".")) if kind == "ip" else False, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def crc(ids):
    import numpy as np

    return zlib.crc32(np.array(ids, "<u4").tobytes())


def terms(docs, generalise=0.8, remove=0.95, prior=1.0):
    """doc_id -> [(start, end, action)] of disclosing words, by plain counting over distinct texts."""
    import math

    import regex

    word = regex.compile(r"[\p{L}\p{M}\p{N}]{2,}+|\p{Ideographic}")
    texts = {t or "" for d, t in docs if d is not None}
    bags = {t: {w[0].lower() for w in word.finditer(t)} for t in texts}
    held = {t: {(k, t[a:z].lower()) for k, a, z in base_spans(t)} for t in texts}
    n, n_t, n_c, n_ct = len(texts), {}, {}, {}
    for t in texts:
        for w in bags[t]:
            n_t[w] = n_t.get(w, 0) + 1
        for c in held[t]:
            n_c[c] = n_c.get(c, 0) + 1
            for w in bags[t]:
                n_ct[c, w] = n_ct.get((c, w), 0) + 1

    def disclosure(c, w, more=0.0):
        ic = math.log(n / n_c[c])
        return 1 + math.log((n_ct[c, w] + more * n_c[c] / n) / (n_t[w] + more)) / ic if ic > 0 else -1.0

    out = {}
    for d, t in docs:
        t = t or ""
        action = {}
        for c in held.get(t, ()) if d is not None else ():
            for w in bags[t]:
                if disclosure(c, w) >= generalise:
                    action[w] = "remove" if disclosure(c, w, prior) >= remove or action.get(w) == "remove" else "generalise"
        base = base_spans(t)
        out[d] = [(m.start(), m.end(), action[m[0].lower()]) for m in word.finditer(t) if m[0].lower() in action and not any(a < m.end() and z > m.start() for _, a, z in base)] if action else []
    return out
