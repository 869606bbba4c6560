"""Plain single-machine versions of the operators, from their definitions."""

import re
import zlib
from hashlib import sha256

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def ascii_lower(text):
    return (text or "").translate(ASCII_LOWER)


def contaminated(docs, items, width=10):
    """{doc_id: (n_words, n_hit, items)} for documents with distinct ids."""
    windows = []
    for item, text in items:
        w = WORD.findall(ascii_lower(text))
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.append((item, w[i:i + width]))
    out = {}
    for doc, text in docs:
        words = WORD.findall(ascii_lower(text))
        places = {}
        for i, x in enumerate(words):
            places.setdefault(x, []).append(i)
        hit, found = set(), set()
        for item, w in windows:
            for i in places.get(w[0], ()):
                if words[i:i + len(w)] == w:
                    hit.update(range(i, i + len(w)))
                    found.add(item)
        out[doc] = len(words), len(hit), sorted(map(str, found))
    return out


def components(docs, percent, n=5):
    """{doc_id: (n_shingles, component)} by comparing every pair that shares a shingle."""
    sets = {}
    for doc, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
        sets[doc] = {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    seen = set()
    for members in by.values():
        for i, a in enumerate(members):
            for b in members[:i]:
                if (a, b) in seen:
                    continue
                seen.add((a, b))
                x, y = sets[a], sets[b]
                if 100 * len(x & y) >= percent * len(x | y):
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in sets}


def judged(url, rules, default="allow"):
    """(host, path, rule, verdict) of a url."""
    if url is None or "://" not in url:
        host, path = "", ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = ascii_lower(host)
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    if not fits:
        return host, path, None, default
    best = max(fits, key=lambda r: (r[0].count("."), len(r[1]), r[2]))
    return host, path, best[0] + best[1], best[2]


def edited(docs):
    """{doc_id: sha256 of the edited text} for distinct ids."""
    order = sorted(docs, key=lambda d: -d[0])
    out = {}
    for i, (doc, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 3
        out[doc] = sha256((text[:len(text) - cut] + following[:cut]).encode()).hexdigest()
    return out


def token_digest(docs, tokenizer, end_id=1):
    """{doc_id: (start, n_tokens, crc32)} for distinct ids."""
    out, start = {}, 0
    for doc, text in sorted(docs):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id]
        out[doc] = start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        start += len(ids)
    return out
