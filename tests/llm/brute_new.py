"""Plain versions of the operators on conversations, 64-bit fingerprints and hard negatives."""

import math
import re
import zlib
from functools import lru_cache
from hashlib import sha256

import xxhash

SPACE = " \t\n\x0b\x0c\r"


def damaged_rows(rows):
    """{conv_id: [(turn, role, text)]} after damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        show = lambda x: " " if x is None else x
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        mine += [(turn, role, text)] * (2 if kind == 3 else 1)
    key = lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode())
    return {c: sorted(m, key=key) for c, m in out.items()}


def audited(turns):
    """The audit of one conversation's turns [(turn, role, text)] by trying all edits."""
    faults, seen = [], set()
    for _, role, text in turns:
        body = text.strip(SPACE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    follows = {"": "u", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, last, inserts):
        """Least (cost, audit, repaired) from turn i on, after the initial ``last``."""
        found = [(0, "", ())] if i == len(turns) and last in ("", "a") else []
        need = follows[last]
        name = {"u": "user", "a": "assistant"}[need]
        if inserts < 2:
            c, a, r = best(i, need, inserts + 1)
            found.append((c + 2, "I" + a, (f"{name}:", *r)))
        if i < len(turns):
            _, role, text = turns[i]
            c, a, r = best(i + 1, last, 0)
            found.append((c + 3, "D" + a, r))
            if faults[i] not in ("blank", "duplicate"):
                stay = faults[i] == "truncated"
                c, a, r = best(i + 1, need, 0)
                found.append((c + 2 + stay, "R" + a, (f"{name}:{text}", *r)))
                if role[:1] == need or (role[:1] == "s" and last == ""):
                    c, a, r = best(i + 1, role[0], 0)
                    found.append((c + stay, "K" + a, (f"{role}:{text}", *r)))
        return min(found) if found else (math.inf, "", ())

    cost, audit, repaired = best(0, "", 0)
    numbers = {t for t, _, _ in turns if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    initials = [r[:1] for _, r, _ in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
            sha256("\n".join(repaired).encode()).hexdigest())


def simhash64(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    terms = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(t.encode(), seed=42) for t in terms]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def hamming_components(values, radius=3):
    """{value: smallest value it reaches} over all pairs."""
    values, label = sorted(set(values)), {}
    for v in values:
        if v in label:
            continue
        label[v], open_ = v, [v]
        while open_:
            x = open_.pop()
            for y in values:
                if y not in label and (x ^ y).bit_count() <= radius:
                    label[y] = v
                    open_.append(y)
    return label


def mined(rows, is_anchor, positives=5, negatives=3, least=50, most=95):
    """Sorted result rows for ``rows`` [(vec_id, label, integer vector)] by scoring everything."""
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    out = []
    for i, (anchor, label, v) in enumerate(rows):
        if not is_anchor(anchor):
            continue
        score = [(-dot(v, w), n) for n, _, w in rows]
        same = sorted(score[j] for j, r in enumerate(rows) if r[1] == label and j != i)[:positives]
        other = sorted(score[j] for j, r in enumerate(rows) if r[1] != label)
        for p, pid in same:
            fit = [(n, m) for n, m in other if least * -p <= 100 * -n <= most * -p][:negatives]
            out += [(anchor, pid, r + 1, m, -p, -n) for r, (n, m) in enumerate(fit)]
    return sorted(out)
