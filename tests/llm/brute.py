"""Brute-force versions that several tests use."""

import re


def sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def similarity(a, b):
    return len(sets(a) & sets(b)) / len(sets(a) | sets(b))


def groups(rows):
    """Row numbers by group, joined over all pairs."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    own = [sets(t) for _, t in rows]
    for i in range(len(rows)):
        for k in range(i):
            if 5 * len(own[i] & own[k]) >= 4 * len(own[i] | own[k]):
                root[find(i)] = find(k)
    out = {}
    for i in range(len(rows)):
        out.setdefault(find(i), []).append(i)
    return list(out.values())


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base(text):
    found = {}
    for kind, pattern in KINDS.items():
        found[kind] = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits[:30])))
            if kind == "ip" and any(int(p[-9:]) > 255 or len(p.lstrip("0")) > 3 for p in m[0].split(".")):
                continue
            if kind == "card" and (not 16 <= len(digits) <= 19 or total % 10):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            found[kind].append((m.start(), m.end()))
    return found
