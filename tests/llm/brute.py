"""Plain single-process versions of the operators' contracts."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UP = {i: i + 32 for i in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def near_duplicates(rows, k=5, percent=75):
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(UP))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    index = {}
    for n, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(n)
    seen = set()
    for ids in index.values():
        for a in ids:
            for b in ids:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    i = len(sets[a] & sets[b])
                    if 100 * i >= percent * len(sets[a] | sets[b]):
                        x, y = find(rows[a][0]), find(rows[b][0])
                        parent[max(x, y)] = min(x, y)
    return {(d, len(s), find(d), find(d) == d) for (d, _), s in zip(rows, sets)}


def contamination(rows, items, window=13, share=20):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for item, text in items:
        w = word.findall((text or "").translate(UP))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add("null" if item is None else str(item))
    sizes = sorted({len(k) for k in windows})
    out = set()
    for d, text in rows:
        w = word.findall((text or "").translate(UP))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i:i + n]))):
                    hit.update(range(i, i + n))
                    found |= own
        out.add((d, len(w), len(hit), len(found), sha(",".join(sorted(found))),
                 bool(hit) and share * len(hit) >= len(w)))
    return out


def quality_base(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    repeat = {j for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat),
            len(w) < 10 or 100 * len(repeat) > 20 * len(w))


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LOGIN = re.compile(r"""(?i:\b(user(?:name)?|login|account|client_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{3,64})""", re.A)
ENDPOINT = re.compile(r"""(?i:https?://[a-z0-9][a-z0-9.-]+(?::[0-9]+)?(?:/[^\s"'<>]*)?|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[a-z0-9][a-z0-9.-]{2,}(?::[0-9]+)?)""", re.A)
KINDS = ("assign", "access", "hex", "login", "short", "endpoint")
ROLE = dict(zip(KINDS, ("secret", "identifier", "secret", "identifier", "secret", "endpoint")))
NEEDS = {"identifier": {"secret"}, "secret": {"identifier", "endpoint"}, "endpoint": {"secret"}}


def secrets(text, reach=200):
    text = text or ""
    spans = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 6:
            spans.append((m.start(), "assign" if len(m[2]) >= 12 else "short", m.end()))
    spans += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    spans += [(m.start(), "hex", m.end()) for m in HEX.finditer(text) if len(m[0]) >= 16]
    spans += [(m.start(), "login", m.end()) for m in LOGIN.finditer(text)]
    spans += [(m.start(), "endpoint", m.end()) for m in ENDPOINT.finditer(text)]
    breaks = [m.start() for m in re.finditer(r"\n[\x20\t\r]*\n", text)]

    def scope(s):
        return sum(b <= s for b in breaks)
    keep = [s for s in spans if s[1] in KINDS[:3] or any(
        ROLE[o[1]] in NEEDS[ROLE[s[1]]] and abs(o[0] - s[0]) <= reach and scope(o[0]) == scope(s[0]) for o in spans)]
    keep.sort(key=lambda s: (s[0], KINDS.index(s[1])))
    base = [s for s in keep if s[1] in KINDS[:3]]

    def join(x):
        return ",".join(f"{k}:{a}:{b}" for a, k, b in x)
    return (*(sum(s[1] == k for s in base) for k in KINDS[:3]), sha(join(base)), join(keep))


def substrings(rows, length=50):
    first = {}
    words = [WORD.findall(t or "") for _, t in rows]
    for (d, _), w in zip(rows, words):
        if d is None:
            continue
        for i in range(len(w) - length + 1):
            k = tuple(w[i:i + length])
            first[k] = min(first.get(k, d), d)
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - length + 1):
            if d is not None and first[tuple(w[i:i + length])] < d:
                gone.update(range(i, i + length))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def chats(rows):
    talks = {}
    for c, t, role, text in rows:
        talks.setdefault(c, []).append((t, role or "", text or ""))
    out = set()
    for c, turns in talks.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out.add((c, len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss)))
    return out
