"""Plain versions of the operators, over all pairs or all strings."""

import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class Sets:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text, n=5):
    words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if len(words) < n:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1))


def near_components(docs, percent):
    sets = {k: shingles(t) for k, t in docs}
    holders = defaultdict(list)
    for k, s in sets.items():
        for g in s:
            holders[g].append(k)
    shared = Counter((a, b) for h in holders.values() for i, a in enumerate(h) for b in h[i + 1:])
    out = Sets(sets)
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            out.join(a, b)
    return {k: (len(s), out.root(k)) for k, s in sets.items()}


def without_repeats(docs, least):
    """{id: (bytes, removed, spans, kept)}; ids differ."""
    seen, out = set(), {}
    for k, text in sorted(docs):
        data = (text or "").encode()
        covered = bytearray(len(data))
        own = [data[i:i + least] for i in range(len(data) - least + 1)]
        for i, s in enumerate(own):
            if s in seen:
                covered[i:i + least] = b"\1" * least
        seen.update(own)
        spans = sum(c and not (i and covered[i - 1]) for i, c in enumerate(covered))
        out[k] = len(data), sum(covered), spans, bytes(b for b, c in zip(data, covered) if not c)
    return out


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def without_lines(docs, least_words):
    """{id: text} of the documents that stay; ids differ."""
    first = {}
    for k, text in sorted(docs):
        for i, line in enumerate((text or "").split("\n")):
            words = tuple(WORD.findall(line.encode()))
            if words:
                first.setdefault(words, (k, i))
    long = sorted((w for w in first if len(w) >= least_words), key=len)
    near = set()
    for i, a in enumerate(long):
        for b in long[i + 1:]:
            if len(b) > len(a) + 1:
                break
            if one_edit(a, b):
                near.add(max(a, b, key=first.get))
    out = {}
    for k, text in docs:
        if text is None:
            out[k] = None
            continue
        left, seen, cut, wordy = [], set(), False, False
        for line in text.split("\n"):
            words = tuple(WORD.findall(line.encode()))
            if words and (words in near or first[words][0] != k or words in seen):
                cut = True
                continue
            seen.add(words)
            wordy |= bool(words)
            left.append(line)
        if not cut or wordy:
            out[k] = "\n".join(left)
    return out


def spelling_variants(docs, one_in, least_length=6, least_count=5, times=5):
    """{word: (form, root, n, n_near, form_n)} of (id, text) rows."""
    count = Counter()
    for k, text in docs:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if h % one_in == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= least_length and n >= least_count}
    near = {w: [v for v in words if v != w and one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= times * words[w]:
            form[w] = best
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = form.get(w), root, n, len(near[w]), words.get(form.get(w))
    return out
