"""Plain Python versions of what the operators return, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def repeated_passages(rows, width=20):
    """op1. Rows equal in doc_id and text are one document; other rows of one doc_id come in any order, so texts of one doc_id must not share windows."""
    seen, out = {}, []
    for k, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        ws, gone = BLANK.findall(t or ""), set()
        for i in range(len(ws) - width + 1):
            w = tuple(ws[i : i + width])
            if w in seen:
                gone.update(range(i, i + width))
            seen.setdefault(w, k)
        out += [(k, len(ws), len(gone), sha(" ".join(w for i, w in enumerate(ws) if i not in gone)))] * list(rows).count((k, t))
    return out


def repeated_strings(rows, width=400):
    """op3."""
    data = [(k, (t or "").encode()) for k, t in rows]
    n = Counter(hash(d[i : i + width]) for _, d in data for i in range(len(d) - width + 1))
    out = []
    for k, d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - width + 1):
            if n[hash(d[i : i + width])] > 1:
                gone[i : i + width] = b"\1" * width
        spans = sum(1 for i in range(len(d)) if gone[i] and not (i and gone[i - 1]))
        out.append((k, len(d), sum(gone), spans, sha(bytes(c for c, g in zip(d, gone, strict=True) if not g))))
    return out


def jaccard_components(rows, width=5, percent=80):
    """op4: (doc_id, n_shingles, component_id), all pairs that share a shingle."""
    sets = []
    for _, t in rows:
        ws = BLANK.findall(lower(t))
        sets.append({tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)} if len(ws) >= width else {tuple(ws)} if ws else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            lists[g].append(i)
    met = {(i, j) for own in lists.values() for a, i in enumerate(own) for j in own[a + 1 :]}
    for i, j in met:
        both = len(sets[i] & sets[j])
        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return [(k, len(sets[i]), least.get(find(i))) for i, (k, _) in enumerate(rows)]


def contaminated(rows, items, width=13):
    """op7."""
    windows = defaultdict(set)
    for item, text in items:
        ws = ALNUM.findall(lower(text))
        for i in range(max(1, len(ws) - width + 1) if ws else 0):
            windows[tuple(ws[i : i + width])].add(item)
    lengths = {len(w) for w in windows}
    out = []
    for k, t in rows:
        ws = ALNUM.findall(lower(t))
        hit, met = set(), set()
        for m in lengths:
            for i in range(len(ws) - m + 1):
                if (w := tuple(ws[i : i + m])) in windows:
                    hit.update(range(i, i + m))
                    met |= windows[w]
        out.append((k, len(ws), len(hit), len(met), sha(",".join(sorted(met))), len(hit) > 0 and 20 * len(hit) >= len(ws)))
    return out


def rule_counts(text):
    """op10: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    ws = BLANK.findall(text)
    lines = [x for x in text.split("\n") if BLANK.search(x)]
    n = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    again = set()
    for i in range(len(ws) - 2):
        if n[tuple(ws[i : i + 3])] > 1:
            again |= {i, i + 1, i + 2}
    failed = len(ws) < 50 or 100 * len(again) > 50 * len(ws)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), failed


def size_and_crc(text):
    data = (text or "").encode()
    return len(data) + 1, zlib.crc32(data)


def targets(sizes, weights=(5, 2, 1), share=Fraction(3, 2), most=2):
    """op2: budgets of sources in order. The common level L solves sum(min(weight * L, most * size)) = share * all; sources without words get nothing."""
    total, caps = share * sum(sizes), [(Fraction(most * n, weights[i % len(weights)]), i) for i, n in enumerate(sizes) if n]
    level, full = Fraction(0), Fraction(0)
    for at, (cap, _) in enumerate(sorted(caps)):
        open_weight = sum(weights[i % len(weights)] for _, i in sorted(caps)[at:])
        level = (total - full) / open_weight
        if level <= cap:
            break
        full, level = full + most * sizes[sorted(caps)[at][1]], cap
    return [min(weights[i % len(weights)] * level, Fraction(most * n)) if n else Fraction(0) for i, n in enumerate(sizes)]
