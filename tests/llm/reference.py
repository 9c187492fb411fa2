"""The pipeline's stages in plain Python over rows (doc_id, text, lang, source, n_chars)."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

from stationcast.llm.quality_rules import BOILERPLATE, SEPARATORS, SYMBOLS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _bad_line(line):
    words = WORD.findall(line)
    if not words:
        return False
    c = sum(map(len, words))
    capital = len(re.findall("[A-ZÀ-ÖØ-Þ]", line))
    small = len(re.findall("[a-zß-öø-ÿ]", line))
    low = line.translate({x: x + 32 for x in range(65, 91)})
    return (
        10 * sum(line.count(s) for s in SYMBOLS) > c
        or 5 * sum(w in SEPARATORS for w in words) >= len(words)
        or (len(words) >= 3 and capital > small)
        or (len(words) >= 4 and 2 * sum(a == b for a, b in itertools.pairwise(words)) > len(words))
        or (len(words) >= 40 and not re.search("[.!?,;:]", line))
        or (len(words) <= 40 and any(p in low for p in BOILERPLATE))
    )


def quality(rows):
    out = []
    for doc_id, text, lang, source, _ in rows:
        words = WORD.findall(text or "")
        windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
        inside = {p for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for p in range(i, i + 8)}
        lines = (text or "").split("\n")
        lost = sum(len("".join(WORD.findall(x))) for x in lines if _bad_line(x))
        if len(words) < 20 or 100 * len(inside) > 30 * len(words) or 100 * lost > 30 * sum(map(len, words)):
            continue
        clean = "\n".join(x for x in lines if not _bad_line(x))
        out.append((doc_id, clean, lang, source, len(clean)))
    return out


def join(rows):
    sets = []
    by_shingle = defaultdict(list)
    for i, row in enumerate(rows):
        w = WORD.findall(row[1] or "")
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
        for s in sets[-1]:
            by_shingle[s].append(i)
    both = Counter(p for own in by_shingle.values() for p in itertools.combinations(own, 2))
    label = list(range(len(rows)))
    linked = [p for p, c in both.items() if 5 * c >= 4 * len(sets[p[0]] | sets[p[1]])]
    for _ in range(len(rows)):
        before = list(label)
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b], key=lambda i: rows[i][0])
        if label == before:
            break
    return [row for i, row in enumerate(rows) if label[i] == i]


def dedup(rows):
    words = [list(WORD.finditer(r[1] or "")) for r in rows]
    count = Counter(tuple(m[0] for m in w[i:i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for (doc_id, text, lang, source, _), w in zip(rows, words):
        gone = {p for i in range(len(w) - 34) if count[tuple(m[0] for m in w[i:i + 35])] > 1 for p in range(i, i + 35)}
        ends = [m.start() for m in w[1:]] + [len(text)]
        parts = [text[m.start():e] for i, (m, e) in enumerate(zip(w, ends)) if i not in gone]
        clean = text[: w[0].start() if w else len(text)] + "".join(parts)
        out.append((doc_id, clean, lang, source, len(clean)))
    return out


def mix(rows):
    size = [len(WORD.findall(r[1] or "")) for r in rows]
    total = defaultdict(int)
    for r, n in zip(rows, size):
        total[r[3]] += n
    names = sorted(total, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), 1.5 * sum(total.values())
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 2 * total[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * total[s] for s in over}
        rest -= sum(2 * total[s] for s in over)
        free -= over
    out = []
    for s in names:
        own = defaultdict(list)
        for r, n in zip(rows, size):
            if r[3] == s:
                own[hashlib.md5(str(r[0] if r[0] is not None else "null").encode()).hexdigest()[:9]].append((r, n))
        rounds = int(target[s] // total[s]) if total[s] else 0
        left = target[s] - rounds * total[s]
        for key in sorted(own):
            n = sum(x[1] for x in own[key])
            more = left is not None and (n <= left or 2 * left > n)
            left = None if left is None or n > left else left - n
            out += [r for r, _ in own[key] for _ in range(rounds + more)]
    return out
