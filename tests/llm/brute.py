"""Plain single-machine versions of the operators, for comparison."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def jaccard_components(docs):
    """doc_id: (n_shingles, component_id); rows of one id are tied."""
    sets = []
    for i, t in docs:
        w = WORD.findall(low(t))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for g in s:
            holders[g].append(k)
    for k, (i, s) in enumerate(sets):
        both = defaultdict(int)
        for g in s:
            for m in holders[g]:
                if m > k:
                    both[m] += 1
        for m, n in both.items():
            if 100 * n >= 75 * (len(s) + len(sets[m][1]) - n):
                a, b = sorted((root(i), root(sets[m][0])))
                parent[b] = a
    most = defaultdict(int)
    for i, s in sets:
        most[i] = max(most[i], len(s))
    return {i: (most[i], root(i)) for i, _ in sets}


def edits(docs):
    """doc_id: (n_chars, edited_sha256) of documents with different ids."""
    rows = sorted(((i, t or "") for i, t in docs), key=lambda x: -x[0])
    out = {}
    for k, (i, t) in enumerate(rows):
        n, following = len(t) // 2, rows[(k + 1) % len(rows)][1]
        out[i] = (len(t), sha(t[: len(t) - n] + following[:n]))
    return out


def winnowed(hashes, w):
    """Positions that winnowing picks: in each window the rightmost of the least."""
    at = set()
    for k in range(max(1, len(hashes) - w + 1)):
        part = hashes[k : k + w]
        at.add(k + max(j for j, x in enumerate(part) if x == min(part)))
    return sorted(at)


def without_repeats(docs, length=13):
    """(doc_id, n_words, n_removed, kept_sha256) of each row."""
    least = {}
    rows = [(i, WORD.findall(t or "")) for i, t in docs]
    for i, w in rows:
        for k in range(len(w) - length + 1):
            g = tuple(w[k : k + length])
            least[g] = min(i, least.get(g, i))
    out = []
    for i, w in rows:
        gone = set()
        for k in range(len(w) - length + 1):
            if least[tuple(w[k : k + length])] < i:
                gone.update(range(k, k + length))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def repeat_words(words):
    n = defaultdict(int)
    for k in range(len(words) - 2):
        n[tuple(words[k : k + 3])] += 1
    return len({k + j for k in range(len(words) - 2) if n[tuple(words[k : k + 3])] > 1 for j in range(3)})


def quality_base(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    words = WORD.findall(text or "")
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    r = repeat_words(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, r, len(words) < 50 or 100 * r > 50 * len(words)


def license_base(text):
    """n_words, n_base, first_word, last_word, base_labels."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    found = [(k, label) for p, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    at = [k for k, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def sources_targets(totals, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by resharing what is above, again and again."""
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, full = share * sum(totals.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        each = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        above = [s for s in rest if each[s] > most * totals[s]]
        if not above:
            return full | each
        for s in above:
            full[s] = most * totals[s]
            left -= full[s]
