"""Plain-Python versions of the operators, and awkward rows."""

import re
from collections import defaultdict

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

PROSE = "The quick brown fox jumps over the lazy dog while seven wizards quietly watch the harbour lights. "
ODD_TEXTS = [None, "", "   \n\n ", "!!! ???", "word", "Two words", "\u00c9t\u00e9 na\u00efve \u4e2d\u6587 \U0001f600", PROSE * 300, "x" * 5000, PROSE, PROSE]


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def odd_documents(spark):
    """Awkward texts, repeated rows, a NULL id, and columns named like those operators make."""
    rows = [(i, t, "h1" if i % 2 else None, "en", len(t or ""), "x", True) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[-1], (None, PROSE, "h1", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, ids string, kept boolean")


def ngram_sets(texts, n=5):
    out = []
    for text in texts:
        w = words(text)
        out.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    return out


def jaccard_links(texts):
    """Number of similar others, and the smallest row each row reaches."""
    sets = ngram_sets(texts)
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    common = defaultdict(int)
    for rows in holders.values():
        for a in rows:
            for b in rows:
                if a < b:
                    common[a, b] += 1
    pairs = [(a, b) for (a, b), k in common.items() if 5 * k >= 4 * (len(sets[a]) + len(sets[b]) - k)]
    return reach(len(texts), pairs)


def reach(n, pairs):
    links, root = [0] * n, list(range(n))
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return links, root


def contamination(texts, items, window=13):
    """Word count, hit words and item ids of every text."""
    windows = defaultdict(set)
    for name, text in items:
        w = words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(name))
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if names := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= names
        out.append((len(w), len(hit), sorted(found)))
    return out
