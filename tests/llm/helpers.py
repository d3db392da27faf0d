"""Plain Python versions that the operators are held against."""

import re
from collections import Counter, defaultdict

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


def shingles(text, width):
    ws = words((text or "").translate(FOLD))
    if not ws:
        return frozenset()
    n = min(width, len(ws))
    return frozenset(tuple(ws[i: i + n]) for i in range(len(ws) - n + 1))


def components(sets, percent=80):
    """doc -> least doc reachable over links, all pairs tested."""
    ids, up = sorted(sets), {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def repeats(text):
    ws = words(text)
    at = defaultdict(list)
    for i in range(len(ws) - 2):
        at[tuple(ws[i: i + 3])].append(i)
    return len({p + k for v in at.values() if len(v) > 1 for p in v for k in range(3)})


def dup_lines(text):
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(lines) - len(Counter(lines))


def prose(rng, n, vocab=400):
    """``n`` words of letters only."""
    return " ".join("word" + "".join(chr(97 + int(x) // 26**k % 26) for k in range(3)) for x in rng.integers(0, vocab, n))
