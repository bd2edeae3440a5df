"""Plain single-machine versions that the operators are held against."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingle_set(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def similar(rows, threshold=0.8):
    """doc_id -> (class_id, n_links); ids are unique."""
    sets = {d: shingle_set(t) for d, t in rows}
    ids = sorted(sets)
    parent = {d: d for d in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) >= threshold * len(x | y):
                links[a] += 1
                links[b] += 1
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {d: (root(d), links[d]) for d in ids}


def contamination(rows, items, width=13):
    """doc_id -> (n_words, n_hit, sorted item ids)."""
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1)) if w else ():
            windows[tuple(w[i : i + width])].add(str(item))
    out = {}
    for d, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[k]
        out[d] = (len(w), len(hit), sorted(found))
    return out


def cut_repeats(texts, depth):
    """For each text (n_bytes, n_removed, n_spans, sha256) after every repeated window is cut out."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + depth] for d in data for i in range(len(d) - depth + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - depth + 1):
            if seen[d[i : i + depth]] > 1:
                gone[i : i + depth] = b"\1" * depth
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def dedup_lines(rows, size=3):
    """rows in doc_id order -> [(doc_id, text, n_removed)]."""
    seen, out = set(), []
    for d, text in rows:
        if text is None:
            out.append((d, None, 0))
            continue
        lines, gone = text.split("\n"), set()
        for i in range(len(lines) - size + 1):
            w = tuple(lines[i : i + size])
            if not "".join(w).strip(" \t\n\v\f\r"):
                continue
            if w in seen:
                gone.update(range(i, i + size))
            seen.add(w)
        out.append((d, "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)))
    return out


def unigram_count(word, scores, unknown):
    """Tokens of the best segmentation: highest score, then fewest tokens."""
    best = [(0.0, 0)]
    for d in range(1, len(word) + 1):
        s, n = best[d - 1]
        ways = [(s + unknown, n + len(word[d - 1].encode()))]
        for i in range(d):
            if word[i:d] in scores:
                ways.append((best[i][0] + scores[word[i:d]], best[i][1] + 1))
        top = max(w[0] for w in ways)
        best.append((top, min(n for s, n in ways if s > top - 1e-9)))
    return best[-1][1]


def url_verdict(url, rules, default="allow"):
    """(host, path, rule, verdict)"""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for rule, verdict in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, default)
