"""Plain-Python versions of the corpus operators' contracts, for small data."""

import re
import zlib
from collections import Counter

import numpy as np
import xxhash

SPACES = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def fold(doc_id, parts):
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % parts


def measures(text):
    w = words(text)
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def simhash(text, shingle=4):
    w = words(ascii_lower(text))
    if not w:
        return 0
    parts = [" ".join(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=4):
    """Label (smallest position) of every fingerprint in a list."""
    a = np.array(prints, dtype=np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= radius
    label = np.arange(len(a))
    while True:
        least = np.array([label[row].min() for row in near])
        if (least == label).all():
            return label.tolist()
        label = least


def targets(sizes, weights=(5, 2, 1)):
    """The excess over twice a source's size, reshared by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 2.0 * sizes[s] for s in over}
        if len(capped) == len(order):
            return capped


def boilerplate(rows, ratio, least):
    """(host, line) pairs of rows (host, text); equal texts are one page."""
    rows = set(rows)
    pages, count = Counter(h for h, _ in rows), Counter()
    for h, t in rows:
        count.update({(h, x.strip(SPACES)) for x in (t or "").split("\n") if words(x)})
    return {k for k, n in count.items() if n >= least and n > ratio * pages[k[0]]}


def drop_lines(host, text, bad):
    return None if text is None else "\n".join(x for x in text.split("\n") if (host, x.strip(SPACES)) not in bad)
