"""Plain restatements that several tests share."""

import re
from itertools import combinations


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def plain_fingerprint_classes(fps):
    """Smallest id reachable over fingerprints at four or fewer bits."""
    root = {d: d for d in fps}
    changed = True
    while changed:
        changed = False
        for a, b in combinations(sorted(fps), 2):
            if (fps[a] ^ fps[b]).bit_count() <= 4 and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return root
