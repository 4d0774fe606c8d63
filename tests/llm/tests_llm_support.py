"""Brute force shared by the tests."""

import re
import string

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute_kept(texts, k, percent):
    """The ids that stay when of each linked group the least stays."""
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(FOLD))
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    home = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                n = len(sets[i] & sets[j])
                if sets[i] and sets[j] and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n) and home[j] < home[i]:
                    home[i], changed = home[j], True
    return sorted(i for i in sets if home[i] == i)
