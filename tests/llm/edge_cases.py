"""Rows with every kind of edge, for all operators."""

import random

WORDS = "the of and river stone light people table green walk answer never small large under paper window summer".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 60)) for _ in range(n))


def edge_rows():
    """(doc_id, text): nulls, empties, ties, repeated rows, a repeated id, a very long text."""
    rng = random.Random(5)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base),
        (2, base),
        (2, base),
        (3, " ".join(near)),
        (4, base + "\n" + prose(rng, 60)),
        (5, ""),
        (6, None),
        (7, " \n\t "),
        (8, "short text"),
        (9, "short text"),
        (10, prose(rng, 4000) + " " + base),
        (11, "\u00a0nbsp\u00a0word \u2003 em é́ İ"),
        (None, base),
        (None, None),
        (12, prose(rng, 55)),
        (12, prose(rng, 56)),
    ]
    return rows + [(20 + i, prose(rng, 30 + i)) for i in range(30)]
