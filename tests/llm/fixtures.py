"""Documents with everything that may go wrong."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept int, id string, digest int"


def prose(words: int, seed: int, vocabulary: str = "abcdefgh") -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(vocabulary, k=rng.randint(2, 7))) for _ in range(words))


def awkward(spark, extra=()):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    long = prose(3000, 1) + "\n" + "x" * 5000
    base = prose(120, 2)
    near = base.split()
    near[60] = "changed"
    texts = [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, long), (7, long), (7, long), (None, None), (None, prose(40, 3)),
        (8, " \t\r\n "), (9, "one"), (10, "one"), (11, "The quick 123 fox's\n\n  don't 'll  " + base), (12, prose(80, 4) + "\n" + base), *extra,
    ]
    rows = [(i, t, "en" if t else None, None if i == 9 else f"s{(i or 0) % 3}", len(t or ""), "x", 1, "y", 2) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def source_targets(sizes: dict, weights=(5, 2, 1), share: float = 1.5, most: float = 2) -> dict:
    """Each source's share of 150 % of all sizes by weight, step by step: above twice its size the excess is shared anew."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, targets = share * sum(sizes.values()), list(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > most * sizes[s]]
        if not full:
            return targets | {s: unit * weight[s] for s in open_}
        for s in full:
            targets[s] = float(most * sizes[s])
            left -= targets[s]
            open_.remove(s)
    return targets
