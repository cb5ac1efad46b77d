"""Documents with the cases that operators must stand, and comparison of results as bags of rows."""

import random
from collections import Counter

WORDS = "river stone amber quiet lantern morning velvet harbor copper window saddle thunder meadow sparrow".split()
CLASHING = ["key", "pos", "h1", "salt", "row", "chunk", "bucket", "root", "score", "start", "kind", "held_out", "_part"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "er", "ing"]) + str(rng.randrange(30)) for _ in range(n))


def edge_rows():
    """Texts with copies, near copies, shared passages, repeated lines; nulls, empties, a long text, repeated rows."""
    rng = random.Random(3)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    passage = prose(rng, 30)
    lines = "\n".join(prose(rng, 6) for _ in range(5))
    texts = [
        base, base, " ".join(near), base.upper(), prose(rng, 80) + " " + passage, passage + " " + prose(rng, 70),
        lines, prose(rng, 3) + "\n" + lines + "\n" + prose(rng, 3), "a\na\na\na\na", None, "", " \t\n", "one two", "one two",
        "ab" * 400, "ab" * 300, "é" * 90 + "x", "é" * 90 + "y", prose(rng, 4000), "single", "w " * 500, "\x01 \U0001f600 ok " * 30,
    ]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, base), (None, None), (7, "another text under one id"), (500, base), (-3, passage)]
    return [(i, t, rng.choice(["en", None]), rng.choice(["a", "b", None]), len(t or "")) for i, t in rows]


def result(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())
