"""Documents with every odd case, for the tests of the corpus operators."""

import re

#: Extra columns whose names the operators use themselves.
CLASHING = ["row", "path", "size", "key", "taken", "blob", "_row", "_doc", "_key", "_score", "spans", "component_id", "payload", "place", "label", "tree", "target", "kept"]
LONG = " ".join(f"w{i * i % 977}" for i in range(40_000))
ODD = [
    (1, "alpha beta gamma", "web"),
    (2, None, "web"),
    (3, "", None),
    (4, "  \n\t ", ""),
    (None, "lost id here", "web"),
    (None, None, None),
    (5, "alpha beta gamma", "code"),
    (5, "alpha beta gamma", "code"),
    (6, "é ü 漢字 🙂 \xa0 a\x1cb x\x85y <|endoftext|> it's they'll  two", None),
    (7, LONG, "web"),
    (8, LONG + " end", "web"),
    (9, "tie", "code"),
    (10, "TIE", "code"),
]


def documents(spark, rows):
    """(doc_id, text, source) rows with all columns of documents and the clashing ones."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), *["x"] * len(CLASHING)) for i, t, s in rows], schema)


def words(text, lower=False):
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in found] if lower else found


def near_components(rows, n, percent):
    """doc_id: (set size, least doc_id reachable) by comparing all pairs; rows are (doc_id, text)."""
    sets = {}
    for i, t in rows:
        w = words(t, lower=True)
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def colliding_words(n=1024):
    """Two different words that collide under every polynomial hash modulo 2**64."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
