"""Small awkward tables that every corpus operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, key string, length string, kept string, family string, `a.b` string, `two words` string"


def rows(texts, ids=None):
    """Documents with extra columns whose names the operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    return [(i, t, ["en", "de", None][n % 3], ["a", None, "b", "a"][n % 4], len(t or ""), n, "k", "l", "m", "f", "d", "w") for n, (i, t) in enumerate(zip(ids, texts, strict=True))]


def awkward(seed=0):
    """Nulls, empty and blank texts, one giant, exact and near copies, repeated rows, a repeated id, null ids."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "Und", "é", "naïve", "x" * 30, "łódź", "data-%d" % rng.randrange(400), "w%d" % rng.randrange(3000)])
    base = [" ".join(word() for _ in range(rng.choice([1, 2, 3, 5, 19, 20, 21, 60, 200]))) for _ in range(40)]
    near = []
    for t in base[:25]:
        words = t.split()
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(len(words))] = word()
        near.append("\n".join([" ".join(words), base[rng.randrange(40)][:120]]) if rng.random() < 0.3 else "\t".join(words))
    texts = [None, "", " \n\t ", "123 !!", *base, *near, base[3].upper(), *base[:5], None, " ".join(word() for _ in range(30_000))]
    found = rows(texts)
    found += [found[10], found[12], (found[20][0], *found[21][1:]), (None, *found[8][1:]), (None, "only here " * 9, *found[8][2:])]
    rng.shuffle(found)
    return found
