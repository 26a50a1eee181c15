"""Small tables with the awkward cases every operator has to bear."""

import random

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

AWKWARD = [None, "", " ", "\n\n", "one", "a b c", "Straße ñ 漢字 😀", "tab\tand\x0bfeed\r\nline", "!!! ??? ...", "x" * 3000]


def words(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def texts(seed=1, n=40):
    """Awkward texts, random ones, exact and near copies of a hub, shared passages and one long text."""
    rng = random.Random(seed)
    out = [*AWKWARD, *AWKWARD]
    passage = words(rng, 60)
    hub = words(rng, 120, 100_000)
    for i in range(n):
        out.append(words(rng, rng.randrange(1, 90)))
        near = hub.split()
        for _ in range(i % 4):
            near[rng.randrange(len(near))] = f"edit{i}"
        out.append(" ".join(near))
        if i % 5 == 0:
            out += [hub, words(rng, 20) + " " + passage + "\n" + words(rng, 9)]
    out.append(words(rng, 6000))
    return out


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def numbered(spark, some):
    """doc_id and text, with an extra column whose name clashes with internal ones, a row without id and a repeated row."""
    rows = [(i, t, "clash") for i, t in enumerate(some)]
    rows += [(None, "without id, " + words(random.Random(3), 30), "clash"), rows[-1]]
    return spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(3)
