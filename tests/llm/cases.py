"""Small tables that every operator must take: nulls, empties, repeats, ties, long texts, clashing columns."""

import random

WORDS = "the of and river stone amber quiet lantern orchard velvet meadow copper signal harbor thistle window garden marble echo winter ember saddle puzzle rocket cinder willow anchor basket".split()
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) * (rng.random() < 0.5) for _ in range(n))


def documents(seed=1):
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(20, 120)) for _ in range(12)]
    texts = list(base)
    for t in base[:4]:
        w = t.split()
        w[len(w) // 2] = "changed"
        texts += [" ".join(w), t, " ".join(w[: len(w) // 2])]
    texts += [None, "", "   ", "one", "###", "###", prose(rng, 4000), "É\nÉ\tß ", "a b c d", "A, b. C d!"]
    rows = [(k, t, "en", None if k % 7 == 0 else f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[0], rows[2], (None, base[1], None, "s1", None), (None, base[1], None, "s1", None), (5, "another text under a used id, long enough to count as such", "de", "s2", 3)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows=None, extra=True):
    df = spark.createDataFrame(documents() if rows is None else rows, DOCS)
    if extra:
        # Columns whose names the operators use inside.
        for c in ("id", "node", "h", "key", "size", "bands", "y", "w"):
            df = df.withColumn(c, df.lang)
    return df.repartition(3)
