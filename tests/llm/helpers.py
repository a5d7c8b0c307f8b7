"""Small tables with the awkward cases every operator has to define."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string, row long"


def frame(spark, rows):
    """Documents with extra columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), 0.5, "x", 7) for i, t, lang, src in rows], DOCS)


def awkward(seed=0, n=60):
    """Nulls, blanks, repeats, odd white space, other scripts, long runs and one long text."""
    rnd = random.Random(seed)
    vocab = ["the", "The", "of", "and", "hello", "wörld", "naïve", "don't", "x1", "42", "日本語", "a", "token", "É", "İx", "ß", "fine,", "end."]
    out = []
    for i in range(n):
        out.append((i, " ".join(rnd.choices(vocab, k=rnd.randint(0, 40))), rnd.choice(["en", "de", None]), rnd.choice(["s1", "s1", "s2", None])))
    out += [(n, None, None, None), (n + 1, "", "en", "s1"), (n + 2, "  \n\t ", "en", "s1"), (n + 3, out[3][1], "en", "s2"), (None, "no id at all", "en", "s1"), (None, None, "en", "s1")]
    out += [(n + 4, "a" * 300, "en", "s1"), (n + 5, " ".join(rnd.choices(vocab, k=5000)), "en", "s3"), (7, "the same id again", "en", "s1"), (n + 6, "x\x1cy\x85z w  v\xa0u", "en", "s1")]
    return out
