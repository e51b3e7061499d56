"""Awkward rows that every operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, label string, score double"

BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega one two three four five six seven eight nine ten"


def rows():
    words = BASE.split()
    near = " ".join([*words[:-1], "changed"])
    huge = " ".join(f"w{k}" for k in range(60_000))
    texts = [BASE, BASE, near, None, "", "   \n\t ", "short one", "short one", "SHORT   ONE", huge, "ünï çödé ßtraße", "12 34 !!", "a" * 5000, BASE.upper(), "中文 文字 测试", "x"]
    return [(k, t, ("en", "de", None)[k % 3], ("s1", None, "s2")[k % 3], None, "clash", 0.5) for k, t in enumerate(texts)] + [(0, BASE, "en", "s1", 1, "clash", 0.1), (None, BASE, "en", "s1", 1, "clash", 0.1), (50, None, None, None, None, None, None)]


def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
