"""Small tables with the awkward rows that every operator must stand."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, toxic_score double, item_id long, fp long"


def awkward(spark):
    rnd = random.Random(5)
    words = [f"{a}{b}" for a in ("al", "be", "cor", "dan", "el", "fi") for b in ("ta", "mo", "ri", "su", "ven")]
    text = [" ".join(rnd.choice(words) for _ in range(60)) for _ in range(12)]
    rows = [(i, t, "en", f"s{i % 3}", len(t), 0.5, 7, 1) for i, t in enumerate(text)]
    rows += [(3, text[3], "en", "s0", 1, None, None, None), (3, text[3], "en", "s0", 1, None, None, None)]  # repeated
    rows += [(20, text[0], None, None, None, None, None, None), (None, text[1], None, "s1", None, None, None, None)]
    rows += [(21, "", "fr", "s2", 0, None, None, None), (22, None, None, None, None, None, None, None), (23, "  \n\t ", "de", "s0", 5, None, None, None), (24, "word", "de", "s0", 4, None, None, None)]
    rows += [(25, " ".join(rnd.choice(words) for _ in range(30_000)), "en", "s1", 1, None, None, None), (26, "Ünïcödé 12.5 «текст» 漢字 \U0001f600 <|im_end|>", "xx", "s1", 1, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def nothing(spark):
    return spark.createDataFrame([], DOCS)
