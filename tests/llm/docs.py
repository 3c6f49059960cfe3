"""Small document tables with the awkward cases: nulls, empty and long texts, repeated rows, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "en": "the house and water that river stone morning light people under window every garden little".split(),
    "de": "das haus und wasser der fluss stein morgen licht leute unter fenster jeder garten klein".split(),
    "fr": "la maison et eau qui rivière pierre matin lumière gens sous fenêtre chaque jardin petit".split(),
}


def prose(lang: str, n: int, seed: int) -> str:
    rng = random.Random(f"{lang}{seed}")
    return " ".join(rng.choice(WORDS[lang]) + (rng.choice(".,") if rng.random() < 0.1 else "") for _ in range(n))


def plain(n: int = 60) -> list[tuple]:
    out = []
    for i in range(n):
        lang = ("en", "de", "fr")[i % 3]
        text = prose(lang, 20 + 7 * (i % 13), i)
        out.append((i, text, lang, f"s{i % 4}", len(text)))
    return out


def awkward() -> list[tuple]:
    """Rows after the plain ones: nulls in every column, empty, blank, no letter, very long, repeated."""
    long = prose("en", 30_000, 999)
    return [
        (100, None, "en", "s0", None), (101, "", None, None, 0), (102, " \t\n", "de", "s1", 3), (103, "12 34 --", "en", None, 8),
        (None, "the house and the water under the window", "en", "s2", 1), (None, None, None, None, None),
        (104, long, "en", "s3", len(long)), (105, "ein", "de", "s1", 3), (105, "ein", "de", "s1", 3), (106, "naïve ☃ 𝄞 text", None, "s2", 1),
    ]


def table(spark, rows, extra: bool = False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        # Names that operators use themselves.
        for c in ("size", "target", "score", "lang_pred", "row", "t1", "fp", "block", "n_bytes", "own", "key", "n", "copies", "rank"):
            df = df.selectExpr("*", f"'x' as {c}")
    return df
