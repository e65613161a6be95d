"""Folds over lines, sentences and tokens: their results, and time in proportion to the text."""

import re
import time

import pytest
from pyspark.sql import functions as F

from proseflow.functions import text as T
from proseflow.operators import fidelity, lexicon_ru, rules_ru, segments

N = 20_000


def one(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id long, text string")


def test_fold_list(spark):
    df = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 63, 64, 65, 128, 129, 1000)], "xs array<int>")
    step = lambda s, x: ((s + x).cast("int"), F.when(x % 3 == 0, F.array(s)).when(x % 3 == 1, F.array(s, x)).otherwise(F.expr("array()").cast("array<int>")))
    for xs, got in df.select("xs", T.fold_list(F.col("xs"), F.lit(0), step, "int")).collect():
        want, s = [], 0
        for x in xs:
            want += [s] if x % 3 == 0 else [s, x] if x % 3 == 1 else []
            s += x
        assert got == want


def test_cut_like(spark):
    rows = [("", []), ("abc", ["xyz"]), ("é" * 3000 + "ab" * 500, ["p" * (k % 7) for k in range(1000)] + ["r" * 1003])]
    for text, pieces, got in spark.createDataFrame(rows, "text string, pieces array<string>").select("text", "pieces", T.cut_like(F.col("text"), F.col("pieces"))).collect():
        want, at = [], 0
        for p in pieces:
            want.append(text[at : at + len(p)])
            at += len(p)
        assert got == want


def test_fences(spark):
    texts = ["", "```", "a\n```\nb\n```\nc", "```\na\n~~~\n```\n~~~\nb", "~~~x\na", "a\n ```\n```\n```\nb"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.split("text", "\n", -1).alias("ls"))
    rows = df.select("text", rules_ru.fenced_lines(F.col("ls")).alias("inside"), rules_ru.fenced_blocks(F.col("ls")).alias("blocks")).collect()
    for text, inside, blocks in rows:
        open_, since, flags, want = "", 0, [], []
        lines = text.split("\n")
        for i, x in enumerate(lines):
            mark = m[1] if (m := re.match(r"\s*(```|~~~)", x)) else ""
            flags.append(bool(open_ or mark))
            if not open_:
                open_, since = mark, i
            elif mark == open_:
                open_ = ""
                want.append((since, i))
        want += [(since, len(lines))] if open_ else []
        assert (inside, [tuple(b) for b in blocks]) == (flags, want)


TEXTS = {
    "tokens of a sentence": (lambda n: "слово и еще " * (n // 3), lambda d: rules_ru.tokens(d)),
    "parts of a token": (lambda n: "а-" * n + "а", lambda d: lexicon_ru.candidates(d)),
    "sentences of a line": (lambda n: "Он был. И `x` тут. " * (n // 2), lambda d: rules_ru.placed(d)),
    "lines with conjunctions": (lambda n: "\n".join(["а потом, и так", " "] * (n // 2)), lambda d: rules_ru.placed(d)),
    "fences": (lambda n: "\n".join(["```", "x", "```", "y"] * (n // 4)), lambda d: d.select(rules_ru.prose(F.col("text")))),
    "code lines": (lambda n: "\n".join(["    x = 1", "- a `b`", "", "text"] * (n // 4)), lambda d: d.select(segments.strip_code(F.col("text")))),
    "numbers found": (lambda n: " ".join(map(str, range(n))), lambda d: d.select(fidelity.found_in(F.col("text"), fidelity.NUMBER))),
    "spans of code": (lambda n: "\n".join(f"`x{k}` and `y{k % 7}`" for k in range(n // 2)), lambda d: d.select(fidelity.code_of(F.col("text")))),
}


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_twice_the_text_takes_twice_the_time(spark, name):
    make, run = TEXTS[name]

    def seconds(n):
        df = one(spark, make(n)).cache()
        df.count()
        times = []
        for _ in range(2):
            start = time.perf_counter()
            run(df).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        df.unpersist()
        return min(times)

    seconds(N // 4)
    base = seconds(4)  # what a run takes besides the text
    small, large = seconds(N) - base, seconds(2 * N) - base
    assert large <= 2.3 * small + 0.4, (base, small, large)
