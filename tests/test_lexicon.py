"""Inflected patterns: two algorithms agree in the queries; here known answers."""

import json

import pytest

from proseflow.operators import lexicon_ru as L
from proseflow.operators import rules_ru


def test_patterns():
    assert [[w["stem"] for w in p] for p in L.parse_term("[за,про]деплой:n, код:n написан:n, `Ёж`")] == [["деплой"], ["код", "написан"], ["еж"]]
    assert L.parse_word("[за]депло:vn") == {"prefixes": ["", "за"], "stem": "депло", "classes": "nv", "number": False}
    for bad in ("депло:x", "[за", ":n", ""):
        with pytest.raises(ValueError):
            L.parse_word(bad)
    assert len(L.verb_endings()) == 2959 and len(L.NOUN_ENDINGS) == 43 and "" not in L.verb_endings()


def found(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return sorted((r.rule, r.match) for r in L.single_words(df).collect()), sorted(r.match for r in L.phrases(df, L.SEED["ru-non-approved"] + [{"term": "уровен:n #"}]).collect())


def test_findings(spark):
    assert found(spark, "Мы задеплоили сервис и смотрим логи.") == ([("lexicon", "задеплоили"), ("lexicon", "логи")], [])
    assert found(spark, "Логика web-сервера и web-сервер.") == ([], [])
    assert found(spark, "Узлы сети целы.") == ([("domain", "узлы")], [])
    assert found(spark, "Узлы целы.") == ([("lexicon", "узлы")], [])
    assert found(spark, "Крутые узлы сети.") == ([("lexicon", "узлы")], [])
    assert found(spark, "Код написан, а код  написан. Код, написан. Уровень 5 и уровень пять. Код. Написан.") == ([], ["Код написан", "Уровень 5", "код написан"])
    assert found(spark, "Уровену 5.")[1] == ["Уровену 5"]


def test_lookup(spark):
    got = {(r.term, r.table, r.row_id) for r in L.lookup(spark, ["логами", "код написан", "код", "узлов"]).collect()}
    assert got == {("логами", "ru-non-approved", 1), ("код написан", "ru-non-approved", 3), ("узлов", "ru-non-approved", 2), ("узлов", "ru-domain", 0)}


def test_read_tables(spark, tmp_path):
    def write(name, columns, rows):
        (tmp_path / "l.json").write_text(json.dumps({"files": [{"name": name, "columns": columns, "rows": rows}]}))
        return L.read_tables(spark, str(tmp_path / "l.json"))

    assert write("ru-allowed", ["note", "class", "term"], [["x", "latin", "api"]]) == {"ru-allowed": [{"note": "x", "class": "latin", "term": "api"}]}
    for bad in (("ru-allowed", ["term"], [["api"]]), ("ru-allowed", ["term", "class"], []), ("ru-allowed", ["term", "class"], [["api", "greek"]])):
        with pytest.raises(ValueError):
            write(*bad)


def test_verdict(spark):
    texts = {
        "Мы задеплоили сервис.": (1, 0, 1),
        "Код написан.": (1, 0, 1),
        "Узлы сети целы.": (0, 1, 0),
        "Узлы целы, код  написан и задеплоен, а UIшка нет.": (4, 0, 1),
        "Вот web-сервер.": (0, 0, 0),
        "Вот foo, а вот big data и bar.": (1, 2, 1),
        "Bar, big data.": (1, 1, 1),
        "Чистый текст.": (0, 0, 0),
        "": (0, 0, 0),
    }
    lexicon = L.SEED | {"ru-non-approved": [*L.SEED["ru-non-approved"], {"term": "big data", "kind": "slang", "use_instead": "данные"}]}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [tuple(r)[1:] for r in rules_ru.verdict(df, lexicon).orderBy("doc_id").collect()] == list(texts.values())
    assert rules_ru.verdict(df.limit(2)).where("exit_code = 1").count() == 2


def test_cues_of_many_rows(spark):
    import random
    import re

    from pyspark.sql import functions as F

    from proseflow.functions import text as T

    rng = random.Random(8)
    cells = [", ".join("".join(rng.choices("абв", k=rng.randint(1, 4))) for _ in range(rng.randint(0, 3))) for _ in range(106)]
    texts = [" ".join("".join(rng.choices("абвгё-", k=rng.randint(1, 7))) for _ in range(12)) for _ in range(60)] + ["", "АБВ", "х_аб"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for text, rows in df.select("text", L.cue_rows(F.col("text"), cells)).collect():
        low = text.lower().replace("ё", "е")
        want = [i for i, cell in enumerate(cells) if any(re.search(r"(?<!\w)" + re.escape(c), low) for c in L._cues(cell))]
        assert sorted(rows) == want, text
    assert re.fullmatch(T.trie_pattern(["a.b", "a", "a.c", "b"]), "a.c") and not re.fullmatch(T.trie_pattern(["a.b", "a"]), "axb")
    pattern = re.compile(T.trie_pattern([c for cell in cells for c in L._cues(cell)]))
    assert all(pattern.match(c)[0] == c for cell in cells for c in L._cues(cell))


def test_lookup_leaves_out_words_that_meet_nothing(spark):
    """Only terms whose first word a table knows are made distinct."""
    firsts = spark.createDataFrame([("лог",), ("#",), ("recommend*",), ("пробный запуск",)], "key string")
    terms = ["ЛОГ", "лог файл", "12", "Recommended", "Пробный запуск", "иное", "x1", ""]
    df = spark.createDataFrame([(t,) for t in terms], "term string")
    assert sorted(r.term for r in L._may_match(df, firsts, L.FULL["hedges-en-ru"]).collect()) == sorted(terms[:5])
