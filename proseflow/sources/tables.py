"""Sources: driver tables, text files, and corpora derived from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each whole file: ``path, text``."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


#: English sentences of our own, one for each phenomenon that the rules look for.  ``{n}`` is the key of the row.
ENGLISH = [
    "Open the valve. Turn the handle 90 degrees to the left. Wait for {n} s.",
    "# Section {n}",
    "Before You Start",
    "---",
    "- Remove the cover.\n- Clean the unit with 5 % solution.\n- Install the cover again",
    "1. Push the button.\n2. Read the value. Record it.",
    "The service reads `config {n}` first; it ignores the rest. See internal/app/main.go:{n} for details.",
    "```\nrm -rf build; he said\n```\nAfter the block the text goes on.",
    "We don't know if it's ready. The user's file can't change. Let's go.",
    "Use tools, e.g. a brush, i.e. a soft one, etc. The etcd server is not one. See Fig. 3 and No. {n}.",
    "He told her that the operator must do it himself. The sheet is theirs.",
    "The data has been copied. The job is being stopped. They had written {n} rows. The test was done by the team.",
    "The file was removed. It is installed. The list had changed and was read by nobody.",
    "When running the tool, do not use the wiring diagram. This string is nothing. The cleaning must stop.",
    "The server error log file name list is long. Set the HTTP_PROXY, my_var, fooBar, pkg.Func(), --dry-run and https://a.example/x values.",
    "It may fail. It might be slow; we should probably test it. Perhaps it is likely.",
    "WARNING: THE PUMP IS HOT. DO NOT TOUCH THE PUMP.\r\nNOTE: The JSON API of ACME is new: It has 3.5 kg of paper (see the list in the annex).",
    "A very long sentence in which the writer goes on and on about {n} things that nobody wants to read "
    "because there is no end in sight and the words keep on coming one after the other without a stop.",
    "One. Two. Three. Four. Five. Six. Seven! Eight? \"Nine\" is “ten”.",
]

#: Russian ones.
RUSSIAN = [
    "Служба читает файл {n} раз. Потом она пишет ответ.",
    "Мы деплоим сервис через pipeline, а потом смотрим логи.",
    "Это не-API, а web-сервер с UIшкой и v{n}; он быстрый, но сложный, а код, кажется, старый.",
    "Запустите `make test` и прочитайте https://a.example/{n} до конца. Готово!",
    "Она сказала: «Нет…» И ушла. (Совсем.) а потом вернулась — при этом молча.",
    "Очень длинное предложение, в котором автор долго рассказывает о том, что было сделано за {n} дней, "
    "и никак не может остановиться, потому что слов ещё много, а точки всё нет и нет, но конец близок.",
    "```\nкод и code\n```\nТекст после кода. Код написан за {n} дней, узлы кластера деплоятся.",
    "Крутые узлы сети в логах; узел кластера цел. Задеплоили web-сервером.",
]

#: Words labelled as faults in these, by the text's place in the list; some are none to the lexicon, and some that it has are not labelled.
RUSSIAN_LABELS = {1: ["деплоим", "логи"], 3: ["Готово"], 6: ["узлов", "деплоятся"], 7: ["Крутые", "логах", "узел", "Задеплоили"]}

#: (source, target) pairs; the second of a target's two forms loses or changes something.
PAIRS = [
    ("Set the limit to {n}.5 and run `go test ./...` twice.", "Задайте предел {n},5 и выполните `go test ./...` дважды.", "Задайте предел и выполните тесты дважды."),
    ("See cmd/app/main.go:{n} and ./docs/readme.md for 1,000 rows.", "См. cmd/app/main.go:{n} и ./docs/readme.md: 1000 строк.", "См. main.go: 1 строка."),
    ("It may take {n} ms; it is certainly safe.", "Это может занять {n} мс; это точно безопасно.", "Это займёт {n} мс."),
    ("Deploy the service, wait {n} ms and read the log file.", "Разверните сервис, подождите {n} мс и прочитайте журнал.", "Задеплоили сервис, ждём {n} мс, лог прочитан, узлы целы."),
    ("You should probably use `x` and `y`.", "Вероятно, вам следует взять `x` и `y`.", "Возьмите `x`."),
]


def _quoted(text: str, key: str, newline: str) -> str:
    """SQL for a text with the key in place of {n}, for Spark and DuckDB alike."""
    parts = []
    for k, piece in enumerate(text.split("{n}")):
        if k:
            parts.append(f"CAST({key} AS {newline})")
        for j, line in enumerate(piece.replace("'", "''").split("\n")):
            if j:
                parts.append("chr(10)")
            for i, x in enumerate(line.split("\r")):
                if i:
                    parts.append("chr(13)")
                parts.append(f"'{x}'")
    return "concat(" + ", ".join(parts) + ")"


def chosen(texts: list[str], key: str, kind: str = "VARCHAR") -> str:
    """SQL that picks a text by ``key``."""
    cases = " ".join(f"WHEN {k} THEN {_quoted(t, 'o_orderkey', kind)}" for k, t in enumerate(texts))
    return f"CASE CAST({key} AS INT) % {len(texts)} {cases} END"


def corpus_sql(texts: list[str], kind: str = "VARCHAR") -> str:
    """SQL for ``doc_id, text``: three paragraphs for each order."""
    parts = [chosen(texts, f"floor(o_orderkey / {d})", kind) for d in (1, 5, 11)]
    return f"SELECT o_orderkey AS doc_id, concat({parts[0]}, chr(10), chr(10), {parts[1]}, chr(10), chr(10), {parts[2]}) AS text FROM orders"


def pairs_sql(kind: str = "VARCHAR") -> str:
    source = chosen([a for a, _, _ in PAIRS], "o_orderkey", kind)
    target = f"CASE WHEN o_orderkey % 3 = 0 THEN {chosen([c for _, _, c in PAIRS], 'o_orderkey', kind)} ELSE {chosen([b for _, b, _ in PAIRS], 'o_orderkey', kind)} END"
    return f"SELECT o_orderkey AS pair_id, {source} AS src_text, {target} AS out_text FROM orders"


def labels_sql(explode: str, left: str, right: str) -> str:
    """SQL for ``doc_id, item``: the labelled words of each text that ``corpus_sql`` makes of RUSSIAN; how a list is opened up and written is given."""
    cases = " ".join(f"WHEN {k} THEN {left}" + ", ".join(f"'{w}'" for w in ws) + right for k, ws in RUSSIAN_LABELS.items())
    parts = [f"SELECT o_orderkey AS doc_id, {explode}(CASE CAST(floor(o_orderkey / {d}) AS INT) % {len(RUSSIAN)} {cases} END) AS item FROM orders" for d in (1, 5, 11)]
    return " UNION ".join(parts)


#: Rows of a key table that a task makes texts from, about.
ROWS_OF_A_TASK = 4000


def spread(rows: DataFrame, size: int = ROWS_OF_A_TASK) -> DataFrame:
    """``rows`` in as many partitions as their texts need: a file of keys is small and may be one row group, which is one task."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // size)))  # counted from the file's footer


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """``documents`` for work on their texts: dealt anew if the file has fewer row groups than there are cores, since a row group is one task."""
    rows = table(spark, sf_dir, "documents").select(*columns)
    of_tasks = rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"))  # from footers
    tasks, total = of_tasks.agg(F.count("*"), F.sum("n")).head()
    cores = spark.sparkContext.defaultParallelism
    return rows if tasks >= cores else rows.repartition(max(cores, -(-(total or 0) // ROWS_OF_A_TASK)))


def _derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("FROM orders", "FROM {orders}"), orders=spread(table(spark, sf_dir, "orders").select("o_orderkey")))


def english(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, _braced(corpus_sql(ENGLISH, "STRING")))


def russian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, _braced(corpus_sql(RUSSIAN, "STRING")))


def russian_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, labels_sql("explode", "array(", ")"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, _braced(pairs_sql("STRING")))


def _braced(sql: str) -> str:
    return sql.replace("{", "{{").replace("}", "}}")
