"""Exam lists and programs out of pasted text: questions with parts, tickets with questions, what is wrong with them.

Everything is windows over a text's lines: which node a line belongs to is a running count of the lines that begin one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import shared
from . import series

# What a part (3.1), a ticket, an item, a task and a header look like, and where a line has several items.
PART = r"^\s*(\d{1,4})\.(\d{1,3})(?:[.)])?\s+(\S.*?)\s*$"
TICKET = r"(?iu)^\s*Билет\s*(?:№|#)?\s*(\d+)\s*(?:[.:—-]\s*)?(.*?)\s*$"
MARK = r"^\s*(?:(?:\d+(?:\.\d+)*[.)])\s*|(?:\d+(?:\.\d+)*)\s+|[-—*•]\s+)(.+?)\s*$"
TASK = r"(?iu)^\s*(?:Задача|Задание)\s*:\s*(.+)$"
QUESTIONS, TASKS = r"(?iu)^\s*Вопросы\s*:??\s*$", r"(?iu)^\s*(?:Задачи|Задания)\s*:??\s*$"
INLINE = r"(?<=[.!?…])\s+(?=\d{1,4}[.)](?!\d))"
PAGE = r"^\d{1,4}$"


def _dealt(texts: DataFrame) -> DataFrame:
    """Texts dealt out by key before lines are made of them: windows, groups and joins by key shuffle no lines. Texts weigh less
    than what is made of them costs, so tasks aren't put together by size."""
    return texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")


def lines(texts: DataFrame, inline: bool = True, *more: str) -> DataFrame:
    """key, pos, line (and ``more``) of (key, text): the lines that aren't blank, without the space around them; with ``inline``, a
    line that has several items, each at a sentence's end, is several lines. Null texts have none. A text's lines are numbered
    in its row."""
    said = F.transform(F.split("text", r"\r\n|\r|\n"), lambda x: F.trim(x))
    if inline:
        said = F.flatten(F.transform(said, lambda x: F.split(x, INLINE)))
    return texts.select("key", *more, F.posexplode(F.filter(said, lambda x: F.length(x) > 0)).alias("pos", "line"))


def _named(title: Column) -> Column:
    """A node's title without what says that it is a task."""
    task = F.regexp_extract(title, TASK, 1)
    return F.when(task != "", F.trim(task)).otherwise(F.trim(title))


def _kind(title: Column, default: Column) -> Column:
    return F.when(title.rlike(TASK), "task").otherwise(default)


def _titled(rows: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """One row for each node of lines (``by``, pos, said): its title put together."""
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "said"))), lambda x: x["said"]), " ")
    return rows.groupBy(*by).agg(F.trim(said).alias("title"), F.min("pos").alias("pos"), *more)


def _counted(nodes: DataFrame, keys: DataFrame, warnings: DataFrame, errors: DataFrame) -> DataFrame:
    """A report for each key. Titles that stand twice among the nodes that are learnt are duplicates."""
    top = F.col("type") == "topic"
    study = nodes.where("type <> 'section'")
    twice = study.groupBy("key", F.lower("title").alias("_t")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy("key").agg(F.count(F.lit(1)).alias("duplicates"))
    counts = nodes.groupBy("key").agg(F.count_if(F.col("type") == "section").alias("tickets"), F.count_if(top & (F.col("kind") == "question")).alias("questions"), F.count_if(top & (F.col("kind") == "task")).alias("tasks"), F.count_if(F.col("type") == "part").alias("parts"))
    both = keys.select("key").distinct().join(counts, "key", "left").join(twice, "key", "left").join(warnings, "key", "left").join(errors, "key", "left")
    none = F.when(F.coalesce(F.col("questions") + F.col("tasks"), F.lit(0)) == 0, "empty")
    return both.select("key", F.coalesce("error", none).alias("error"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tickets", "questions", "tasks", "parts", "duplicates", "warnings")))


def marked(rows: DataFrame, headers: bool = False, kind: str = "question") -> DataFrame:
    """key, node, type, kind, title, position: lists without a series of numbers: each marked line begins a topic, and the others
    go on with it; where no line is marked, each is a topic. With ``headers``, lines that say questions or tasks turn the kind;
    a line that says questions does so in any case, and is no topic."""
    order = Window.partitionBy("key").orderBy("pos")
    # What patterns say is found once a line, below the windows.
    rows = rows.select("key", "pos", "line", F.regexp_extract("line", MARK, 1).alias("mark"), F.col("line").rlike(QUESTIONS).alias("_is_q"), (F.col("line").rlike(TASKS) if headers else F.lit(False)).alias("_is_t"))
    rows = rows.withColumn("said", F.when(F.col("mark") != "", F.col("mark")).otherwise(F.col("line")))
    rows = rows.select("key", "pos", "said", "_is_q", "_is_t", (F.col("mark") != "").alias("_mark"), F.regexp_extract("said", TASK, 1).alias("_task"), F.col("said").rlike(TASK).alias("_is_task"))
    turned = F.last(F.when(F.col("_is_q"), "question").when(F.col("_is_t"), "task"), ignorenulls=True).over(order)
    rows = rows.withColumn("_kind", F.coalesce(turned, F.lit(kind))).withColumn("_any", F.max("_mark").over(Window.partitionBy("key"))).where("NOT _is_q AND NOT _is_t")
    begins = F.col("_mark") | ~F.col("_any") | (F.row_number().over(order) == 1)
    rows = rows.withColumn("_begins", begins).withColumn("_n", F.sum(F.col("_begins").cast("int")).over(order))
    first = F.min_by(F.when(F.col("_is_task"), "task").otherwise(F.col("_kind")), "pos").alias("kind")
    own = F.when(F.col("_task") != "", F.trim("_task")).otherwise(F.trim("said"))
    rest = _titled(rows.withColumn("said", F.when(F.col("_begins"), own).otherwise(F.col("said"))), ["key", "_n"], first).where("title <> ''")
    position = F.row_number().over(Window.partitionBy("key").orderBy("_n")) - 1
    return rest.select("key", F.lit(None).cast("int").alias("parent"), position.alias("node"), F.lit("topic").alias("type"), "kind", "title", position.alias("position"))


def _numbered(texts: DataFrame, *more: str) -> DataFrame:
    """Lines of texts with the numbers of their part (``parent``, ``child``) or of their item (``n``), what ``part`` and ``item`` say,
    and ``series``."""
    (a, b, part), (c, d, item) = ([F.regexp_extract("line", form, i) for i in (1, 2, 3)] for form in (PART, series.ITEM))
    number = lambda x: F.nullif(x, F.lit("")).cast("int")
    rows = lines(texts, True, *more).select("key", *more, "pos", "line", number(a).alias("parent"), number(b).alias("child"), part.alias("part"), F.coalesce(number(c), number(d)).alias("n"), item.alias("item"))
    return series.in_series(rows.withColumn("n", F.when(F.col("parent").isNull(), F.col("n"))))


def exam_list(texts: DataFrame, expected: DataFrame | None = None, kind: str = "question") -> tuple[DataFrame, DataFrame]:
    """Nodes and reports of lists (key, text): questions by the numbered series that is meant (``expected`` has the number of its
    items by key), parts by numbers like 3.1 that go on from part to part of their question.

    A part that doesn't is text of the node before it, with a warning. Printed page numbers and items of other series are left
    out. Reports have error (ambiguous, empty, null), counts, duplicates and warnings. Lists without a series go by marks.

    What is kept is small: which series a text means, and the nodes, of which reports are counts.
    """
    texts = _dealt(texts.select("key", "text"))
    runs = _numbered(texts).where("n IS NOT NULL").groupBy("key", "series").agg(F.min("n").alias("first"), F.max("n").alias("last"), F.count(F.lit(1)).alias("n"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    strange = (F.size("chain") > 1).cast("int") + (total(F.col("dropped")) > 0).cast("int") + F.coalesce((F.col("expected") != total(F.col("chain"))).cast("int"), F.lit(0))
    chosen = shared.cut(series.choice(runs, expected).select("key", "ambiguous", F.transform("chain", lambda x: x["s"]).alias("taken"), strange.alias("_s")))
    order = Window.partitionBy("key").orderBy("pos")
    begins = F.col("begins")
    held = _numbered(texts.join(chosen.where("NOT ambiguous").select("key", "taken"), "key"), "taken").withColumn("begins", F.col("n").isNotNull() & F.array_contains("taken", F.col("series")))
    held = held.withColumn("number", F.last(F.when(begins, F.col("n")), ignorenulls=True).over(order)).withColumn("_q", F.count_if(begins).over(order)).where("_q > 0")
    # Within a question and from one to the next, lines are in one order.
    inner, whole = Window.partitionBy("key", "_q").orderBy("pos"), Window.partitionBy("key").orderBy("_q", "pos")
    own = F.col("parent") == F.col("number")
    before = F.coalesce(F.max(F.when(own, F.col("child"))).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.withColumn("_part", F.coalesce(own & (F.col("child") > before), F.lit(False)))
    kinds = F.first(F.when(begins, _kind(F.col("item"), F.lit(kind)))).over(inner)  # a question's first line begins it
    dropped = ~begins & F.col("parent").isNull() & (F.col("n").isNotNull() | F.col("line").rlike(PAGE))
    said = F.when(begins, _named(F.col("item"))).when(F.col("parent").isNotNull(), F.col("part")).otherwise(F.col("line"))
    held = held.withColumn("kind", kinds).where(~dropped).withColumn("said", said).withColumn("_n", F.count_if(begins | F.col("_part")).over(whole))
    late = F.count_if(F.col("parent").isNotNull() & ~F.col("_part")).alias("_w")
    nodes = _titled(held, ["key", "_n"], F.bool_or(begins).alias("_top"), F.first("kind").alias("kind"), F.max("_q").alias("_q"), F.max(F.when(F.col("_part"), F.col("child"))).alias("child"), late)
    top = F.min("_n").over(Window.partitionBy("key", "_q")) - 1
    nodes = nodes.select("key", F.when(~F.col("_top"), top).cast("int").alias("parent"), (F.col("_n") - 1).cast("int").alias("node"), F.when(F.col("_top"), "topic").otherwise("part").alias("type"), "kind", "title",
                         F.when(F.col("_top"), F.col("_q") - 1).otherwise(F.col("child") - 1).cast("int").alias("position"), "_w")
    free = marked(lines(texts.join(chosen.select("key"), "key", "left_anti")), kind=kind)
    nodes = shared.cut(nodes.unionByName(free.withColumn("_w", F.lit(0).cast("bigint"))))
    warnings = nodes.groupBy("key").agg(F.sum("_w").alias("_w")).join(chosen.select("key", "_s"), "key").select("key", (F.col("_w") + F.col("_s")).cast("bigint").alias("warnings"))
    errors = chosen.where("ambiguous").select("key", F.lit("ambiguous").alias("error"))
    return nodes.drop("_w"), _counted(nodes, texts, warnings, errors)


def tickets(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and reports of programs (key, text) of tickets, each with marked questions. What stands before the first ticket and
    printed page numbers don't count. Errors: no_ticket, empty_ticket (a ticket without a question), unmarked (text before a
    ticket's first question); a text with an error has no nodes."""
    texts = _dealt(texts.select("key", "text"))
    order = Window.partitionBy("key").orderBy("pos")

    def placed(texts: DataFrame) -> DataFrame:
        ticket, mark, suffix = F.regexp_extract("line", TICKET, 1), F.regexp_extract("line", MARK, 1), F.regexp_extract("line", TICKET, 2)
        rows = lines(texts, inline=False).select("key", "pos", "line", ticket.alias("ticket"), suffix.alias("suffix"), mark.alias("mark"), F.col("line").rlike(PAGE).alias("_page")).withColumn("_is", F.col("ticket") != "")
        rows = rows.withColumn("_t", F.count_if("_is").over(order)).where("_t > 0 AND (_is OR NOT _page)").withColumn("_mark", ~F.col("_is") & (F.col("mark") != ""))
        return rows.withColumn("_m", F.count_if("_mark").over(Window.partitionBy("key", "_t").orderBy("pos")))

    of = placed(texts).groupBy("key", "_t").agg(F.max("_m").alias("n"), F.bool_or((F.col("_m") == 0) & ~F.col("_is")).alias("loose")).groupBy("key").agg(F.max("loose").alias("loose"), F.min("n").alias("least"))
    errors = texts.select("key").distinct().join(of, "key", "left").select("key", F.when(F.col("least").isNull(), "no_ticket").when(F.col("loose"), "unmarked").when(F.col("least") == 0, "empty_ticket").alias("error")).where("error IS NOT NULL")
    errors = shared.cut(errors)
    titled = F.concat(F.lit("Билет "), F.col("ticket"), F.when(F.col("suffix") != "", F.concat(F.lit(": "), "suffix")).otherwise(""))
    said = F.when(F.col("_is"), titled).when(F.col("_mark"), _named(F.col("mark"))).otherwise(F.col("line"))
    rows = placed(texts.join(errors, "key", "left_anti")).withColumn("said", said).withColumn("_kind", F.when(F.col("_mark"), _kind(F.col("mark"), F.lit("question"))))
    kept = _titled(rows, ["key", "_t", "_m"], F.max("_kind").alias("kind"))
    node = F.row_number().over(Window.partitionBy("key").orderBy("_t", "_m")) - 1
    nodes = kept.withColumn("node", node).withColumn("_p", F.min("node").over(Window.partitionBy("key", "_t")))
    section = F.col("_m") == 0
    nodes = nodes.select("key", F.when(~section, F.col("_p")).cast("int").alias("parent"), F.col("node").cast("int").alias("node"), F.when(section, "section").otherwise("topic").alias("type"), F.when(section, "ticket").otherwise(F.col("kind")).alias("kind"), "title",
                         F.when(section, F.col("_t") - 1).otherwise(F.col("_m") - 1).cast("int").alias("position"))
    nodes = shared.cut(nodes)
    return nodes, _counted(nodes, texts, texts.select("key").distinct().withColumn("warnings", F.lit(0).cast("bigint")), errors)
