"""Question routing: which columns a question names and which answer it asks for.

``match_columns`` and ``routes`` work on a table of questions. The column
catalogue is bounded by a schema. A short one becomes part of the expression, so
every question is scored where it lies: no join and no shuffle. A long one becomes
an index from tokens and grams to names; questions meet only names they may mention.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import fixed_values as V
from tablewright.functions.columns import analytic_class, columns_of, small_frame, unrolled
from tablewright.operators import answers


# Longer catalogues are looked up in an index.
EXPRESSION_COLUMNS = 64
# Characters of a gram of the index.
GRAM = 4


def catalogue_of(df: DataFrame) -> list[tuple[str, str]]:
    """(column, class) pairs of one table, in column order."""
    return [(f.name, analytic_class(f.dataType)) for f in df.schema.fields]


def _score(name: str, said: Column, joined: Column, words: Column) -> Column:
    """How clearly a question names one column; 0 if it does not."""
    lower = name.lower()
    spaced = re.sub(r"[^a-z0-9]", " ", lower).strip()
    packed = spaced.replace(" ", "")
    tokens = sorted(set(spaced.split()))
    if not tokens:
        # A name without ASCII letters or digits can only be quoted as it is.
        return F.when(F.contains(said, F.lit(lower)), 100).otherwise(0)
    present = [F.contains(words, F.lit(f" {t} ")) for t in tokens]
    shared = F.lit(0)
    for token, found in zip(tokens, present):
        if len(token) > 2:
            shared = shared + found.cast("int")
    return (
        F.when(
            F.contains(said, F.lit(lower)) | F.contains(said, F.lit(spaced)), 100 + len(spaced)
        )
        .when(F.contains(joined, F.lit(packed)), 90 + len(packed))
        .when(reduce(and_, present), 80 + len(tokens))
        .when(shared > 0, 40 + 10 * shared)
        .otherwise(0)
    )


def _read(questions: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, said, joined, words): the question in the forms that names are looked for in."""
    return questions.select(id_, F.lower(text).alias("said")).select(
        id_,
        "said",
        F.regexp_replace("said", "[^a-z0-9]+", "").alias("joined"),
        F.concat(F.lit(" "), F.regexp_replace("said", "[^a-z0-9]+", " "), F.lit(" ")).alias("words"),
    )


def _grams(text: str) -> list[str]:
    return [text[k : k + GRAM] for k in range(max(1, len(text) - GRAM + 1))]


def _index(catalogue) -> list[tuple]:
    """(key, position, column, kind, lower, spaced, packed, tokens) of all keys of all names.

    A question that mentions a name holds one of its keys: a token of three or more characters (any
    token, if all are shorter), or the gram of its letters and digits that the fewest names have.
    Names without ASCII letters and digits have a gram of the name itself. The empty key is in every question.
    """
    names = []
    for i, (name, kind) in enumerate(catalogue):
        lower = name.lower()
        spaced = re.sub(r"[^a-z0-9]", " ", lower).strip()
        names.append((i, name, kind, lower, spaced, spaced.replace(" ", ""), sorted(set(spaced.split()))))
    mark = lambda n: ("g:", n[5]) if n[5] else ("u:", n[3])
    held = Counter(kind + g for kind, text in map(mark, names) for g in set(_grams(text)))
    rows = [("", -1, None, None, None, None, None, None)]
    for n in names:
        kind, text = mark(n)
        long = [t for t in n[6] if len(t) > 2]
        keys = {min((kind + g for g in _grams(text)), key=lambda k: (held[k], k))}
        rows += [(key, *n) for key in keys | {f"t:{t}" for t in long or n[6]}]
    return rows


def _indexed_matches(questions: DataFrame, catalogue, id_: str, text: str) -> DataFrame:
    """``_matches`` for long catalogues: names are joined by the keys that question and name share.

    The index is bounded by the schema. Only matches are shuffled, with the empty key once per row,
    which brings rows without a match, and repeated rows, back as often as they were.
    """
    spark, rows = questions.sparkSession, _index(catalogue)
    index = small_frame(
        spark, rows,
        "key string, position int, column string, kind string, lower string, spaced string, packed string, tokens array<string>",
    )
    known = F.split(F.lit("\x01".join(sorted({r[0] for r in rows}))), "\x01")

    def grams(source: str, mark: str) -> list[Column]:
        def of(size: int) -> Column:
            starts = F.sequence(F.lit(1), F.char_length(source) - (size - 1))
            cut = F.transform(starts, lambda k: F.concat(F.lit(mark), F.substring(F.col(source), k, F.lit(size))))
            return F.when(F.char_length(source) >= size, cut)

        return [of(size) for size in sorted({len(r[0]) - 2 for r in rows if r[0].startswith(mark)})]

    tokens = F.transform(F.split(F.trim("words"), " "), lambda t: F.concat(F.lit("t:"), t))
    parts = [F.coalesce(p, F.array().cast("array<string>")) for p in [tokens, *grams("joined", "g:"), *grams("said", "u:")]]
    # Only keys of the index leave the row: the text is copied once per name that it may mention.
    keys = F.concat(F.array(F.lit("")), F.array_except(F.array_intersect(F.concat(*parts), known), F.array(F.lit(""))))
    read = _read(questions, id_, text).withColumnRenamed(id_, "__id")
    met = read.withColumn("key", F.explode(keys)).join(F.broadcast(index), "key")
    said, joined = F.col("said"), F.col("joined")
    present = F.filter("tokens", lambda t: F.contains(F.col("words"), F.concat(F.lit(" "), t, F.lit(" "))))
    shared = F.size(F.filter(present, lambda t: F.char_length(t) > 2))
    named = (
        F.when(F.contains(said, F.col("lower")) | F.contains(said, F.col("spaced")), 100 + F.char_length("spaced"))
        .when(F.contains(joined, F.col("packed")), 90 + F.char_length("packed"))
        .when(F.size(present) == F.size("tokens"), 80 + F.size("tokens"))
        .when(shared > 0, 40 + 10 * shared)
    )
    score = F.when(F.col("packed") != "", named).when(F.contains(said, F.col("lower")), F.lit(100))
    match = F.struct((-score).alias("rank_key"), "position", "column", "kind")
    found = met.select("__id", "said", score.alias("score"), match.alias("match"), (F.col("position") < 0).alias("self"))
    grouped = found.where("self OR score IS NOT NULL").groupBy("__id", "said").agg(
        F.array_sort(F.collect_set(F.when(F.col("score").isNotNull(), F.col("match")))).alias("matches"),
        F.count_if("self").alias("copies"),
    )
    each = grouped.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return each.select(F.col("__id").alias(id_), "said", "matches")


def _matches(questions: DataFrame, catalogue, id_: str, text: str) -> DataFrame:
    """(id, said, matches): matches is array<struct>, best first, catalogue order on ties.

    Lower-casing and splitting happen in projections of their own, so that
    scoring a column does not repeat them.
    """
    if len(catalogue) > EXPRESSION_COLUMNS:
        return _indexed_matches(questions, catalogue, id_, text)
    read = _read(questions, id_, text)
    scored = [
        F.struct(
            (-_score(name, F.col("said"), F.col("joined"), F.col("words"))).alias("rank_key"),
            F.lit(i).alias("position"),
            F.lit(name).alias("column"),
            F.lit(kind).alias("kind"),
        )
        for i, (name, kind) in enumerate(catalogue)
    ]
    found = read.select(id_, "said", F.array(*scored).alias("scored"))
    return found.select(
        id_, "said", F.array_sort(F.filter("scored", lambda s: s["rank_key"] < 0)).alias("matches")
    )


def match_columns(
    questions: DataFrame, catalogue: list[tuple[str, str]], id_: str = "question_id",
    text: str = "question",
) -> DataFrame:
    """(id, rank, column, score, kind) for every column a question mentions."""
    found = unrolled(
        _matches(questions, catalogue, id_, text).drop("said"), F.col("matches"), "p", "m"
    )
    return found.select(
        id_,
        (F.col("p") + 1).alias("rank"),
        F.col("m.column").alias("column"),
        (-F.col("m.rank_key")).alias("score"),
        F.col("m.kind").alias("kind"),
    )


def _says(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def _number_after(text: Column, pattern: str) -> Column:
    digits = F.regexp_extract(text, pattern, 1)
    return F.when(digits != "", digits.try_cast("int"))


def routes(
    questions: DataFrame, catalogue: list[tuple[str, str]], id_: str = "question_id",
    text: str = "question",
) -> DataFrame:
    """One row per question: the answer it is routed to and that answer's arguments."""
    first = lambda kind: F.try_element_at(
        F.filter("matches", lambda m: m["kind"] == kind), F.lit(1)
    )["column"]
    named = _matches(questions, catalogue, id_, text).select(
        id_,
        F.trim("said").alias("said"),
        F.size("matches").alias("matches"),
        F.try_element_at("matches", F.lit(1)).alias("first"),
        first("categorical").alias("text_column"),
        first("numeric").alias("number_column"),
    )
    q = F.col("said")
    any_match = F.col("matches") > 0
    numeric = F.col("number_column").isNotNull()
    category = F.col("text_column").isNotNull()
    numeric_columns = sum(kind == "numeric" for _, kind in catalogue)
    route = (
        F.when(_says(q, V.PROCEDURE_WORDS), "procedure")
        .when(_says(q, V.ROWS_WORDS), "rows")
        .when(_says(q, V.COLUMNS_WORDS), "columns")
        .when(_says(q, V.MISSING_WORDS), "missing")
        .when(_says(q, V.DUPLICATE_WORDS), "duplicates")
        .when(
            category & (_says(q, V.GROUP_WORDS) | numeric),
            F.when(numeric, "grouped").otherwise("value_counts"),
        )
        .when(_says(q, V.DISTINCT_WORDS) & any_match, "distinct")
        .when(_says(q, V.EXTREME_WORDS) & numeric, "extreme")
        .when(numeric & _says(q, V.TOTAL_WORDS), "total")
        .when(numeric & _says(q, V.MEAN_WORDS), "average")
        .when(numeric & _says(q, V.MEDIAN_WORDS), "median")
        .when(any_match, "summary")
        .when(_says(q, V.CORRELATION_WORDS) & F.lit(numeric_columns >= 2), "correlation")
        .otherwise("unanswerable")
    )
    agg = (
        F.when(_says(q, V.MEAN_WORDS), "mean")
        .when(_says(q, V.COUNT_WORDS), "count")
        .when(_says(q, V.MAX_WORDS), "max")
        .when(_says(q, V.MIN_WORDS), "min")
        .otherwise("sum")
    )
    grouping = F.col("route").isin("grouped", "value_counts")
    on_number = F.col("route").isin("extreme", "total", "average", "median")
    return named.withColumn("route", route).select(
        id_,
        "route",
        F.when(grouping, F.col("text_column"))
        .when(on_number, F.col("number_column"))
        .when(F.col("route").isin("distinct", "summary"), F.col("first.column"))
        .alias("target"),
        F.when(F.col("route") == "grouped", F.col("number_column")).alias("metric"),
        F.when(F.col("route") == "grouped", agg).alias("aggregation"),
        F.when(F.col("route") == "extreme", _says(q, V.EXTREME_HIGH_WORDS)).alias("highest"),
        F.when(grouping, _number_after(q, V.TOP_N_PATTERN)).alias("top_n"),
        F.when(grouping, _number_after(q, V.BOTTOM_N_PATTERN)).alias("bottom_n"),
    )


def route_one(df: DataFrame, question: str) -> dict:
    one = small_frame(df.sparkSession, [(0, question)], "question_id int, question string")
    return routes(one, catalogue_of(df)).first().asDict()


def ask(df: DataFrame, question: str, order_by: list[str] | None = None) -> DataFrame:
    """Answer one question about ``df``; the data work is the routed operator's."""
    if df.isEmpty():
        return answers.table_size(df)
    r = route_one(df, question)
    target = r["target"]
    run = {
        "rows": lambda: answers.table_size(df),
        "columns": lambda: answers.columns_by_class(df),
        "missing": lambda: answers.missing_ranked(df),
        "duplicates": lambda: answers.duplicate_rows(df),
        "grouped": lambda: answers.group(
            df, target, r["metric"], r["aggregation"], r["top_n"], r["bottom_n"]
        ),
        "value_counts": lambda: answers.value_counts(df, target, r["top_n"], r["bottom_n"]),
        "distinct": lambda: answers.distinct_values(df, target),
        "extreme": lambda: answers.extreme(df, target, r["highest"], order_by),
        "total": lambda: answers.column_total(df, target),
        "average": lambda: answers.column_average(df, target),
        "median": lambda: answers.column_median(df, target),
        "summary": lambda: answers.summary(df, target),
        "correlation": lambda: answers.correlation_pairs(df),
    }.get(r["route"])
    if run is not None:
        return run()
    # Procedures and unanswerable questions have no table: say what is there.
    names = ", ".join(df.columns)
    return small_frame(
        df.sparkSession,
        [(r["route"], len(df.columns), len(columns_of(df, "numeric")), names)],
        "route string, total_columns int, numeric_columns int, columns string",
    )
