"""Quality rules with thresholds that adapt to each language and source.

Fixed base rules reject very short and very repetitive texts. What passes
them fills two quantile sketches for each measure, language and source, of what texts have and of what one
occurrence weighs in a text: histograms with fixed bins of 1/100,000 whose width grows with the value, 128 at most, so that a quantile is
known to within an eighth of itself. Sketches are merged by addition and are the same on any partitioning. A group's distribution is its own sketch and
PRIOR rows of its language's distribution, which is that language's sketch and PRIOR rows of
all; so a group of any size has limits that change with each of its rows, and small
groups lean on their parents. A measure's limit is a high quantile, plus SPREAD times its distance from the median, plus
what a few occurrences weigh in the group's usual text: the median of one's weight, a few times. So a limit is never under what chance
does, also where most texts have none, and no part of it is a constant. Documents above a limit are rejected by a join with the limits.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Fewer words than this, or more than this per cent in repeated windows, fail the base.
MIN_WORDS, MAX_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"
#: Each measure's high quantile in per cent (the rest of a source may be junk without moving it) and how many occurrences in a usual text are chance.
MEASURES = {"symbols": (75, 8), "dup_lines": (99, 1), "repeats": (99, 4)}
SPREAD, PRIOR = 1, 200
#: (values under, width) of the sketch's bins: eight to each doubling.
WIDTHS = [*((16 << i, 1 << i) for i in range(13)), (1 << 62, 1 << 13)]
#: What each measure counts, of what, and how much of it one occurrence is.
PARTS = {"symbols": ("n_symbols", "word_chars", 1), "dup_lines": ("n_dup_lines", "n_lines", 1), "repeats": ("n_repeat_words", "n_words", 3)}
SCALE = 100_000

_SPACES = rf"[{common.SPACE}]+"


def _measures(docs: DataFrame) -> DataFrame:
    """docs' row as `doc`, with what the rules need beside it."""
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    one = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    one = one.select("doc", F.filter(F.split(text, _SPACES), lambda w: w != "").alias("w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(common.WORD)).alias("l"))
    one = one.withColumn("h", F.expr("transform(slice(w, 1, greatest(size(w) - 2, 0)), (x, i) -> xxhash64(x, get(w, i + 1), get(w, i + 2)))"))
    return one.select(
        "doc",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace(text, _SPACES, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("h")) == F.size("h"), F.lit(0)).otherwise(_repeated()).cast("long").alias("n_repeat_words"),
    )


def _repeated() -> Column:
    """Words in the windows whose hash, of h, another window has: sorts the hashes
    with their places, keeps the places beside an equal hash, and adds up
    what each of those windows has beyond the one before."""
    sort = "sort_array(transform(h, (x, i) -> struct(x AS x, i AS i)))"
    mark = f"transform(array({sort}), s -> transform(filter(transform(s, (e, j) -> struct(e.i AS i, coalesce(get(s, j - 1).x = e.x, false) OR coalesce(get(s, j + 1).x = e.x, false) AS r)), e -> e.r), e -> e.i))[0]"
    return F.expr(f"aggregate(sort_array({mark}), struct(0 AS n, 0 AS upto), (a, i) -> struct(a.n + i + 3 - greatest(i, a.upto) AS n, i + 3 AS upto), a -> a.n)")


def _judged(rows: DataFrame) -> DataFrame:
    """_measures with base_failed, each measure in 1/SCALE, and in one_<measure> what one occurrence is."""
    part = lambda a, b: F.expr(f"coalesce(({a} * {SCALE}L) div nullif({b}, 0), 0)").cast("long")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return rows.withColumns({"base_failed": failed, **{m: part(n, of) for m, (n, of, _) in PARTS.items()}, **{f"one_{m}": part(str(one), of) for m, (_, of, one) in PARTS.items()}})


_SKETCHED = [*MEASURES, *(f"one_{m}" for m in MEASURES)]


def _keys(doc: str = "doc.") -> list[Column]:
    return [F.coalesce(F.col(f"{doc}{c}").cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


def _width(value: str) -> str:
    """SQL of the width of the bin that holds a value."""
    return "CASE " + " ".join(f"WHEN {value} < {under} THEN {width}" for under, width in WIDTHS) + " END"


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, bin, n) of the rows that passed the base. bin: the least value of its bin."""
    bins = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.expr(f"{m} - {m} % {_width(m)}").alias("bin")) for m in _SKETCHED]))
    return rows.where("NOT base_failed").select("lang", "source", bins.alias("b")).groupBy("lang", "source", "b.measure", "b.bin").agg(F.count("*").alias("n"))


def limits(sketch: DataFrame) -> DataFrame:
    """(lang, source, max_symbols, max_dup_lines, max_repeats): the greatest value, in 1/SCALE, that is kept."""
    merged = sketch.groupBy("measure", "bin").agg(F.sum("n").alias("n"))
    each = W.partitionBy("measure")
    every = merged.select("measure", "bin", (F.sum("n").over(each.orderBy("bin")).cast("double") / F.sum("n").over(each)).alias("parent"))

    def level(keys: list[str], parent: DataFrame, parent_keys: list[str]) -> DataFrame:
        """(keys, measure, bin, share): the part of a group's distribution up to each bin of the measure."""
        own = sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
        grid = own.groupBy(*keys, "measure").agg(F.sum("n").alias("rows")).join(parent, [*parent_keys, "measure"])
        upto = F.sum(F.coalesce("n", F.lit(0))).over(W.partitionBy(*keys, "measure").orderBy("bin")).cast("double")
        return grid.join(own, [*keys, "measure", "bin"], "left").select(*keys, "measure", "bin", ((upto + PRIOR * F.col("parent")) / (F.col("rows") + PRIOR)).alias("share"))

    by_lang = level(["lang"], F.broadcast(every), []).withColumnRenamed("share", "parent")  # 128 bins a sketch
    own = level(["lang", "source"], by_lang, ["lang"])
    per_cent = F.coalesce(F.create_map(*[F.lit(x) for m, v in MEASURES.items() for x in (m, v[0])])[F.col("measure")], F.lit(50))
    at = lambda part: F.min(F.when(F.col("share") * 100 >= part, F.col("bin") + F.expr(_width("bin")) - 1))
    quantiles = own.groupBy("lang", "source", "measure").agg(at(F.lit(50)).alias("middle"), at(per_cent).alias("high"))
    of = lambda m, x: F.max(F.when(F.col("measure") == m, x))
    limit = {m: of(m, F.col("high") + SPREAD * (F.col("high") - F.col("middle"))) + few * F.coalesce(of(f"one_{m}", F.col("middle")), F.lit(0)) for m, (_, few) in MEASURES.items()}
    return quantiles.groupBy("lang", "source").agg(*[x.alias(f"max_{m}") for m, x in limit.items()])


def _verdict(rows: DataFrame, limit: DataFrame) -> DataFrame:
    """rows(lang, source, ...) with kept. A group none of whose rows passed the base has no limits and needs none."""
    within = F.lit(True)
    for m in MEASURES:
        within &= F.col(m) <= F.col(f"max_{m}")
    return rows.join(limit, ["lang", "source"], "left").withColumn("kept", F.when(F.col("base_failed"), False).otherwise(within))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, kept) of every row of docs.

    A null or empty text has no words and fails the base; a null language or source
    counts as the empty string. Texts of any length are measured whole; windows are compared by
    64-bit hashes within their text. Repeated rows each
    get a row and each count in the sketches; a null doc_id stays null; an
    empty table gives an empty result; other columns are not read.
    """
    need = docs.select("doc_id", "text", "lang", "source")
    rows = common.stored(_judged(_measures(need)).select("doc.doc_id", *_keys(), *COUNTS, "base_failed", *_SKETCHED), "measures")
    limit = common.stored(limits(sketches(rows)), "limits")
    return _verdict(rows, limit).select("doc_id", *COUNTS, "base_failed", "kept")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, with docs' columns. Edge cases as there."""
    rows = common.stored(_judged(_measures(docs)).withColumns(dict(zip(("lang", "source"), _keys(), strict=True))), "measured")
    limit = common.stored(limits(sketches(rows)), "limits")
    return _verdict(rows, limit).where("kept").select("doc.*")


def sql(docs: str = "documents") -> str:
    """DuckDB's SQL for judge()."""

    def level(keys: str, parent: str, parent_keys: str) -> str:
        return f"""SELECT {keys}, measure, bin, (CAST(sum(coalesce(n, 0)) OVER (PARTITION BY {keys}, measure ORDER BY bin) AS DOUBLE) + {PRIOR} * parent) / (al + {PRIOR}) AS share
            FROM (SELECT {keys}, measure, sum(n) AS al FROM sketch GROUP BY {keys}, measure) JOIN {parent} USING ({parent_keys}measure)
            LEFT JOIN (SELECT {keys}, measure, bin, sum(n) AS n FROM sketch GROUP BY {keys}, measure, bin) USING ({keys}, measure, bin)"""

    per_cent = "CASE measure " + " ".join(f"WHEN '{m}' THEN {v[0]}" for m, v in MEASURES.items()) + " ELSE 50 END"
    upper = f"bin + {_width('bin')} - 1"
    picked = ", ".join(f"max(CASE WHEN measure = '{m}' THEN high + {SPREAD} * (high - middle) END) + {few} * max(CASE WHEN measure = 'one_{m}' THEN middle END) AS max_{m}" for m, (_, few) in MEASURES.items())
    within = " AND ".join(f"{m} <= max_{m}" for m in MEASURES)
    listed = ", ".join(f"{{'measure': '{m}', 'bin': {m} - {m} % {_width(m)}}}" for m in _SKETCHED)
    shares = ", ".join([*(f"coalesce({n} * {SCALE} // nullif({'wc' if of == 'word_chars' else of}, 0), 0) AS {m}" for m, (n, of, _) in PARTS.items()), *(f"coalesce({one * SCALE} // nullif({'wc' if of == 'word_chars' else of}, 0), 0) AS one_{m}" for m, (_, of, one) in PARTS.items())])
    return f"""
    WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM {docs}),
    split AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM texts),
    words AS (SELECT r, unnest(w) AS x, unnest(range(len(w))) AS i FROM split),
    windows AS (SELECT r, i, [x, lead(x) OVER o, lead(x, 2) OVER o] AS win, lead(i, 2) OVER o AS whole FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
    counted AS (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM windows WHERE whole IS NOT NULL),
    covered AS (SELECT r, count(DISTINCT i + k) AS n FROM counted, (SELECT unnest([0, 1, 2]) AS k) WHERE n >= 2 GROUP BY r),
    m AS (SELECT s.r, doc_id, lang, source, len(w)::BIGINT AS n_words, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS wc, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM split s LEFT JOIN covered c ON s.r = c.r),
    j AS MATERIALIZED (SELECT *, coalesce(wc, 0) AS word_chars, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed, {shares} FROM m),
    sketch AS MATERIALIZED (SELECT lang, source, b.measure AS measure, b.bin AS bin, count(*) AS n FROM (SELECT lang, source, unnest([{listed}]) AS b FROM j WHERE NOT base_failed) GROUP BY ALL),
    every AS (SELECT measure, bin, CAST(sum(n) OVER (PARTITION BY measure ORDER BY bin) AS DOUBLE) / sum(n) OVER (PARTITION BY measure) AS parent FROM (SELECT measure, bin, sum(n) AS n FROM sketch GROUP BY measure, bin)),
    by_lang AS (SELECT lang, measure, bin, share AS parent FROM ({level("lang", "every", "")})),
    own AS ({level("lang, source", "by_lang", "lang, ")}),
    quantiles AS (SELECT lang, source, measure, min(CASE WHEN share * 100 >= 50 THEN {upper} END) AS middle, min(CASE WHEN share * 100 >= {per_cent} THEN {upper} END) AS high FROM own GROUP BY lang, source, measure),
    lim AS (SELECT lang, source, {picked} FROM quantiles GROUP BY lang, source)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({within}, false) AS kept FROM j LEFT JOIN lim USING (lang, source)
    """
