r"""Line dedup by winnowing over line hashes.

A text is cut into lines; blank lines belong to the line before them. Of every window of `window` lines the line with
the smallest hash (the last of equals) is selected: the fingerprints of a text are its selected places, far fewer than its
windows, and any run of `window` equal lines in two places shares a selected line at the same offset, which is winnowing's
guarantee. Places are joined by the hash of their line: a place whose line is selected nowhere else drops out. From the
places that remain a match is extended to both sides, over the up to `window` windows for which the line was selected, by
comparing the hashes of the lines around it with those around the earliest place. Windows that stand at an earlier place
too, overlaps included, join to runs, and the lines of such runs are deleted; the earliest place keeps its lines.

So the result is exactly: a line goes if it lies in a run of at least `window` lines that also starts earlier, in order
of (doc_id, place in the text). Earlier means in the input, not in what is left. With `long_words`, a run of fewer lines
counts too if it has more words than that, so a long passage on one or two lines goes like one on three.

Defined results: a null text stays null and has no lines; a text shorter than the window stays (unless its lines are long
enough); rows that repeat a doc_id with the same text are one document, and both stay alike; other columns pass through.

Scale: a text is read once for its line hashes, which are kept in a few bytes for each line; all work but the last step is
on these. No pairs of places are made, as each is held against the earliest of its surroundings, found by an aggregate with
map-side combine; a passage that a third of all texts share costs one row for each place. Lines that stay are put together
from the stretches between runs, so a text costs time in proportion to its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLANKS, materialise, table

WINDOW = 3
#: Words above which a run of fewer lines counts, where asked for.
LONG_WORDS = 50
#: A line feed after which a line with a visible character follows.
LINE_END = r"\n(?=[^\S\n]*\S)"


def lines_of(text: Column) -> Column:
    return F.split(text, LINE_END)


def line_table(docs: DataFrame, counted: bool) -> DataFrame:
    """doc_id, text_hash, hashes, words (of each line, if counted; else null): one row for each text."""
    trimmed = F.transform(F.col("lines"), lambda x: F.xxhash64(F.trim(x)))
    words = F.transform(F.col("lines"), lambda x: F.size(F.array_remove(F.split(x, BLANKS), "")))
    rows = docs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), lines_of(F.col("text")).alias("lines"))
    return rows.select("doc_id", "text_hash", trimmed.alias("hashes"), (words if counted else F.lit(None).cast("array<int>")).alias("words"))


def fingerprints(lines: DataFrame, width: int, long_words: int | None) -> DataFrame:
    """One row for each selected place: doc_id, text_hash, width, place, print (the line's hash), windows (start, around: the hash
    of its lines). A window that is shorter than `window` counts only with more than long_words words."""
    hashes, size = F.col("hashes"), F.size("hashes")

    def window_at(s: Column) -> Column:
        inside = F.slice(hashes, s + 1, width)
        # the last of equals: the distance from the window's end in the reversed window
        chosen = s + width - F.array_position(F.reverse(inside), F.array_min(inside)).cast("int")
        return F.struct(s.alias("start"), chosen.alias("chosen"), F.xxhash64(inside).alias("around"))

    def counts(w: Column, i: Column) -> Column:
        if long_words is None:
            return w.chosen == i
        return (w.chosen == i) & (F.aggregate(F.slice("words", w.start + 1, width), F.lit(0), lambda s, n: s + n) > long_words)

    def place(i: Column) -> Column:
        windows = F.transform(F.sequence(F.greatest(i - (width - 1), F.lit(0)), F.least(i, size - width)), window_at)
        return F.struct(i.alias("place"), F.get(hashes, i).alias("print"), F.filter(windows, lambda w: counts(w, i)).alias("windows"))

    places = F.filter(F.transform(F.sequence(F.lit(0), size - 1), place), lambda p: F.size(p.windows) > 0)
    found = lines.filter(size >= width).select("doc_id", "text_hash", F.explode(places).alias("p"))
    return found.select("doc_id", "text_hash", F.lit(width).alias("width"), "p.*")


def repeats(docs: DataFrame, window: int = WINDOW, long_words: int | None = LONG_WORDS) -> DataFrame:
    """doc_id, text_hash, runs (array of from, to), n_removed: the stretches of lines of each text that go."""
    lines = materialise(line_table(docs, long_words is not None))
    places = fingerprints(lines, window, None)
    if long_words is not None:
        for width in range(1, window):
            places = places.unionByName(fingerprints(lines, width, long_words))
    # Selected lines that stand at one place only find nothing; all but they are left out before anything else is shuffled.
    shared = places.groupBy("width", "print").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    joined = places.join(shared, ["width", "print"], "left_semi")
    # To both sides: the lines around the selected one, as far as it stands for their windows.
    around = joined.select("doc_id", "text_hash", "width", "print", "place", F.explode("windows").alias("w"))
    around = materialise(around.select("doc_id", "text_hash", "width", "print", (F.col("place") - F.col("w.start")).alias("offset"), F.col("w.start").alias("start"), F.col("w.around").alias("around")))
    at = F.struct("doc_id", "text_hash", "start")
    key = ["width", "print", "offset", "around"]
    earliest = around.groupBy(*key).agg(F.min(at).alias("earliest"), F.max(at).alias("latest")).filter("earliest <> latest").drop("latest")
    later = around.join(earliest, key).filter(at > F.col("earliest")).select("doc_id", "text_hash", "start", (F.col("start") + F.col("width")).alias("to"))
    # Overlapping and touching windows are one run.
    before = Window.partitionBy("doc_id", "text_hash").orderBy("start", "to")
    opens = F.coalesce(F.col("start") > F.max("to").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    runs = later.withColumn("opens", opens.cast("int")).withColumn("run", F.sum("opens").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("doc_id", "text_hash", "run").agg(F.min("start").alias("from"), F.max("to").alias("to"))
    return runs.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("runs"), F.sum(F.col("to") - F.col("from")).alias("n_removed"))


def _judged(docs: DataFrame, window: int, long_words: int | None) -> DataFrame:
    """docs and _ld_text, _ld_lines, _ld_removed, _ld_runs."""
    found = repeats(docs, window, long_words).select(F.col("doc_id").alias("_ld_id"), F.col("text_hash").alias("_ld_hash"), F.col("runs").alias("_ld_gone"), F.col("n_removed").alias("_ld_n"))
    same = F.col("doc_id").eqNullSafe(F.col("_ld_id")) & (F.xxhash64("text") == F.col("_ld_hash"))
    marked = docs.join(found, same, "left").withColumn("_ld_all", lines_of(F.col("text")))
    size, none = F.size("_ld_all"), F.col("_ld_gone").isNull()
    # What lies between the end of a run (or the beginning) and the next run (or the end).
    ends = F.concat(F.array(F.lit(0)), F.transform("_ld_gone", lambda r: r["to"]))
    starts = F.concat(F.transform("_ld_gone", lambda r: r["from"]), F.array(size))
    kept = F.array_join(F.flatten(F.zip_with(ends, starts, lambda a, b: F.slice("_ld_all", a + 1, b - a))), "\n")
    return marked.select(
        *docs.columns,
        F.when(none, F.col("text")).otherwise(kept).alias("_ld_text"),
        F.when(F.col("text").isNull(), 0).otherwise(size).cast("long").alias("_ld_lines"),
        F.coalesce("_ld_n", F.lit(0)).cast("long").alias("_ld_removed"),
        F.coalesce(F.when(~none, F.size("_ld_gone")), F.lit(0)).cast("long").alias("_ld_runs"),
    )


def _with_text(docs: DataFrame) -> list[Column]:
    return [F.col("_ld_text").alias("text") if c == "text" else F.col(c) for c in docs.columns]


def dedup(docs: DataFrame, window: int = WINDOW, long_words: int | None = LONG_WORDS) -> DataFrame:
    """doc_id, text (what is left), n_lines, n_removed, n_runs."""
    names = {"_ld_lines": "n_lines", "_ld_removed": "n_removed", "_ld_runs": "n_runs"}
    return _judged(docs.select("doc_id", "text"), window, long_words).select("doc_id", F.col("_ld_text").alias("text"), *[F.col(k).alias(v) for k, v in names.items()])


def without_repeats(docs: DataFrame, window: int = WINDOW, long_words: int | None = LONG_WORDS) -> DataFrame:
    """docs, all columns, with their kept lines; texts of which no line is left go."""
    found = _judged(docs, window, long_words)
    return found.filter("not (_ld_removed > 0 and _ld_removed = _ld_lines)").select(*_with_text(docs))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_lines", "n_removed", "n_runs", F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("kept_md5"))


def oracle_sql(window: int = WINDOW, long_words: int = LONG_WORDS) -> str:
    return f"""
WITH raw AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
flat AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS k FROM raw),
mark AS (SELECT *, sum(CASE WHEN k > 1 AND regexp_matches(l, '[^ \\t\\n\\x0B\\f\\r]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS i FROM flat),
unit AS (SELECT doc_id, i, string_agg(l, chr(10) ORDER BY k) AS line FROM mark GROUP BY ALL),
sized AS (SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words FROM unit),
win AS ({" UNION ALL ".join(f"SELECT doc_id, i AS s, {w} AS width, list(trim(line, ' ')) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) AS c, sum(words) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) AS n FROM sized" for w in range(1, window + 1))}),
full_win AS (SELECT * FROM win WHERE len(c) = width AND (width = {window} OR n > {long_words})),
later AS (SELECT doc_id, s, width FROM (SELECT doc_id, s, width, row_number() OVER (PARTITION BY c ORDER BY doc_id, s) AS r FROM full_win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, s + j AS i FROM later, range({window}) t(j) WHERE j < width),
runs AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (o) AS n_runs FROM (SELECT doc_id, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 1, true) AS o FROM gone) GROUP BY doc_id),
kept AS (SELECT u.doc_id, string_agg(u.line, chr(10) ORDER BY u.i) AS text FROM unit u ANTI JOIN gone g ON u.doc_id = g.doc_id AND u.i = g.i GROUP BY u.doc_id),
n AS (SELECT doc_id, count(*) AS n_lines FROM unit GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs, md5(coalesce(kept.text, '')) AS kept_md5
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)"""
