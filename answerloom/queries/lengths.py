"""Answer-length profiles over the corpus view."""

from pyspark.sql import functions as F

from answerloom.operators import corpus as C
from answerloom.operators import lengths as L
from answerloom.queries import sql as q
from answerloom.queries.registry import query
from answerloom.queries.views import QA, qa, rounded
from answerloom.session import stage

BINS = 80
COLUMNS = ["ai_m1_basic", "ai_m1_guided", "chatgpt_answers", "human_answers"]

_LISTS = {c: (q.one_text(c) if c == "ai_m1_basic" else q.texts(c)) for c in COLUMNS}
LENGTHS = f"""{QA},
answers AS ({' UNION ALL '.join(f"SELECT '{c}' AS answer_column, unnest({t}) AS answer FROM qa" for c, t in _LISTS.items())}),
lengths AS (SELECT answer_column, len({q.lexical('answer')})::BIGINT AS length FROM answers),
cap AS (SELECT greatest(1, ceil(round(quantile_cont(length, 0.995), 9)))::BIGINT AS cap FROM lengths)"""


def frequencies(spark, sf_dir):
    df = qa(spark, sf_dir)
    return L.length_frequencies(df, C.resolve_answer_columns(df))


@query(
    "length_frequencies",
    f"WITH {LENGTHS} SELECT answer_column, length, count(*) AS n FROM lengths GROUP BY answer_column, length",
)
def length_frequencies(spark, sf_dir):
    return frequencies(spark, sf_dir).withColumn("length", F.col("length").cast("long"))


@query(
    "length_stats",
    f"""WITH {LENGTHS} SELECT answer_column, count(*) AS n, min(length) AS "min", round(avg(length), 6) AS mean,
          round(quantile_cont(length, 0.5), 6) AS "median", round(quantile_cont(length, 0.9), 6) AS p90,
          round(quantile_cont(length, 0.95), 6) AS p95, round(quantile_cont(length, 0.99), 6) AS p99,
          max(length) AS "max" FROM lengths GROUP BY answer_column
        UNION ALL SELECT 'ai_none', 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL""",
)
def length_stats(spark, sf_dir):
    stats = L.length_stats(frequencies(spark, sf_dir), [*COLUMNS, "ai_none"])
    return rounded(stats.withColumns({c: F.col(c).cast("long") for c in ("min", "max")}))


@query("length_cap", f"WITH {LENGTHS} SELECT cap FROM cap")
def length_cap(spark, sf_dir):
    return L.length_cap(frequencies(spark, sf_dir))


@query(
    "length_cap_sketch",
    f"WITH {LENGTHS} SELECT (SELECT count(*) FROM lengths) AS n, cap AS exact_cap, TRUE AS within_bound FROM cap",
)
def length_cap_sketch(spark, sf_dir):
    """The cap by sketches of each split, merged: whether its rank among all lengths is within the bound of the exact one."""
    df = qa(spark, sf_dir)
    columns = C.resolve_answer_columns(df)
    kept = [L.length_sketches(df.where(F.col("split") == split), columns) for split in ("train", "eval")]
    sketches = stage(kept[0].unionByName(kept[1]))
    freq = stage(L.length_frequencies(df, columns))
    rank = lambda inside: F.sum(F.when(inside, F.col("n")).otherwise(0)) / F.sum("n")
    exact = L.length_cap(freq).withColumnRenamed("cap", "exact_cap")
    found = freq.crossJoin(F.broadcast(L.sketched_cap(sketches))).crossJoin(F.broadcast(exact))  # one row each
    near = (rank(F.col("length") < F.col("cap")) <= 0.995 + L.rank_error()) & (rank(F.col("length") <= F.col("cap")) >= 0.995 - L.rank_error())
    return found.agg(F.sum("n").alias("n"), F.max("exact_cap").alias("exact_cap"), near.alias("within_bound"))


@query(
    "length_histogram",
    f"""WITH {LENGTHS}, shown AS (SELECT l.* FROM lengths l, cap WHERE length <= cap),
        placed AS (SELECT answer_column, least(length * {BINS} // cap, {BINS - 1}) AS bin FROM shown, cap),
        counts AS (SELECT answer_column, bin, count(*) AS bin_n FROM placed GROUP BY answer_column, bin),
        totals AS (SELECT answer_column, count(*) AS visible_n FROM shown GROUP BY answer_column),
        grid AS (SELECT answer_column, visible_n, unnest(range(0, {BINS})) AS bin FROM totals)
        SELECT g.answer_column, g.bin, coalesce(bin_n, 0) AS bin_n, round((g.bin + 0.5) * cap / {BINS}, 6) AS center,
          round(coalesce(bin_n, 0) / (visible_n * (cap / {BINS})), 6) AS density
        FROM grid g CROSS JOIN cap LEFT JOIN counts c ON c.answer_column = g.answer_column AND c.bin = g.bin""",
)
def length_histogram(spark, sf_dir):
    freq = stage(frequencies(spark, sf_dir))
    curve = L.length_histogram(freq, L.length_cap(freq), BINS)
    return rounded(curve.withColumn("bin", F.col("bin").cast("long")))


@query(
    "char_length_stats",
    f"""WITH {LENGTHS}, chars AS (SELECT answer_column, length(answer) AS length FROM answers)
        SELECT answer_column, count(*) AS n, min(length)::BIGINT AS "min", round(avg(length), 6) AS mean,
          round(quantile_cont(length, 0.5), 6) AS "median", round(quantile_cont(length, 0.9), 6) AS p90,
          round(quantile_cont(length, 0.95), 6) AS p95, round(quantile_cont(length, 0.99), 6) AS p99,
          max(length)::BIGINT AS "max" FROM chars GROUP BY answer_column""",
)
def char_length_stats(spark, sf_dir):
    stats = L.length_stats(L.length_frequencies(qa(spark, sf_dir), COLUMNS, "chars"), COLUMNS)
    return rounded(stats.withColumns({c: F.col(c).cast("long") for c in ("min", "max")}))
