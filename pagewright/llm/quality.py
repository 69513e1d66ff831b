"""Quality rules whose cutoffs come from labelled holdouts with a bound on false rejections.

A rule rejects a text whose measure is above a cutoff. In each stratum (language) the cutoffs are tightened along one path of
joint steps, each of which moves one rule to its next notch. Notches are quantiles of the measure, and the order of the steps
goes by how much more often than elsewhere the texts that a step adds are labelled bad; both rest on unlabelled and bad rows
alone, so they are independent of the good rows that certify the steps. Of n good rows a step's joint cutoffs reject k: the
step is safe if k or fewer rejections would have a probability of at most delta / strata were the true rate of false rejections
RISK or more (an exact binomial tail). Steps are tested in their order up to the first that is not safe, so within a stratum no
test costs another one's error (fixed-sequence testing), and across strata the error is shared (Bonferroni). So with
probability 1 - delta no stratum loses more than RISK of its good rows to all rules together. A stratum with too few good
rows to certify even one step has no rules.

All of it is DataFrame functions; a text is measured in its own row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.plans.workspace import Workspace

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
RISK, DELTA = 0.02, 0.05
#: Shares of a stratum's rows above each notch.
TAILS = [1.5**j / 1000 for j in range(17)] + [0.8, 0.9, 0.99]
#: Rows of the stratum's own share of bad ones that are added to those above a notch.
PRIOR = 2.0
#: Rows of the table of cutoffs, one a stratum, that may be broadcast; beyond it, it is joined.
MOST_BROADCAST = 10_000


def measured(docs: DataFrame) -> DataFrame:
    """row (all columns of docs), doc_id, stratum, _m: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
    n_capitals. What docs' columns are called does not matter, but for doc_id, lang and text.

    The text (null: empty) is cut into words once; five-word windows are compared by 64-bit hashes, and only texts in which a
    window recurs are sorted. Work is in proportion to n log n of a text's own words.
    """
    known = F.coalesce(F.concat(F.lit("l"), F.col("lang")), F.lit("n")).alias("stratum")
    docs = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", known, "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = docs.withColumn("_t", F.btrim(text, F.lit(SPACE)))
    words = F.when(F.col("_t") == "", F.array().cast("array<string>")).otherwise(F.split("_t", "[\\x20\\x09-\\x0D]+", -1))
    hashed = whole.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))
    n = F.size("_h")
    at = lambda i, k: F.get("_h", i + k)
    window = F.transform(F.sequence(F.lit(0), F.greatest(n - 5, F.lit(0))), lambda i: F.xxhash64(at(i, 0), at(i, 1), at(i, 2), at(i, 3), at(i, 4)))
    windows = hashed.withColumn("_w", F.when(n >= 5, window).otherwise(F.array().cast("array<bigint>")))
    pairs = F.sort_array(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    recur = windows.withColumn("_s", F.when(F.size(F.array_distinct("_w")) < F.size("_w"), pairs))
    meets = lambda x, k: F.coalesce(F.get("_s", k)["h"] == x["h"], F.lit(False))
    places = F.sort_array(F.transform(F.filter("_s", lambda x, i: meets(x, i - 1) | meets(x, i + 1)), lambda x: x["i"]))
    start = F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(5), p - a["last"])).alias("n")), lambda a: a["n"])
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(SPACE)) != "")
    lined = recur.withColumn("_l", F.transform(lines, lambda line: F.md5(line)))
    squeezed = F.translate("_t", SPACE, "")
    m = F.struct(
        n.cast("bigint").alias("n_words"), F.length(squeezed).cast("bigint").alias("word_chars"), (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"), F.size("_l").cast("bigint").alias("n_lines"), (F.length("_t") - F.length(F.translate("_t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("bigint").alias("n_capitals"),
    )
    return lined.select("row", "doc_id", "stratum", m.alias("_m"))


def base_failed(m: str = "_m") -> Column:
    return (F.col(f"{m}.n_words") < 10) | (100 * F.col(f"{m}.n_repeat_words") > 20 * F.col(f"{m}.n_words"))


def measures(m: str = "_m") -> dict[str, Column]:
    """Whole numbers: shares in thousandths, the length of words in tenths of a character."""
    of = lambda part, whole, scale: F.expr(f"{m}.{part} * {scale} div greatest({m}.{whole}, 1)")
    return {"symbols": of("n_symbols", "word_chars", 1000), "capitals": of("n_capitals", "word_chars", 1000), "word_length": of("word_chars", "n_words", 10), "dup_lines": of("n_dup_lines", "n_lines", 1000)}


def log_binomial_tail(n: Column, k: Column, p: float) -> Column:
    """Natural logarithm of the probability of k or fewer hits in n trials of probability p, summed term by term in logs."""
    first = n * math.log1p(-p)
    ratio = math.log(p) - math.log1p(-p)
    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + ratio
        high, low = F.greatest(acc["total"], term), F.least(acc["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    return F.aggregate(steps, F.struct(first.alias("term"), first.alias("total")), add, lambda acc: acc["total"])


def _tagged(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum, good (true, false, null: no label, or labels that differ), values (rule to measure) of rows the base rules keep."""
    told = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    told = told.filter("low = high and low in (0, 1)").select("doc_id", (F.col("low") == 1).alias("good"))
    values = F.create_map(*(x for rule, v in measures().items() for x in (F.lit(rule), v)))
    return rows.filter(~base_failed()).join(told, "doc_id", "left").select("stratum", "good", values.alias("values"))


def path(tagged: DataFrame, ws: Workspace, tails: list[float] | None = None) -> DataFrame:
    """stratum, step, rule, cutoff: the steps of each stratum, from those that lead to the most bad rows for what is rejected.

    Only rows that are not known to be good have a say. A notch's lift is the share of bad rows above it by that in the whole
    stratum (drawn to 1 where few rows are above); it is worth the most that it or a stricter notch of its rule lifts, so a
    rule's notches come in their order. Notches worth less than 1 are left out.
    """
    tails = TAILS if tails is None else tails
    each = tagged.filter("good is null or not good").select("stratum", "good", F.explode("values").alias("rule", "value"))
    bars = ws.save(each.groupBy("stratum", "rule", "value").agg(F.count("*").alias("n"), F.count_if(~F.col("good")).alias("bad")), "histogram")
    whole = Window.partitionBy("stratum", "rule")
    higher = whole.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    above = bars.withColumn("above", F.coalesce(F.sum("n").over(higher), F.lit(0))).withColumn("bad_above", F.coalesce(F.sum("bad").over(higher), F.lit(0)))
    above = above.withColumn("total", F.sum("n").over(whole)).withColumn("bad_total", F.sum("bad").over(whole)).filter("bad_total > 0")
    notch = F.explode(F.filter(F.array(*(F.struct(F.lit(j).alias("nth"), F.lit(float(q)).alias("tail")) for j, q in enumerate(tails))), lambda t: F.col("above") <= t["tail"] * F.col("total")))
    cuts = above.select("stratum", "rule", "value", "above", "bad_above", "total", "bad_total", notch.alias("t")).groupBy("stratum", "rule", F.col("t.nth").alias("nth")).agg(F.min_by(F.struct("value", "above", "bad_above", "total", "bad_total"), "value").alias("c"))
    once = cuts.groupBy("stratum", "rule", "c").agg(F.min("nth").alias("nth")).select("stratum", "rule", "nth", F.col("c.value").alias("cutoff"), "c.above", "c.bad_above", "c.total", "c.bad_total").filter("above > 0")
    base = F.col("bad_total") / F.col("total")
    lifted = once.withColumn("lift", (F.col("bad_above") + PRIOR * base) / ((F.col("above") + F.lit(PRIOR)) * base))
    onward = Window.partitionBy("stratum", "rule").orderBy("nth").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    worth = lifted.withColumn("worth", F.max("lift").over(onward)).filter("worth >= 1")
    return worth.withColumn("step", F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("worth"), "rule", "nth"))).select("stratum", "step", "rule", "cutoff")


def calibrate(rows: DataFrame, labels: DataFrame, ws: Workspace, risk: float = RISK, delta: float = DELTA, tails: list[float] | None = None) -> DataFrame:
    """stratum, cutoffs (map of rule to its cutoff; rules that are off are missing), n_good, n_rejected (good rows, and those
    of them that the cutoffs reject), one row a stratum in which a step is certified.

    rows: doc_id, stratum and `_m`; labels: doc_id, quality. A good row is one that its labels call 1, and that the base rules
    keep. Ids that occur several times count once a row.
    """
    tagged = ws.save(_tagged(rows, labels), "tagged")
    steps = ws.save(path(tagged, ws, tails), "path")
    listed = steps.groupBy("stratum").agg(F.collect_list(F.struct("step", "rule", "cutoff")).alias("steps"))
    side = F.broadcast(listed) if listed.count() <= MOST_BROADCAST else listed
    good = tagged.filter("good").join(side, "stratum")
    first = F.array_min(F.transform(F.filter("steps", lambda p: F.col("values")[p["rule"]] > p["cutoff"]), lambda p: p["step"]))
    fell = ws.save(good.groupBy("stratum", first.alias("step")).agg(F.count("*").alias("k")), "fell")
    held = fell.groupBy("stratum").agg(F.sum("k").alias("n"))
    tests = tagged.filter("good").select("stratum").distinct().count()
    if not tests:
        return ws.spark.createDataFrame([], "stratum string, cutoffs map<string,bigint>, n_good bigint, n_rejected bigint")
    so_far = Window.partitionBy("stratum").orderBy("step")
    counted = steps.join(fell, ["stratum", "step"], "left").join(held, "stratum").withColumn("k", F.sum(F.coalesce("k", F.lit(0))).over(so_far))
    few = F.col("k") < F.col("n") * risk
    safe = few & (F.when(few, log_binomial_tail(F.col("n"), F.col("k"), risk)).otherwise(0.0) <= math.log(delta / tests))
    passed = counted.withColumn("passed", F.min(safe.cast("int")).over(so_far)).filter("passed = 1")
    best = passed.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"), F.max("n").alias("n"), F.max("k").alias("k"))
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"), F.max("n").alias("n_good"), F.max("k").alias("n_rejected"))


def verdicts(rows: DataFrame, safe: DataFrame) -> DataFrame:
    """rows with base_failed and kept."""
    side = F.broadcast(safe) if safe.count() <= MOST_BROADCAST else safe
    hit = F.lit(False)
    for rule, value in measures().items():
        hit = hit | F.coalesce(value > F.col("cutoffs")[rule], F.lit(False))
    return rows.join(side.select("stratum", "cutoffs"), "stratum", "left").withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~hit).drop("cutoffs")


def judge(docs: DataFrame, labels: DataFrame, ws: Workspace) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for each row of docs.

    docs: doc_id, text, lang; labels: doc_id, quality; other columns are ignored. Null and empty texts have no words and fail
    the base rules (fewer than ten words, or more than a fifth of them in repeated five-word windows). A null language is a
    stratum of its own, and so is an empty one. Repeated rows are judged alike. Without labels only the base rules reject. No
    rows, no result.
    """
    rows = ws.save(measured(docs.select("doc_id", "lang", "text")).select("doc_id", "stratum", "_m"), "measures")
    safe = ws.save(calibrate(rows, labels, ws), "cutoffs")
    return verdicts(rows, safe).select("doc_id", *(F.col(f"_m.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept")


def stage(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, all columns, whatever their names. Rows are written with their measures first: a
    filter on measures that are not would be pushed below them and write their expressions out many times over."""
    ws = Workspace(spark, "quality-stage")
    rows = ws.save(measured(docs), "measures")
    safe = ws.save(calibrate(rows.select("doc_id", "stratum", "_m"), labels, ws), "cutoffs")
    return verdicts(rows, safe).filter("kept").select(*(F.col("row")[c].alias(c) for c in docs.columns))
