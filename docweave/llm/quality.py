"""Quality rules: base rules and robust multivariate outliers, in column expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docweave.operators.sizing import BROADCAST_ROWS, at_most, salted_join
from docweave.session import cut_lineage

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
#: Median-like point of the chi-square law with four degrees of freedom, at the share of rows kept in a step.
CHI_SQUARE_75 = 5.385
FEATURES = ["f_length", "f_symbols", "f_lines", "f_repeats"]
#: Least standard deviations of the features: differences below them are no sign of a bad text.
FLOORS = [0.03, 0.05, 0.15, 0.1]
#: Words of its group's average that every text's rates are mixed with, so short texts don't look odd by chance.
PRIOR_WORDS = 100
BINS_PER_UNIT = 64
#: Share of the rows that the estimates rest on; starts of the search, and about how many rows the drawn ones begin with.
INNER, STARTS, SUBSET = 0.75, 5, 12
#: Rows, and words, that the level above counts for in the estimate and in the rates of a group.
PRIOR_ROWS, PRIOR_SENT = 100, 20_000
#: Largest squared distance of a kept row. Fitted: clean labelled rows of the sample tables reach 31, and the chi-square law of four features gives 5e-9 beyond 43.
CUTOFF = 45.0


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long) to the rows.

    Words are runs of anything but blank, tab to carriage return. A repeated word lies in a
    window of eight words whose 64-bit hash is found at least twice in the text. Windows are
    hashed arrays inside the row; sorting happens only for texts with a repeated window.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_words", F.filter(F.split(t, SPACE), lambda w: w != ""))
    lines = F.filter(F.split(t, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("_lines", lines).withColumn("_hash", F.transform("_words", lambda w: F.xxhash64(w))).select(
        *docs.columns, F.size("_words").cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), "_hash")
    spots = F.when(F.size("_hash") >= WINDOW, F.sequence(F.lit(0), F.size("_hash") - WINDOW)).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("_windows", F.transform(spots, lambda i: F.xxhash64(*[F.get("_hash", i + k) for k in range(WINDOW)])))
    some = F.size(F.array_distinct("_windows")) < F.size("_windows")
    out = out.withColumn("_sorted", F.when(some, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda j, k: F.coalesce(F.get("_sorted", j)["h"] == F.get("_sorted", k)["h"], F.lit(False))
    held = F.filter("_sorted", lambda x, j: same(j, j - 1) | same(j, j + 1))
    out = out.withColumn("_at", F.array_sort(F.transform(held, lambda x: x["i"])))
    covered = F.aggregate(F.transform("_at", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", j + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)
    # always true, but not deterministic: a later filter stays above, where it doesn't repeat these expressions
    there = F.spark_partition_id() >= 0
    return out.withColumn("n_repeat_words", F.when(there, F.coalesce(covered, F.lit(0)).cast("long"))).drop("_hash", "_windows", "_sorted", "_at")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def distance(features: list[str]) -> Column:
    """Squared Mahalanobis distance from the centre m_i under the triangular factor l_i_j of the row."""
    solved: list[Column] = []
    for i, f in enumerate(features):
        rest = F.col(f) - F.col(f"m_{i}")
        for j in range(i):
            rest = rest - F.col(f"l_{i}_{j}") * solved[j]
        solved.append(rest / F.col(f"l_{i}_{i}"))
    return sum((y * y for y in solved), F.lit(0.0))


def factored(found: DataFrame, features: list[str], floors: list[float]) -> DataFrame:
    """Adds the lower triangular factor l_i_j of the covariance s_i_j; no feature varies less than its floor."""
    for j in range(len(features)):
        left = F.col(f"s_{j}_{j}") - sum((F.col(f"l_{j}_{k}") ** 2 for k in range(j)), F.lit(0.0))
        found = found.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(left, F.lit(floors[j] ** 2))))
        for i in range(j + 1, len(features)):
            left = F.col(f"s_{i}_{j}") - sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
            found = found.withColumn(f"l_{i}_{j}", left / F.col(f"l_{j}_{j}"))
    return found


def moments(rows: DataFrame, by: list[str], features: list[str]) -> DataFrame:
    """Centre m_i and covariance s_i_j of each group, one aggregation."""
    d = range(len(features))
    return rows.groupBy(*by).agg(*[F.avg(f).alias(f"m_{i}") for i, f in enumerate(features)],
                                 *[F.covar_pop(features[i], features[j]).alias(f"s_{i}_{j}") for i in d for j in range(i + 1)])


def beside(rows: DataFrame, groups: DataFrame, on: list[str], spread: str, few: bool, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of their group: ``groups`` is broadcast if it is known to be of ``few`` rows, else joined with salt."""
    return rows.join(F.broadcast(groups), on, how) if few else salted_join(rows, groups, on, [spread], how=how)


def starts(rows: DataFrame, group: str, key: str, features: list[str], few: bool) -> DataFrame:
    """(group, _start, m_i, s_i_j): where the search begins, from all rows, from medians, and from some dozen rows each, chosen by the hash of their key."""
    d = range(len(features))
    every = moments(rows, [group], features).withColumn("_start", F.lit(0))
    middle = rows.groupBy(group).agg(*[F.percentile_approx(f, 0.5).alias(f"m_{i}") for i, f in enumerate(features)], F.count(F.lit(1)).alias("_n"))
    middle = cut_lineage(middle, small=True)
    apart = beside(rows, middle, [group], key, few)
    spread = apart.groupBy(group).agg(*[(1.4826 * F.percentile_approx(F.abs(F.col(f) - F.col(f"m_{i}")), 0.5)).alias(f"w_{i}") for i, f in enumerate(features)])
    medians = middle.join(spread, group).select(group, F.lit(1).alias("_start"), *[f"m_{i}" for i in d],
                                                *[(F.col(f"w_{i}") ** 2 if i == j else F.lit(0.0)).alias(f"s_{i}_{j}") for i in d for j in range(i + 1)])
    some = F.array(*[F.struct(F.lit(n).alias("n"), F.pmod(F.xxhash64(F.col(key), F.lit(n)), F.ceil(F.col("_n") / SUBSET)).alias("h")) for n in range(2, STARTS)])
    drawn = apart.select(group, *features, F.explode(F.filter(some, lambda x: x["h"] == 0)).alias("x")).select(group, *features, F.col("x.n").alias("_start"))
    return every.unionByName(medians).unionByName(moments(drawn, [group, "_start"], features))


def minimum_covariance(rows: DataFrame, group: str, key: str, features: list[str], floors: list[float], steps: int = 4, share: float = 0.75) -> DataFrame:
    """Minimum-covariance-determinant estimates of each group: n, m_i, s_i_j, l_i_j.

    Concentration steps begin at several starts: distances under the current estimate are counted
    in narrow bins, and the bins with the nearest ``share`` of the group's rows make the next subset, whose determinant is
    no larger. Of the ends, that of the least determinant is kept. Counts and moments are summed before the shuffle, so a group of
    any size costs a row per start and task.
    """
    few = at_most(rows.select(group).distinct(), BROADCAST_ROWS // STARTS)
    found = cut_lineage(factored(starts(rows, group, key, features, few), features, floors), small=True)
    keys = [group, "_start"]
    for _ in range(steps):
        far = beside(rows, found, [group], key, few).withColumn("_bin", F.floor(BINS_PER_UNIT * F.log1p(distance(features))).cast("int"))
        edges = inner_edges(far, keys, share)
        inner = beside(far.select(*keys, key, *features, "_bin"), edges, keys, key, few).filter(F.col("_bin") <= F.col("edge_bin"))
        found = cut_lineage(factored(moments(inner, keys, features), features, floors), small=True)
    determinant = sum((F.log(f"l_{i}_{i}") for i in range(len(features))), F.lit(0.0))
    best = found.groupBy(group).agg(F.min_by("_start", F.struct(F.round(determinant, 9), "_start")).alias("_start"))
    return cut_lineage(found.join(best, keys).drop("_start").join(rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")), group), small=True)


def inner_edges(far: DataFrame, keys: list[str], share: float) -> DataFrame:
    """(keys, edge_bin): the bin of ``_bin`` up to which the nearest ``share`` of each group's rows lie."""
    bins = far.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_c"))
    up, of = W.partitionBy(*keys).orderBy("_bin"), W.partitionBy(*keys)
    return bins.withColumn("_below", F.sum("_c").over(up)).withColumn("_total", F.sum("_c").over(of)).filter(
        F.col("_below") >= share * F.col("_total")).groupBy(*keys).agg(F.min("_bin").alias("edge_bin"))


RATES = ["word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _keyed(docs: DataFrame, held: list[Column], text: str, lang: str, source: str) -> DataFrame:
    return docs.select(*held, F.col(f"`{text}`").alias("text"), F.to_json(F.struct(F.col(f"`{lang}`").alias("l"))).alias("_lang"),
                       F.to_json(F.struct(F.col(f"`{lang}`").alias("l"), F.col(f"`{source}`").alias("s"))).alias("_both"))


def _features(rows: DataFrame, groups: DataFrame, spread: list[str]) -> DataFrame:
    """``rows`` with what ``groups`` says of their language and source, and their transformed statistics."""
    if at_most(groups, BROADCAST_ROWS):
        joined = rows.join(F.broadcast(groups), "_both", "left")
    else:
        joined = salted_join(rows, groups, ["_both"], spread, how="left")
    rate = {c: (F.col(c) + PRIOR_WORDS * F.col(f"r_{c}")) / (F.col("n_words") + PRIOR_WORDS) for c in RATES}
    return joined.withColumns({"f_length": F.log(rate["word_chars"]), "f_symbols": F.log1p(10 * rate["n_symbols"]),
                               "f_lines": F.log1p(100 * rate["n_dup_lines"]), "f_repeats": rate["n_repeat_words"]})


def pulled(n: Column, own: Column, other: Column, weight: float) -> Column:
    """``own``, known from ``n`` rows (or words), pulled to ``other`` as if that were known from ``weight`` more."""
    return (n * own + weight * other) / (n + weight)


def levels(lang: str = "_lang", both: str = "_both") -> Column:
    """Names of the whole table, the language, and the language and source of a row."""
    return F.array(F.lit("all"), F.concat(F.lit("lang "), F.col(lang)), F.concat(F.lit("both "), F.col(both)))


def shrunken(found: DataFrame, features: list[str], prior: int) -> DataFrame:
    """Estimates of ``found`` (n, m_i, s_i_j, and p_m_i, p_s_i_j of the level above) pulled to the level above; the distance of the centres adds to the covariance."""
    d = range(len(features))
    n = F.coalesce(F.col("n"), F.lit(0))
    mean = {i: F.coalesce(pulled(n, F.col(f"m_{i}"), F.col(f"p_m_{i}"), prior), F.col(f"p_m_{i}")) for i in d}
    gap = lambda i: F.coalesce(F.col(f"m_{i}") - F.col(f"p_m_{i}"), F.lit(0.0))
    between = n * prior / (n + prior) ** 2
    cov = {(i, j): F.coalesce(pulled(n, F.col(f"s_{i}_{j}"), F.col(f"p_s_{i}_{j}"), prior), F.col(f"p_s_{i}_{j}")) + between * gap(i) * gap(j) for i in d for j in range(i + 1)}
    others = [c for c in found.columns if not c.startswith(("m_", "s_", "p_", "l_"))]
    return found.select(*others, *[mean[i].alias(f"m_{i}") for i in d], *[c.alias(f"s_{i}_{j}") for (i, j), c in cov.items()])


def learn_rules(stats: DataFrame, least: int, prior: int = PRIOR_ROWS) -> DataFrame:
    """A row for each language and source (``_both``): rates r_* of its texts, m_*, l_*_* and edge of its robust estimate, own_rows behind it.

    Rates and estimates of a language are pulled to those of the whole table, and those of a source in a language to the
    language's, as if these came with ``PRIOR_SENT`` words and ``prior`` rows more. So a group of three rows is judged nearly by its language, one of
    thousands by itself, and none by a switch between the two. With fewer than ``least`` rows in all there is no estimate.
    """
    good = stats.filter(~F.col("base_failed"))
    sums = cut_lineage(good.groupBy("_lang", "_both").agg(F.count(F.lit(1)).alias("own_rows"), *[F.sum(c).alias(f"s_{c}") for c in ["n_words", *RATES]]), small=True)
    langs = sums.groupBy("_lang").agg(F.sum("s_n_words").alias("w"), *[F.sum(f"s_{c}").alias(f"a_{c}") for c in RATES])
    whole = sums.agg(F.sum("own_rows").alias("_all"), *[(F.sum(f"s_{c}") / F.sum("s_n_words")).alias(f"t_{c}") for c in RATES])
    known = langs.join(F.broadcast(whole.withColumn("_one", F.lit(1))), F.col("_one") == 1).select(
        "_lang", "_all", *[((F.col(f"a_{c}") + PRIOR_SENT * F.col(f"t_{c}")) / (F.col("w") + PRIOR_SENT)).alias(f"g_{c}") for c in RATES])
    groups = cut_lineage(sums.join(known, "_lang").select("_lang", "_both", "own_rows", "_all", *[
        ((F.col(f"s_{c}") + PRIOR_SENT * F.col(f"g_{c}")) / (F.col("s_n_words") + PRIOR_SENT)).alias(f"r_{c}") for c in RATES]), small=True)
    rows = cut_lineage(_features(good, groups.drop("_lang"), ["_key"]).filter(F.col("_all") >= least).select("_key", "_lang", "_both", *FEATURES))
    several = rows.select("_key", *FEATURES, F.explode(levels()).alias("_level"))
    found = minimum_covariance(several, "_level", "_key", FEATURES, FLOORS)
    values = [c for c in found.columns if c.startswith(("m_", "s_"))]
    of = lambda name: found.select("_level", "n", *values).withColumnRenamed("_level", name)
    above = lambda frame: frame.select("_level", *[F.col(c).alias(f"p_{c}") for c in values])
    top = found.filter("_level = 'all'").select(*[F.col(c).alias(f"p_{c}") for c in values], F.lit(1).alias("_one"))
    second = shrunken(of("_level").filter(F.col("_level").startswith("lang ")).join(F.broadcast(top), F.col("_one") == 1).drop("_one"), FEATURES, prior)
    third = groups.select("_both", "_lang").withColumn("_level", F.concat(F.lit("lang "), F.col("_lang"))).join(above(second), "_level").drop("_level").withColumn(
        "_level", F.concat(F.lit("both "), F.col("_both"))).join(of("_level"), "_level", "left")
    judged = cut_lineage(factored(shrunken(third, FEATURES, prior), FEATURES, FLOORS), small=True)
    far = beside(rows, judged.select("_both", *[c for c in judged.columns if c.startswith(("m_", "l_"))]), ["_both"], "_key", at_most(judged, BROADCAST_ROWS)).withColumn(
        "_bin", F.floor(BINS_PER_UNIT * F.log1p(distance(FEATURES))).cast("int"))
    edges = cut_lineage(inner_edges(far.select("_key", "_bin", F.explode(levels()).alias("_level")), ["_level"], INNER).withColumn("e", F.expm1((F.col("edge_bin") + 1) / BINS_PER_UNIT)), small=True)
    edge = lambda level, name: F.broadcast(edges.select(F.col("_level").alias(level), F.col("e").alias(name))) if at_most(edges, BROADCAST_ROWS) else edges.select(F.col("_level").alias(level), F.col("e").alias(name))
    named = judged.select("_both", "_lang", "n", *[c for c in judged.columns if c.startswith(("m_", "l_"))]).withColumns({"_l0": F.lit("all"), "_l1": levels()[1], "_l2": levels()[2]})
    for i in range(3):
        named = named.join(edge(f"_l{i}", f"e{i}"), f"_l{i}", "left")
    size = rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("_size"))
    named = named.join(size, "_lang", "left")
    second_edge = pulled(F.coalesce("_size", F.lit(0)), F.coalesce("e1", "e0"), F.col("e0"), prior)
    named = named.withColumn("edge", pulled(F.coalesce("n", F.lit(0)), F.coalesce("e2", "e1", "e0"), second_edge, prior))
    return cut_lineage(groups.drop("_lang", "_all").join(named.drop("_lang", "n", "_size", *[f"{x}{i}" for x in ("_l", "e") for i in range(3)]), "_both", "left"), small=True)


def _judged(stats: DataFrame, rules: DataFrame, cutoff: float) -> DataFrame:
    far = _features(stats, rules, ["_key"]).withColumn("distance", distance(FEATURES) * CHI_SQUARE_75 / F.greatest(F.col("edge"), F.lit(CHI_SQUARE_75)))
    return far.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff))


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF, least: int = 100, key: str = "doc_id", text: str = "text", lang: str = "lang",
                  source: str = "source") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept, own_share), one row per row of ``docs``.

    A row is kept if it passes the base rules and its squared robust distance, scaled so that
    the inner three quarters of its group match the chi-square law, is at most ``cutoff``.
    Vectors are log word length, log symbols per word, repeated lines and repeated words, as
    rates mixed with ``PRIOR_WORDS`` words at the group's rate; rows failing the base rules
    have no part in the estimates. Groups are (lang, source), pulled to their language as far as they are small;
    ``own_share`` is the part of the judgement that is the group's own (null: no row of it passes the base rules). With fewer than ``least``
    rows in all no row is an outlier.

    Null texts are empty and fail; null languages and sources are groups of their own; repeated
    rows and keys each count; an empty table gives no rows; other columns are not read.
    """
    rows = _keyed(docs, [F.col(f"`{key}`").cast("long").alias("doc_id")], text, lang, source)
    stats = cut_lineage(text_statistics(rows).drop("text").withColumn("base_failed", base_failed()).withColumn("_key", F.col("doc_id")))
    return _judged(stats, learn_rules(stats, least), cutoff).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept",
        F.round(F.col("own_rows") / (F.col("own_rows") + PRIOR_ROWS), 6).alias("own_share"))


def drop_low_quality(docs: DataFrame, cutoff: float = CUTOFF, least: int = 100, key: str = "doc_id", text: str = "text", lang: str = "lang",
                     source: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns.

    The statistics are taken twice, to learn and to judge, so that no text is shuffled.
    """
    number = F.col(f"`{key}`").cast("long").alias("_key")
    learnt = text_statistics(_keyed(docs, [number], text, lang, source)).drop("text").withColumn("base_failed", base_failed())
    rules = learn_rules(cut_lineage(learnt), least)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = text_statistics(_keyed(docs, [number, whole], text, lang, source)).withColumn("base_failed", base_failed())
    return _judged(rows, rules, cutoff).filter("kept").select("_row.*")
