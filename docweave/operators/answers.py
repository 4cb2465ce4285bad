"""Checks on answers: citations, coverage, confidence, support by sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docweave.functions.numbers import value_clusters
from docweave.functions.vectors import cosine

# fixed values: citation marks, lines of markup, end of a sentence
CITATION = r"\[(\d+|\?)\]"
FORMAT_LINE = r"^\s*(?:[-=*]{3,}|#{1,6}\s|```|>\s*|\s*[-*+]\s+|\s*\d+\.\s+)|^\s*$"
SENTENCE_END = r"(?<=[。！？!?])"
LEAST_FACT = 5


def sentence_rows(answers: DataFrame, key: str, text_col: str = "answer") -> DataFrame:
    """(key, line_no, part_no, piece, is_fact): an answer as pieces that join back to it.

    Lines keep their break; a line of markup is one piece, others are cut after sentence ends.
    """
    lines = answers.select(key, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), r"(?<=\n)")).alias("line_no", "line"))
    whole = F.trim(F.col("line")).rlike(FORMAT_LINE)
    parts = F.when(whole, F.array("line")).otherwise(F.filter(F.split("line", SENTENCE_END), lambda p: p != ""))
    rows = lines.select(key, "line_no", F.posexplode(parts).alias("part_no", "piece"))
    body = F.btrim("piece", F.lit(" \t\n\r"))
    return rows.withColumn("is_fact", ~body.rlike(FORMAT_LINE) & (F.length(body) >= LEAST_FACT))


def citation_marks(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CITATION), F.lit(1))


def citation_report(answers: DataFrame, key: str, text_col: str = "answer", n_sources: str = "n_sources") -> DataFrame:
    """(key, facts, cited, coverage, out_of_range): [?] does not count as a citation."""
    rows = sentence_rows(answers, key, text_col).filter("is_fact")
    cited = F.size(F.filter(citation_marks(F.col("piece")), lambda c: c != "?")) > 0
    share = rows.groupBy(key).agg(F.count(F.lit(1)).alias("facts"), F.count_if(cited).alias("cited"))
    wrong = F.size(F.filter(citation_marks(F.col(text_col)), lambda c: (c != "?") & ((c.cast("long") < 1) | (c.cast("long") > F.col(n_sources)))))
    base = answers.select(key, F.when(F.col(n_sources) > 0, wrong).otherwise(0).alias("out_of_range"))
    return base.join(share, key, "left").select(
        key, F.coalesce("facts", F.lit(0)).alias("facts"), F.coalesce("cited", F.lit(0)).alias("cited"),
        F.when(F.col("facts") > 0, F.round(F.col("cited") / F.col("facts"), 4)).otherwise(F.lit(0.0)).alias("coverage"), "out_of_range")


def append_citation(piece: Column, tag: Column) -> Column:
    """Mark before the final sentence sign; trailing white space stays."""
    mark = F.concat(F.lit("["), tag, F.lit("]"))
    body = F.regexp_replace(piece, r"\s+$", "")
    tail = F.substr(piece, F.length(body) + 1, F.length(piece))
    ended = body.rlike(r"[。！？!?]$")
    return F.concat(F.when(ended, F.concat(F.expr("''"), F.substr(body, F.lit(1), F.length(body) - 1), mark, F.substr(body, F.length(body), F.lit(1))))
                    .otherwise(F.concat(body, mark)), tail)


def backfill_citations(answers: DataFrame, sources: DataFrame, key: str, embed, threshold: float = 0.65) -> DataFrame:
    """(key, answer): uncited fact sentences get [n] of the closest source, or [?].

    ``answers``: key, answer; ``sources``: key, source_index, content. Marks that name no
    source become [?]. Sentences meet only the sources of their own answer; an answer is put
    together again from its pieces, which are as many as it had.
    """
    rows = sentence_rows(answers, key)
    known = sources.groupBy(key).agg(F.collect_set(F.col("source_index").cast("string")).alias("known"))
    rows = rows.join(known, key, "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    marks = citation_marks(F.col("piece"))
    open_rows = rows.filter(F.col("is_fact") & (F.size(marks) == 0)).select(key, "line_no", "part_no", embed(F.trim(F.col("piece"))).alias("v"))
    vectors = sources.select(key, "source_index", embed(F.col("content")).alias("sv"))
    best = open_rows.join(vectors, key).groupBy(key, "line_no", "part_no").agg(
        F.max_by("source_index", F.struct(cosine(F.col("v"), F.col("sv")).alias("c"), (-F.col("source_index")).alias("i"))).alias("best"),
        F.max(cosine(F.col("v"), F.col("sv"))).alias("score"))
    j = rows.join(best, [key, "line_no", "part_no"], "left")
    # marks outside the known sources, one alternative per wrong number
    bad = F.array_except(F.filter(marks, lambda c: c != "?"), F.col("known"))
    fixed = F.when(F.size(bad) > 0, F.regexp_replace(F.col("piece"), F.concat(F.lit(r"\[(?:"), F.array_join(bad, "|"), F.lit(r")\]")), F.lit("[?]"))).otherwise(F.col("piece"))
    tag = F.when(F.col("score") > threshold, F.col("best").cast("string")).otherwise("?")
    piece = F.when(~F.col("is_fact"), F.col("piece")).when(F.size(marks) > 0, fixed).otherwise(append_citation(F.col("piece"), tag))
    return j.select(key, "line_no", "part_no", piece.alias("p")).groupBy(key).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("line_no", "part_no", "p"))), lambda x: x["p"]), "").alias("answer"))


def cross_source_share(answer_values: DataFrame, source_values: DataFrame, key: str, tolerance: float = 0.05) -> DataFrame:
    """(key, share): answer numbers close to a value that several domains agree on."""
    agreed = value_clusters(source_values, [key], tolerance).filter(F.col("verdict") == "validated").groupBy(key).agg(
        F.collect_set("base").alias("bases"))
    near = F.exists("bases", lambda b: F.abs(F.col("value") - b) <= tolerance * F.abs(b))
    return answer_values.join(agreed, key, "left").groupBy(key).agg(
        F.avg(F.coalesce(near, F.lit(False)).cast("double")).alias("share"))


def answer_confidence(cross: Column, citation: Column, authority: Column, freshness: Column) -> Column:
    """.4 cross-source + .3 citations + .2 authority + .1 freshness, clamped, 4 digits."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    score = 0.4 * z(cross) + 0.3 * z(citation) + 0.2 * z(authority) + 0.1 * z(freshness)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)


def navigation_summary(steps: DataFrame) -> DataFrame:
    """(trace_id, rounds, index_rounds, modes, pages) from ordered navigation steps.

    A trace has as many steps as its agent took, so its lists are short.
    """
    row = F.struct("step", "mode", "page")
    listed = steps.groupBy("trace_id").agg(F.array_sort(F.collect_list(row)).alias("s"), F.count(F.lit(1)).alias("rounds"),
                                           F.count_if(F.col("mode") == "index").alias("index_rounds"))
    return listed.select("trace_id", "rounds", "index_rounds", F.array_join(F.transform("s", lambda x: x["mode"]), ">").alias("modes"),
                         F.array_join(F.transform("s", lambda x: x["page"]), ">").alias("pages"))


def material(chunks: DataFrame, key: str, most_chars: int) -> DataFrame:
    """(key, material, chars, cut): chunk texts in order, cut at a number of characters.

    Only the leading chunks that can matter are gathered: a running length, taken per
    thousand chunks and then inside the block, drops the rest before anything is collected.
    """
    from pyspark.sql import Window as W

    rows = chunks.filter(F.coalesce("content", F.lit("")) != "").withColumn("_n", F.length("content") + 2).withColumn("_b", F.floor(F.col("chunk_index") / 1000))
    blocks = rows.groupBy(key, "_b").agg(F.sum("_n").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.withColumn("_before", before).filter(F.col("_before") < most_chars).select(key, "_b", "_before")
    inside = F.coalesce(F.sum("_n").over(W.partitionBy(key, "_b").orderBy("chunk_index").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lead = rows.join(starts, [key, "_b"]).withColumn("_start", F.col("_before") + inside).filter(F.col("_start") < most_chars)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), "\n\n")
    totals = rows.groupBy(key).agg((F.sum("_n") - 2).alias("_all"))
    return lead.groupBy(key).agg(F.substring(text, 1, most_chars).alias("material")).join(totals, key).select(
        key, "material", F.length("material").alias("chars"), (F.col("_all") > most_chars).alias("cut"))
