"""Pages, links and bases: link graph, lint, navigation, recommendation, knowledge graph."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from docweave.functions.text import extract_links, normalize_title, rows_of
from docweave.functions.vectors import cosine
from docweave.operators.dense import distinct_vectors, similar_pairs
from docweave.operators.matching import nearest_in_turn
from docweave.operators.sequential import numbered_in_order
from docweave.session import cut_lineage

# fixed values: titles that travel to the tasks as one table; else pages and titles of a base that one task holds
TITLE_ROWS = 200_000
PAGE_GROUP, TITLE_GROUP = 4096, 100_000


def title_mentions(pages: DataFrame, titles: DataFrame, most: int = 8) -> DataFrame:
    """(id, title, position, place): titles of the same base found in a page's text.

    ``pages``: id, kb_id, title, content; ``titles``: kb_id, title. Blanks and case are
    ignored, titles of one character and the page's own title are left out, the first
    ``most`` by first position stay, and no task returns more than these of a page. A title table of checked size travels to
    the tasks, so each text is read once and not shuffled; a larger one meets the texts base by base,
    in groups of so many pages and so many titles.
    """
    t = titles.select("kb_id", "title", normalize_title(F.col("title")).alias("norm")).filter(F.length("norm") >= 2)
    t = t.groupBy("kb_id", "norm").agg(F.min("title").alias("title"))
    body = pages.select("id", "kb_id", normalize_title(F.col("content")).alias("hay"), normalize_title(F.col("title")).alias("own"))
    small = t.filter(F.col("kb_id").isNotNull()).select(F.col("kb_id").cast("string").alias("kb"), "norm", "title").limit(TITLE_ROWS + 1).collect()
    found = _mentions_in_task(body, small, most) if len(small) <= TITLE_ROWS else _mentions_by_base(body, t, most)
    w = W.partitionBy("id").orderBy("position", "title")
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("id", "title", "position", "place")


def first_mentions(text: str, own: str, names: dict[int, dict[str, str]], most: int) -> list[tuple[int, str]]:
    """(position, title) of the first ``most`` titles in a text; ``names``: by length, title by normalised title."""
    if sum(map(len, names.values())) < len(text) // 8:
        # few names: look each up in the text
        found = ((text.find(norm) + 1, title) for by in names.values() for norm, title in by.items() if norm != own)
        return sorted(f for f in found if f[0])[:most]
    # many: look the text's windows up among them, up to the last position that can still matter
    hits, seen = [], {own}
    for i in range(len(text)):
        for size, by in names.items():
            part = text[i:i + size]
            if part in by and part not in seen:
                seen.add(part)
                hits.append((i + 1, by[part]))
        if len(hits) >= most:
            break
    return sorted(hits)[:most]


def _by_length(norms, titles) -> dict[int, dict[str, str]]:
    names: dict[int, dict[str, str]] = {}
    for norm, title in zip(norms, titles):
        names.setdefault(len(norm), {})[norm] = title
    return names


def _mentions_in_task(body: DataFrame, rows: list, most: int) -> DataFrame:
    """Every text beside the titles of its base."""
    listed: dict[str, tuple[list[str], list[str]]] = {}
    for kb, norm, title in rows:
        held = listed.setdefault(kb, ([], []))
        held[0].append(norm)
        held[1].append(title)
    packed = body.sparkSession.sparkContext.broadcast({kb: _by_length(*held) for kb, held in listed.items()})

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("position", T.IntegerType()), T.StructField("title", T.StringType())])))
    def find(kb: pd.Series, hay: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([first_mentions(text, mine, packed.value.get(base, {}), most) for base, text, mine in zip(kb, hay, own)], dtype=object)

    hits = body.select("id", rows_of(find(F.col("kb_id").cast("string"), F.col("hay"), F.col("own"))).alias("h")).filter(
        F.col("h").isNotNull())
    return hits.select("id", "h.title", "h.position")


def _mentions_by_base(body: DataFrame, t: DataFrame, most: int) -> DataFrame:
    """Groups of pages and of titles of one base; each returns the first ``most`` of its titles for a page, so the first of all are among them."""
    some = lambda rows, size, name: rows.groupBy("kb_id").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    sizes = some(body, PAGE_GROUP, "parts").join(some(t, TITLE_GROUP, "shards"), "kb_id")
    part = lambda n, *cols: F.pmod(F.xxhash64(*cols), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = body.join(sizes, "kb_id").select(F.col("kb_id").alias("base"), "id", "hay", "own", part("parts", "id", "hay").alias("part"), every("shards").alias("shard"))
    right = t.join(sizes, "kb_id").select(F.col("kb_id").alias("base"), "norm", "title", part("shards", "norm").alias("shard"), every("parts").alias("part"))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = _by_length(b["norm"], b["title"])
        hits = [(i, title, at) for i, text, own in zip(a["id"], a["hay"], a["own"]) for at, title in first_mentions(text, own, names, most)]
        return pd.DataFrame(hits, columns=["id", "title", "position"])

    keys = ["base", "part", "shard"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        meet, f"id {body.schema['id'].dataType.simpleString()}, title string, position int")


def fill_links(pages: DataFrame) -> DataFrame:
    """Edges of every base from the titles of its own active pages."""
    active = pages.filter(F.col("status") == "active")
    return title_mentions(active, active.select("kb_id", "title"))


def marked_links(pages: DataFrame) -> DataFrame:
    """(id, target, place) from ``[[Title]]`` marks that name a page of the same base."""
    raw = pages.select("id", "kb_id", F.posexplode(extract_links(F.col("content"), F.col("title"))).alias("place", "mark"))
    names = pages.select("kb_id", F.col("title").alias("target"), normalize_title(F.col("title")).alias("norm")).groupBy("kb_id", "norm").agg(F.min("target").alias("target"))
    hit = raw.withColumn("norm", normalize_title(F.col("mark"))).join(names, ["kb_id", "norm"])
    return hit.groupBy("id", "target").agg(F.min("place").alias("place"))


# fixed values: page sizes that are reported
TOO_SHORT, TOO_LONG = 200, 20000


def lint_pages(pages: DataFrame) -> DataFrame:
    """(id, rule, level, detail) over the active pages of every base.

    ``pages``: id, kb_id, page_type, title, content, links[], source_doc_ids[], status.
    """
    active = pages.filter(F.col("status") == "active").withColumn("norm", normalize_title(F.col("title")))
    body = active.filter(F.col("page_type").isin("entity", "topic"))
    names = active.select("kb_id", "norm").distinct()
    links = body.select("id", "kb_id", "norm", F.explode("links").alias("link")).withColumn("target", normalize_title(F.col("link")))
    broken = links.join(names.select("kb_id", F.col("norm").alias("target")), ["kb_id", "target"], "left_anti").select(
        "id", F.lit("broken_link").alias("rule"), F.lit("error").alias("level"), F.col("link").alias("detail"))
    index = active.filter(F.col("page_type") == "index")
    has_index = index.select("kb_id").distinct().withColumn("has_index", F.lit(True))
    marks = F.regexp_extract_all("content", F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1))
    listed = index.select("kb_id", F.explode(marks).alias("m")).select("kb_id", normalize_title(F.col("m")).alias("norm")).distinct().withColumn("listed", F.lit(True))
    pointed = links.filter(F.col("target") != F.col("norm")).select("kb_id", F.col("target").alias("norm")).distinct().withColumn("pointed", F.lit(True))
    j = body.join(listed, ["kb_id", "norm"], "left").join(pointed, ["kb_id", "norm"], "left").join(has_index, "kb_id", "left")
    size = F.length(F.coalesce("content", F.lit("")))
    issue = lambda rule, level, detail: F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("level"), detail.alias("detail"))
    nothing = F.lit("")
    found = F.array_compact(F.array(
        F.when(F.col("listed").isNull() & F.col("pointed").isNull(), issue("orphan_page", "warning", nothing)),
        F.when(F.col("has_index") & F.col("listed").isNull(), issue("missing_in_index", "warning", nothing)),
        F.when(F.coalesce(F.size("source_doc_ids"), F.lit(0)) <= 0, issue("empty_source", "warning", nothing)),
        F.when(((size > 0) & (size < TOO_SHORT)) | (size > TOO_LONG), issue("abnormal_size", "info", size.cast("string")))))
    return broken.unionByName(j.select("id", F.explode(found).alias("i")).select("id", "i.rule", "i.level", "i.detail"))


# fixed values: headings of the index page by page type, in order
INDEX_HEADINGS = [("entity", "实体页"), ("topic", "主题页"), ("synthesis", "综合页")]


def index_lines(pages: DataFrame) -> DataFrame:
    """(kb_id, page_type, line_no, line): the index of every base as ordered lines.

    One heading with the count per type, then its titles; a base of any size stays spread
    over tasks and a writer sorts by (page_type, line_no).
    """
    active = pages.filter((F.col("status") == "active") & (F.col("page_type") != "index"))
    label = F.col("page_type")
    for key, name in INDEX_HEADINGS:
        label = F.when(F.col("page_type") == key, name).otherwise(label)
    heads = active.groupBy("kb_id", "page_type").agg(F.count(F.lit(1)).alias("n")).select(
        "kb_id", "page_type", F.lit("").alias("title"), F.concat(F.lit("## "), label, F.lit("（"), F.col("n").cast("string"), F.lit("）")).alias("line"))
    rows = active.select("kb_id", "page_type", "title", F.concat(F.lit("- [["), F.col("title"), F.lit("]]")).alias("line"))
    return heads.unionByName(rows)


def related_line(links: Column, excluded: Column, most: int = 8) -> Column:
    """``Related: [[A]] [[B]]`` of the first distinct links outside the excluded titles."""
    kept = F.slice(F.filter(F.array_distinct(links), lambda x: ~F.array_contains(excluded, x)), 1, most)
    text = F.array_join(F.transform(kept, lambda x: F.concat(F.lit("[["), x, F.lit("]]"))), " ")
    return F.when(F.size(kept) > 0, F.concat(F.lit("Related: "), text)).otherwise("")


def navigate(entries: DataFrame, links: DataFrame, per_page: int, k: int) -> DataFrame:
    """(query_id, page_id, rank): entry pages in order, each followed by those of its first
    ``per_page`` linked pages not seen before, cut at k.

    An entry already reached through an earlier one keeps that place and opens no links of
    its own. ``entries``: query_id, page_id, rank, already cut to the few entry pages of a
    question, so the fold over them is short; ``links``: page_id, target_id, place.
    """
    near = links.filter(F.col("place") < per_page).groupBy("page_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("place", "target_id"))), lambda x: x["target_id"]).alias("near"))
    rows = entries.join(near, "page_id", "left")
    kind = entries.schema["page_id"].dataType.simpleString()
    none = F.array().cast(f"array<{kind}>")
    listed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "page_id", F.coalesce("near", none).alias("near")))).alias("e"))
    walk = F.aggregate("e", none, lambda seen, e: F.when(F.array_contains(seen, e["page_id"]), seen).otherwise(
        F.concat(seen, F.array(e["page_id"]), F.array_except(e["near"], F.concat(seen, F.array(e["page_id"]))))))
    return listed.select("query_id", F.posexplode(F.slice(walk, 1, k)).alias("rank", "page_id")).withColumn("rank", F.col("rank") + 1)


def entry_pages(hits: DataFrame, kinds: list[str], each: int, k: int) -> DataFrame:
    """First ``each`` hits per kind, kinds one after another, cut at k."""
    w = W.partitionBy("query_id", "source_kind").orderBy("rank")
    order = F.array_position(F.array(*[F.lit(x) for x in kinds]), F.col("source_kind"))
    some = hits.filter(F.col("source_kind").isin(kinds)).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= each)
    all_kinds = W.partitionBy("query_id").orderBy(order, "_n")
    return some.withColumn("rank", F.row_number().over(all_kinds)).filter(F.col("rank") <= k).drop("_n")


def route_priors(questions: DataFrame, index_pages: DataFrame) -> DataFrame:
    """(query_id, kb_id, prior): cosine of question and index page, not below 0, best per base.

    ``questions`` carries the candidate kb_id beside the embedding, so only wanted pairs meet.
    """
    pages = index_pages.select("kb_id", F.col("embedding").alias("page_vec"))
    return questions.join(pages, "kb_id").groupBy("query_id", "kb_id").agg(
        F.greatest(F.lit(0.0), F.max(cosine(F.col("embedding"), F.col("page_vec")))).alias("prior"))


def recommend_bases(hits: DataFrame, priors: DataFrame | None = None, weight: float = 0.3, k: int = 3) -> DataFrame:
    """Bases per question by mean hit score, mixed with a prior where there is one."""
    per = hits.filter(F.coalesce(F.col("kb_id").cast("string"), F.lit("")) != "").groupBy("query_id", "kb_id").agg(
        F.avg("score").alias("chunk_score"), F.count(F.lit(1)).alias("matched_chunks"))
    per = per.join(priors, ["query_id", "kb_id"], "left") if priors is not None else per.withColumn("prior", F.lit(None).cast("double"))
    fused = F.when(F.col("prior").isNull(), F.col("chunk_score")).otherwise(F.col("chunk_score") * (1 - weight) + F.col("prior") * weight)
    w = W.partitionBy("query_id").orderBy(F.round("relevance_score", 6).desc(), "kb_id")
    return per.withColumn("relevance_score", fused).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def knowledge_graph(docs: DataFrame, vectors: DataFrame, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges). Nodes: bases and documents; edges: contains, similar, same.

    ``docs``: doc_id, kb_id; ``vectors``: doc_id, embedding, one per document. Documents
    of equal vectors are tied to the first of them by ``same`` edges, and only that one
    takes part in ``similar`` edges, so a group of copies costs its size, not its square.
    """
    kb = lambda c: F.concat(F.lit("kb:"), c.cast("string"))
    doc = lambda c: F.concat(F.lit("doc:"), c.cast("string"))
    nodes = docs.select(kb(F.col("kb_id")).alias("id"), F.lit("kb").alias("type")).distinct().unionByName(
        docs.select(doc(F.col("doc_id")).alias("id"), F.lit("document").alias("type")))
    contains = docs.select(kb(F.col("kb_id")).alias("source"), doc(F.col("doc_id")).alias("target"), F.lit("contains").alias("type"), F.lit(1.0).alias("weight"))
    pairs = similar_pairs(vectors, "doc_id", threshold).select(
        doc(F.col("a")).alias("source"), doc(F.col("b")).alias("target"), F.lit("similar").alias("type"), F.col("score").alias("weight"))
    rep = distinct_vectors(vectors, "doc_id").filter(F.col("copies") > 1)
    same = vectors.join(rep.select("embedding", F.col("id").alias("first")), "embedding").filter(F.col("doc_id") != F.col("first")).select(
        doc(F.col("first")).alias("source"), doc(F.col("doc_id")).alias("target"), F.lit("same").alias("type"), F.lit(1.0).alias("weight"))
    return nodes, contains.unionByName(pairs).unionByName(same)


def compare_answers(answers: DataFrame) -> DataFrame:
    """(question_id, answers, similarity_score, consistency): mean pairwise cosine.

    The sum over all pairs of unit vectors is (|sum of vectors|^2 - n) / 2, so no pair is
    built: per question one vector sum, added up map-side.
    """
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    parts = answers.select("question_id", length.alias("length"), F.posexplode("embedding").alias("d", "raw")).withColumn(
        "x", F.when(F.col("length") > 0, F.col("raw").cast("double") / F.col("length")).otherwise(F.lit(0.0)))
    sums = parts.groupBy("question_id", "d").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count(F.lit(1)).alias("n"))
    agg = sums.groupBy("question_id").agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s") - F.col("q")).alias("cross"))
    mean = F.when(F.col("n") > 1, F.col("cross") / (F.col("n") * (F.col("n") - 1))).otherwise(F.lit(1.0))
    return agg.select("question_id", F.col("n").alias("answers"), F.round(mean, 2).alias("similarity_score"),
                      F.when(mean >= 0.8, "high").when(mean >= 0.5, "medium").otherwise("low").alias("consistency"))


def equal_titles(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """(kb_id, cand_id, page_id, how): of equal titles in a base the first candidate and the first page pair up, and so on."""
    nth = lambda order: F.row_number().over(W.partitionBy("kb_id", "norm").orderBy(order))
    c = candidates.withColumn("norm", normalize_title(F.col("title"))).withColumn("n", nth("pos"))
    p = pages.withColumn("norm", normalize_title(F.col("title"))).withColumn("n", nth("page_id"))
    return cut_lineage(c.join(p.select("kb_id", "norm", "n", "page_id"), ["kb_id", "norm", "n"]).select("kb_id", "cand_id", "page_id", F.lit("title").alias("how")))


def match_titles_by_vector(candidates: DataFrame, pages: DataFrame, members: DataFrame, vectors: DataFrame, threshold: float = 0.85) -> DataFrame:
    """``match_titles`` by the cosine of vectors, without a row per pair.

    ``members``: copy (a candidate or page), id of its class of equal vectors; ``vectors``: id, v. See ``nearest_in_turn``.
    """
    exact = equal_titles(candidates, pages)
    wanted = candidates.select("kb_id", "pos", "cand_id").join(members.withColumnsRenamed({"copy": "cand_id", "id": "cand_class"}), "cand_id").join(
        exact.select("kb_id", "cand_id"), ["kb_id", "cand_id"], "left_anti")
    queues = pages.select("kb_id", "page_id").join(members.withColumnsRenamed({"copy": "page_id", "id": "class_id"}), "page_id").join(
        exact.select("kb_id", "page_id"), ["kb_id", "page_id"], "left_anti")
    return exact.unionByName(nearest_in_turn(wanted, queues, vectors, threshold).withColumn("how", F.lit("vector")))


def match_titles(candidates: DataFrame, pages: DataFrame, scored: DataFrame, threshold: float = 0.85,
                 copies: DataFrame | None = None) -> DataFrame:
    """(kb_id, cand_id, page_id, how): equal titles first, then best remaining page in candidate order.

    ``candidates``: kb_id, cand_id, pos, title; ``pages``: kb_id, page_id, title; ``scored``:
    kb_id, cand_id, page_id, score of title vectors (pairs under the threshold cannot match
    and need not be given). A page is taken once. Among equal titles the first candidate
    and the first page pair up in order. With ``copies`` (kb_id, page_id, class_id), ``scored`` names
    classes of equally scored pages in place of pages, and a class gives its pages in order.
    """
    exact = equal_titles(candidates, pages)
    gone = exact.select("kb_id", "page_id")
    if copies is None:
        copies = scored.select("kb_id", "page_id", F.col("page_id").alias("class_id")).distinct()
    queues = copies.join(gone, ["kb_id", "page_id"], "left_anti")
    offers = scored.filter(F.col("score") >= threshold).join(exact.select("kb_id", "cand_id"), ["kb_id", "cand_id"], "left_anti").join(
        candidates.select("kb_id", "cand_id", "pos"), ["kb_id", "cand_id"]).select("kb_id", "pos", "cand_id", F.col("page_id").alias("class_id"), "score")
    return exact.unionByName(first_come(offers, queues).withColumn("how", F.lit("vector")))


#: Places in a queue, and positions of candidates, that are counted together.
STRETCH = 4096


def first_come(offers: DataFrame, queues: DataFrame) -> DataFrame:
    """(kb_id, cand_id, page_id): what each candidate takes when they choose one after the other by ``pos``.

    ``offers``: kb_id, pos, cand_id, class_id, score; ``queues``: kb_id, class_id, page_id. A candidate takes the best class with a
    page left, and of equally good classes the one whose next page comes first; a class gives its pages in order.

    All candidates choose at once, as if those before them would take what they took in the last round: a
    class has then given as many pages as it has takers of lower position. The first candidate's choice depends on nobody, the
    second's on the first's, so what no longer changes is the outcome of choosing in turn; chains of candidates
    who push each other away, not the candidates, make the rounds. Takers are counted in stretches of positions, and
    pages of a queue are met by their number, so no base or class is held by one task.
    """
    numbered = numbered_in_order(queues.select("kb_id", "class_id", "page_id"), ["kb_id", "class_id"], "page_id")
    queue = cut_lineage(numbered.select("kb_id", "class_id", "page_id", "n"))
    offers = cut_lineage(offers.withColumn("part", F.floor(F.col("pos") / STRETCH).cast("long")))
    taken, seen = offers.select("kb_id", "pos", "cand_id", "class_id").withColumn("page_id", F.lit(None)).filter("false"), None
    while True:
        both = offers.withColumn("took", F.lit(0)).unionByName(
            taken.select("kb_id", "pos", "cand_id", "class_id", F.lit(None).cast("double").alias("score"), F.floor(F.col("pos") / STRETCH).cast("long").alias("part"), F.lit(1).alias("took")))
        takers = both.groupBy("kb_id", "class_id", "part").agg(F.sum("took").alias("c"))
        before = takers.select("kb_id", "class_id", "part", F.coalesce(F.sum("c").over(W.partitionBy("kb_id", "class_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        inside = F.coalesce(F.sum("took").over(W.partitionBy("kb_id", "class_id", "part").orderBy("pos").rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
        reach = both.withColumn("inside", inside).filter("took = 0").join(before, ["kb_id", "class_id", "part"]).withColumn("n", (F.col("before") + F.col("inside")).cast("long"))
        choice = reach.join(queue, ["kb_id", "class_id", "n"]).groupBy("kb_id", "pos", "cand_id").agg(
            F.min(F.struct((-F.col("score")).alias("s"), "page_id", "class_id")).alias("x"))
        taken = cut_lineage(choice.select("kb_id", "pos", "cand_id", "x.class_id", "x.page_id"))
        now = taken.agg(F.count(F.lit(1)), F.sum(F.xxhash64("kb_id", "cand_id", "page_id").cast("decimal(20,0)"))).first()
        if now == seen:
            return taken.select("kb_id", "cand_id", "page_id")
        seen = now


def fact_retention(facts: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Retained share per page and in all (null page) from the best similarity per key fact.

    ``facts``: page_id, fact_id, best (null when the page has no sentence).
    """
    kept = F.coalesce(F.col("best") >= threshold, F.lit(False))
    return facts.rollup("page_id").agg(F.count(F.lit(1)).alias("facts"), F.count_if(kept).alias("retained"),
                                       F.round(F.avg(kept.cast("double")), 4).alias("rate"))
