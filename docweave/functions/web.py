"""Web sources: address forms, authority, freshness, result scores and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: authority of a source, first entry contained in the host
DOMAIN_AUTHORITY = [
    ("gov.cn", 0.95), ("gov.hk", 0.95), ("wikipedia.org", 0.9), ("zh.wikipedia.org", 0.9), ("baike.baidu.com", 0.85),
    ("news.sina.com.cn", 0.8), ("news.qq.com", 0.8), ("people.com.cn", 0.85), ("xinhuanet.com", 0.85), ("cctv.com", 0.8),
    ("sina.com.cn", 0.75), ("sohu.com", 0.75), ("163.com", 0.75), ("ifeng.com", 0.75), ("thepaper.cn", 0.8),
    ("github.com", 0.85), ("stackoverflow.com", 0.85), ("open-meteo.com", 0.9), ("gold.org", 0.9), ("lbma.org.uk", 0.95),
    ("sge.com.cn", 0.95), ("xaus.com", 0.85), ("goldapi.io", 0.85), ("frankfurter.app", 0.85),
    ("exchangerate-api.com", 0.85), ("investing.com", 0.75), ("xetra-gold.com", 0.8),
]
LOW_QUALITY_DOMAINS = [
    "youtube.com", "youtu.be", "bilibili.com", "tiktok.com", "twitter.com", "x.com", "facebook.com", "instagram.com",
    "weibo.com", "reddit.com", "pinterest.com", "taobao.com", "tmall.com", "jd.com", "amazon.com",
]
LOW_AUTHORITY, DEFAULT_AUTHORITY = 0.2, 0.5


def host(url: Column) -> Column:
    """Lower-cased authority part of an address."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def domain(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def normal_url(url: Column) -> Column:
    """Host without leading w and dot characters, plus the path without trailing slashes."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.concat(F.regexp_replace(host(url), r"^[w.]+", ""), F.regexp_replace(path, r"/+$", ""))


def content_hash(text: Column) -> Column:
    """md5 of the first 200 characters without white space."""
    head = F.substring(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r")), 1, 200)
    return F.md5(F.regexp_replace(head, r"(?U)\s+", ""))


def is_low_quality(url: Column) -> Column:
    where = host(url)
    out = F.lit(False)
    for d in LOW_QUALITY_DOMAINS:
        out = out | F.contains(where, F.lit(d))
    return out


def authority(url: Column) -> Column:
    where = host(url)
    out = F.lit(DEFAULT_AUTHORITY)
    for d, score in reversed(DOMAIN_AUTHORITY):
        out = F.when(F.contains(where, F.lit(d)), score).otherwise(out)
    return F.when(is_low_quality(url), LOW_AUTHORITY).otherwise(out)


RECENT = r"\d{2}:\d{2}|刚刚|几分钟前|小时前|今日|今天|当前|现在|实时"


def year_freshness(text: Column, year: int) -> Column:
    """Freshness by the latest year 2020-2039 named in the text; ``year`` is the current one."""
    text = F.coalesce(text, F.lit(""))
    latest = F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"(20[2-3]\d)"), F.lit(1)), lambda y: y.cast("int")))
    named = F.when(latest >= year, F.when(text.rlike(RECENT), 1.0).otherwise(0.85)).when(
        latest == year - 1, 0.7).when(latest >= year - 2, 0.4).otherwise(0.2)
    return F.when(text == "", 0.0).when(latest.isNull(), 0.5).otherwise(named)


def length_relevance(title: Column, text: Column) -> Column:
    n = F.length(F.coalesce(text, F.lit(""))) + F.length(F.coalesce(title, F.lit(""))) * 2
    return F.greatest(F.lit(0.3), F.least(F.lit(1.0), n / 1000.0))


def dedupe_results(results: DataFrame, group: list[str], pos: str) -> DataFrame:
    """First result of every address and of every opening text, in order of ``pos``.

    A row dropped for its text does not register its address, so the rule is followed
    in order: a row stays unless an earlier kept row shares its address or its text.
    Rows that are first in both are kept at once; chains among the rest are settled by
    repeating the same joins until nothing changes, two or three rounds in practice.
    """
    from docweave.session import cut_lineage

    open_rows = results.select(*group, pos, "_url", "_hash")
    kept = None
    while True:
        per_url = open_rows.groupBy(*group, "_url").agg(F.min_by("_hash", pos).alias("_hash"), F.min(pos).alias(pos))
        per_hash = open_rows.groupBy(*group, "_hash").agg(F.min(pos).alias(pos))
        now = cut_lineage(per_url.join(per_hash, [*group, "_hash", pos], "left_semi").select(*group, pos, "_url", "_hash"))
        kept = now if kept is None else kept.unionByName(now)
        rest = open_rows.join(now.select(*group, "_url"), [*group, "_url"], "left_anti").join(
            now.select(*group, "_hash"), [*group, "_hash"], "left_anti")
        open_rows = cut_lineage(rest)
        if open_rows.isEmpty():
            return results.join(kept.select(*group, pos), [*group, pos], "left_semi")


def score_results(results: DataFrame, year: int) -> DataFrame:
    """.3 authority + .3 freshness + .4 relevance. ``results``: url, title, content."""
    final = F.col("authority") * 0.3 + F.col("freshness") * 0.3 + F.col("relevance") * 0.4
    return results.withColumns({
        "domain": domain(F.col("url")), "authority": authority(F.col("url")),
        "freshness": year_freshness(F.col("content"), year), "relevance": length_relevance(F.col("title"), F.col("content")),
    }).withColumn("final_score", final)


DATA_MARK = r"[\d,]+\.?\d*\s*(元|美元|美金|￥|\$|€|£|%|万|亿|公斤|kg|吨|度|岁)"


def select_blocks(blocks: Column, most: int = 2) -> Column:
    """First two blocks; without a measured number in them, the first later block with one."""
    head = F.slice(blocks, 1, most)
    later = F.filter(F.when(F.size(blocks) > most, F.slice(blocks, most + 1, F.greatest(F.size(blocks) - most, F.lit(1)))
                            ).otherwise(F.array().cast("array<string>")), lambda b: b.rlike(DATA_MARK))
    extra = F.when(F.exists(head, lambda b: b.rlike(DATA_MARK)), F.array().cast("array<string>")).otherwise(F.slice(later, 1, 1))
    return F.array_join(F.concat(head, extra), "\n")
