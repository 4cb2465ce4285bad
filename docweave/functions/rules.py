"""Rule columns: classification, quality, safety, cleaning. Word lists are fixed values."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from docweave.functions.text import rows_of
from docweave.operators.sizing import broadcast_if_small

# fixed values: keywords of the document types, tried in this order: (type, domain, topic, words)
TYPE_RULES = [
    ("technical", "it", "技术开发", ["代码", "编程", "开发", "api", "function", "class", "method", "algorithm", "软件", "系统"]),
    ("business", "finance", "财务管理", ["财务", "报表", "预算", "投资", "利润", "收入", "成本", "审计"]),
    ("report", None, "数据分析", ["报告", "分析", "总结", "评估", "调研", "数据"]),
    ("manual", None, "使用指南", ["手册", "指南", "教程", "说明", "使用", "操作"]),
    ("policy", "government", "政策法规", ["政策", "规定", "通知", "公告", "条例", "办法"]),
    ("news", None, "新闻资讯", ["新闻", "消息", "报道", "发布", "动态"]),
]
# fixed values: a domain found here overrides the one of the type: (domain, topic, words)
DOMAIN_RULES = [
    ("healthcare", "医疗健康", ["医疗", "健康", "医院", "药品", "疾病", "诊断"]),
    ("education", "教育培训", ["教育", "学校", "学习", "培训", "课程", "学生"]),
    ("legal", "法律合规", ["法律", "法规", "合同", "诉讼", "权利", "义务"]),
    ("enterprise", "企业管理", ["管理", "企业", "公司", "组织", "战略", "运营"]),
]
# fixed values: single words that add a topic
TOPIC_WORDS = [("安全", "安全"), ("数据", "数据分析"), ("系统", "系统设计"), ("流程", "流程管理")]
DEFAULT_TOPIC = "综合内容"


def any_word(text: Column, words: list[str]) -> Column:
    """Any listed word occurs; plain substring tests beat one alternation by far."""
    out = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(text, F.lit(w))
    return out


def _first_rule(text: Column, lists: list[list[str]]) -> Column:
    """Place of the first word list with a hit, or the number of lists."""
    out = F.lit(len(lists))
    for i in range(len(lists) - 1, -1, -1):
        out = F.when(any_word(text, lists[i]), i).otherwise(out)
    return out


def classify_document(text: Column) -> Column:
    """struct(document_type, domain, topics): first matching type, then domain, at most five topics."""
    low = F.lower(F.coalesce(text, F.lit("")))
    # the place of the first matching rule is one expression, shared by all that is read from it
    first = _first_rule(low, [words for *_, words in TYPE_RULES])
    second = _first_rule(low, [words for *_, words in DOMAIN_RULES])
    pick = lambda values, at: F.get(F.array(*[F.lit(v).cast("string") for v in values]), at)
    kind = pick([r[0] for r in TYPE_RULES] + ["other"], first)
    domain = F.coalesce(pick([r[0] for r in DOMAIN_RULES] + [None], second), pick([r[1] or "other" for r in TYPE_RULES] + ["other"], first))
    topic = pick([r[2] for r in TYPE_RULES] + [None], first)
    second = pick([r[1] for r in DOMAIN_RULES] + [None], second)
    extra = [F.when(F.contains(low, F.lit(w)), F.lit(label)) for w, label in TOPIC_WORDS]
    topics = F.slice(F.array_compact(F.array(topic, second, *extra)), 1, 5)
    topics = F.when(F.size(topics) > 0, topics).otherwise(F.array(F.lit(DEFAULT_TOPIC)))
    return F.struct(kind.alias("document_type"), domain.alias("domain"), topics.alias("topics"))


# fixed values: grades by score
GRADES = [(90, "优秀"), (80, "良好"), (70, "中等"), (60, "及格")]
LOWEST_GRADE = "需改进"


def grade(score: Column) -> Column:
    out = F.lit(LOWEST_GRADE)
    for least, name in reversed(GRADES):
        out = F.when(score >= least, name).otherwise(out)
    return out


def quality_of(text: Column) -> dict[str, Column]:
    """completeness, readability, structure, relevance, overall_score, grade, comments, suggestions."""
    text = F.coalesce(text, F.lit(""))
    n = F.length(text)
    kept = lambda sep: F.filter(F.transform(F.split(text, sep), lambda s: F.btrim(s, F.lit(" \t\n\r"))), lambda s: s != "")
    sents, paras = kept("。"), F.size(kept("\n\n"))
    mean = F.when(F.size(sents) > 0, F.aggregate(sents, F.lit(0), lambda a, s: a + F.length(s)) / F.size(sents)).otherwise(F.lit(0.0))
    pick = lambda *cases: _cases(cases)
    completeness = pick((n < 100, 20), (n < 500, 50), (n < 2000, 75), (None, 90))
    readability = pick((mean < 10, 40), (mean > 100, 50), (None, 85))
    headed = text.rlike(r"\n# |\n## |\n### |一、|二、|1\.|2\.")
    structure = pick((paras < 3, 40), (paras < 5, 60), (None, F.least(F.lit(80), paras * 5))) + F.when(headed, 10).otherwise(0)
    overall = (completeness + readability + structure + 80) / 4
    suggestions = F.array_compact(F.array(
        F.when(completeness < 60, "建议增加文档内容，使信息更加完整"),
        F.when(readability < 60, "建议优化句子结构，提高文档可读性"),
        F.when(structure < 60, "建议增加段落和标题，改善文档结构")))
    return {
        "completeness": completeness.cast("double"), "readability": readability.cast("double"),
        "structure": structure.cast("double"), "relevance": F.lit(80.0), "overall_score": F.round(overall, 1),
        "overall_grade": grade(overall),
        "completeness_comment": pick((n < 100, "内容过于简短"), (n < 500, "内容较为简短"), (n < 2000, "内容基本完整"), (None, "内容丰富完整")),
        "readability_comment": pick((mean < 10, "句子过短，可能影响可读性"), (mean > 100, "句子过长，建议拆分"), (None, "句子长度适中，可读性良好")),
        "structure_comment": pick((headed, "段落结构合理，包含标题层级"), (paras < 3, "段落结构较少，建议增加分段"),
                                  (paras < 5, "段落结构一般"), (None, "段落结构合理")),
        "suggestions": F.when(F.size(suggestions) > 0, suggestions).otherwise(F.array(F.lit("文档质量良好，继续保持"))),
    }


def _cases(cases) -> Column:
    out = None
    for cond, value in reversed(cases):
        value = value if isinstance(value, Column) else F.lit(value)
        out = value if cond is None else F.when(cond, value).otherwise(out)
    return out


# fixed values: secrets, in the order they are replaced
SECRET_RULES = [
    ("private_key", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----"),
    ("openai_key", r"\bsk-[A-Za-z0-9_\-]{16,}\b"),
    ("aws_key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("db_credentials", r"(?i)postgres(?:ql)?://[^\s:@/]+:[^\s@/]+@"),
    ("bearer_token", r"\bBearer\s+[A-Za-z0-9._\-]{20,}\b"),
    ("system_prompt_leak", r"你是一个严谨的智能助手[，,]\s*可以调用工具来回答用户问题"),
]
REDACTION = "[已屏蔽敏感内容]"


def redact(text: Column, mask: str = REDACTION) -> tuple[Column, Column]:
    """(redacted text, names of the rules that fired), rules applied one after another."""
    out = F.coalesce(text, F.lit(""))
    hits = []
    for name, pattern in SECRET_RULES:
        hits.append(F.when(out.rlike(pattern), F.lit(name)))
        out = F.regexp_replace(out, pattern, mask)
    return out, F.array_compact(F.array(*hits))


# fixed values: injection rules on NFKC text, first match wins
INJECTION_RULES = [
    ("ignore_instructions", r"(忽略|无视|忘记|忘掉|抛弃|跳过)[^。！？\n]{0,20}(指令|提示|规则|要求|设定|限制|指示)"),
    ("system_prompt_extraction", r"(?i)(泄露|透露|输出|展示|打印|重复|告诉我)[^。！？\n]{0,20}(系统提示|系统指令|提示词|system\s*prompt)"),
    ("jailbreak_mode", r"(?i)(开发者模式|调试模式|越狱模式|越狱|jailbreak|developer\s*mode)"),
    ("role_override", r"(从现在起|现在开始|接下来)[^。！？\n]{0,12}(你是|你扮演|扮演)"),
    ("ignore_instructions_en", r"(?i)(ignore|disregard|forget|override)\s+(all\s+|any\s+)?(previous|above|prior|earlier|system)\s+(instructions?|prompts?|rules?)"),
    ("system_prompt_extraction_en", r"(?i)(reveal|show|print|repeat|output)\s+(your\s+|the\s+)?(system\s*prompt|system\s*instructions?|hidden\s*prompt)"),
]
# fixed values: weaker signals in retrieved texts, numbered in order
CONTEXT_SIGNALS = [
    r"(?i)(忽略|无视|忘记|跳过)[^。！？\n]{0,20}(指令|提示|规则|要求|限制)",
    r"(?i)(ignore|disregard|forget|override)\s+(all\s+|any\s+)?(previous|above|prior|system)\s+(instructions?|prompts?|rules?)",
    r"(?i)(system\s*prompt|系统提示|系统指令|开发者模式|jailbreak|越狱)",
    r"(?i)(fetch_webpage|web_search|kb_search|wiki_lookup)\s*\(",
    r"(?i)(下一步操作|调用工具|tool_call|<tool_call>)",
    r"(?i)https?://[^\s\"'<>]{1,500}\?(?:[^\s\"'<>]*[=&][^\s\"'<>]*)",
]
CONTROL_LIMIT = 20


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFKC", s) if s is not None and not s.isascii() else s)


def input_rule(text: Column, max_chars: int = 4000) -> Column:
    """Name of the first input rule that fires on already normalised text, else null."""
    text = F.coalesce(text, F.lit(""))
    controls = F.length(text) - F.length(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))
    out = F.lit(None).cast("string")
    for name, pattern in reversed(INJECTION_RULES):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    out = F.when(controls >= CONTROL_LIMIT, "control_char_flood").otherwise(out)
    out = F.when(text.rlike(r"\x00"), "null_byte").otherwise(out)
    out = F.when(F.length(text) > max_chars, "input_too_long").otherwise(out)
    return F.when(F.trim(text) == "", F.lit(None).cast("string")).otherwise(out)


def context_signals(text: Column) -> Column:
    """Names signal_1 ... signal_6 of the signals found in a retrieved text."""
    return F.array_compact(F.array(*[F.when(F.coalesce(text, F.lit("")).rlike(p), F.lit(f"signal_{i}"))
                                     for i, p in enumerate(CONTEXT_SIGNALS, 1)]))


def wrap_untrusted(text: Column, source: Column) -> Column:
    """Text between isolation marks; marks inside the text are defused."""
    name = F.substring(F.regexp_replace(F.coalesce(source, F.lit("retrieved")), r"[^a-zA-Z0-9_\-:. ]", ""), 1, 64)
    body = F.replace(text, F.lit("<<<END_UNTRUSTED_CONTEXT>>>"), F.lit("<<<END_UNTRUSTED_CONTEXT_ESCAPED>>>"))
    wrapped = F.concat(F.lit('<<<UNTRUSTED_CONTEXT source="'), name, F.lit('">>>\n'), body, F.lit("\n<<<END_UNTRUSTED_CONTEXT>>>"))
    return F.when(text == "", text).otherwise(wrapped)


#: Words of a lexicon that are searched by one pattern; a longer lexicon meets the texts' windows in a join.
PATTERN_WORDS = 20_000


def lexicon_findings(docs: DataFrame, key: str, text_col: str, lexicon: DataFrame) -> DataFrame:
    """(key, word, category, position, n): every listed word found in every text, at every start position.

    The lexicon is a table (word, category, position). A short one is an alternation of patterns
    whose hits are joined back to the table; the windows of a longer one's word lengths are joined with it.
    """
    listed = lexicon.select("word").filter("word != ''").distinct()
    words = [r[0] for r in listed.limit(PATTERN_WORDS + 1).collect()]
    if len(words) > PATTERN_WORDS:
        found = text_windows(docs, key, text_col, listed).withColumnRenamed("window", "word").join(broadcast_if_small(listed), "word", "left_semi")
    else:
        hits = F.array().cast("array<string>")
        for size in sorted({len(w) for w in words}):
            part = "|".join(re.escape(w) for w in sorted(w for w in words if len(w) == size))
            hits = F.concat(hits, F.regexp_extract_all(F.col(text_col), F.lit(f"(?=({part}))"), F.lit(1)))
        found = docs.select(key, rows_of(hits).alias("word")).filter(F.col("word").isNotNull())
    rows = found.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(broadcast_if_small(lexicon), "word").select(key, "word", "category", "position", "n")


def text_windows(docs: DataFrame, key: str, text_col: str, words: DataFrame, column: str = "word") -> DataFrame:
    """(key, window): all substrings of each text that are as long as some word (one row of lengths on the driver).

    Texts are cut into overlapping stretches first, so that a long text costs its length.
    """
    sizes = [r[0] for r in words.select(F.length(column).alias("n")).filter("n > 0").distinct().collect()]
    stretch, text = 1000, F.col(text_col)
    sized = docs.select(key, text.alias("_t"), F.explode(F.array(*[F.lit(n) for n in sizes]).cast("array<int>")).alias("_n")).filter(F.length("_t") >= F.col("_n"))
    starts = F.sequence(F.lit(1), F.length("_t") - F.col("_n") + 1, F.lit(stretch))
    cut = sized.select(key, "_n", F.explode(F.transform(starts, lambda i: F.substr(F.col("_t"), i, F.lit(stretch - 1) + F.col("_n")))).alias("_t"))
    every = F.sequence(F.lit(1), F.length("_t") - F.col("_n") + 1)
    return cut.select(key, F.explode(F.transform(every, lambda i: F.substr(F.col("_t"), i, F.col("_n")))).alias("window"))


def first_finding(findings: DataFrame, key: str) -> DataFrame:
    """The listed word that comes first in the lexicon, per text."""
    return findings.groupBy(key).agg(F.min_by(F.struct("word", "category"), "position").alias("f")).select(
        key, "f.word", "f.category")


def mask_words(text: Column, words: list[str]) -> Column:
    """Each word, in list order, replaced by stars of its length."""
    for w in words:
        text = F.replace(text, F.lit(w), F.lit("*" * len(w)))
    return text


# fixed values: traces of tool calls and of narrated steps in an answer
TOOL_CALL = [
    r'(?i)\[\s*\{\s*"name"\s*:\s*"\w+"', r'(?i)\{\s*"name"\s*:\s*"\w+"', r'(?i)"tool"\s*:\s*"\w+"',
    r'(?i)"arguments"\s*:\s*\{\s*"', r"(?i)<tool_call>\s*\[", r"(?i)<tool_call>\s*\{", r"(?i)<RichMediaReference>",
]
NARRATION = [r"^\s*第\s*\d+\s*步", r"^\s*观察结果\s*[：:]", r"^\s*下一步操作\s*[：:]", r"^\s*调用\s*\w+\s*\(", r"调用\s*\w+\s*\(\s*\{"]
# fixed values: openings that are cut off an answer, in order
ANSWER_PREFIXES = ["根据搜索结果", "根据参考信息", "根据提供的参考信息", "资料显示", "数据显示", "经查询", "我查询到", "我认为",
                   "在我看来", "根据以上信息", "综上所述", "结合参考信息", "结合以上信息"]


def _any(text: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out


def clean_answer_text(text: Column) -> tuple[Column, Column]:
    """(clean text, polluted): thoughts, tool calls and narration removed, opening phrases cut."""
    raw = F.coalesce(text, F.lit(""))
    narrated = F.exists(F.split(raw, "\n"), lambda line: _any(line, NARRATION))
    polluted = _any(raw, TOOL_CALL) | narrated
    out = F.regexp_replace(raw, r"(?is)<think>.*?</think>", "")
    out = F.regexp_replace(out, r"(?is)<thinking>.*?</thinking>", "")
    out = F.trim(F.regexp_replace(out, r"(?i)</think>", ""))
    whole = F.btrim(out, F.lit(" \t\n\r"))
    names = F.from_json(whole, "array<struct<name:string>>")
    single = F.get_json_object(whole, "$.name").isNotNull() & F.get_json_object(whole, "$.arguments").isNotNull()
    many = whole.startswith("[") & whole.endswith("]") & names.isNotNull() & F.forall(names, lambda n: n["name"].isNotNull())
    call = (whole.startswith("{") & whole.endswith("}") & single) | F.coalesce(many, F.lit(False))
    block = r"(?is)```json\s*((?:(?!```).)*?)\s*```"
    tool_block = r'(?is)```json\s*(?:(?!```).)*?(?:\{\s*"name"\s*:\s*"\w+"|"tool"\s*:\s*"\w+"|"arguments"\s*:\s*\{\s*")(?:(?!```).)*?```'
    out = F.regexp_replace(F.regexp_replace(out, tool_block, ""), block, "$1")
    out = F.regexp_replace(out, r"(?is)<tool_call>.*?</tool_call>", "")
    lines = F.filter(F.split(out, r"(?<=\n)"), lambda line: ~_any(F.rtrim(line), TOOL_CALL) & ~_any(line, NARRATION))
    out = F.btrim(F.array_join(lines, ""), F.lit(" \t\n\r"))
    for p in ANSWER_PREFIXES:
        out = F.regexp_replace(out, f"^{p}[，：:；]?\\s*", "")
    return F.when(call, "").otherwise(F.btrim(out, F.lit(" \t\n\r"))), polluted | call


# fixed values: words in a complaint that set category and severity; a later rule overrides an earlier one
COMPLAINT_RULES = [
    ("hallucination", 5, ["编造", "没有提到", "不存在", "臆测", "胡说", "虚构"]),
    ("incomplete_answer", 3, ["不完整", "不够详细", "漏了", "缺少", "太简单"]),
    ("wrong_answer", 4, ["错误", "不对", "不准确", "不符"]),
]


def classify_complaint(reason: Column, answer: Column, has_sources: Column, feedback_type: Column) -> Column:
    """struct(category, severity 1-5) of a negative rating."""
    low = F.lower(F.coalesce(reason, F.lit("")))
    category = severity = None
    missed = ~has_sources | any_word(low, ["检索", "找不到", "没提到"])
    bad = F.lower(feedback_type).isin("negative", "dislike", "差评")
    brief = bad & (F.coalesce(answer, F.lit("")) != "") & (F.length(F.coalesce(answer, F.lit(""))) < 50)
    category = F.when(missed, "retrieval_failure").when(brief, "incomplete_answer").otherwise("other")
    severity = F.when(~has_sources, 4).when(missed, 3).otherwise(2)
    for name, level, words in COMPLAINT_RULES:
        hit = any_word(low, words)
        category = F.when(hit, name).otherwise(category)
        severity = F.when(hit, level).otherwise(severity)
    return F.struct(category.alias("category"), severity.alias("severity"))


def is_toc_chunk(text: Column) -> Column:
    """Table of contents: at least three numbered lines that link to an anchor."""
    return F.size(F.filter(F.split(text, "\n"), lambda s: s.rlike(r"^\s*\d+\.\s*\[[^\]]+\]\(#"))) >= 3


def is_document_lead(text: Column, heading_path: Column) -> Column:
    """Opening chunk: no nested heading, at most 400 characters, no table or list line."""
    listed = F.exists(F.split(text, "\n"), lambda s: s.rlike(r"^\s*(\||- |\* )"))
    return ~F.contains(F.coalesce(heading_path, F.lit("")), F.lit(" > ")) & (F.length(text) <= 400) & ~listed
