"""Question rules: class flags, gates, tools, rewriting, history. Word lists are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docweave.functions.rules import any_word

# fixed values: words of the question classes
GREETING = (r"(?i)^(你好|您好|嗨|哈喽|hello|hi|hey|在吗|在\?|有人吗|早上好|中午好|晚上好|晚安|再见|拜拜|bye)\s*[.!?！？]*\s*$"
            r"|^(请?问?)?\s*(你是谁|你能做什么|介绍一下自己|自我介绍一下|你好啊|您好啊)\s*[.!?！？]*\s*$")
REALTIME = [
    "天气", "气温", "温度", "预报", "下雨", "下雪", "降雨", "降雪", "台风", "空气质量", "pm2.5", "aqi", "weather", "forecast",
    "temperature", "新闻", "最新消息", "近日", "今天", "刚刚", "刚才", "热点", "news", "latest news", "价格", "多少钱", "股价", "股票",
    "基金", "汇率", "油价", "金价", "比特币", "加密货币", "price", "stock price", "exchange rate", "实时", "现在", "当前", "目前",
    "latest", "today", "now", "current", "比分", "赛果", "排名", "排行榜", "score", "ranking",
]
CALCULATE = ["计算", "等于", "换算"]
OPERATORS = ["+", "-", "*", "×", "÷", "/", "%"]
RESEARCH = ["对比", "比较", "分析", "总结", "综合", "调研", "研究", "有哪些", "排名", "推荐", "优缺点", "区别"]
STRONG_RESEARCH = ["对比", "比较", "调研", "总结", "优缺点", "区别"]
AGENT_RESEARCH = ["对比", "比较", "分析", "总结", "调研", "研究", "优缺点", "区别"]
BASE_PREFERRED = ["文档", "文件", "资料", "规定", "制度", "流程", "手册", "指南", "第几条", "根据", "按照", "依据"]
PRICE = ["金价", "黄金价格", "白银价格", "银价", "铂金价格", "钯金价格", "黄金", "白银", "铂金", "钯金", "贵金属"]
EXCHANGE = ["汇率", "兑换", "换算", "外汇", "美元兑人民币", "美元等于多少人民币", "美元换人民币", "欧元兑人民币", "日元兑人民币",
            "港币兑人民币", "人民币兑美元"]
EXCHANGE_FORM = r"(?i)\d*\s*[a-zA-Z]{3}\s*(?:to|兑|兑换|换算成|等于|换|转)\s*[a-zA-Z]{3}"
COMPLEX = ["对比", "分析", "总结", "综合", "调研", "研究", "最新进展", "优缺点", "区别", "排行榜", "评测"]
TEMPLATE = ["今天", "今日", "现在", "当前", "实时", "最新", "最近", "价格", "多少钱", "金价", "银价", "油价", "股价", "汇率", "天气", "气温",
            "温度", "预报"]
PRONOUN_FORM = r"它|这个|那个|这|那|其|此|该|上面|刚才"
SEVERAL_FORM = r"(.+?)\s*(?:和|与|vs|VS|对比|比较)\s*(.+)"
SHORT_QUESTION = 15


def question_flags(question: Column, has_history: Column) -> dict[str, Column]:
    """Boolean columns per class, the search path, and whether rules contradict each other."""
    q = F.coalesce(question, F.lit(""))
    low = F.lower(q)
    realtime = any_word(F.replace(low, F.lit("对比"), F.lit("")), REALTIME)
    calc = q.rlike("[0-9０-９]") & (any_word(q, OPERATORS) | any_word(q, CALCULATE))
    research, base = any_word(q, RESEARCH), any_word(q, BASE_PREFERRED)
    several = realtime.cast("int") + calc.cast("int") + base.cast("int")
    full = any_word(q, COMPLEX) | q.rlike(SEVERAL_FORM) | (has_history & q.rlike(PRONOUN_FORM))
    fast = any_word(q, TEMPLATE) | (F.length(q) < SHORT_QUESTION)
    return {
        "greeting": F.trim(q).rlike(GREETING), "realtime": realtime, "calculation": calc, "research": research, "kb_preferred": base,
        "price": any_word(low, PRICE), "exchange": low.rlike(EXCHANGE_FORM) | any_word(low, EXCHANGE),
        "search_path": F.when(q == "", "fast").when(full, "full").when(fast, "fast").otherwise("full"),
        "conflict": (realtime & any_word(q, STRONG_RESEARCH)) | (several >= 2) | (base & research),
    }


def gate_decision(drafts: DataFrame, threshold: float = 0.4, gap: float = 0.15) -> DataFrame:
    """Final mode, fallback and clarify flag of routed questions.

    ``drafts``: query_id, question, primary_mode, fallback, needs_clarify, scores map with
    needs_kb, needs_web, needs_realtime, needs_tool; has_kb, use_web, search_mode.
    """
    score = lambda k: F.coalesce(F.element_at("scores", k), F.lit(0.0))
    values = F.reverse(F.array_sort(F.map_values("scores")))
    top, second = F.coalesce(F.get(values, 0), F.lit(0.0)), F.get(values, 1)
    weak = top < threshold
    kb0, web0, now, tool = (score(k) >= threshold for k in ("needs_kb", "needs_web", "needs_realtime", "needs_tool"))
    kb = kb0 & F.col("has_kb")
    web = web0 | (kb0 & ~F.col("has_kb"))
    clarify = F.col("needs_clarify") | (F.when(second.isNull(), 1.0).otherwise(top - second) < gap)
    mode = (F.when(tool & ~kb & ~web, "tool_first").when(web & kb, "hybrid").when(web, "web_search").when(kb, "kb_only")
            .when(~tool, "direct_llm").otherwise(F.col("primary_mode")))
    deep = F.col("search_mode").isin("function_calling", "agent") & any_word(F.col("question"), AGENT_RESEARCH)
    mode = F.when(mode.isin("web_search", "hybrid") & deep, "agent_research").otherwise(mode)
    drafted = F.when(now & ~F.col("use_web"), "tell_failure").otherwise(F.col("fallback"))
    chosen = (F.when(F.col("_mode").isin("web_search", "hybrid", "agent_research"), F.when(now, "tell_failure").otherwise("web_search"))
              .when(F.col("_mode").isin("kb_only", "tool_first"), "llm_direct").otherwise(F.col("_draft")))
    rows = drafts.withColumns({"_mode": mode, "_draft": drafted, "_weak": weak, "_clarify": clarify, "_kb": kb, "_web": web})
    return rows.withColumn("_fb", F.when(F.col("_draft") == "none", chosen).otherwise(F.col("_draft"))).select(
        "query_id", F.when(F.col("_weak"), "direct_llm").otherwise(F.col("_mode")).alias("primary_mode"),
        F.when(F.col("_weak"), "none").otherwise(F.col("_fb")).alias("fallback"),
        (~F.col("_weak") & F.col("_clarify")).alias("needs_clarify"), (~F.col("_weak") & F.col("_kb")).alias("needs_kb"),
        (~F.col("_weak") & F.col("_web")).alias("needs_web"))


# fixed values: tools with trigger words and priority
TOOLS = [
    ("get_current_time", 10, ["时间", "几点", "几号", "星期几", "日期", "今天", "现在", "time", "date", "what time", "what day"]),
    ("weather_query", 9, ["天气", "气温", "温度", "下雨", "下雪", "空气质量", "预报", "weather", "temperature", "forecast", "rain", "snow"]),
    ("gold_price", 9, ["金价", "黄金价格", "银价", "白银价格", "铂金价格", "钯金价格", "贵金属", "gold price", "silver price"]),
    ("exchange_rate", 9, ["汇率", "兑换", "换算", "美元兑人民币", "人民币兑美元", "exchange rate", "convert", "currency"]),
    ("calculator", 8, ["计算", "等于", "+", "-", "*", "×", "÷", "/", "%", "平方", "开方", "calculate", "compute", "sum", "sqrt"]),
    ("web_search", 5, ["搜索", "查一下", "最新", "新闻", "资料", "信息", "search", "google", "bing", "lookup"]),
    ("fetch_webpage", 4, ["网页", "链接", "url", "打开", "抓取", "fetch", "webpage", "url content"]),
]


def matched_tools(question: Column) -> Column:
    """Names of the tools a trigger word of which occurs, by falling priority."""
    low = F.lower(F.coalesce(question, F.lit("")))
    order = sorted(range(len(TOOLS)), key=lambda i: -TOOLS[i][1])
    return F.array_compact(F.array(*[F.when(any_word(low, TOOLS[i][2]), F.lit(TOOLS[i][0])) for i in order]))


def resolved_tools(tools: Column, top_complete: Column) -> Column:
    """The first tool when its entities are all there, else the first two."""
    return F.when(top_complete, F.slice(tools, 1, 1)).otherwise(F.slice(tools, 1, 2))


# fixed values: words of the keyword strategy
EXACT_GREETINGS = ["你好", "您好", "hi", "hello", "嗨", "在吗", "你是谁", "介绍一下", "你能做什么", "谢谢", "再见", "拜拜", "早上好", "下午好",
                   "晚上好", "晚安", "早安", "很高兴认识你", "初次见面", "久仰大名"]
KNOWLEDGE_WORDS = ["根据", "依据", "参考", "查阅", "查找", "文档", "资料", "文件", "报告", "数据", "内容", "信息", "知识", "了解", "知道", "什么是",
                   "什么叫", "定义", "解释", "说明", "如何", "怎么", "怎样", "方法", "步骤", "为什么", "原因", "理由", "原理", "机制"]
CLOSED_FORMS = [
    r"^(嗨|嘿|哈喽|hi|hello|hey)\s*[!。，]?$", r"^(在吗|在不在|有人吗|有人在线吗)\s*[?？]?$", r"^(谢谢|感谢|多谢|辛苦了)\s*[!。]?$",
    r"^(再见|拜拜|告辞|下次见|回见)\s*[!。]?$", r"^(你是谁|你叫什么|你的名字|介绍一下你自己)\s*[?？]?$",
    r"^(你能做什么|你会什么|你的功能|有什么用)\s*[?？]?$", r"^(早上好|上午好|中午好|下午好|晚上好|晚安|早安)\s*[!。]?$",
    r"^(好的|知道了|明白了|收到|ok)\s*[!。]?$", r"^(是的|对|没错|正确|准确)\s*[!。]?$", r"^(不是|不对|错误|不正确)\s*[!。]?$",
]


def words_present(text: Column, words: list[str]) -> Column:
    """How many of the listed words occur."""
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words[1:]), F.contains(text, F.lit(words[0])).cast("int"))


def keyword_strategy(question: Column) -> Column:
    """struct(result, confidence): greetings say no, knowledge words yes."""
    low = F.lower(F.btrim(F.coalesce(question, F.lit("")), F.lit(" \t\n\r")))
    closed = F.lit(False)
    for form in CLOSED_FORMS:
        closed = closed | low.rlike(form)
    n = words_present(low, KNOWLEDGE_WORDS)
    greet = any_word(low, EXACT_GREETINGS)
    conf = F.when(closed, 0.95).when(greet, 0.9).when(n >= 2, F.least(0.8 + n * 0.05, F.lit(0.95))).when(n == 1, 0.6).otherwise(0.3)
    return F.struct((~closed & ~greet & (n >= 1)).alias("result"), conf.alias("confidence"))


def context_strategy(turns: DataFrame, questions: DataFrame, knowledge: list[str] = KNOWLEDGE_WORDS,
                     greetings: list[str] = EXACT_GREETINGS) -> DataFrame:
    """(session_id, result, confidence) from the last three messages and the question.

    ``turns``: session_id, turn, role, text; ``questions``: session_id, question.
    """
    w = W.partitionBy("session_id").orderBy(F.col("turn").desc())
    low = F.lower(F.coalesce("text", F.lit("")))
    k, g = words_present(low, knowledge), words_present(low, greetings)
    user, bot = F.col("role") == "user", F.col("role") == "assistant"
    part = turns.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= 3).select(
        "session_id", (F.when(user, k * 0.25 - g * 0.2).when(bot, k * 0.15).otherwise(0.0)).alias("s"),
        (F.when(user, (k > 0).cast("int") * 0.25 + (g > 0).cast("int") * 0.2).when(bot, (k > 0).cast("int") * 0.15).otherwise(0.0)).alias("w"))
    past = part.groupBy("session_id").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))
    q = F.lower(F.btrim("question", F.lit(" \t\n\r")))
    kq, gq = words_present(q, knowledge), words_present(q, greetings)
    rows = questions.join(past, "session_id", "left").select(
        "session_id", kq.alias("kq"),
        ((F.coalesce("s", F.lit(0.0)) + kq * 0.3 - gq * 0.25) / (F.coalesce("w", F.lit(0.0)) + 0.3 + F.when(gq > 0, 0.25).otherwise(0.0))).alias("x"))
    x = F.col("x")
    conf = F.when(x > 0.1, F.least(0.7 + x * 0.3, F.lit(0.95))).when(x < -0.1, F.least(0.7 + (1 + x) * 0.3, F.lit(0.95))).otherwise(0.5 + x * 0.5)
    return rows.select("session_id", F.when(x > 0.1, True).when(x < -0.1, False).otherwise(F.col("kq") > 0).alias("result"), conf.alias("confidence"))


# fixed values: words, templates and synonyms of the rewriting rules, tried in this order
STOP_WORDS = ["的", "了", "在", "是", "我", "你", "他", "她", "它", "们", "这", "那", "哪", "什么", "怎么", "为什么", "如何", "请", "一下", "能否", "可以",
              "告诉", "帮忙", "呢", "吗", "吧", "啊", "the", "a", "an", "is", "are", "was", "were", "be", "been", "have", "has", "had", "do", "does",
              "did", "will", "would", "could", "should", "may", "might", "can", "shall"]
TIME_WORDS = ["今天", "今日", "现在", "当前", "实时", "最新", "最近"]
PRICE_WORDS = ["价格", "多少钱", "金价", "银价", "油价", "股价", "汇率"]
EVENT_WORDS = ["最新", "最近", "新闻", "进展", "动态"]
PRICE_ENTITIES = [("金价", "黄金"), ("黄金", "黄金"), ("银价", "白银"), ("白银", "白银"), ("油价", "石油"), ("石油", "石油"), ("股价", "股票"),
                  ("股票", "股票"), ("汇率", "汇率")]
TEMPLATES = [
    ("definition", ["是什么", "什么是", "定义", "概念", "含义", "意思", "介绍"], ["定义", "维基百科", "介绍"]),
    ("troubleshooting", ["报错", "错误", "异常", "失败", "无法", "不能", "bug", "exception", "error", "debug", "调试"], ["报错 解决方案", "stackoverflow", "排查"]),
    ("how_to", ["怎么", "如何", "怎样", "教程", "学习", "入门", "使用", "配置", "安装", "部署"], ["教程", "入门指南", "官方文档"]),
    ("code", ["代码", "code", "示例", "demo", "实现", "函数", "库", "package", "github"], ["代码示例", "github", "implementation"]),
    ("location", ["哪里", "在哪", "位置", "地址", "路线", "距离", "附近"], ["地址", "位置", "怎么去"]),
    ("person", ["是谁", "什么人", "生平", "简介", "经历", "成就"], ["简介", "生平", "wikipedia"]),
    ("product", ["评测", "推荐", "对比", "怎么样", "好用吗", "值得买"], ["评测", "用户评价", "推荐"]),
]
DEFINITION_CUTS = ["是什么", "什么是", "的定义", "的意思", "的含义"]
SYNONYMS = [
    ("ai", ["人工智能", "artificial intelligence"]), ("人工智能", ["AI", "artificial intelligence"]),
    ("llm", ["大模型", "大语言模型", "large language model"]), ("大模型", ["LLM", "large language model"]),
    ("rag", ["检索增强生成", "retrieval augmented generation"]), ("gpu", ["显卡", "图形处理器"]), ("cpu", ["处理器", "中央处理器"]),
]


def core_terms(text: Column) -> Column:
    """Runs of two or more CJK characters and latin words, without stop words."""
    found = F.regexp_extract_all(text, F.lit(r"([\x{4E00}-\x{9FFF}]{2,}|[a-zA-Z0-9]+)"), F.lit(1))
    return F.array_join(F.filter(found, lambda t: (F.length(t) > 1) & ~F.lower(t).isin(STOP_WORDS)), " ")


def rewrite_queries(question: Column, today: str, most: int = 5, places: list[str] | None = None) -> Column:
    """Search queries of a question: itself, template queries, synonyms; equal ones once.

    ``today`` is a date like 2024-01-31. ``places`` are the names of cities that a weather
    question may ask for; the longest name in the question counts, and without one there is no template.
    """
    q = F.btrim(F.coalesce(question, F.lit("")), F.lit(" \t\n\r"))
    low = F.lower(q)
    entity = F.lit("黄金")
    for key, name in reversed(PRICE_ENTITIES):
        entity = F.when(F.contains(q, F.lit(key)), name).otherwise(entity)
    none = F.array().cast("array<string>")
    year = today[:4]
    price = F.array(F.concat(F.lit(f"{today} "), entity, F.lit(" 价格 人民币")), F.concat(F.lit("今日"), entity, F.lit(" 实时价格")))
    a = F.substring(F.trim(F.regexp_extract(q, SEVERAL_FORM, 1)), 1, 20)
    b = F.substring(F.trim(F.regexp_extract(q, SEVERAL_FORM, 2)), 1, 20)
    versus = F.array(F.concat(a, F.lit(" 评测")), F.concat(b, F.lit(" 评测")), F.concat(a, F.lit(" vs "), b))
    blank = F.array_join(F.filter(F.split(q, r"\s+"), lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS)), " ")
    event = F.when(blank != "", F.array(F.concat(blank, F.lit(f" 最新进展 {year}")), F.concat(blank, F.lit(f" 新闻 {year}")))).otherwise(none)
    rule = none
    for name, words, tails in reversed(TEMPLATES):
        text = q
        if name == "definition":
            for cut in DEFINITION_CUTS:
                text = F.replace(text, F.lit(cut), F.lit(""))
        core = core_terms(text)
        made = F.when(core != "", F.array(*[F.concat(core, F.lit(f" {tail}")) for tail in tails])).otherwise(none)
        rule = F.when(any_word(low, words), made).otherwise(rule)
    weather = any_word(low, ["天气", "气温", "温度", "预报", "下雨", "空气质量"])
    named = [F.when(F.contains(q, F.lit(p)), F.lit(p)) for p in sorted(places or [], key=lambda p: (-len(p), p)) if p]
    place = F.coalesce(*named) if named else F.lit(None).cast("string")
    forecast = F.when(place.isNotNull(), F.array(F.concat(place, F.lit(" 今天 天气预报 实时温度")), F.concat(place, F.lit(" weather today")))).otherwise(none)
    rule = F.when(any_word(low, TIME_WORDS) & any_word(low, PRICE_WORDS), price).when(weather, forecast).when(q.rlike(SEVERAL_FORM), versus).when(
        any_word(low, EVENT_WORDS), event).otherwise(rule)
    more = F.flatten(F.array(*[F.when(F.contains(low, F.lit(k)), F.array(*[F.replace(low, F.lit(k), F.lit(w)) for w in ws])).otherwise(none)
                               for k, ws in SYNONYMS]))
    return F.slice(distinct_queries(F.concat(F.array(q), rule, more)), 1, most)


def query_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}_]", ""))


def distinct_queries(queries: Column) -> Column:
    """First of every normalised key, in order; empty keys are dropped."""
    keyed = F.transform(queries, lambda x, i: F.struct(query_key(x).alias("k"), i.alias("i"), x.alias("x")))
    firsts = F.filter(keyed, lambda e: e["k"] != "")
    return F.transform(F.aggregate(firsts, F.filter(firsts, lambda e: F.lit(False)), lambda acc, e: F.when(
        F.exists(acc, lambda o: o["k"] == e["k"]), acc).otherwise(F.concat(acc, F.array(e)))), lambda e: e["x"])


def clean_search_query(question: Column, code_words: list[str]) -> Column:
    """Search words without stop words and one-character tokens; code keeps its symbols."""
    code = any_word(F.lower(question), code_words) | question.rlike(r"[a-zA-Z_][\w\-.]*\.[a-zA-Z_][\w\-.]*")
    keep = F.when(code, F.regexp_replace(question, r"[^\p{L}\p{N}_\s\-.+#/\\:<>()\[\]{}]", " ")).otherwise(
        F.regexp_replace(question, r"[^\p{L}\p{N}_\s]", " "))
    words = F.filter(F.split(F.trim(keep), r"\s+"), lambda t: (F.length(t) > 1) & ~F.lower(t).isin(STOP_WORDS))
    return F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(F.trim(question))


def search_suffix(question: Column, code_words: list[str], recent_words: list[str], year: int) -> Column:
    low = F.lower(question)
    return F.when(any_word(low, code_words), "site:github.com OR site:stackoverflow.com").when(
        any_word(low, recent_words), f"{year} OR {year - 1}").otherwise("")


def compress_history(messages: DataFrame, turns: int = 5, most_chars: int = 1000) -> DataFrame:
    """(session_id, history): last messages as labelled lines.

    When too long, the last two stay whole and only user lines before them; then it is cut
    with ``...``. The list per session is at most ``turns`` long.
    """
    w = W.partitionBy("session_id").orderBy(F.col("turn").desc())
    line = F.concat(F.when(F.col("role") == "user", "用户").otherwise("助手"), F.lit(": "), F.coalesce("text", F.lit("")))
    last = messages.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= turns).select(
        "session_id", F.struct((-F.col("_n")).alias("o"), (F.col("role") == "user").alias("user"), line.alias("line")).alias("m"))
    listed = last.groupBy("session_id").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    text = lambda ms: F.array_join(F.transform(ms, lambda m: m["line"]), "\n")
    full = text(F.col("ms"))
    brief = F.when(F.size("ms") > 2, text(F.filter("ms", lambda m: (m["o"] >= -2) | m["user"]))).otherwise(full)
    long = F.when(F.length(brief) > most_chars, F.concat(F.substring(brief, 1, most_chars), F.lit("..."))).otherwise(brief)
    return listed.select("session_id", F.when(F.length(full) <= most_chars, full).otherwise(long).alias("history"))


# fixed values: pronouns (longest first) and words that are no topic
LONG_PRONOUNS = ["这个", "那个", "上面", "刚才", "之前"]
SHORT_PRONOUNS = ["它", "这", "那", "其", "此", "该"]
TOPIC_STOP_WORDS = ["是", "的", "了", "在", "和", "与", "或", "有", "没有", "多少", "什么", "怎么", "为什么", "如何", "请", "帮我", "给我", "查询", "查一下",
                    "告诉我", "今天", "现在", "当前", "最新", "最近", "实时", "你好", "您好", "嗨", "哈喽", "hello", "hi", "hey", "在吗", "再见", "拜拜"]


def topic_of(text: Column) -> Column:
    """Topic named by a message; null when there is none."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r"))
    quoted = F.try_element_at(F.regexp_extract_all(t, F.lit('["“”]([^"“”]+)["“”]'), F.lit(1)), F.lit(-1))
    tool = F.coalesce(*[F.when(F.regexp_extract(t, p, 1) != "", F.regexp_extract(t, p, 1)) for p in (
        r"([\x{4E00}-\x{9FA5}]{2,6}(?:价格|金价|银价|汇率|天气|气温|股票|股价))", r"([A-Z]{3}).*?(?:汇率|兑换|换算)",
        r"([\x{4E00}-\x{9FA5}]+(?:市|县|区|镇))(?:的?天气)")])
    rest = F.regexp_replace(t, r"^(?:请问|请|帮我|给我|查询|查一下|告诉我|我想知道|我想了解)\s*", "")
    rest = F.regexp_replace(F.regexp_replace(rest, r"[\s?？。！!]", ""), r"(多少|什么|怎么|吗|呢|吧|行不行|可以吗)$", "")
    return (F.when(F.length(t) < 2, F.lit(None).cast("string"))
            .when((F.length(t) <= 10) & ~any_word(t, TOPIC_STOP_WORDS), t)
            .when(F.length(F.trim(F.coalesce(quoted, F.lit("")))) >= 2, F.trim(quoted))
            .when(tool.isNotNull(), tool).when((F.length(rest) >= 2) & ~rest.isin(TOPIC_STOP_WORDS), rest))


def resolve_pronouns(questions: DataFrame, history: DataFrame) -> DataFrame:
    """(session_id, question, resolved): first pronoun replaced by the topic of the latest
    user message that has one, else of the latest assistant message.

    One-character pronouns count only where no CJK character stands before them.
    """
    topics = history.withColumn("topic", topic_of(F.col("text"))).filter(F.col("topic").isNotNull() & F.col("role").isin("user", "assistant"))
    best = topics.groupBy("session_id").agg(F.max_by("topic", F.struct((F.col("role") == "user").alias("u"), F.col("turn"))).alias("topic"))
    q, topic = F.col("question"), F.regexp_replace("topic", r"([\\$])", r"\\$1")
    out = q
    for p in reversed(SHORT_PRONOUNS):
        form = rf"(?<![\x{{4E00}}-\x{{9FFF}}]){p}"
        out = F.when(q.rlike(form), F.regexp_replace(q, F.lit(f"(?s)^(.*?){form}"), F.concat(F.lit("$1"), topic))).otherwise(out)
    for p in reversed(LONG_PRONOUNS):
        out = F.when(F.contains(q, F.lit(p)), F.regexp_replace(q, F.lit(f"(?s)^(.*?){p}"), F.concat(F.lit("$1"), topic))).otherwise(out)
    return questions.join(best, "session_id", "left").select("session_id", "question", F.when(F.col("topic").isNull(), q).otherwise(out).alias("resolved"))
