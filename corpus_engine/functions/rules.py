"""Rule tables and the column functions that apply them.

Rules are data: other languages or domains pass tables of their own. The tables below are fixed
values for Chinese legal text, in the order in which they are applied.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Corrections of frequent misspellings.
TYPOS = {
    "诉讼实效": "诉讼时效", "起诉书": "起诉状", "辨护": "辩护", "辨护人": "辩护人", "辩护律": "辩护律师", "答辨状": "答辩状",
    "上述状": "上诉状", "申述": "申诉", "公正处": "公证处", "公正书": "公证书", "公正员": "公证员", "仲才": "仲裁", "管辖全": "管辖权",
    "法定带理人": "法定代理人", "法定带表人": "法定代表人", "执行意": "执行异议", "财产保权": "财产保全", "证据保权": "证据保全",
    "强制直行": "强制执行", "取保后审": "取保候审", "拒留": "拘留", "逮扑": "逮捕", "行事责任": "刑事责任", "明事责任": "民事责任",
    "行事案件": "刑事案件", "明事案件": "民事案件", "知识产全": "知识产权", "商标全": "商标权", "专利全": "专利权", "著作全": "著作权",
    "不正当竞正": "不正当竞争", "善意曲得": "善意取得", "不当德利": "不当得利", "缔约过实": "缔约过失", "显失公评": "显失公平",
}
#: A correction that is left out where the text has the right word already.
UNLESS = {"辩护律": "辩护律师", "执行意": "执行意见"}
# Short names of courts.
COURTS = {"最高法": "最高人民法院", "最高检": "最高人民检察院", "高法": "高级人民法院", "中法": "中级人民法院", "基层法院": "基层人民法院"}
PROVINCE_COURTS = {
    "北京高院": "北京市高级人民法院", "上海高院": "上海市高级人民法院", "广东高院": "广东省高级人民法院", "江苏高院": "江苏省高级人民法院",
    "浙江高院": "浙江省高级人民法院", "山东高院": "山东省高级人民法院", "四川高院": "四川省高级人民法院", "湖北高院": "湖北省高级人民法院",
    "河南高院": "河南省高级人民法院", "福建高院": "福建省高级人民法院",
}
# Names of laws, provinces and court levels.
LAW_NAMES = (
    "民法典", "刑法", "宪法", "合同法", "劳动法", "劳动合同法", "公司法", "婚姻法", "继承法", "行政诉讼法", "民事诉讼法", "刑事诉讼法",
    "行政处罚法", "治安管理处罚法", "道路交通安全法", "消费者权益保护法", "侵权责任法", "物权法", "担保法", "商标法", "专利法", "著作权法",
    "反不正当竞争法",
)
PROVINCES = (
    "北京", "天津", "上海", "重庆", "河北", "山西", "辽宁", "吉林", "黑龙江", "江苏", "浙江", "安徽", "福建", "江西", "山东", "河南",
    "湖北", "湖南", "广东", "海南", "四川", "贵州", "云南", "陕西", "甘肃", "青海", "内蒙古", "广西", "西藏", "宁夏", "新疆",
)
NATIONWIDE = ("最高人民法院", "最高法", "全国")
COURT_LEVELS = {
    "最高人民法院": "最高", "高级人民法院": "高级", "中级人民法院": "中级", "基层人民法院": "基层", "人民法庭": "基层", "最高法": "最高",
    "高院": "高级", "中院": "中级",
}
# Patterns of query types by priority; the first that matches decides.
QUERY_TYPES = (
    ("simple_law_query", 100, (
        r"第\s*\d+\s*条", r"第\s*[一二三四五六七八九十百千]+\s*条", r"《[^》]+》\s*第",
        r"(?:民法典|刑法|宪法|合同法|劳动法|公司法|婚姻法|继承法|行政诉讼法|民事诉讼法|刑事诉讼法)", r"法律\s*规定", r"法条", r"条款\s*内容")),
    ("case_retrieval", 90, (
        r"案例", r"判决", r"裁定", r"判例", r"(?:案件|纠纷)", r"法院\s*(?:认为|判|裁)", r"\d{4}.*?号", r"(?:赔偿|损害|侵权)\s*案")),
    ("case_analysis", 85, (r"分析.*(?:案例|案件|争议)", r"(?:争议焦点|裁判要旨|判决理由)", r"(?:这个|该)\s*案")),
    ("document_generation", 80, (
        r"(?:写|起草|拟|生成|模板).*(?:起诉状|答辩状|合同|协议|申请书|委托书|遗嘱)",
        r"(?:起诉状|答辩状|合同|协议|申请书|委托书|遗嘱).*(?:模板|范本|格式|怎么写)")),
    ("procedure_consultation", 75, (
        r"(?:起诉|上诉|申诉|仲裁|立案)\s*(?:需要|要|得)\s*(?:什么|哪些|准备)", r"(?:流程|程序|步骤|手续|材料)", r"怎么\s*(?:起诉|立案|上诉|申请)")),
    ("concept_explanation", 70, (
        r"什么\s*是\s*", r"(?:解释|含义|定义|概念)\s*(?:是|指)", r"(?:善意取得|不当得利|缔约过失|诉讼时效|公序良俗|显失公平|情势变更)")),
    ("comparative_analysis", 65, (r"(?:对比|比较|区别|异同|不同)", r"(?:A|甲)\s*(?:和|与|跟)\s*(?:B|乙)")),
    ("legal_consultation", 50, (r"怎么\s*办", r"(?:应该|可以|能不能|是否|能否)", r"(?:被.*?了|遇到|碰到)", r"(?:维权|赔偿|责任|义务|权利)")),
)
DEFAULT_TYPE, DEFAULT_CONFIDENCE = "legal_consultation", 0.5
MIXED = "mixed_law_case"
LAW_SIGNS, CASE_SIGNS = r"第\s*\d+\s*条|法条|《[^》]+》", r"案例|判决|案件|\d{4}.*?号"
COMPLEX_SIGNS = (r"并且|而且|同时|以及|另外", r"如果|假设|假如|倘若", r"对比|比较|区别")
RETRIEVAL = {"simple_law_query": "法条", "case_retrieval": "案例", "case_analysis": "案例"}
# K multiplier, rerank, parent, window of types that differ from (1.0, no, no, no).
STRATEGIES = {
    "simple_law_query": (1.0, False, True, False), "case_retrieval": (1.5, False, False, True), "case_analysis": (2.0, True, False, True),
    "mixed_law_case": (2.0, True, True, True), "document_generation": (0.5, False, False, False),
}
# Search scopes of each type; others search laws.
SCOPES = {
    "simple_law_query": ("law_search",), "concept_explanation": ("law_search",), "procedure_consultation": ("law_search",),
    "case_retrieval": ("case_search",), "case_analysis": ("case_search",), "legal_consultation": ("law_search", "case_search"),
    "mixed_law_case": ("law_search", "case_search"), "comparative_analysis": ("law_search", "case_search"), "document_generation": (),
}
YEAR_RANGE, ONE_YEAR, LAST_YEARS, CURRENT = r"(20\d{2})\s*[年至\-~—]+\s*(20\d{2})", r"(20\d{2})\s*年", r"最近\s*(\d+)\s*年", "最新|现行|当前"
ARABIC_ARTICLE, CHINESE_ARTICLE = r"第\s*(\d+)\s*条", r"第\s*([一二三四五六七八九十百千]+)\s*条"
FULL_CASE, LOOSE_CASE = r"[（(]\s*(20\d{2})\s*[）)]\s*(\S+?)\s*(\d+)\s*号", r"(20\d{2}).*?(\d+)\s*号"


@dataclass(frozen=True)
class Rule:
    """weight * min(matches, cap) of `pattern` in the text or file name speaks for `label`.

    kind: regex counts matches, word counts presence. With `density`, `bonus` is added once if
    matches per character reach it.
    """

    label: str
    name: str
    kind: str
    pattern: str
    weight: float
    cap: int | None = None
    field: str = "text"
    density: float | None = None
    bonus: float = 0.0


def _words(label: str, name: str, words: tuple[str, ...], weight: float, field: str = "text") -> list[Rule]:
    return [Rule(label, name, "word", w, weight, 1, field) for w in words]


# Features of statutes and of court decisions.
LEGAL_RULES: tuple[Rule, ...] = (
    Rule("law", "article_pattern", "regex", r"第[一二三四五六七八九十百千万零\d]+[条款项]", 2.0, 50, density=0.005, bonus=20.0),
    Rule("law", "structure_pattern", "regex", r"第[一二三四五六七八九十百千万零\d]+[章节]", 5.0),
    *_words("law", "law_meta_keyword", ("法", "条例", "规定", "办法", "规则", "细则", "准则", "章程", "法典", "法规"), 15.0, "file_name"),
    *_words("law", "law_content_keyword", ("总则", "分则", "附则", "施行日期", "本法自", "公布之日起施行", "法律责任"), 5.0),
    *_words("case", "case_section_keyword", (
        "原告诉称", "被告辩称", "本院查明", "本院认为", "判决如下", "裁定如下", "审判长", "审判员", "书记员", "合议庭", "经审理查明",
        "裁判要旨", "案件基本", "基本案情", "案件焦点"), 8.0),
    Rule("case", "case_number", "regex", r"[（(]\d{4}[)）][^\s]{2,20}?号", 12.0),
    *_words("case", "case_meta_keyword", ("判决书", "裁定书", "通知书", "调解书", "决定书", "起诉书", "案例"), 15.0, "file_name"),
    *_words("case", "case_narrative_keyword", (
        "诉至本院", "提起诉讼", "不服判决", "上诉", "赔偿损失", "承担责任", "事故发生", "原告", "被告", "当事人"), 3.0),
)


def rule_score(rule: Rule) -> Column:
    field = F.coalesce(F.col(rule.field), F.lit(""))
    if rule.kind == "word":
        return F.when(field.contains(rule.pattern), F.lit(rule.weight)).otherwise(0.0)
    n = F.regexp_count(field, F.lit(rule.pattern))
    score = (F.least(n, F.lit(rule.cap)) if rule.cap else n) * F.lit(rule.weight)
    if rule.density is not None:
        score += F.when((F.length(field) > 0) & (n / F.length(field) >= rule.density), rule.bonus).otherwise(0.0)
    return score


def file_text(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page_number, file_name, text) -> doc_id, file_name, text of the pages in order."""
    ordered = F.sort_array(F.collect_list(F.struct("page_number", "text")))
    return pages.groupBy("doc_id").agg(
        F.min("file_name").alias("file_name"), F.concat_ws("\n", F.transform(ordered, lambda p: p["text"])).alias("text")
    )


def classify_documents(files: DataFrame, rules: tuple[Rule, ...] = LEGAL_RULES, default: str = "case") -> DataFrame:
    """files(doc_id, file_name, text) with doc_type, confidence and a score of each label.

    The larger score wins; a tie and no match at all give the default, no match confidence 0.
    """
    labels = list(dict.fromkeys(r.label for r in rules))
    scores = {}
    for label in labels:
        total = F.lit(0.0)
        for rule in rules:
            if rule.label == label:
                total = total + rule_score(rule)
        scores[f"{label}_score"] = total
    scored = files.withColumns(scores)
    every = sum((F.col(c) for c in scores), F.lit(0.0))
    best = F.greatest(*[F.col(c) for c in scores])
    winner = F.lit(default)
    for label in labels:
        others = [F.col(f"{o}_score") for o in labels if o != label]
        wins = F.lit(True)
        for other in others:
            wins &= F.col(f"{label}_score") > other
        winner = F.when(wins, F.lit(label)).otherwise(winner)
    return scored.withColumns({
        "doc_type": winner, "confidence": F.when(every > 0, F.round(best / every, 6)).otherwise(0.0),
    })


def correct_query(query: Column, parity: bool = False) -> Column:
    """Typos, then court names, then law names in 《》 unless they stand beside such a mark already.

    With `parity`, corrections also change longer right words, as the plain table does.
    """
    never = "\0"  # stands in no query
    steps = [(wrong, right, never if parity else UNLESS.get(wrong, never)) for wrong, right in TYPOS.items()]
    steps += [(short, full, full) for short, full in (COURTS | PROVINCE_COURTS).items()]
    table = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip("abc", step)]) for step in steps])
    text = F.aggregate(table, query, lambda t, r: F.when(t.contains(r["c"]), t).otherwise(F.replace(t, r["a"], r["b"])))
    for name in LAW_NAMES:
        text = F.regexp_replace(text, f"(?<!《){name}(?!》)", f"《{name}》")
    return text


def classify_query(query: Column) -> tuple[Column, Column]:
    """(type, confidence) by the first matching pattern."""
    kind, sure = F.lit(DEFAULT_TYPE), F.lit(DEFAULT_CONFIDENCE)
    for name, priority, patterns in reversed(QUERY_TYPES):
        hit = query.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))
        kind = F.when(hit, F.lit(name)).otherwise(kind)
        sure = F.when(hit, F.lit(min(1.0, 0.7 + priority / 500))).otherwise(sure)
    return F.when(query.rlike(LAW_SIGNS) & query.rlike(CASE_SIGNS), F.lit(MIXED)).otherwise(kind), sure


def query_complexity(query: Column, kind: Column) -> Column:
    signs = sum((query.rlike(p).cast("int") for p in COMPLEX_SIGNS), F.lit(0))
    signs += (F.regexp_count(query, F.lit("，")) >= 3).cast("int") + (F.regexp_count(query, F.lit("？")) >= 2).cast("int")
    size = F.length(query)
    middle = (signs >= 1) | (size > 50) | kind.isin("case_analysis", "comparative_analysis", MIXED)
    return F.when((signs >= 2) | (size > 100), "complex").when(middle, "medium").otherwise("simple")


def present(query: Column, words: tuple[str, ...]) -> Column:
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: query.contains(w))


def extract_region(query: Column) -> Column:
    wide = F.lit(False)
    for word in NATIONWIDE:
        wide |= query.contains(word)
    return F.concat(present(query, PROVINCES), F.when(wide, F.array(F.lit("全国"))).otherwise(F.array().cast("array<string>")))


def extract_years(query: Column, as_of_year: int) -> Column:
    def year(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(query, pattern, group), F.lit("")).cast("int")

    def span(first: Column, last: Column) -> Column:
        return F.struct(first.alias("start"), last.alias("end"))

    now = F.lit(as_of_year)
    return (
        F.when(query.rlike(YEAR_RANGE), span(year(YEAR_RANGE, 1), year(YEAR_RANGE, 2)))
        .when(query.rlike(ONE_YEAR), span(year(ONE_YEAR, 1), year(ONE_YEAR, 1)))
        .when(query.rlike(LAST_YEARS), span(now - year(LAST_YEARS, 1), now))
        .when(query.rlike(CURRENT), span(now - 2, now))
    )


def extract_court_levels(query: Column) -> Column:
    found = F.transform(present(query, tuple(COURT_LEVELS)), lambda w: F.element_at(F.create_map(*[F.lit(x) for p in COURT_LEVELS.items() for x in p]), w))
    return F.array_distinct(found)


def extract_articles(query: Column) -> Column:
    return F.concat(F.regexp_extract_all(query, F.lit(ARABIC_ARTICLE), F.lit(1)), F.regexp_extract_all(query, F.lit(CHINESE_ARTICLE), F.lit(1)))


def extract_case_number(query: Column) -> Column:
    """year, court code and number; the code is null for loose numbers."""
    def part(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(query, pattern, group), F.lit(""))

    full = F.struct(part(FULL_CASE, 1).cast("int").alias("year"), part(FULL_CASE, 2).alias("court_code"), part(FULL_CASE, 3).cast("int").alias("number"))
    loose = F.struct(part(LOOSE_CASE, 1).cast("int").alias("year"), F.lit(None).cast("string").alias("court_code"), part(LOOSE_CASE, 2).cast("int").alias("number"))
    return F.when(query.rlike(FULL_CASE), full).when(query.rlike(LOOSE_CASE), loose)


def _by_type(kind: Column, values: dict[str, object], default: object) -> Column:
    out = F.lit(default)
    for name, value in values.items():
        out = F.when(kind == name, F.lit(value)).otherwise(out)
    return out


def strategy(kind: Column, complexity: Column) -> dict[str, Column]:
    hard = complexity == "complex"
    k = _by_type(kind, {n: s[0] for n, s in STRATEGIES.items()}, 1.0)
    return {
        "k_multiplier": F.when(hard, F.greatest(k, F.lit(2.0))).otherwise(k),
        "enable_rerank": hard | _by_type(kind, {n: s[1] for n, s in STRATEGIES.items()}, False),
        "enable_parent_fetch": _by_type(kind, {n: s[2] for n, s in STRATEGIES.items()}, False),
        "enable_sliding_window": _by_type(kind, {n: s[3] for n, s in STRATEGIES.items()}, False),
    }


def route_tools(kind: Column, complexity: Column) -> Column:
    """The scopes to search. Complex queries of one scope search the other too."""
    scopes = F.array(F.lit("law_search"))
    for name, found in SCOPES.items():
        scopes = F.when(kind == name, F.array(*[F.lit(s) for s in found]).cast("array<string>")).otherwise(scopes)
    other = F.when(scopes[0] == "law_search", "case_search").otherwise("law_search")
    return F.when((complexity == "complex") & (F.size(scopes) == 1), F.concat(scopes, F.array(other))).otherwise(scopes)


def ranking_preferences(kind: Column, query: Column) -> dict[str, Column]:
    latest = query.rlike("最新|最近|近期")
    case, law = kind.isin("case_retrieval", "case_analysis"), kind == "simple_law_query"
    return {
        "sort_by": F.when(latest, "date").otherwise("relevance"),
        "time_weight": F.when(latest, 0.5).when(law, 0.1).when(case, 0.3).otherwise(0.2),
        "authority_weight": F.when(law, 0.2).when(case, 0.4).otherwise(0.3),
    }


def prepare_queries(queries: DataFrame, as_of_year: int, parity: bool = False) -> DataFrame:
    """queries(query_id, query) with everything that routing, filters and ranking need."""
    out = queries.withColumn("corrected_query", correct_query(F.col("query"), parity))
    q = F.col("corrected_query")
    kind, sure = classify_query(q)
    out = out.withColumns({"query_type": kind, "confidence": F.round(sure, 4)})
    out = out.withColumn("complexity", query_complexity(q, F.col("query_type")))
    out = out.withColumns(strategy(F.col("query_type"), F.col("complexity")) | ranking_preferences(F.col("query_type"), q))
    return out.withColumns({
        "retrieval_type": _by_type(F.col("query_type"), RETRIEVAL, "general"),
        "tools": route_tools(F.col("query_type"), F.col("complexity")),
        "region": extract_region(q), "year_range": extract_years(q, as_of_year), "court_level": extract_court_levels(q),
        "articles": extract_articles(q), "case_number": extract_case_number(q), "law_names": present(q, LAW_NAMES),
        "doc_type": F.when(F.col("query_type") == "simple_law_query", "law").when(F.col("query_type").isin("case_retrieval", "case_analysis"), "case"),
    })


def needs_correction(query: Column) -> Column:
    """Whether a query should go to a language model: repeated characters, digits only, colloquial, long without legal words."""
    return (
        query.rlike(r"(.)\1{2,}") | ((F.length(query) < 3) & query.rlike(r"^\d+$")) | query.rlike("咋|啥|肿么|木有")
        | ((F.length(query) > 30) & ~query.rlike("法|诉|判|案|律|权"))
    )


def accept_correction(original: Column, new: Column) -> Column:
    ratio = F.length(new) / F.greatest(F.length(original), F.lit(1))
    return F.when((F.coalesce(new, F.lit("")) != "") & (ratio > 0.3) & (ratio < 3.0), new).otherwise(original)
