"""Registered queries of cleaning, chunking, rules and quality, with their DuckDB counterparts.

Where the tables hold no text of the kind a rule is for, it is derived from their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.functions import rules, text
from corpus_engine.operators import chunk, quality
from corpus_engine.plans.search_queries import table

AS_OF_YEAR = 2024
#: Questions that are dealt to the documents in turn and completed with their source.
QUESTIONS = (
    "民法典第1165条规定什么", "交通事故赔偿的典型案例有哪些", "被公司辞退了怎么办", "帮我写一份劳动仲裁申请书", "分析该案的争议焦点",
    "对比有限责任和无限责任，并且说明理由", "起诉需要哪些材料", "什么是善意取得", "刑法第二百三十二条的相关判决", "诉讼实效是多久，最新规定",
    "北京高院2021年至2023年的判例", "(2023)京01民终1234号判决书", "最近3年上海的劳动合同法纠纷", "最高法关于辩护律师的规定", "如果甲和乙离婚，财产怎么分，孩子归谁，房子归谁，而且还有债务？谁来还？",
    "行事责任与明事责任的区别", "执行意见和执行意的申请流程", "浙江中院2020年案件", "啊啊啊啊怎么办", "第十二条 第3条 合同法 法条",
)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    asked = F.element_at(F.array(*[F.lit(q) for q in QUESTIONS]), (F.col("doc_id") % len(QUESTIONS) + 1).cast("int"))
    return docs.select(F.col("doc_id").alias("query_id"), F.concat(asked, F.lit(" "), F.col("source")).alias("query"))


_LIST = "[" + ", ".join(f"'{q}'" for q in QUESTIONS) + "]"
_ASKED = f"asked AS (SELECT doc_id AS query_id, {_LIST}[doc_id % {len(QUESTIONS)} + 1] || ' ' || source AS query FROM documents)"


def personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with numbers, dates and marks to clean."""
    docs = table(spark, sf_dir, "documents")
    extra = F.concat(
        F.lit("  138"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(" 2024年1月5日 3/4/24 <b>x</b>　\u0007 138-1234-5678 "), F.lit("   \n\n\n[")
    )
    return docs.select("doc_id", F.concat(F.col("text"), extra).alias("text"))


_PERSONAL = "SELECT doc_id, text || '  138' || lpad(doc_id::VARCHAR, 8, '0') || ' 2024年1月5日 3/4/24 <b>x</b>　' || chr(7) || ' 138-1234-5678 ' || '   ' || chr(10) || chr(10) || chr(10) || '[' AS text FROM documents"
_SPACES = "[\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]"


def _step(name: str, step) -> tuple[str, object]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return personal(spark, sf_dir).select("doc_id", F.md5(step(F.col("text"))).alias("cleaned"))

    query.__name__ = f"clean_{name}"
    query.__doc__ = f"Cleaning step {name} over all documents."
    return query.__name__, query


_CLEAN = {
    "strip": f"regexp_replace(text, '^{_SPACES}+|{_SPACES}+$', '', 'g')",
    "nfc": "nfc_normalize(text)",
    "strip_tags": "regexp_replace(text, '<[^>]*>', '', 'g')",
    "strip_control": "regexp_replace(text, '[\\x00-\\x08\\x0B-\\x0C\\x0E-\\x1F\\x7F]', '', 'g')",
    "keep_allowed": f"regexp_replace(text, '[^\\p{{L}}\\p{{N}}_\\s\\x0B\\x1C-\\x1F\\x{{85}}\\p{{Z}}.,!?;:，。！？；：\\x{{4e00}}-\\x{{9fff}}]', '', 'g')",
    "cn_date": "replace(text, '2024年1月5日', '2024-01-05')",
    "slash_date": "replace(text, '3/4/24', '2024-04-03')",
    "full_width": "translate(text, ',.!?;:', '，。！？；：')",
    "mask_personal": "regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\b\\d{17}[\\dXx]\\b', '***', 'g'), '\\b\\d{15}\\b', '***', 'g'), '\\b1[3-9]\\d{9}\\b', '***', 'g'), '\\b1[3-9]\\d-\\d{4}-\\d{4}\\b', '***', 'g')",
    "collapse_space": f"regexp_replace(text, '{_SPACES}+', ' ', 'g')",
}


def clean_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps in order; documents of source src0 pass as high quality."""
    rows = personal(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    marked = rows.withColumn("source", F.when(F.col("source") == "src0", "src0.MD").otherwise(F.col("source")))
    cleaned = text.clean_corpus(marked, source="source")
    return cleaned.select("doc_id", "preprocessed_by", "high_quality_source", F.length("text").alias("n"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and estimates of every document."""
    found = text.tokenize(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(found).cast("long").alias("n_tokens"), F.md5(F.array_join(found, " ")).alias("tokens"),
        text.estimate_tokens(F.col("text")).alias("estimate"), text.estimate_agent_tokens(F.length("text")).alias("agent_estimate"),
    )


def pages_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every page without its tags."""
    body = text.collapse_space(text.strip_tags(F.col("html")))
    return table(spark, sf_dir, "pages").select("page_id", F.length(body).alias("n"), F.md5(body).alias("body"))


def similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation against the one before."""
    turns = table(spark, sf_dir, "conversations")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("other"))
    a, b = F.col("text"), F.col("other")
    return turns.join(before, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(text.char_jaccard(a, b), 6).alias("char_jaccard"),
        F.round(text.jaccard(F.array_distinct(text.tokenize(a)), F.array_distinct(text.tokenize(b))), 6).alias("token_jaccard"),
    )


def chunks_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 500 characters, 450 apart, of all documents."""
    found = chunk.split_fixed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "chunk_index", "chunk_total", F.md5("text").alias("chunk"), F.length("text").alias("char_count"))


def chunks_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces at the coarsest separators that fit."""
    return chunk.split_recursive(table(spark, sf_dir, "documents").select("doc_id", "text"))


def chunks_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows without overlap joined again give the documents."""
    found = chunk.split_fixed(table(spark, sf_dir, "documents").select("doc_id", "text"), 500, 0)
    return chunk.rejoin_chunks(found, "").select("doc_id", F.md5("text").alias("text"))


def packed_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I5."""
    return chunk.pack_paragraphs(table(spark, sf_dir, "documents").select("doc_id", "text"))


def statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sentences under headings of a statute."""
    parts = F.split("text", r"\. ", 3)
    part = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    body = F.concat(
        F.lit("第一章 总则\n第一条 "), part(0), F.lit("\n第二条 "), part(1), F.lit("\n第二章 分则\n第一节 一般\n第三条 "), part(2)
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("law_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_name"), body.alias("text"))


_STATUTES = """SELECT doc_id, split_part(text, '. ', 1) AS s1, split_part(text, '. ', 2) AS s2,
    CASE WHEN len(string_split(text, '. ')) < 3 THEN '' ELSE substr(text, len(split_part(text, '. ', 1)) + len(split_part(text, '. ', 2)) + 5) END AS s3 FROM documents"""
_TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles of the statutes."""
    _, children = chunk.split_structured(statutes(spark, sf_dir))
    return children.select("doc_id", "law_name", "article_number", "chapter", "chapter_number", "section", "section_number", F.md5("text").alias("text"), "char_count")


def statute_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chapters and sections that hold articles."""
    parts, _ = chunk.split_structured(statutes(spark, sf_dir))
    return parts.select("doc_id", "chapter", "section", "child_count", F.md5("text").alias("text"))


def routed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4, G1: statutes by structure, other documents by size."""
    files = statutes(spark, sf_dir).withColumn("doc_type", F.when(F.col("doc_id") % 2 == 0, "law").otherwise("case"))
    return chunk.route_and_split(files).groupBy("doc_type", "chunk_type").agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents"))


def legal_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statutes for even documents, decisions for odd ones."""
    docs = table(spark, sf_dir, "documents")
    number = F.col("doc_id").cast("string")
    case = F.concat(F.lit("本院认为 原告 被告 (2023)京01民终"), number, F.lit("号 "), F.col("text"))
    law = F.concat(F.lit("第一章 总则 第一条 第二条 第三款 "), F.col("text"))
    even = F.col("doc_id") % 2 == 0
    return docs.select(
        "doc_id", F.when(even, F.concat(F.lit("law_"), number, F.lit(".md"))).otherwise(F.concat(F.lit("判决书_"), number, F.lit(".txt"))).alias("file_name"),
        F.when(even, law).otherwise(case).alias("text"),
    )


_FILES = """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'law_' || doc_id || '.md' ELSE '判决书_' || doc_id || '.txt' END AS file_name,
    CASE WHEN doc_id % 2 = 0 THEN '第一章 总则 第一条 第二条 第三款 ' || text ELSE '本院认为 原告 被告 (2023)京01民终' || doc_id || '号 ' || text END AS text FROM documents"""


def classified_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of each file by weighted rules."""
    return rules.classify_documents(legal_files(spark, sf_dir)).select("doc_id", "law_score", "case_score", "doc_type", "confidence")


def _score_sql(rule: rules.Rule) -> str:
    if rule.kind == "word":
        return f"CASE WHEN contains({rule.field}, '{rule.pattern}') THEN {rule.weight} ELSE 0 END"
    n = f"len(regexp_extract_all({rule.field}, '{rule.pattern}'))"
    score = f"{f'least({n}, {rule.cap})' if rule.cap else n} * {rule.weight}"
    return score + (f" + CASE WHEN {n} / nullif(len({rule.field}), 0) >= {rule.density} THEN {rule.bonus} ELSE 0 END" if rule.density else "")


def _scores(label: str, of: tuple[rules.Rule, ...] = rules.LEGAL_RULES) -> str:
    return "(" + " + ".join(_score_sql(r) for r in of if r.label == label) + ")::DOUBLE"


def _classified_sql(files: str, of: tuple[rules.Rule, ...]) -> str:
    return f"""SELECT doc_id, law_score, case_score, CASE WHEN law_score > case_score THEN 'law' ELSE 'case' END AS doc_type,
        CASE WHEN law_score + case_score > 0 THEN round(greatest(law_score, case_score) / (law_score + case_score), 6) ELSE 0 END AS confidence
        FROM (SELECT doc_id, {_scores('law', of)} AS law_score, {_scores('case', of)} AS case_score FROM ({files}))"""


OTHER_RULES = (
    rules.Rule("law", "suffix", "regex", "tion|ing", 2.0, 50, density=0.02, bonus=20.0), rules.Rule("law", "word", "word", "the", 5.0, 1),
    rules.Rule("case", "infix", "regex", "que|sch", 3.0), rules.Rule("case", "word", "word", "der", 8.0, 1),
)


def classified_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: the same with rules of another language over the documents as they are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("file_name"), "text")
    return rules.classify_documents(docs, OTHER_RULES).select("doc_id", "law_score", "case_score", "doc_type", "confidence")


def corrected_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H13."""
    return questions(spark, sf_dir).select("query_id", rules.correct_query(F.col("query")).alias("corrected_query"))


def _correct_sql() -> str:
    q = "query"
    for wrong, right in rules.TYPOS.items():
        new = f"replace({q}, '{wrong}', '{right}')"
        kept = rules.UNLESS.get(wrong)
        q = f"CASE WHEN contains({q}, '{kept}') THEN {q} ELSE {new} END" if kept else new
    steps = [f"SELECT query_id, {q} AS query FROM asked"]
    for short, full in (rules.COURTS | rules.PROVINCE_COURTS).items():
        steps.append(f"SELECT query_id, CASE WHEN contains(query, '{short}') AND NOT contains(query, '{full}') THEN replace(query, '{short}', '{full}') ELSE query END AS query FROM ({steps[-1]})")
    for name in rules.LAW_NAMES:
        wrapped = f"replace(query, '{name}', '《{name}》')"
        steps.append(f"SELECT query_id, replace(replace({wrapped}, '《《{name}》', '《{name}'), '《{name}》》', '{name}》') AS query FROM ({steps[-1]})")
    return steps[-1]


def prepared_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type, complexity, strategy, filters and scopes of every query."""
    found = rules.prepare_queries(questions(spark, sf_dir).withColumn("query", F.col("query")), AS_OF_YEAR)
    return found.select(
        "query_id", "query_type", "confidence", "complexity", "retrieval_type", "k_multiplier", "enable_rerank", "enable_parent_fetch", "enable_sliding_window",
        F.array_join("tools", ",").alias("tools"), F.array_join("region", ",").alias("region"), F.col("year_range.start").alias("year_start"),
        F.col("year_range.end").alias("year_end"), F.array_join("court_level", ",").alias("court_level"), F.array_join("articles", ",").alias("articles"),
        F.col("case_number.year").alias("case_year"), F.col("case_number.number").alias("case_no"), F.array_join("law_names", ",").alias("law_names"),
        "sort_by", "time_weight", "authority_weight", "doc_type",
    )


def _prepared_sql() -> str:
    def case(values, default: str) -> str:
        return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in values) + f" ELSE {default} END"

    def hit(p: str, i: bool = False) -> str:
        return f"regexp_matches(q, '{p}'{', ' + chr(39) + 'i' + chr(39) if i else ''})"

    kinds = [("|".join(f"(?:{p})" for p in ps), n, min(1.0, 0.7 + pr / 500)) for n, pr, ps in rules.QUERY_TYPES]
    kind = case([(f"{hit(rules.LAW_SIGNS)} AND {hit(rules.CASE_SIGNS)}", f"'{rules.MIXED}'")] + [(hit(p, True), f"'{n}'") for p, n, _ in kinds], f"'{rules.DEFAULT_TYPE}'")
    sure = case([(hit(p, True), str(s)) for p, _, s in kinds], str(rules.DEFAULT_CONFIDENCE))
    signs = " + ".join(f"{hit(p)}::INT" for p in rules.COMPLEX_SIGNS) + " + (len(regexp_extract_all(q, '，')) >= 3)::INT + (len(regexp_extract_all(q, '？')) >= 2)::INT"
    of = lambda k, default: case([(f"query_type = '{n}'", str(s[k])) for n, s in rules.STRATEGIES.items()], default)
    words = lambda ws: "list_filter([" + ", ".join(f"'{w}'" for w in ws) + "], lambda w: contains(q, w))"
    nation = " OR ".join(f"contains(q, '{w}')" for w in rules.NATIONWIDE)
    level = case([(f"w = '{w}'", f"'{v}'") for w, v in rules.COURT_LEVELS.items()], "NULL")
    years = lambda a, b, c, d: case([(hit(rules.YEAR_RANGE), a), (hit(rules.ONE_YEAR), b), (hit(rules.LAST_YEARS), c), (hit(rules.CURRENT), d)], "NULL")
    number = lambda p, g: f"regexp_extract(q, '{p}', {g})::INT"
    scopes = case([(f"query_type = '{n}'", "[" + ", ".join(f"'{x}'" for x in s) + "]::VARCHAR[]") for n, s in rules.SCOPES.items()], "['law_search']")
    levels = f"list_transform({words(rules.COURT_LEVELS)}, lambda w: {level})"
    distinct = f"list_filter({levels}, lambda x, i: list_position({levels}, x) = i)"
    return f"""WITH {_ASKED}, c AS (SELECT query_id, query AS q FROM ({_correct_sql()})),
k AS (SELECT query_id, q, {kind} AS query_type, round({sure}, 4)::DOUBLE AS confidence, {signs} AS signs FROM c),
x AS (SELECT *, CASE WHEN signs >= 2 OR len(q) > 100 THEN 'complex' WHEN signs >= 1 OR len(q) > 50 OR query_type IN ('case_analysis', 'comparative_analysis', '{rules.MIXED}') THEN 'medium' ELSE 'simple' END AS complexity FROM k),
t AS (SELECT *, {scopes} AS scopes FROM x)
SELECT query_id, query_type, confidence, complexity,
  {case([(f"query_type = '{n}'", f"'{v}'") for n, v in rules.RETRIEVAL.items()], "'general'")} AS retrieval_type,
  (CASE WHEN complexity = 'complex' THEN greatest({of(0, '1.0')}, 2.0) ELSE {of(0, '1.0')} END)::DOUBLE AS k_multiplier,
  complexity = 'complex' OR {of(1, 'False')} AS enable_rerank, {of(2, 'False')} AS enable_parent_fetch, {of(3, 'False')} AS enable_sliding_window,
  array_to_string(CASE WHEN complexity = 'complex' AND len(scopes) = 1 THEN list_concat(scopes, [CASE WHEN scopes[1] = 'law_search' THEN 'case_search' ELSE 'law_search' END]) ELSE scopes END, ',') AS tools,
  array_to_string(list_concat({words(rules.PROVINCES)}, CASE WHEN {nation} THEN ['全国'] ELSE []::VARCHAR[] END), ',') AS region,
  {years(number(rules.YEAR_RANGE, 1), number(rules.ONE_YEAR, 1), f"{AS_OF_YEAR} - {number(rules.LAST_YEARS, 1)}", str(AS_OF_YEAR - 2))} AS year_start,
  {years(number(rules.YEAR_RANGE, 2), number(rules.ONE_YEAR, 1), str(AS_OF_YEAR), str(AS_OF_YEAR))} AS year_end,
  array_to_string({distinct}, ',') AS court_level,
  array_to_string(list_concat(regexp_extract_all(q, '{rules.ARABIC_ARTICLE}', 1), regexp_extract_all(q, '{rules.CHINESE_ARTICLE}', 1)), ',') AS articles,
  CASE WHEN {hit(rules.FULL_CASE)} THEN {number(rules.FULL_CASE, 1)} WHEN {hit(rules.LOOSE_CASE)} THEN {number(rules.LOOSE_CASE, 1)} END AS case_year,
  CASE WHEN {hit(rules.FULL_CASE)} THEN {number(rules.FULL_CASE, 3)} WHEN {hit(rules.LOOSE_CASE)} THEN {number(rules.LOOSE_CASE, 2)} END AS case_no,
  array_to_string({words(rules.LAW_NAMES)}, ',') AS law_names,
  CASE WHEN {hit('最新|最近|近期')} THEN 'date' ELSE 'relevance' END AS sort_by,
  (CASE WHEN {hit('最新|最近|近期')} THEN 0.5 WHEN query_type = 'simple_law_query' THEN 0.1 WHEN query_type IN ('case_retrieval', 'case_analysis') THEN 0.3 ELSE 0.2 END)::DOUBLE AS time_weight,
  (CASE WHEN query_type = 'simple_law_query' THEN 0.2 WHEN query_type IN ('case_retrieval', 'case_analysis') THEN 0.4 ELSE 0.3 END)::DOUBLE AS authority_weight,
  CASE WHEN query_type = 'simple_law_query' THEN 'law' WHEN query_type IN ('case_retrieval', 'case_analysis') THEN 'case' END AS doc_type FROM t"""


def query_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many queries of each type and complexity, and their mean confidence."""
    found = rules.prepare_queries(questions(spark, sf_dir), AS_OF_YEAR)
    return found.groupBy("query_type", "complexity").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("confidence"))


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every rule in every document."""
    return quality.quality_findings(personal(spark, sf_dir))


def quality_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By type, for each document and for all."""
    return quality.error_distribution(quality_report(spark, sf_dir))


def quality_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cleaning white space and control characters changes."""
    before = personal(spark, sf_dir)
    after = before.withColumn("text", text.collapse_space(text.strip_control(F.col("text"))))
    return quality.compare_before_after(quality.quality_findings(before), quality.quality_findings(after))


def finding_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the findings of patterns are."""
    return quality.finding_positions(personal(spark, sf_dir))


def _unmatched_sql(source: str) -> str:
    parts = []
    for a, b in quality.BRACKETS:
        marks = f"\\{a}\\{b}" if a.isascii() else a + b
        parts.append(f"""SELECT doc_id, (total - 2 * lost)::BIGINT AS n FROM (
            SELECT doc_id, least(0, min(run)) AS lost, arg_max(run, i) AS total FROM (
              SELECT doc_id, i, sum(v) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
                SELECT doc_id, unnest(list_transform(cs, lambda c: CASE WHEN c = '{a}' THEN 1 ELSE -1 END)) AS v, unnest(range(len(cs))) AS i FROM (
                  SELECT doc_id, string_split(regexp_replace(text, '[^{marks}]', '', 'g'), '') AS cs FROM {source} WHERE regexp_matches(text, '[{marks}]'))))
            GROUP BY doc_id)""")
    return "SELECT doc_id, sum(n)::BIGINT AS n FROM (" + " UNION ALL ".join(parts) + ") GROUP BY doc_id"


def _quality_sql(source: str, name: str) -> str:
    same = "|".join(("!{2,}", "\\.{2,}", "，{2,}", "。{2,}", "？{2,}", "！{2,}", ",{2,}", ";{2,}", ":{2,}", "\\\\{2,}", "-{2,}"))
    runs, pair = "len(regexp_extract_all(w, '[A-Z]+|[a-z]+'))", "regexp_matches(w, '[A-Z][A-Z]')"
    odd = f"""regexp_full_match(w, '[a-z]*[A-Z][a-z]*[A-Z][a-zA-Z]*|[A-Z]*[a-z][A-Z]*[a-z][a-zA-Z]*') AND regexp_matches(w, '[a-z]') AND regexp_matches(w, '[A-Z]')
        AND ({runs} > 5 OR (regexp_matches(w, '^[a-z]') AND {pair}) OR (regexp_matches(w, '^[A-Z]') AND {pair} AND len(regexp_replace(w, '[^A-Z]', '', 'g')) > 4))"""
    symbol = """SELECT doc_id, count(*) AS n FROM (SELECT doc_id, c, substr(line, greatest(i - 10, 1), i + 10 - greatest(i - 10, 1) + 1) AS ctx
        FROM (SELECT doc_id, line, unnest(string_split(line, '')) AS c, unnest(range(1, len(line) + 1)) AS i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM src)
              WHERE regexp_matches(line, '[&@#]') AND NOT regexp_matches(trim(line), '^https?://') AND NOT regexp_matches(trim(line), '^[\\w.-]+@[\\w.-]+\\.\\w+$')))
        WHERE c IN ('&', '@', '#') AND NOT contains(regexp_extract(ctx, 'https?://\\S*'), c) AND NOT regexp_matches(ctx, '^[\\w.-]*@') GROUP BY doc_id"""
    count = lambda p: f"SELECT doc_id, len(regexp_extract_all(text, '{p}')) AS n FROM src"
    counts = {
        "spaces": count(" {3,}"), "newlines": count("\\n{3,}"), "repeated": count(same), "controls": count("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{9f}]"),
        "odd_case": f"SELECT doc_id, len(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda w: {odd})) AS n FROM src",
        "symbols": symbol, "brackets": _unmatched_sql("src"),
    }
    rows = " UNION ALL ".join(f"SELECT doc_id, '{r}' AS rule, '{t}' AS error_type, '{s}' AS severity, n::BIGINT AS findings FROM ({counts[r]}) WHERE n > 0" for r, (t, s) in quality.RULES.items())
    return f"{name} AS (WITH src AS ({source}) {rows})"


_CLEANED = f"SELECT doc_id, regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0B-\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '{_SPACES}+', ' ', 'g') AS text FROM ({_PERSONAL})"
TOKENS = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}]{{2,}}')"
_LETTERS = "list_distinct(list_filter(string_split({0}, ''), lambda c: c <> ''))"
_WORDS = f"list_distinct({TOKENS})"
_JACCARD = "CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0 ELSE round(len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))), 6) END"

def _merged_sql(parts: str, size: int, overlap: int) -> str:
    """The fold of chunk.recursive_pieces over a list of parts."""
    n, joined = "len(e.p)", "array_to_string(s.h, '')"
    closed = f"(CASE WHEN len(s.h) > 0 THEN list_append(s.o, {joined}) ELSE s.o END)"
    behind = f"list_filter(s.h, lambda w, i: len(array_to_string(s.h[i:], '')) <= least({overlap}, {size} - {n}))"
    step = f"""CASE WHEN {n} > {size} THEN {{'o': list_append({closed}, e.p), 'h': []::VARCHAR[], 'p': ''}}
      WHEN len(s.h) > 0 AND len({joined}) + {n} > {size} THEN {{'o': {closed}, 'h': list_append({behind}, e.p), 'p': ''}}
      ELSE {{'o': s.o, 'h': list_append(s.h, e.p), 'p': ''}} END"""
    rows = f"list_transform({parts}, lambda z: {{'o': []::VARCHAR[], 'h': []::VARCHAR[], 'p': z}})"
    folded = f"list_reduce([{{'o': []::VARCHAR[], 'h': []::VARCHAR[], 'p': ''}}] || {rows}, lambda s, e: {step})"
    return f"list_transform([{folded}], lambda s: {closed})[1]"


def _recursive_sql(source: str, size: int = chunk.SIZE, overlap: int = chunk.OVERLAP) -> str:
    """doc_id, list p of pieces of source(doc_id, text)."""
    found = f"SELECT doc_id, [coalesce(text, '')] AS p FROM ({source})"
    for mark in chunk.SEPARATORS:
        if mark:
            m = mark.replace("\n", "' || chr(10) || '")
            parts = f"list_filter(list_transform(string_split(x, '{m}'), lambda y, i: CASE WHEN i > 1 THEN '{m}' || y ELSE y END), lambda y: y <> '')"
            made = f"CASE WHEN len(x) <= {size} OR NOT contains(x, '{m}') THEN [x] ELSE {_merged_sql(parts, size, overlap)} END"
        else:
            made = f"CASE WHEN len(x) <= {size} THEN [x] ELSE list_transform(range(0, ceil((len(x) - {overlap}) / {size - overlap}.0)::BIGINT), lambda i: substr(x, i * {size - overlap} + 1, {size})) END"
        found = f"SELECT doc_id, flatten(list_transform(p, lambda x: {made})) AS p FROM ({found})"
    return f"SELECT doc_id, list_filter(list_transform(p, lambda x: {_TRIM.format('x')}), lambda x: x <> '') AS p FROM ({found})"


def _packed_sql(parts: str, size: int, mark: str) -> str:
    """The fold of chunk.packed over a list of parts."""
    closed = "(CASE WHEN s.h <> '' THEN list_append(s.o, s.h) ELSE s.o END)"
    full = f"s.h <> '' AND len(s.h) + {2 if mark else 0} + len(e.h) > {size}"
    more = f"s.h || {mark} || e.h" if mark else "s.h || e.h"
    step = f"{{'o': CASE WHEN {full} THEN {closed} ELSE s.o END, 'h': CASE WHEN {full} OR s.h = '' THEN e.h ELSE {more} END}}"
    rows = f"list_transform({parts}, lambda z: {{'o': []::VARCHAR[], 'h': z}})"
    return f"list_transform([list_reduce([{{'o': []::VARCHAR[], 'h': ''}}] || {rows}, lambda s, e: {step})], lambda s: {closed})[1]"


_BREAK = "(chr(10) || chr(10))"
_SENTENCES = _packed_sql("string_split(regexp_replace(y, '([。！？.!?])', '\\1' || chr(1), 'g'), chr(1))", 5000, "")
_PARAGRAPHS = f"flatten(list_transform(list_filter(string_split(text, {_BREAK}), lambda y: {_TRIM.format('y')} <> ''), lambda y: CASE WHEN len(y) > 5000 THEN {_SENTENCES} ELSE [y] END))"
_PACKED = f"""SELECT doc_id, (i - 1)::INT AS chunk_index, p[i] AS text FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (
    SELECT doc_id, CASE WHEN len(text) <= 6000 THEN [text] ELSE {_packed_sql(_PARAGRAPHS, 5000, _BREAK)} END AS p FROM documents WHERE text <> ''))"""
_ROUTED_TEXTS = f"SELECT doc_id, '第一章 总则' || chr(10) || '第一条 ' || s1 || chr(10) || '第二条 ' || s2 || chr(10) || '第二章 分则' || chr(10) || '第一节 一般' || chr(10) || '第三条 ' || s3 AS text FROM ({_STATUTES}) WHERE doc_id % 2 <> 0"
_ROUTED_CHUNKS = f"""SELECT 'case' AS doc_type, 'plain' AS chunk_type, sum(len(p))::BIGINT AS chunks, count(*) AS documents FROM ({_recursive_sql(_ROUTED_TEXTS)}) WHERE len(p) > 0
    UNION ALL SELECT 'law', kind, n * count(*), count(*) FROM documents, (VALUES ('parent', 2), ('child', 3)) AS k(kind, n) WHERE doc_id % 2 = 0 GROUP BY kind, n"""


QUERIES = dict(_step(name, getattr(text, name)) for name in _CLEAN) | {
    f.__name__: f
    for f in (
        clean_all, tokens, pages_text, similarities, chunks_fixed, chunks_recursive, chunks_rejoined, packed_paragraphs, articles, statute_parts,
        routed_chunks, classified_files, classified_other, corrected_queries, prepared_queries, query_profile, quality_report, quality_distribution,
        quality_gain, finding_places,
    )
}
ORACLE_SQL = {f"clean_{name}": f"SELECT doc_id, md5({sql}) AS cleaned FROM ({_PERSONAL})" for name, sql in _CLEAN.items()} | {
    "tokens": f"SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, ' ')) AS tokens, CASE WHEN text = '' THEN 0 ELSE greatest(1, len(text) // 2) END AS estimate, floor(len(text) / 1.5)::BIGINT AS agent_estimate FROM (SELECT *, {TOKENS.format('text')} AS t FROM documents)",
    "pages_text": f"SELECT page_id, len(b) AS n, md5(b) AS body FROM (SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '{_SPACES}+', ' ', 'g') AS b FROM pages)",
    "similarities": f"""SELECT conv_id, turn, {_JACCARD.format('ca', 'cb')} AS char_jaccard, {_JACCARD.format('wa', 'wb')} AS token_jaccard FROM (
        SELECT a.conv_id, a.turn, {_LETTERS.format('a.text')} AS ca, {_LETTERS.format('b.text')} AS cb, {_WORDS.format('a.text')} AS wa, {_WORDS.format('b.text')} AS wb
        FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1)""",
    "chunks_fixed": """SELECT doc_id, i::INT AS chunk_index, n AS chunk_total, md5(c) AS chunk, len(c) AS char_count FROM (SELECT doc_id, i, n, substr(text, i * 450 + 1, 500) AS c
        FROM (SELECT doc_id, text, greatest(1, ceil((len(text) - 50) / 450.0)::INT) AS n, unnest(range(0, greatest(1, ceil((len(text) - 50) / 450.0)::INT))) AS i FROM documents))""",
    "chunks_recursive": f"""SELECT doc_id, n AS chunk_total, (i - 1)::INT AS chunk_index, p[i] AS text, len(p[i])::INT AS char_count FROM (
        SELECT doc_id, p, len(p)::INT AS n, unnest(range(1, len(p) + 1)) AS i FROM ({_recursive_sql('SELECT doc_id, text FROM documents')}))""",
    "packed_paragraphs": _PACKED,
    "routed_chunks": _ROUTED_CHUNKS,
    "chunks_rejoined": "SELECT doc_id, md5(text) AS text FROM documents",
    "articles": f"""WITH s AS ({_STATUTES}) SELECT doc_id, 'law_' || doc_id AS law_name, no AS article_number, chapter, cn AS chapter_number, section, sn AS section_number, md5(t) AS text, len(t) AS char_count FROM (
        SELECT doc_id, 1 AS no, '总则' AS chapter, 1 AS cn, NULL AS section, NULL AS sn, {_TRIM.format("'第一条 ' || s1")} AS t FROM s
        UNION ALL SELECT doc_id, 2, '总则', 1, NULL, NULL, {_TRIM.format("'第二条 ' || s2")} FROM s
        UNION ALL SELECT doc_id, 3, '分则', 2, '一般', 1, {_TRIM.format("'第三条 ' || s3")} FROM s)""",
    "statute_parts": f"""WITH s AS ({_STATUTES}) SELECT doc_id, '总则' AS chapter, NULL AS section, 2 AS child_count, md5({_TRIM.format("'第一章 总则' || chr(10) || '第一条 ' || s1 || chr(10) || '第二条 ' || s2")}) AS text FROM s
        UNION ALL SELECT doc_id, '分则', '一般', 1, md5({_TRIM.format("'第一节 一般' || chr(10) || '第三条 ' || s3")}) FROM s""",
    "classified_files": _classified_sql(_FILES, rules.LEGAL_RULES),
    "classified_other": _classified_sql("SELECT doc_id, source AS file_name, coalesce(text, '') AS text FROM documents", OTHER_RULES),
    "corrected_queries": f"WITH {_ASKED} SELECT query_id, query AS corrected_query FROM ({_correct_sql()})",
    "prepared_queries": _prepared_sql(),
    "query_profile": f"SELECT query_type, complexity, count(*) AS n, round(avg(confidence), 4) AS confidence FROM ({_prepared_sql()}) GROUP BY ALL",
    "quality_report": f"WITH {_quality_sql(_PERSONAL, 'f')} SELECT * FROM f",
    "quality_distribution": f"WITH {_quality_sql(_PERSONAL, 'f')} SELECT doc_id, error_type, sum(findings)::BIGINT AS findings FROM f GROUP BY GROUPING SETS ((doc_id, error_type), (error_type))",
    "quality_gain": f"""WITH {_quality_sql(_PERSONAL, 'f')}, {_quality_sql(_CLEANED, 'g')}, b AS (SELECT error_type, sum(findings)::BIGINT AS n FROM f GROUP BY 1), a AS (SELECT error_type, sum(findings)::BIGINT AS n FROM g GROUP BY 1)
        SELECT coalesce(b.error_type, a.error_type) AS error_type, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after, coalesce(b.n, 0) - coalesce(a.n, 0) AS errors_reduced,
        CASE WHEN coalesce(b.n, 0) > 0 THEN round((b.n - coalesce(a.n, 0)) / b.n * 100, 2) ELSE 0 END AS reduction_rate FROM b FULL JOIN a ON b.error_type = a.error_type""",
}
