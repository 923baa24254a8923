"""Job postings derived from the star-schema tables.

One posting per order. The order's status names the site, its lines name the
technologies and the phrases, its date and price the application window. The
Korean wording is that of the three sites, so the real rules meet every row.
Every per-order aggregate has a bounded size (at most 75 technology entries),
however many lines an order has.

`CORPUS_SQL` states the same derivation in SQL for the result checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gonggo.functions.joins import spread

# brand number -> (canonical technology, spelling used in posting text)
BRAND_TECHS = (
    ("Python", "파이썬"), ("Java", "java"), ("JavaScript", "자바스크립트"), ("TypeScript", "typescript"),
    ("Kotlin", "코틀린"), ("Go", "golang"), ("Spring", "스프링"), ("Spring Boot", "Spring Boot"),
    ("Django", "장고"), ("React", "리액트"), ("Vue.js", "vue.js"), ("Node.js", "nodejs"),
    ("MySQL", "MySQL"), ("PostgreSQL", "postgres"), ("Redis", "레디스"), ("Kafka", "카프카"),
    ("AWS", "AWS"), ("Docker", "도커"), ("Kubernetes", "k8s"), ("Jenkins", "젠킨스"),
    ("Linux", "리눅스"), ("TensorFlow", "텐서플로우"), ("Git", "깃"), ("C++", "C++"), ("시스템", "시스템"),
)
# part type -> (skill as a recruiter types it, its canonical name or None)
TYPE_SKILLS = {
    "ECONOMY": ("엑셀", None), "LARGE": ("JAVA", "Java"), "MEDIUM": ("Restful API", "REST API"),
    "PROMO": ("정보처리기사", None), "SMALL": ("Pythn", "Python"), "STANDARD": ("java17", "Java"),
}
SOURCES = {"F": "saramin", "O": "jobkorea", "P": "wanted"}
AS_OF = "2023-06-20"
DAY_SHIFT = 9131                      # 25 years: 1995 becomes 2020
PHRASE_TAX = 0.07

PRIVACY = "개인정보 보호법에 의거하여 당사 상시 채용을 위한 용도로만 사용됩니다"
DISCLAIMER_TEXT = "마감일은 기업의 사정으로 인해 조기 마감 또는 변경될 수 있습니다"
TAIL_TEXT = "본 채용정보는 다른회사 백엔드 개발자 상시채용 급구 하둡"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: technologies, skills and phrase flags of its lines."""
    part = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.substring("p_brand", 7, 9).cast("int").alias("brand_no"), "p_type")
    lines = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_tax", "l_discount", "l_returnflag",
        F.col("l_shipdate").cast("date").alias("ship"))
    heavy = F.col("l_tax") >= F.lit(PHRASE_TAX)

    def has(kind):
        return F.max((heavy & (F.col("p_type") == kind)).cast("int")).alias("has_" + kind.lower())
    return lines.join(part, "l_partkey").groupBy("l_orderkey").agg(
        F.sort_array(F.collect_set(F.struct("l_returnflag", "brand_no"))).alias("entries"),
        F.sort_array(F.collect_set("p_type")).alias("types"),
        F.count(F.lit(1)).alias("n_lines"), F.min("l_quantity").cast("int").alias("qty"),
        F.min("ship").alias("min_ship"), *(has(k) for k in TYPE_SKILLS))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw master table plus the pieces it was made of (start, end, …)."""
    tech_names = F.array(*(F.lit(t) for t, _ in BRAND_TECHS))
    spellings = F.array(*(F.lit(s) for _, s in BRAND_TECHS))
    skill_names = F.create_map(*(x for k, (s, _) in TYPE_SKILLS.items()
                                 for x in (F.lit(k), F.lit(s))))
    source_names = F.create_map(*(x for k, v in SOURCES.items() for x in (F.lit(k), F.lit(v))))
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority",
        F.col("o_orderdate").cast("date").alias("ordered"))
    customers = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment",
        F.col("c_nationkey").alias("n_nationkey"))
    nations = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    base = (orders.join(order_lines(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"))
            .join(customers, "o_custkey").join(nations, "n_nationkey"))
    base = spread(base.select(
        F.col("o_orderkey").alias("row_id"), source_names[F.col("o_orderstatus")].alias("source"),
        F.concat_ws("-", F.col("o_custkey").cast("string"),
                    F.date_format("ordered", "yyyyMM")).alias("job_id"),
        F.col("c_name").alias("company_name"),
        F.concat(F.lower("c_mktsegment"), F.lit(" 개발자")).alias("title_text"),
        F.col("n_name").alias("place"), "o_totalprice", "o_orderpriority", "qty", "n_lines",
        F.col("o_orderpriority").substr(1, 1).cast("int").alias("old_label"),
        F.date_add("ordered", DAY_SHIFT).alias("start"),
        F.when(F.col("n_lines") >= 6, F.date_add("min_ship", DAY_SHIFT)).otherwise(
            F.date_add(F.date_add("ordered", DAY_SHIFT),
                       F.pmod(F.floor("o_totalprice"), F.lit(45)).cast("int"))).alias("end"),
        F.transform("entries", lambda e: tech_names[e["brand_no"] - 1]).alias("final_techs"),
        F.sort_array(F.array_distinct(F.transform("entries", lambda e: e["brand_no"])))
        .alias("brands"),
        F.transform("types", lambda t: skill_names[t]).alias("hard_skills"),
        *("has_" + k.lower() for k in TYPE_SKILLS)), "row_id")

    def when(flag, text):
        return F.when(F.col(flag) == 1, F.lit(text)).otherwise(F.lit(""))
    words = F.concat_ws(" / ", F.transform("brands", lambda b: spellings[b - 1]))
    people = F.col("qty").cast("string")
    rolling = F.concat(when("has_small", " 채용 시 마감"), when("has_standard", " 채용시까지"))
    phrases = F.concat(when("has_economy", "급구 "), when("has_large", "즉시 입사 가능자 우대 "),
                       when("has_medium", "결원 충원 "), when("has_promo", "합격 축하금 지급 "))
    jobkorea = F.concat(
        F.col("company_name"), F.lit(" "), F.col("title_text"),
        F.lit(" 상세요강 접수기간∙방법 기업정보 추천공고 "), F.lit("회사 소개와 업무 안내 "), words,
        F.lit(" 접수기간 · 방법 시작일 "), F.date_format("start", "yyyy.MM.dd"), F.lit("(수) "),
        F.when(F.col("qty") % 9 == 0, F.lit("마감일 상시채용"))
        .otherwise(F.concat(F.lit("마감일 "), F.date_format("end", "yyyy.MM.dd"), F.lit("(목)"))),
        rolling, F.lit(" 접수방법 즉시지원 지원자 현황 통계 지원자 수 "),
        F.col("n_lines").cast("string"), F.lit(" 명 모집인원 "),
        F.when(F.col("qty") >= 40, F.lit("○○")).otherwise(people), F.lit(" 명 "), phrases,
        F.when(F.col("qty") >= 45, F.lit("다수 모집 ")).otherwise(F.lit("")),
        F.lit(DISCLAIMER_TEXT), F.lit(" "), F.lit(TAIL_TEXT))
    saramin = F.concat(
        F.col("title_text"), F.lit(" 전형절차 접수기간 "),
        F.when(F.col("qty") % 9 == 0, F.lit(": 상시모집"))
        .otherwise(F.concat(F.date_format("start", "yyyy. M. d"), F.lit("(월) ~ "),
                            F.date_format("end", "yyyy. M. d"), F.lit("(금)"))),
        rolling, F.lit(" 접수방법 온라인 "),
        F.when(F.col("n_lines") % 2 == 0, F.concat(people, F.lit("명 모집 ")))
        .otherwise(F.concat(F.lit("모집인원 "), people, F.lit(" 명 "))),
        phrases, words, F.lit(" "), F.lit(PRIVACY))
    tasks = F.concat(when("has_economy", "급성장하는 조직 "), F.lit("업무 "), words)
    needs = F.concat(when("has_large", "바로 합류 가능한 분 "), when("has_medium", "팀 확장 "),
                     when("has_promo", "초기 멤버 "))
    likes = F.concat(when("has_small", "애자일 문화 "), when("has_standard", "다수 채용 "))

    def filled(c):
        return F.nullif(c, F.lit(""))
    wanted = F.concat_ws("\n\n", filled(tasks), filled(needs), filled(likes))
    known = F.col("source") != "saramin"
    return base.select(
        "row_id", "source", "job_id",
        F.when(known, F.col("company_name")).alias("company"),
        F.when(known, F.col("title_text")).alias("title"),
        F.when(known, F.col("place")).alias("location"),
        F.when(F.col("source") == "jobkorea", jobkorea)
        .when(F.col("source") == "saramin", saramin).otherwise(wanted).alias("raw_text"),
        "final_techs", "hard_skills", "old_label", "start", "end", "qty", "n_lines", "brands",
        "company_name", "title_text", "place", "o_totalprice", "o_orderpriority",
        tasks.alias("main_tasks"), needs.alias("requirements"), likes.alias("preferred"))


def _cases(column: str, pairs) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k!r} THEN '{v}'" for k, v in pairs) + " END"


_BRANDS = "[" + ", ".join(f"'{t}'" for t, _ in BRAND_TECHS) + "]"
_SPELLINGS = "[" + ", ".join(f"'{s}'" for _, s in BRAND_TECHS) + "]"


def _flag(name: str, text: str) -> str:
    return f"CASE WHEN has_{name} = 1 THEN '{text}' ELSE '' END"


_ROLLING = f"{_flag('small', ' 채용 시 마감')} || {_flag('standard', ' 채용시까지')}"
_PHRASES = (f"{_flag('economy', '급구 ')} || {_flag('large', '즉시 입사 가능자 우대 ')} || "
            f"{_flag('medium', '결원 충원 ')} || {_flag('promo', '합격 축하금 지급 ')}")
_HAS = ", ".join(
    f"max(CASE WHEN l_tax >= CAST({PHRASE_TAX} AS DOUBLE) AND p_type = '{k}' THEN 1 ELSE 0 END) "
    f"AS has_{k.lower()}" for k in TYPE_SKILLS)

CORPUS_SQL = f"""
order_lines AS (
  SELECT l_orderkey,
         list_sort(list_distinct(list(l_returnflag || lpad(substr(p_brand, 7), 2, '0')))) AS entries,
         list_sort(list_distinct(list(p_type))) AS types,
         count(*) AS n_lines, CAST(min(l_quantity) AS INTEGER) AS qty,
         min(CAST(l_shipdate AS DATE)) AS min_ship, {_HAS}
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
base AS (
  SELECT o_orderkey AS row_id, {_cases('o_orderstatus', SOURCES.items())} AS source,
         CAST(o_custkey AS VARCHAR) || '-' || strftime(o_orderdate, '%Y%m') AS job_id,
         c_name AS company_name, lower(c_mktsegment) || ' 개발자' AS title_text,
         n_name AS place, o_totalprice, o_orderpriority, qty, n_lines,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS old_label,
         CAST(o_orderdate AS DATE) + {DAY_SHIFT} AS start_day,
         CASE WHEN n_lines >= 6 THEN min_ship + {DAY_SHIFT}
              ELSE CAST(o_orderdate AS DATE) + {DAY_SHIFT}
                   + CAST(CAST(floor(o_totalprice) AS BIGINT) % 45 AS INTEGER) END AS end_day,
         list_transform(entries, lambda e: ({_BRANDS})[CAST(substr(e, 2) AS INTEGER)]) AS final_techs,
         list_sort(list_distinct(list_transform(entries, lambda e: CAST(substr(e, 2) AS INTEGER)))) AS brands,
         list_transform(types, lambda t: {_cases('t', [(k, s) for k, (s, _) in TYPE_SKILLS.items()])}) AS hard_skills,
         {", ".join("has_" + k.lower() for k in TYPE_SKILLS)}
  FROM orders JOIN order_lines ON o_orderkey = l_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
worded AS (
  SELECT *, array_to_string(list_transform(brands, lambda b: ({_SPELLINGS})[b]), ' / ') AS words,
         {_ROLLING} AS rolling_words, {_PHRASES} AS phrases,
         CAST(year(start_day) AS VARCHAR) || '. ' || month(start_day) || '. ' || day(start_day) AS start_short,
         CAST(year(end_day) AS VARCHAR) || '. ' || month(end_day) || '. ' || day(end_day) AS end_short
  FROM base),
parts AS (
  SELECT *, {_flag('economy', '급성장하는 조직 ')} || '업무 ' || words AS main_tasks,
         {_flag('large', '바로 합류 가능한 분 ')} || {_flag('medium', '팀 확장 ')} || {_flag('promo', '초기 멤버 ')} AS requirements,
         {_flag('small', '애자일 문화 ')} || {_flag('standard', '다수 채용 ')} AS preferred
  FROM worded),
postings AS (
  SELECT *, CASE WHEN source <> 'saramin' THEN company_name END AS company,
         CASE WHEN source <> 'saramin' THEN title_text END AS title,
         CASE WHEN source <> 'saramin' THEN place END AS location,
         CASE source
         WHEN 'jobkorea' THEN company_name || ' ' || title_text || ' 상세요강 접수기간∙방법 기업정보 추천공고 '
           || '회사 소개와 업무 안내 ' || words || ' 접수기간 · 방법 시작일 ' || strftime(start_day, '%Y.%m.%d') || '(수) '
           || CASE WHEN qty % 9 = 0 THEN '마감일 상시채용' ELSE '마감일 ' || strftime(end_day, '%Y.%m.%d') || '(목)' END
           || rolling_words || ' 접수방법 즉시지원 지원자 현황 통계 지원자 수 ' || n_lines || ' 명 모집인원 '
           || CASE WHEN qty >= 40 THEN '○○' ELSE CAST(qty AS VARCHAR) END || ' 명 ' || phrases
           || CASE WHEN qty >= 45 THEN '다수 모집 ' ELSE '' END || '{DISCLAIMER_TEXT} {TAIL_TEXT}'
         WHEN 'saramin' THEN title_text || ' 전형절차 접수기간 '
           || CASE WHEN qty % 9 = 0 THEN ': 상시모집' ELSE start_short || '(월) ~ ' || end_short || '(금)' END
           || rolling_words || ' 접수방법 온라인 '
           || CASE WHEN n_lines % 2 = 0 THEN qty || '명 모집 ' ELSE '모집인원 ' || qty || ' 명 ' END
           || phrases || words || ' {PRIVACY}'
         ELSE main_tasks || CASE WHEN requirements <> '' THEN chr(10) || chr(10) || requirements ELSE '' END
           || CASE WHEN preferred <> '' THEN chr(10) || chr(10) || preferred ELSE '' END
         END AS raw_text
  FROM parts)
"""


def over_corpus(sql: str, *ctes: str) -> str:
    """A query over the SQL form of the corpus and further named steps."""
    return "WITH " + ",\n".join([CORPUS_SQL.strip(), *[c.strip() for c in ctes]]) + "\n" + sql
