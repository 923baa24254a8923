"""Reading web pages: the given ones, and site pages rendered from the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gonggo.plans.corpus import over_corpus, postings, read
from gonggo.plans.registry import query
from gonggo.plans.urgency_queries import _always_open
from gonggo.sources import pages as G

# ---------------------------------------------------------------- given pages

_UNESCAPE = "{0}"
for _entity, _sign in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&"), ("&amp", "&")):
    _UNESCAPE = f"replace({_UNESCAPE}, '{_entity}', '{_sign}')"
_VISIBLE = "html"
for _tag in ("script", "style", "noscript"):
    _VISIBLE = f"regexp_replace({_VISIBLE}, '(?is)<{_tag}[^>]*>.*?</{_tag}>', ' ', 'g')"


def _squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


@query("page_texts", f"""SELECT page_id, md5(t) AS text, length(t) AS n FROM (SELECT page_id,
    {_squeezed(_UNESCAPE.format(f"regexp_replace({_VISIBLE}, '<[^>]+>', ' ', 'g')"))} AS t FROM pages)""")
def page_texts(spark, sf_dir):
    texts = read(spark, sf_dir, "pages").select("page_id", G.page_text(F.col("html")).alias("t"))
    return texts.select("page_id", F.md5("t").alias("text"), F.length("t").alias("n"))


@query("page_titles", f"""SELECT page_id, {_squeezed(_UNESCAPE.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))} AS title,
    '' AS description FROM pages""")
def page_titles(spark, sf_dir):
    return read(spark, sf_dir, "pages").select(
        "page_id", G.page_title(F.col("html")).alias("title"),
        G.meta_description(F.col("html")).alias("description"))


# ---------------------------------------------------------------- rendered pages

def site_pages(spark, sf_dir) -> DataFrame:
    """url, html, mobile_html, detail_html of every posting as its site would show it."""
    rows = postings(spark, sf_dir)
    key = F.col("row_id").cast("string")
    url = (F.when(F.col("qty") == 50, F.lit("https://www.jobkorea.co.kr/Search/?stext=java"))
           .when(F.col("source") == "jobkorea", F.concat(F.lit("https://www.jobkorea.co.kr/Recruit/GI_Read/"), key, F.lit("?Oem=1")))
           .when(F.col("source") == "saramin", F.concat(F.lit("www.saramin.co.kr/zf_user/jobs/relay/view?isMypage=no&rec_idx="), key, F.lit("#seq=0")))
           .otherwise(F.concat(F.lit(" https://WWW.wanted.co.kr/wd/"), key)))
    start, end = F.date_format("start", "yyyy.MM.dd"), F.date_format("end", "yyyy.MM.dd")

    def page(title, description, body):
        return F.concat(
            F.lit("<html><head><title>"), title, F.lit('</title><meta name="description" content="'),
            description, F.lit('"/><script>var t = "</p>";</script></head><body>\n'), body,
            F.lit("</body></html>"))
    jobkorea = page(
        F.concat("company_name", F.lit(" 채용 - "), "title_text", F.lit(" | 잡코리아")),
        F.when(F.col("n_lines") % 2 == 1, F.concat(F.lit("공고 &middot; 마감일 : "), end)).otherwise(F.lit("공고")),
        F.concat(F.lit("<nav>메뉴 취업톡톡</nav> <p>"), "raw_text", F.lit("</p> Q&amp;A"),
                 F.when(F.col("n_lines") == 3, F.lit(" 마감되었습니다")).otherwise(F.lit(""))))
    saramin = page(
        F.concat(F.lit("["), "company_name", F.lit("] "), "title_text", F.lit(" (D-3) - 사람인")),
        F.concat("company_name", F.lit(", "), "title_text", F.lit(", 급구, 경력:경력 3년↑, 학력:대졸"),
                 F.when(F.col("qty") % 2 == 0, F.concat(F.lit(", 마감일:"), F.date_format("end", "yyyy-MM-dd")))
                 .otherwise(F.lit(""))), F.lit("<p>요약</p>"))
    mobile = F.concat(
        F.lit("<div>근무 지역 서울 강남구 역삼동</div>"),
        F.when(F.col("n_lines") >= 3, F.concat(F.lit("<b>시작일</b> "), start, F.lit(" 10:00 <b>마감일</b> "), end))
        .otherwise(F.lit("")))
    wanted = page(
        F.concat("title_text", F.lit(" | 원티드")), F.lit("공고"),
        F.concat(F.lit("<h1>합격보상</h1> 포지션 상세 "), "raw_text", F.lit(" 마감일 "), end,
                 F.lit(" 더 많은 포지션을 찾아보세요")))
    detail = F.when((F.col("source") == "saramin") & (F.col("n_lines") != 5), F.concat(F.lit("<div>"), "raw_text", F.lit("</div>")))
    html = F.when(F.col("source") == "jobkorea", jobkorea).when(F.col("source") == "saramin", saramin).otherwise(wanted)
    return rows.select("row_id", F.col("source").alias("site"), "n_lines", url.alias("url"), html.alias("html"),
                       F.when(F.col("source") == "saramin", mobile).alias("mobile_html"), detail.alias("detail_html"))


@query("url_detection", over_corpus("""
    SELECT row_id, CASE WHEN qty <> 50 THEN source END AS source, CASE WHEN qty <> 50 THEN CAST(row_id AS VARCHAR) END AS job_id,
      CASE WHEN qty = 50 THEN 'no_job_id' END AS detect_error FROM postings
    UNION ALL SELECT -page_id - 1, NULL, NULL, 'unsupported_site' FROM pages"""))
def url_detection(spark, sf_dir):
    own = site_pages(spark, sf_dir).select("row_id", "url")
    given = read(spark, sf_dir, "pages").select((-F.col("page_id") - 1).alias("row_id"), "url")
    return G.detect(own.unionByName(given)).select("row_id", "source", "job_id", "detect_error")


_SITE = f"""
texts AS (SELECT *, CASE source
    WHEN 'jobkorea' THEN company_name || ' 채용 - ' || title_text || ' | 잡코리아 메뉴 취업톡톡 ' || {_squeezed('raw_text')} || ' Q&A'
      || CASE WHEN n_lines = 3 THEN ' 마감되었습니다' ELSE '' END
    WHEN 'saramin' THEN CASE WHEN n_lines = 5 THEN '[' || company_name || '] ' || title_text || ' (D-3) - 사람인 요약' ELSE {_squeezed('raw_text')} END
    ELSE title_text || ' | 원티드 합격보상 포지션 상세 ' || {_squeezed('raw_text')} || ' 마감일 ' || strftime(end_day, '%Y.%m.%d') || ' 더 많은 포지션을 찾아보세요' END AS t FROM postings),
bodies AS (SELECT *, CASE source
    WHEN 'jobkorea' THEN CASE WHEN length(split_part(t, '취업톡톡 ', 2)) >= 200 THEN split_part(t, '취업톡톡 ', 2) ELSE t END
    WHEN 'saramin' THEN t ELSE t END AS body, {_always_open('t')} AS opened FROM texts),
facts AS (SELECT *, CASE source WHEN 'jobkorea' THEN CASE WHEN qty % 9 <> 0 THEN start_day END
      WHEN 'saramin' THEN CASE WHEN n_lines >= 3 THEN start_day END END AS start_date,
    CASE source WHEN 'jobkorea' THEN CASE WHEN qty % 9 <> 0 OR n_lines % 2 = 1 THEN end_day END
      WHEN 'saramin' THEN CASE WHEN n_lines >= 3 OR qty % 2 = 0 THEN end_day END ELSE end_day END AS deadline,
    CASE source WHEN 'jobkorea' THEN CASE WHEN qty < 40 THEN qty END
      WHEN 'saramin' THEN CASE WHEN n_lines % 2 = 1 AND n_lines <> 5 THEN qty END END AS headcount,
    CASE source WHEN 'jobkorea' THEN opened
      WHEN 'saramin' THEN opened OR regexp_matches(body, '채용\\s*시\\s*마감') ELSE false END AS always_open FROM bodies),
headed AS (SELECT *, trim(CASE WHEN start_date IS NOT NULL AND deadline IS NOT NULL
      THEN '접수기간 · 방법 시작일 ' || strftime(start_date, '%Y.%m.%d') || ' 마감일 ' || strftime(deadline, '%Y.%m.%d') || ' '
      WHEN deadline IS NOT NULL THEN '접수기간 · 방법 마감일 ' || strftime(deadline, '%Y.%m.%d') || ' '
      WHEN always_open THEN '접수기간 · 방법 마감일 상시채용 ' ELSE '' END
    || CASE WHEN headcount IS NOT NULL THEN '모집인원 ' || headcount || ' 명' ELSE '' END) AS header FROM facts)
"""


@query("parsed_pages", over_corpus("""
    SELECT row_id, source, CAST(row_id AS VARCHAR) AS job_id,
      CASE source WHEN 'jobkorea' THEN company_name || ' 채용 - ' || title_text
        WHEN 'saramin' THEN '[' || company_name || '] ' || title_text || ' (D-3)' ELSE title_text END AS title,
      CASE WHEN source = 'wanted' THEN '' ELSE company_name END AS company, deadline, start_date,
      headcount, always_open, md5(trim(header || ' ' || body)) AS raw_text,
      CASE WHEN header = '' THEN 1 ELSE 0 END + CASE WHEN start_date IS NULL AND deadline IS NOT NULL THEN 1 ELSE 0 END
      + CASE WHEN length(body) < 300 THEN 1 ELSE 0 END + CASE source
        WHEN 'jobkorea' THEN CASE WHEN qty % 9 = 0 AND deadline IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN n_lines = 3 THEN 1 ELSE 0 END
        WHEN 'saramin' THEN CASE WHEN n_lines < 3 THEN 1 ELSE 0 END ELSE 1 END AS notes
    FROM headed WHERE qty <> 50""", _SITE))
def parsed_pages(spark, sf_dir):
    """Fields, assembled text and diagnostics of every rendered page."""
    found = G.detect(site_pages(spark, sf_dir)).where("job_id is not null")
    out = G.parse_pages(found, True, "row_id")
    return out.select("row_id", "source", "job_id", "title", "company", "deadline", "start_date",
                      F.col("headcount").cast("long").alias("headcount"), "always_open",
                      F.md5("raw_text").alias("raw_text"), F.size("diagnostics").alias("notes"))


def side_table(spark, sf_dir) -> DataFrame:
    """Backfill rows of the saramin pages; some pages are gone, some have no title."""
    rows = site_pages(spark, sf_dir).where("site = 'saramin'")
    html = F.when(F.col("n_lines") == 1, F.lit(None).cast("string")) \
        .when(F.col("n_lines") == 2, F.lit("<html><p>점검 중</p></html>")).otherwise(F.col("html"))
    mobile = F.when(F.col("n_lines") % 2 == 0, F.col("mobile_html"))
    return G.backfill_fields(rows.select(F.col("row_id").cast("string").alias("job_id"),
                                         html.alias("html"), mobile.alias("mobile_html")))


_SIDE = """side AS (SELECT CAST(row_id AS VARCHAR) AS job_id, n_lines,
    CASE WHEN n_lines > 2 THEN title_text || ', 급구' END AS title, CASE WHEN n_lines > 2 THEN company_name END AS company,
    CASE WHEN n_lines > 2 THEN '경력 3년↑' END AS experience_level, CASE WHEN n_lines > 2 THEN '대졸' END AS education,
    CASE WHEN n_lines > 2 AND qty % 2 = 0 THEN strftime(end_day, '%Y-%m-%d') END AS deadline,
    CASE WHEN n_lines > 2 AND n_lines % 2 = 0 THEN '서울 강남구' END AS location,
    CASE n_lines WHEN 1 THEN 'not_found' WHEN 2 THEN 'parse_failed' ELSE 'ok' END AS status FROM postings WHERE source = 'saramin')"""


@query("backfill_fields", over_corpus("SELECT * EXCLUDE (n_lines) FROM side", _SIDE))
def backfill_fields(spark, sf_dir):
    return side_table(spark, sf_dir)


@query("backfill_title_tags", over_corpus("""
    SELECT row_id, company_name AS company, title_text AS title FROM postings WHERE source = 'saramin'
    UNION ALL SELECT row_id, NULL, title_text || ' | 원티드' FROM postings WHERE source = 'wanted'"""))
def backfill_title_tags(spark, sf_dir):
    """Company and title from the title element alone."""
    rows = site_pages(spark, sf_dir).where("site <> 'jobkorea'")
    tag = G.parse_title_tag(G.page_title(F.col("html")))
    return rows.select("row_id", *(c.alias(k) for k, c in tag.items()))


@query("backfill_status", over_corpus("SELECT status, count(*) AS n FROM side GROUP BY status", _SIDE))
def backfill_status(spark, sf_dir):
    return G.backfill_status(side_table(spark, sf_dir))


@query("backfill_coverage", over_corpus(" UNION ALL ".join(
    f"SELECT '{f}' AS field, count({f}) AS filled, count(*) AS n FROM side WHERE status = 'ok'" for f in G.FIELDS), _SIDE))
def backfill_coverage(spark, sf_dir):
    return G.backfill_coverage(side_table(spark, sf_dir))


@query("backfill_targets", over_corpus("""
    SELECT job_id FROM postings WHERE source = 'saramin' AND job_id NOT IN (
      SELECT job_id FROM postings WHERE source = 'saramin' AND n_lines > 3)"""))
def backfill_targets(spark, sf_dir):
    """job_ids still to fetch, given what an earlier run already stored."""
    rows = postings(spark, sf_dir)
    done = rows.where("source = 'saramin' and n_lines > 3").select("job_id").distinct()
    return G.backfill_targets(rows, done)


@query("pasted_postings", over_corpus(f"""
    SELECT row_id, 'unknown' AS source, {"trim(raw_text, ' ' || chr(10))"} AS raw_text,
      CASE WHEN source = 'jobkorea' AND qty % 9 <> 0 THEN end_day END AS deadline, 1 AS notes FROM postings"""))
def pasted_postings(spark, sf_dir):
    out = G.from_text(postings(spark, sf_dir), "raw_text", "unknown", "row_id")
    return out.select("row_id", "source", "raw_text", "deadline", F.size("diagnostics").alias("notes"))
