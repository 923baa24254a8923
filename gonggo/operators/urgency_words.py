"""Fixed values of the hiring-urgency rule: markers, patterns, weights, labels.

They must equal the published rule for its labels to come out the same.
Patterns are in the notation of `gonggo.functions.regex.rx`.
"""

from __future__ import annotations

# --- what is cut from a jobkorea page before signals are read
TAIL_MARKERS = ("본 채용정보는", "로그인 하고 비슷한 조건의", "관련 태그")
DISCLAIMER = r"마감일은\s*기업의\s*사정으로\s*인해\s*조기\s*마감\s*또는\s*변경될\s*수\s*있습니다"
APPLICANT_STATS = r"(?s)지원자\s*현황\s*통계.{0,80}?지원자\s*수\s*[0-9,]+\s*명"

# --- application window
DATE = r"(20[0-9]{2})\s*[-.년]\s*([0-9]{1,2})\s*[-.월]\s*([0-9]{1,2})\s*일?"
START_END = (r"시작일\s*(20\d\d)\.(\d{1,2})\.(\d{1,2})[^0-9]{0,8}"
             r"마감일\s*(20\d\d)\.(\d{1,2})\.(\d{1,2})")
PERIOD = r"(?s)접수\s*기간(.{0,90})"
ROLLING = r"채용\s*시\s*마감|채용시까지|채용\s*시\s*까지"
ALWAYS_OPEN = r"마감일\s*상시채용|상시\s*채용|수시\s*채용|상시\s*모집|연중\s*수시"
ALWAYS_OPEN_DENIED = r"개인정보|보호법|신용정보|동의"
ALWAYS_OPEN_FIELDS = (
    PERIOD,
    r"(?s)마감일(.{0,20})",
    r"(?s)본\s*공고는(.{0,40})",
)
TITLE_CHARS = 150
TITLE_END = r"(?s)^(.*?)(?:상세요강|추천공고|\z)"
ROLLING_REACH = 40
MAX_WINDOW_DAYS = 400
DAYS_LEFT = r"남은기간\s*([0-9]+)\s*일"

# --- other signals
HEADCOUNT = r"모집인원\s*([0-9]+)\s*명"
HEADCOUNT_LOOSE = r"([0-9]{1,3})\s*명\s*(?:내외\s*)?(?:모집|채용|선발)"
MANY = r"다수\s*(?:모집|채용|선발)|각\s*부문\s*(?:별\s*)?(?:다수|모집)"
URGENT = r"급구|긴급\s*채용|긴급채용|시급히|서둘러"
IMMEDIATE = r"즉시\s*(?:입사|출근|근무|투입|합류)|바로\s*출근|조속히|즉시\s*채용"
BACKFILL = r"결원|충원|대체\s*인력|공석"
EARLY_CLOSE = r"조기\s*마감|마감\s*임박|충원\s*시\s*마감|채용\s*시\s*마감"
BONUS = r"합격\s*축하금|입사\s*축하금|사이닝\s*보너스|정착\s*지원금"
META_SECTION = r"접수\s*기간|접수기간|모집\s*인원|모집인원|마감일|남은기간"

# --- weights: (upper limit, points, note)
WINDOW_TIERS = ((3, 30, "초단기 모집"), (7, 22, "단기"), (14, 12, ""), (30, 4, ""),
                (None, 0, "장기"))
DAYS_LEFT_TIERS = ((2, 45, "임박"), (5, 35, ""), (10, 22, ""), (20, 12, ""),
                   (40, 5, "여유"), (None, 0, "장기"))
HEADCOUNT_TIERS = ((10, 28, "(대규모)"), (5, 20, ""), (2, 11, ""))
ROLLING_POINTS = 10
ALWAYS_OPEN_POINTS = 10
MANY_POINTS = 12
EARLY_CLOSE_POINTS = 12
ROLLING_REASON = "채용 시 마감(충원되면 조기 종료)"
ALWAYS_OPEN_REASON = "상시·수시 채용(지속 수요)"
MANY_REASON = "다수 모집"
EARLY_CLOSE_REASON = "조기 마감 가능성 언급"
FLAG_SIGNALS = (
    ("urgent", URGENT, 32, "급구·긴급 채용 명시"),
    ("immediate", IMMEDIATE, 22, "즉시 입사·투입 요구"),
    ("backfill", BACKFILL, 16, "결원·충원 목적"),
)
BONUS_SIGNAL = ("bonus", BONUS, 12, "합격축하금 등 보상 유인")

# --- vocabulary used where a posting has no recruiting section: (name, pattern, points)
VOCABULARY = (
    ("급구·긴급채용", r"급구|긴급\s*채용|긴급\s*모집", 2),
    ("즉시 합류 요구",
     r"즉시\s*(?:합류|입사|출근|근무\s*가능)|바로\s*(?:합류|입사|출근)|조속한\s*합류|ASAP|asap", 2),
    ("충원·결원", r"충원|결원|공석|대체\s*인력", 2),
    ("마감 압박", r"조기\s*마감|채용\s*시\s*마감|상시\s*채용|수시\s*채용", 2),
    ("다수 모집",
     r"다수\s*(?:모집|채용)|여러\s*명\s*(?:모집|채용)|[0-9]{1,2}\s*명\s*(?:모집|채용|충원)", 2),
    ("급성장 조직", r"급성장|고속\s*성장|빠른\s*성장|가파른\s*성장|폭발적\s*성장|스케일\s*?업", 1),
    ("조직 신설·초기 멤버",
     r"신규\s*(?:팀|조직|부서)|초기\s*멤버|창립\s*멤버|파운딩\s*멤버|태스크\s*포스|조직\s*신설|팀\s*빌딩|0\s*to\s*1",
     1),
    ("증원·조직 확장", r"조직\s*확(?:장|대)|인원\s*(?:확대|충원|증원)|팀\s*확(?:장|대)|채용\s*확대", 1),
    ("빠른 합류·투입", r"빠르게\s*(?:합류|적응|투입)|빠른\s*투입|빠른\s*온보딩", 1),
    ("속도 지향 문화",
     r"빠른\s*(?:의사\s*결정|의사결정|실행|배포|이터레이션|사이클|대응|피드백|성장)|"
     r"빠르게\s*(?:성장|실행|배포|개선|대응)|신속(?:한|히)\s*(?:대응|실행|처리|이해)|애자일|스프린트", 1),
)

# --- levels
LEVEL_LIMITS = ((0, 1), (14, 2), (26, 3), (42, 4))
TOP_LEVEL = 5
LEVEL_NAMES = {1: "매우 낮음", 2: "낮음", 3: "보통", 4: "높음", 5: "매우 높음"}

# --- reason sentences; {level} and {name} are filled per row
REASON_HEAD = "적극성 "
REASON_DASH = " — "
REASON_JOIN = " · "
REASON_NO_SIGNAL = {
    "v5": "채용 메타데이터는 있으나 접수 기간·모집 규모·즉시 입사·결원 충원 등 적극성 신호가 확인되지 않음",
    "v2": "채용 메타데이터는 있으나 마감 임박·모집 규모·즉시 입사·결원 충원 등 적극성 신호가 확인되지 않음",
}
REASON_BASE_ONLY = {
    "v5": (" — 마감·모집 규모 정보가 없어 측정할 수 없고 본문에 긴급 어휘도 없다. 관측이 아니라 기준점(",
           "점)을 부여한 값이다"),
    "v2": ("(중립) — 마감·모집 규모 정보가 없고 본문에 긴급 관련 어휘도 없어 기준점 부여", None),
}
REASON_VOCABULARY = {
    "v5": (" — 마감 정보가 없어 측정 불가. 본문 어휘로만 추정: ", " (검증되지 않은 폴백)"),
    "v2": (" — 마감 정보는 없으나 본문 어휘에서 긴급 정황 감지: ", ""),
}

FEATURE_NAMES = (
    "window_days", "window_missing", "rolling", "headcount", "headcount_missing",
    "is_urgent_word", "is_immediate", "is_backfill", "is_early_close",
    "has_bonus", "is_many",
)
