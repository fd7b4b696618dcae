"""Fixed values and settings of the evaluation domain, in one place and overridable by arguments."""

from __future__ import annotations

from dataclasses import dataclass, field

# They decide results and must stay as they are.
NEWS_STOPWORDS = ("그리고", "그러나", "대한", "관련", "기반", "방법", "시스템", "제공", "포함", "단계", "통해", "있는", "있다", "한다")
EXCLUDED_LABELS = ("", "기타", "etc", "ETC", "기타/미정")
DOCUMENT_INDICATORS = {
    "embodiment_mentions": r"실시예|실시\s*형태|example|embodiment|実施例|実施形態|实施例|具体实施方式",
    "figure_mentions": r"(?:도|도면|fig(?:ure)?\.?|図|附图)\s*\d+",
    "formula_mentions": r"수학식|산식|equation|formula|式\s*\d+|公式",
    "parameter_mentions": r"파라미터|매개변수|임계값|가중치|parameter|threshold|weight|閾値|参数|阈值",
    "data_structure_mentions": r"데이터\s*구조|테이블|리스트|배열|행렬|벡터|그래프|data\s*structure|table|list|array|matrix|vector|graph",
    "input_output_mentions": r"입력|출력|input|output|入力|出力|输入|输出",
    "condition_branch_mentions": r"조건|분기|경우|이면|반복|\b(?:condition|branch|if|when|loop)\b|条件|分岐|分支",
    "control_mentions": r"제어|피드백|상태|동기화|control|feedback|state|synchroni[sz]|制御|控制|反馈",
    "step_reference_mentions": r"\bS\d{2,4}\b|단계|step\s*\d+|ステップ|步骤",
}
#: The characters that each indicator can begin with, in one case.
INDICATOR_STARTS = {
    "embodiment_mentions": "실e実实具", "figure_mentions": "도f図附", "formula_mentions": "수산ef式公", "parameter_mentions": "파매임가ptw閾参阈", "data_structure_mentions": "데테리배행벡그dtlamvg",
    "input_output_mentions": "입출io入出输", "condition_branch_mentions": "조분경이반cbiwl条分", "control_mentions": "제피상동cfs制控反", "step_reference_mentions": "s단ス步",
}
TECHNOLOGY_CANDIDATES = {
    "configuration_operation_differentiation": (0, 10, 20, 30),
    "effect_differentiation": (0, 6, 12, 18),
    "imitation_avoidance_difficulty": (0, 4, 8, 12),
    "component_specificity": (0, 6, 11, 16),
    "procedure_specificity": (0, 6, 11, 16),
    "implementation_utilization_specificity": (0, 2, 6, 8),
}
LEGAL_MAXIMA = {"right_stability": 40, "claim_protection": 40, "portfolio_defensive_value": 20}
BUSINESS_FIT_MAXIMA = {"official_business_evidence": 30, "product_function_direct_match": 45, "business_context_fit": 25}
CAGR_POINTS = ((0.15, 10), (0.08, 8), (0.03, 6), (0.0, 4))
CITATION_TYPE_TIERS = (("E0802", "E0805"), ("E0801",), ("E0806",))


@dataclass(frozen=True)
class Valuation:
    """Weights of the three core axes, grade cutoffs and the business-fit score that overrides a grade."""

    weights: dict[str, float] = field(default_factory=lambda: {"legal": 34.0, "technology": 33.0, "market": 33.0})
    cutoff_a: float = 70.0
    cutoff_b: float = 50.0
    override: float = 60.0

    def __post_init__(self):
        if any(w <= 0 for w in self.weights.values()) or not 100 >= self.cutoff_a > self.cutoff_b >= 0:
            raise ValueError("weights must be positive, and 100 >= A > B >= 0")


MAX_NEWS_AGE_DAYS = 5 * 365
REPORT_SCORE_LEAST = 0.5
STATE_TTL_HOURS, STATE_MOST = 6, 1024
RATE_WINDOW_SECONDS, RATE_MOST = 60, 120

# Fixed values of patent documents: headings in four languages and the sections they open, in the order of their sources.
SECTION_ALIASES = {
    "요약": "abstract", "청구범위": "claims_text", "기술분야": "technical_field", "배경기술": "background_art", "해결하려는 과제": "problem",
    "과제의 해결 수단": "solution", "발명의 효과": "effect", "도면의 간단한 설명": "figure_description",
    "발명을 실시하기 위한 구체적인 내용": "detailed_description", "부호의 설명": "reference_signs",
    "摘要": "abstract", "权利要求书": "claims_text", "技术领域": "technical_field", "背景技术": "background_art", "发明内容": "solution",
    "附图说明": "figure_description", "具体实施方式": "detailed_description",
    "要約": "abstract", "特許請求の範囲": "claims_text", "技術分野": "technical_field", "背景技術": "background_art",
    "発明が解決しようとする課題": "problem", "課題を解決するための手段": "solution", "発明の効果": "effect", "図面の簡単な説明": "figure_description",
    "発明を実施するための形態": "detailed_description",
    "ABSTRACT": "abstract", "CLAIMS": "claims_text", "FIELD OF THE INVENTION": "technical_field", "TECHNICAL FIELD": "technical_field",
    "BACKGROUND": "background_art", "BACKGROUND OF THE INVENTION": "background_art", "SUMMARY": "solution",
    "SUMMARY OF THE INVENTION": "solution", "BRIEF DESCRIPTION OF THE DRAWINGS": "figure_description",
    "DETAILED DESCRIPTION": "detailed_description", "DETAILED DESCRIPTION OF THE EMBODIMENTS": "detailed_description",
}
MORE_HEADINGS = ("명세서", "발명의 설명", "발명의 내용", "発明の詳細な説明", "発明の概要")
BRACKET_HEADINGS = ("特許請求の範囲", "発明の詳細な説明", "技術分野", "背景技術", "発明の概要", "発明が解決しようとする課題", "課題を解決するための手段", "発明の効果", "図面の簡単な説明", "発明を実施するための形態")
HEADER_SPELLINGS = {"명 세 서": "명세서", "기 술 분 야": "기술분야", "배 경 기 술": "배경기술"}
US_SECTIONS = {
    "technical_field": ("TECHNICAL FIELD", "FIELD OF THE INVENTION"), "background_art": ("BACKGROUND ART", "BACKGROUND"), "problem": ("DISCLOSURE", "Technical Problem"),
    "solution": ("Technical Solution", "SUMMARY OF THE INVENTION", "SUMMARY"), "effect": ("Advantageous Effects",),
    "detailed_description": ("DETAILED DESCRIPTION", "DESCRIPTION OF THE EMBODIMENTS", "DESCRIPTION OF EMBODIMENTS", "BEST MODE FOR CARRYING OUT THE INVENTION", "MODE FOR CARRYING OUT THE INVENTION", "MODE FOR THE INVENTION", "BEST MODE"),
}
US_STOPS = (
    "TECHNICAL FIELD", "FIELD OF THE INVENTION", "BACKGROUND ART", "BACKGROUND", "DISCLOSURE", "SUMMARY OF THE INVENTION", "SUMMARY",
    "BRIEF DESCRIPTION OF THE DRAWINGS", "BRIEF DESCRIPTION OF DRAWINGS", "DESCRIPTION OF THE DRAWINGS", "DESCRIPTION OF DRAWINGS", "DESCRIPTION",
    "DETAILED DESCRIPTION", "BEST MODE FOR CARRYING OUT THE INVENTION", "MODE FOR CARRYING OUT THE INVENTION", "BEST MODE", "What is claimed is", "The invention claimed is",
)
FIGURE_PAGE_ENDS = (r"^\s*(?:US\s+\d[\d,\s]*[A-Z]?\d?\s*$|[\d,]+\s+[A-Z]\d?\s*$|\d+\s*$)", r"^\s*[\d,]+\s+[A-Z]\d?\s+\d+\s*$")
# Patterns that decide what is cut from patent documents. `\z` is the end of the text.
COVER_ABSTRACTS = (
    r"\(57\)\s*요\s*약\s*(.+?)(?=\n#{0,6}\s*명세서|\n청구범위|\n####|\n명세서)",
    r"\(57\)\s*摘要\s*(.+?)(?=\n(?:CN\s*\d+\s*[A-Z]?|1\.\s*一种|权利要求书|技术领域|背景技术|发明内容|附图说明|具体实施方式)\s*$)",
    r"\(57\)\s*ABSTRACT\s*(.+?)(?=\n#{0,6}\s*(?:BACKGROUND|FIELD OF THE INVENTION|TECHNICAL FIELD|CLAIMS?)\s*$)",
)
US_ABSTRACT = r"\b(?:\(\s*(?:57|67)\s*\)\s*)?ABSTRACT\b[:\s]*(.+?)(?=^\s*(?:TECHNICAL FIELD|FIELD OF THE INVENTION|BACKGROUND ART|BACKGROUND|DISCLOSURE|SUMMARY OF THE INVENTION|SUMMARY|BRIEF DESCRIPTION OF DRAWINGS|DESCRIPTION|DETAILED DESCRIPTION|BEST MODE)\b|\z)"
US_CLAIMS = r"\b(?:What is claimed is|The invention claimed is)\s*:?\s*(.+?)(?=^\s*(?:TECHNICAL FIELD|BACKGROUND ART|BACKGROUND|DISCLOSURE|BRIEF DESCRIPTION OF DRAWINGS|DESCRIPTION|DETAILED DESCRIPTION|BEST MODE)\b|\z)"
PAGE_NOISE = (
    r"^\s*US\s+\d[\d,]*\s*[A-Z]\d?\s*$",
    r"^\s*U\.S\.\s+Patent(?:ed)?\b.*$",
    r"^\s*(?:Sheet|heet)\s+\d+\s+of\s+\d+\s*$",
    r"^\s*Page\s+\d+\s*$",
    r"^\s*\d+\s*$",
)
MISREADINGS = ((r"\bAl\b", "AI"), (r"(?i)\bleaming\b", "learning"))
NEXT_SECTION = r"^#?\s*(발명의 설명|기술분야|배경기술|발명의 내용|해결하려는 과제|과제의 해결 수단|발명의 효과|도면의 간단한 설명|발명을 실시하기 위한 구체적인 내용|부호의 설명)\s*$"
FIGURE_CAPTION = r"^\s*FIG(?:S)?\s*\.\s*[\d\s,toand]+"
DRAWING_HEADINGS = ("도면의 간단한 설명", "도면")
BEHIND_DRAWINGS = ("발명을 실시하기 위한 구체적인 내용", "발명의 설명", "기술분야", "배경기술")
CLAIM_DEPENDENCY = (
    r"(?:청구항|제)\s*(\d+)\s*항?"
    r"(?:\s*(?:내지|또는|및)\s*(?:청구항|제)?\s*\d+\s*항?)*"
    r"\s*(?:중\s*)?(?:어느\s*(?:한|하나의?)\s*항)?"
    r"\s*(?:에\s*있어서|에\s*기재된|에\s*따른|에\s*의한|에\s*있어|에서|의\s|에\s)"
)
ENGLISH_DEPENDENCY = r"claims?\s*(\d+)"
JAPANESE_OWN_THING = r"請求項[0-9０-９]+(?:(?:又は|若しくは|ないし|乃至|～|〜|-)[0-9０-９]+)?記載の.+?(?:システム|装置|プログラム|記録媒体)であって"
JAPANESE_DEPENDENCY = r"請求項([0-9０-９]+)(?:(?:又は|若しくは|ないし|乃至|～|〜|-)[0-9０-９]+)?(?:のいずれか(?:１|1)項)?(?:に記載|記載)"
ERA_STARTS = {"昭": 1925, "平": 1988, "令": 2018}
REGIONS = ("서울", "경기", "대전", "부산", "인천", "광주", "대구", "울산", "세종", "강원", "충청", "충북", "충남", "전라", "전북", "전남", "경상", "경북", "경남", "제주")
REQUIRED_IDENTIFIERS = ("title", "application_number", "registration_number")

# Industries and their keywords, the more special industry first, which settles ties.
INDUSTRY_KEYWORDS = {
    "반도체": ("반도체", "웨이퍼", "파운드리", "포토", "식각", "증착", "집적회로", "패키징", "semiconductor", "wafer", "foundry", "euv"),
    "이차전지": ("이차전지", "배터리", "리튬", "양극재", "음극재", "전해질", "분리막", "battery", "lithium", "ess"),
    "디스플레이": ("디스플레이", "유기발광", "발광다이오드", "화소", "패널", "oled", "lcd", "qled", "display"),
    "자동차": ("자동차", "차량", "전기차", "자율주행", "모빌리티", "파워트레인", "vehicle", "automotive", "adas"),
    "바이오헬스": ("바이오", "헬스케어", "의료기기", "제약", "신약", "진단", "임상", "유전자", "생명공학", "medical", "healthcare", "biotech", "pharma"),
    "핀테크": ("핀테크", "금융", "결제", "자산배분", "포트폴리오", "로보어드바이저", "보험", "은행", "웰스", "fintech", "payment"),
    "조선": ("조선", "선박", "해양플랜트", "운반선", "의장", "shipbuilding", "vessel"),
    "철강": ("철강", "제철", "강판", "압연", "고로", "steel"),
    "석유화학": ("석유화학", "폴리머", "고분자", "수지", "촉매", "petrochemical", "polymer"),
    "정유": ("정유", "원유", "윤활유", "정제", "refinery"),
    "섬유": ("섬유", "원단", "직물", "방적", "의류", "textile", "fabric"),
    "정보통신기기": ("이동통신", "무선통신", "기지국", "네트워크장비", "라우터", "사물인터넷", "단말기", "telecom", "5g", "6g", "iot"),
    "가전": ("가전", "냉장고", "세탁기", "에어컨", "청소기", "공기청정기", "appliance"),
    "일반기계": ("공작기계", "산업용로봇", "자동화설비", "감속기", "베어링", "유압", "공압", "machinery", "robot"),
    "AI": ("인공지능", "머신러닝", "딥러닝", "기계학습", "신경망", "자연어", "컴퓨터비전", "강화학습", "생성형", "대규모언어", "초거대", "ai", "ml", "llm", "genai"),
}
COMMON_INDUSTRY = "공통"

# Fixed values of the axes' rules.
TECHNOLOGY_GROUPS = {
    "technical_differentiation": (60, ("configuration_operation_differentiation", "effect_differentiation", "imitation_avoidance_difficulty")),
    "implementation_specificity": (40, ("component_specificity", "procedure_specificity", "implementation_utilization_specificity")),
}
LEGAL_DETAIL_MAXIMA = {"prior_art_overlap": ("right_stability", 20), "follow_on_right_signal": ("portfolio_defensive_value", 4)}
MARKET_PARTS, MARKET_PART_MOST = ("industry_marketability", "global_business", "competitiveness", "invention_market_linkage"), 20
MARKET_SIGNALS = ("도입", "출시", "상용", "제품", "서비스", "적용", "확산", "고객", "수요", "규제", "시장", "adoption", "launch", "commercial", "deployment", "product", "service", "demand", "customer", "regulation", "market")
GLOBAL_HINTS = ("global", "international", "worldwide", "across europe", "across asia", "across markets", "overseas", "cross-border", "multi-country", "multinational", "유럽", "아시아", "글로벌", "국가", "해외")
CONCRETE_PATHS = ("/finance", "/manufacturing", "/case-study", "/story", "/solution", "/service", "/industry", "/enterprise", "/security", "/blockchain")
TREND_PATHS = ("/insight", "/trend")
INACTIVE_STATES, ACTIVE_STATES = ("소멸", "거절", "취하", "포기"), ("등록", "유효")
FOREIGN_PATH_WORDS = ("aicc",)
SKIPPED_FILES = (".pdf", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".zip")
TITLE_STOPWORDS = ("및", "또는", "으로", "에서", "에게", "하는", "위한", "통한", "기반", "적용한", "상품", "트렌드", "반영한", "모델", "시스템", "방법", "장치", "프로그램")
BROAD_TERMS = ("ai", "data", "cloud", "서비스", "플랫폼", "자동화", "보안", "인증")
PARTICLES = ("으로", "에서", "에게", "부터", "까지", "을", "를", "은", "는", "이", "가", "의", "와", "과", "한")
DOMAIN_PROFILES = {
    "finance": {"triggers": ("로보어드바이저", "자산배분", "투자", "포트폴리오", "금융", "예측"), "hints": ("금융", "투자", "자산관리", "AI", "예측", "데이터 서비스"), "paths": ("/finance",)},
    "blockchain_security": {"triggers": ("블록체인", "chainz", "합의", "서명", "인증"), "hints": ("블록체인", "인증", "보안", "디지털 자산"), "paths": ("/blockchain", "/security", "/trust")},
    "manufacturing_smart_factory": {"triggers": ("cmp", "반도체", "제조", "공정", "물류", "설비", "agv", "컨베이어", "스마트팩토리"), "hints": ("제조", "스마트팩토리", "MCS", "공정", "물류", "자동화", "설비", "설비 제어"), "paths": ("/manufacturing", "/industry", "/smart-factory", "/enterprise")},
}

# Fixed values of industry reports.
REPORT_INDUSTRIES = ("자동차", "조선", "일반기계", "철강", "정유", "석유화학", "섬유", "가전", "정보통신기기", "디스플레이", "이차전지", "바이오헬스", "반도체")
BODY_STARTS = (r"^□\s*", r"^○\s*", r"^\(\d+\)\s*", r"^\d+\.\s+")
PAGE_FOOTERS = (r"^\d+\s+2026년\s+경제[ㆍ·]?산업\s+전망", r"^\d+\s+KIET\s+경제", r"^제\d+장\s+.+\s+\d+$")
IMPRINT_MARKS = ("발 행 일", "발 행 인", "발 행 처", "ISSN", "무단 복제")
CHAPTER_LINE = r"^제\d+장\s+(.+?산업)\s*[·.\s]{3,}\s*(\d{1,3})$"
INDEX_NOISE_MARKERS = ("appendix", "references", "bibliography", "doi.org", "figure a", "table a", "endnotes", "acknowledgments")
INDEX_TITLE, INDEX_LAST_PAGE, INDEX_LEAST_CHARS, INDEX_CHUNK = "AI INDEX REPORT", 384, 350, (500, 60)
FRONT_SECTIONS = ("Contents", "Foreword", "Building strategic foresight", "Introduction", "Methodology")
SENTENCE_STARTS = (" The ", " This ", " In ", " As ", " Across ", " Since ", " While ", " Source:", " Figure ")
NUMBERED_HEADING = r"\b([0-9]+\.[0-9]+\s+[A-Z][A-Za-z0-9&/,\- ]{2,120})"
FOOTNOTE_START = r"^[0-9]+\s+(Each|Due|For more|The full|National|All data|The LinkedIn)\b"
SOURCE_NOTE_START = r"^[0-9]+\s+Data source:"
ROUNDING_NOTES = ("for the sake of brevity", "figures may not add up", "percentage points are rounded")
SECTION_LEAST_CHARS, REPORT_FIRST_PAGE = 120, 16
REPORT_SECTION_KEYS = {"2": "evaluationScope", "3": "judgmentBasis", "4": "axisDetails", "5": "roleChecklist", "6": "finalOpinion"}
EXTERNAL_EVIDENCE_AXES = ("market", "business_fit")
AXIS_STATES = ("passed", "valuation_retry", "query_rewriting")

# Fixed values of news articles.
ARTICLE_LEAST_CHARS, NOISE_MOST_SHARE = 400, 0.25
BOILERPLATE = (
    "advertisement", "copyright", "all rights reserved", "all contents copyright", "recommended articles", "related articles", "newsletter", "subscribe", "sign in", "sign up",
    "click here", "photo by", "getty images", "연합뉴스", "무단전재", "무단 전재", "재배포 금지", "무단복제", "저작권자", "저작권", "광고", "추천기사", "관련기사", "관련 기사",
    "많이 본 뉴스", "인기뉴스", "주요뉴스", "함께 보면 좋은", "구독", "로그인", "회원가입", "제보", "카카오톡", "네이버에서",
)
NOISE_WORDS = ("광고", "추천", "관련기사", "copyright", "subscribe", "newsletter", "login", "구독", "로그인", "회원가입")
BYLINES = (r"^[가-힣]{2,4}\s*기자\s*[a-z0-9_.+-]+@[a-z0-9.-]+$", r"^[가-힣]{2,4}\s*기자$", r"^[a-z .'-]+\s+reports\s+")
PORTALS = ("네이버 뉴스", "다음 뉴스", "Google News", "Yahoo News")
# Fixed values of applicants, claims and market linkage.
ORGANISATION_MARKS = ("주식회사", "(주)", "㈜", "회사", "법인", "대학", "학교", "연구원", "연구소", "재단", "공사", "청", "청장", "CORP", "INC", "LTD", "CO.", "UNIV")
BLANK_COMPANIES = ("n/a", "na", "none", "null", "-", "기타", "해당사항없음", "해당 사항 없음")
JOINT_MARKS = ("1", "true", "y", "yes", "공동", "공동출원")
INDEPENDENT_MARKS, DEPENDENT_MARKS = ("독립", "独立", "獨立"), ("종속", "従属", "従屬", "從屬", "从属")
# Patterns of claims in running texts of foreign documents.
FOREIGN_CLAIM_MARKERS = (
    r"\bwhat\s+is\s+claimed\s+is\s*:",
    r"\bwe\s+claim\s*:",
    r"^\s*#{1,6}\s*claims?\s*$",
    r"^\s*claims?\s*$",
    r"^\s*权利要求书\s*$",
    r"^\s*申請專利範圍\s*$",
)
FOREIGN_CLAIM_STARTS = (
    r"(?i)^\s*(?:claim|claims?)\s*([0-9]+)\s*[:.)-]?\s*(.*)$",
    r"^\s*【\s*第\s*([0-9]{1,3})\s*項\s*】\s*(.*)$",
    r"^\s*([0-9]{1,3})\s*[、．]\s*(.*)$",
    r"^\s*-?\s*([0-9]{1,3})\s*[.)]\s*(.*)$",
    r"^\s*权利要求\s*([0-9]+)\s*(.*)$",
)
FOREIGN_PAGE_END = r"^\s*##\s*페이지\s+\d+\s*$"
FOREIGN_CLAIM_NOISE = (
    r"^!\[",
    r"(?i)^#{2,6}\s*(?:페이지\s+\d+|OCR 텍스트)$",
    r"(?i)^```(?:text)?$",
    r"^\d{1,3}$",
    r"^\d{6,}[\d.\s]*.*第.*(?:页|頁|丰)\s*$",
)
FOREIGN_MISREAD_ONE = r"(权利要求)\s*[|Il](?=\s|所述|记载|記載|的)"
FOREIGN_DEPENDENCIES = (r"claims?\s*([0-9]+)\b", r"权利要求\s*([0-9]+)", r"申請專利範圍\s*第?\s*([0-9]+)\s*項")
FOREIGN_CLAIM_LEAST, FOREIGN_CLAIM_MOST, CLAIM_DESCRIPTION_MOST = 20, 5_000, 12_000

# Fixed values of structures made in two passes.
NULLISH = ("null", "none", "n/a", "nan", "")
ELEMENT_ROLES, ROLES_OF_PARTS = ("essential", "supporting"), ("essential", "supporting", "limiter")
CLAIM_CLARITIES, OBSERVABILITIES, COUPLINGS = ("self_clear", "spec_resolved", "unresolved"), ("external", "inferable", "internal"), ("strong", "weak")
LINKAGE_ACTIONS = ("스킵", "판단", "비교", "조정", "결합", "예측", "최적화", "반영", "산출", "검증", "리밸런싱", "배분", "동일", "해시", "복원")
GENERIC_ELEMENTS = ("통신부", "프로세서", "저장부", "저장부 (스토리지)", "메모리 영역", "메모리 영역 (memory pool)", "시스템", "장치", "서버")
LINKAGE_SECTIONS = ("과제해결수단", "효과", "발명의효과")
CONNECTIVES = ("그러므로", "따라서", "으로써", "함으로써", ". ")
