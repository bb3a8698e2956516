"""Fixed values the engine must share with the document format it reads.

Word lists, label tables, code points and patterns below are data: they are
written out plainly, in natural order, because any other value would change
results.  Patterns use Java regex syntax (``(?U)`` = Unicode classes,
``(?d)`` = only ``\\n`` ends a line).
"""

# --- fixed values: white space as Unicode-aware text stripping sees it -------
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Non-characters used as in-row separators while a text is being cut up.  They
# are not valid in interchange text, so they cannot collide with content.
CUT = "\ufdd0"
PART = "\ufdd1"
HARD = "\ufdd2"
SOFT = "\ufdd3"

# --- fixed values: metadata fields and their defaults ------------------------
METADATA_DEFAULTS = {
    "title": "IB Report",
    "subtitle": "",
    "company": "Korea Development Bank",
    "ticker": "",
    "sector": "SECTOR",
    "analyst": "DCM Team 1",
}
PLACEHOLDER_VALUES = ("SECTOR", "N/A", "IB REPORT")

# --- fixed values: bold labels that fill metadata fields ---------------------
LABEL_FIELDS = {
    "기준일": "date",
    "as of": "date",
    "작성일": "date",
    "report date": "date",
    "date": "date",
    "분석 대상 기간": "analysis_period",
    "analysis period": "analysis_period",
    "분석 기준": "analysis_basis",
    "analysis basis": "analysis_basis",
    "prepared by": "analyst",
    "작성자": "analyst",
    "analyst": "analyst",
    "institution": "company",
    "company": "company",
    "기관": "company",
    "sector": "sector",
    "업종": "sector",
    "prepared for": "recipient",
    "recipient": "recipient",
    "수신": "recipient",
}

# --- fixed values: words that open a reference region ------------------------
REFERENCE_KEYWORDS = (
    "works cited",
    "references",
    "sources",
    "citations",
    "참고문헌",
    "출처",
)

# --- fixed values: subject delimiters and report suffixes in titles ----------
SUBJECT_DELIMITERS = (" — ", " - ", " – ", ": ")
REPORT_SUFFIXES = (
    r"\s+수익성\s+변화\s+분석\s+보고서$",
    r"\s+수익성\s+분석\s+보고서$",
    r"\s+분석\s+보고서$",
    r"\s+보고서$",
    r"\s+리포트$",
)

# --- fixed values: callout labels --------------------------------------------
CALLOUT_LABELS = (
    "시사점", "참고", "주의", "결론", "요약", "핵심",
    "KEY INSIGHT", "NOTE", "WARNING",
)
DEFAULT_CALLOUT = "KEY INSIGHT"

# --- fixed values: box-drawing characters counted in code blocks -------------
BOX_CHARS = "┌┐└┘│─├┤┬┴┼╔╗╚╝║═╠╣╦╩╬→←↑↓▶◀▲▼►◄━"
BOX_THRESHOLD = 20

# --- fixed values: table header keywords, in order of precedence -------------
TABLE_KEYWORDS = {
    "UPSIDE_DOWNSIDE": ("upside", "downside", "상승", "하락", "요인"),
    "BEP_SENSITIVITY": (
        "bep", "sensitivity", "cmr", "contribution margin", "fixed cost",
        "손익분기", "민감도", "고정비", "변동비",
    ),
    "RISK_MATRIX": (
        "risk", "impact", "probability", "likelihood",
        "리스크", "위험", "영향", "확률",
    ),
    "FINANCIAL": (
        "revenue", "income", "ebitda", "profit", "margin", "expense",
        "매출", "수익", "이익", "손익", "순이익", "영업", "비용",
        "2024", "2025", "2026", "yoy", "cagr", "a)", "b)", "e)",
        "년도", "연도", "실적",
    ),
}
RISK_HEADER_WORDS = ("impact", "probability", "영향", "확률")
RISK_LEVELS = {
    "high": (("high",), ("높",)),
    "medium": (("medium", "moderate"), ("중",)),
    "low": (("low",), ("낮",)),
}
NUMERIC_LIKE = (
    r"(?iUd)^\(?[+-]?\d[\d,]*(?:\.\d+)?\)?\s*"
    r"(?:%|bp|bps|x|배|원|천원|만원|백만원|억원|억|조|주|개|명|건)?$"
)
# characters that count as a digit besides decimal digits
EXTRA_DIGITS = "²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒"
DIGIT = rf"(?U)[\d{EXTRA_DIGITS}]"

# --- fixed values: inline patterns -------------------------------------------
ESCAPES = r"""\\([~.*"'()\[\]{}|_-])"""
SUBSCRIPT = r"(?<!~)~[A-Za-z0-9]{1,8}~(?!~)"
INLINE_MARKS = (
    r"(?U)\*\*[^*\n]+?\*\*|\^[^^\n]+?\^|" + SUBSCRIPT
    + r"|(?<!\*)\*[^*\n]+?\*(?!\*)|(?<!\w)_[^_\n]+?_(?!\w)"
)
INLINE_MATH = r"(?d)(?<!\$)\$(?!\$)(.+?)(?<!\$)\$(?!\$)"
DISPLAY_MATH = r"(?d)(?<!\$)\$\$(?!\$)(.+?)(?<!\$)\$\$(?!\$)"
INLINE_MATH_UNESCAPED = r"(?d)(?<!\$)(?<!\\)\$(?!\$)(.+?)(?<!\$)(?<!\\)\$(?!\$)"
COLOR_SPAN = r"""(?is)<span\s+style=(['"])(.*?)\1\s*>(.*?)</span>"""
STYLE_COLOR = r"(?i)color\s*:\s*(#[0-9A-Fa-f]{6})"
ANCHOR = r"""(?id)<a\b[^>]*\bid\s*=\s*(['"]).*?\1[^>]*>\s*</a>"""
FOOTNOTE_REF = r"(?U)\.(\d+)(?=\s|$|[,;:\-])|\^(\d+)\^"
FOOTNOTE_DEF = r"(?Ud)^(\d+)[\\.]\s+(.+)$"

# --- fixed values: line patterns ---------------------------------------------
FENCE = r"(?Ud)^```([\w.:-]*)\s*$"
MATH_LINE = r"(?Ud)^\$\$(.+?)\$\$\s*$"
MATH_FENCE = r"(?Ud)^\$\$\s*$"
BOLD_NUMBER = r"(?U)^\*\*\d+(?:\.|\\.)"
QUOTE = r"(?Ud)^>\s+(.+)$"
BULLET = r"(?Ud)^([ \t]*)[-*]\s+(.+)$"
NUMBERED = r"(?Ud)^([ \t]*)(\d+)\.\s+(.+)$"
NUMBERED_TITLE = r"(?Ud)^(\d{1,2})\.\s+([가-힣A-Za-z][\w\s가-힣]{0,40})$"
SENTENCE_TAIL = r"[다요음함임됨것수점]\.$"
IMAGE = r"(?d)^!\[(.*?)\]\((.*?)\)$"
DATA_IMAGE_HINT = r"!\[[^\]]*\]\(data:image/[a-zA-Z0-9+.-]+;base64,"
DATA_IMAGE = (
    r"(?Ud)^!\[([^\]]*)\]\(data:(image/[a-zA-Z0-9+.-]+);base64,"
    r"([A-Za-z0-9+/=\s]+)\)\s*$"
)
DATA_IMAGE_OPEN = r"(?Ud)^!\[[^\]]*\]\(data:image/[a-zA-Z0-9+.-]+;base64,[A-Za-z0-9+/=\s]*$"
BOLD_PAIR = r"(?Ud)^\*\*([^*:：]+)[:：]?\*\*\s*[:：]?\s*(.+)$"
FRONTMATTER_PAIR = r"(?Ud)^[A-Za-z0-9_.-]+\s*:\s*.*$"
DATA_IMAGE_WRAP = 50

# --- fixed values: file formats and image types ------------------------------
EXTENSION_FORMATS = {".docx": "docx", ".md": "md", ".markdown": "md", ".txt": "md"}
IMAGE_EXTENSIONS = {
    "image/png": ".png",
    "image/jpeg": ".jpg",
    "image/jpg": ".jpg",
    "image/gif": ".gif",
    "image/bmp": ".bmp",
    "image/webp": ".webp",
    "image/svg+xml": ".svg",
    "image/tiff": ".tiff",
}

# --- fixed values: research markers (private-use code points) ----------------
MARK_OPEN = "\ue200"
MARK_CLOSE = "\ue201"
MARK_SEP = "\ue202"
MARKER = "(?s)\ue200([a-zA-Z_][a-zA-Z0-9_]*)\ue202(.*?)\ue201"
MARK_RANGE = "[\ue200-\ue20f]"
UNKNOWN_PAYLOAD_LIMIT = 240

# --- fixed values: labels and openers in collapsed report text ---------------
HEAD_LABELS = {
    "보고서 작성일": r"보고서\s*작성일:\s*",
    "작성일": r"작성일:\s*",
    "수신": r"수신:\s*",
    "주제": r"주제:\s*",
    "작성자": r"작성자:\s*",
}
HEAD_KEYS = {
    "주제": "subtitle",
    "작성일": "date",
    "보고서 작성일": "date",
    "수신": "recipient",
    "작성자": "analyst",
}
HEAD_TITLE = r"(?Ud)^\[보고서\]\s*(.+?)(?=작성일:|수신:|주제:|작성자:|\d+\.\s)"
HEAD_NEXT_HEADING = r"\d+\.\s+[가-힣A-Z]"
HEAD_NEXT_LABEL = r"[가-힣A-Za-z][가-힣A-Za-z0-9\s]{0,20}:\s*"
BREAK_LABELS = (
    "가정",
    "일 평균 매출",
    "보유 채권 잔액",
    "최대 조달 가능액",
    "트리거 요건",
    "발동 효과",
    "확정일자부 채권양도 승낙",
    "계좌 변경 금지 확약",
    "계좌 분리",
    "인출 통제",
    "API 기반 모니터링",
    "동적 적립률 조정",
    "희석화 준비금",
    "기타 준비금",
    "총 필요 신용보강률",
    "구조",
    "적정성",
    "실행 전략",
)
SPACING_LABELS = ("작성일", "보고서 작성일", "수신", "주제", "작성자") + BREAK_LABELS
PARAGRAPH_OPENERS = (
    "결론적으로,",
    "따라서,",
    "그러나,",
    "다만,",
    "이에,",
    "특히,",
    "또한,",
    "한편,",
    "즉,",
    "예를 들어,",
    "구체적으로,",
    "본 보고서는",
    "본 건은",
    "위 알고리즘",
)
SENTENCE_ENDINGS = "다|요|음|함|임|됨|것|수|점|니다|입니다|습니다|됩니다|합니다|입니까"
SENTENCE_FOLLOWERS = r"[가-힣A-Z\[]"
INLINE_CALLOUT = r"\[(시사점|참고|주의|결론|요약|핵심|NOTE|WARNING)\]"
LIGHT_CALLOUT = r"\[(시사점|참고|주의|결론|요약|핵심)\]"
BULLET_SIGNS = r"(?U)([ㆍ•※])\s*"
MAJOR_HEADING = r"(?U)(\d{1,2})\.\s+([가-힣A-Z][가-힣a-zA-Z\s()\-:]{1,50})"
SUB_HEADING = (
    r"""(?U)(?<!\d\.)(\d{1,2}\.\d{1,2})\.\s+"""
    r"""([가-힣A-Z"][가-힣a-zA-Z\s()\-:"']{1,60})"""
)
SUBSUB_HEADING = (
    r"(?U)(\d{1,2}\.\d{1,2}\.\d{1,2})\.\s+([가-힣A-Z][가-힣a-zA-Z\s()\-:]{1,60})"
)
BOLD_SPAN = r"\*\*[^*]+?\*\*"
MATH_SPAN = r"\$\$[^$]+?\$\$"

# --- fixed values: office styles, callouts, bookmarks ------------------------
HEADING_HINT = r"(?iU)(?:heading|제목)\s*([1-4])"
BULLET_STYLE_IDS = ("ListBullet", "ListBullet2", "ListBullet3")
NUMBER_STYLE_IDS = ("ListNumber", "ListNumber2", "ListNumber3", "ListParagraph")
BULLET_STYLE_NAME = r"(?iU)^(?:List\s*Bullet|IB\s*Bullet)"
NUMBER_STYLE_NAME = r"(?iU)^(?:List\s*Number|List\s*Paragraph)"
BULLET_TEXT = r"(?Ud)^[•●■◦▪\-*]\s+(.+)$"
NUMBERED_TEXT = r"(?Ud)^(\d+)[\.\)]\s+(.+)$"
CALLOUT_FILLS = {"003366": "요약", "E6F0FA": "시사점", "FFF3CD": "주의", "F5F5F5": "참고"}
CALLOUT_PREFIXES = {
    "요약": "요약",
    "시사점": "시사점",
    "주의": "주의",
    "참고": "참고",
    "EXECUTIVE SUMMARY": "요약",
    "KEY INSIGHT": "시사점",
    "WARNING": "주의",
    "NOTE": "참고",
}
THEME_ALIASES = {
    "dk1": "dark1",
    "lt1": "light1",
    "dk2": "dark2",
    "lt2": "light2",
    "hlink": "hyperlink",
    "folhlink": "followedhyperlink",
    "text1": "dark1",
    "background1": "light1",
    "text2": "dark2",
    "background2": "light2",
    "followedhyperlink": "followedhyperlink",
}
TOC_TITLE = "TABLE OF CONTENTS"
ENDNOTES_TITLE = "ENDNOTES"
DISCLAIMER_TITLE = "면책 조항"
TOC_NOTE = "Update Field"
DISCLAIMER_TEXT = "당행은 해당 문서에 최대한 정확하고 완전한 정보를 담고자 노력하였으나"
PANEL_LABELS = ("REPORT DATE", "PREPARED BY", "INSTITUTION", "SECTOR", "PREPARED FOR")
PROPERTY_FIELDS = {
    "title": "title",
    "report_title": "title",
    "subtitle": "subtitle",
    "subject": "subtitle",
    "company": "company",
    "institution": "company",
    "issuer": "company",
    "ticker": "ticker",
    "sector": "sector",
    "analyst": "analyst",
    "author": "analyst",
    "date": "date",
    "report_date": "date",
    "recipient": "recipient",
    "prepared_for": "recipient",
    "report_type": "report_type",
}
REPORT_TYPE_LINE = r"(?Ud)^[A-Z][A-Z0-9\s&/\-]{3,40}$"
BOOKMARK = r"^_ibrep_(CODE_BLOCK|DIAGRAM|SEPARATOR)(?:_(.*))?$"
IMAGE_FILE_NAME = r"(?iU)^[^\\/\s]+?\.(?:png|jpe?g|gif|bmp|tiff?|svg|webp|emf|wmf)$"
PICTURE_NAME = r"(?iU)^Picture \d+$"

# --- fixed values: math commands and their signs -----------------------------
MATH_SIGNS = {
    r"\Leftrightarrow": "⇔",
    r"\Leftarrow": "⇐",
    r"\Rightarrow": "⇒",
    r"\leftrightarrow": "↔",
    r"\leftarrow": "←",
    r"\rightarrow": "→",
    r"\approx": "≈",
    r"\alpha": "α",
    r"\beta": "β",
    r"\gamma": "γ",
    r"\delta": "δ",
    r"\epsilon": "ε",
    r"\varepsilon": "ε",
    r"\theta": "θ",
    r"\lambda": "λ",
    r"\mu": "μ",
    r"\pi": "π",
    r"\rho": "ρ",
    r"\sigma": "σ",
    r"\tau": "τ",
    r"\phi": "φ",
    r"\varphi": "φ",
    r"\omega": "ω",
    r"\Gamma": "Γ",
    r"\Delta": "Δ",
    r"\Theta": "Θ",
    r"\Lambda": "Λ",
    r"\Pi": "Π",
    r"\Sigma": "Σ",
    r"\Phi": "Φ",
    r"\Omega": "Ω",
    r"\cdot": "·",
    r"\times": "×",
    r"\sqrt": "√",
    r"\infty": "∞",
    r"\prod": "∏",
    r"\sum": "∑",
    r"\int": "∫",
    r"\geq": "≥",
    r"\leq": "≤",
    r"\neq": "≠",
    r"\pm": "±",
    r"\to": "→",
    r"\left": "",
    r"\right": "",
    r"\%": "%",
}
