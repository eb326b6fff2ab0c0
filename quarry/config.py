"""Rules that operators take as parameters, with their defaults.

Fixed values: the word lists, patterns, weights and limits below define results and are given as plain text."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: question keywords -------------------------------------------------------------------------------
# One word is left out, an institution's abbreviation: callers add their own (Keywords(stopwords=(*STOPWORDS, "..."))).
STOPWORDS = (
    "là", "gì", "như", "thế", "nào", "ở", "đâu", "khi", "bao", "giờ", "mấy",
    "ai", "sao", "có", "không", "cho", "của", "và", "các", "những", "được",
    "với", "về", "trong", "để", "ra", "đến", "từ", "này", "đó", "thì",
    "hãy", "xin", "hỏi", "biết", "em", "mình", "tôi", "nhé", "ạ",
    "muốn", "xem", "thông", "tin", "phải", "làm", "sinh", "viên",
    "trường", "đại", "học", "kiến", "trúc", "đà", "nẵng",
    "nhà", "nhiêu", "hiện", "tại", "năm", "cần", "hay", "tới", "lại",
    "hỗ", "trợ", "tên", "họ", "liên", "quan", "việc", "chuyện", "thứ",
    "viết", "nói", "bảo", "người", "bạn", "cậu", "mày", "tao", "ông", "bà",
    "anh", "chị", "ơi", "vậy", "nữa", "luôn", "chứ", "rồi", "chưa",
    "chào", "hello", "hi", "hey", "alo", "vừa", "đang", "đã", "sẽ",
)
COMPOUNDS = (
    "học phí", "học lại", "học cải thiện", "nộp học phí", "thời hạn", "hạn nộp", "hạn chót", "phúc khảo", "chuẩn đầu ra",
    "khảo sát", "bảo hiểm", "ngoại ngữ", "tin học", "quy đổi", "học kỳ 1", "học kỳ 2", "học kỳ i", "học kỳ ii", "khóa 2026",
    "toán học", "bài thi", "tiền học", "kỳ đầu", "thủ tục", "học bổng", "du học", "nhật bản", "ký túc xá", "hiệu trưởng",
    "điểm chuẩn", "miễn giảm", "chính sách", "hộp thư", "email", "đối tượng",
)
CORE_WORDS = (
    "học", "thi", "điểm", "khảo sát", "phúc khảo", "học phí", "bảo hiểm", "ngoại ngữ", "tin học", "quy đổi", "tín chỉ",
    "chứng chỉ", "tốt nghiệp", "sinh viên", "học kỳ", "khoa", "ngành", "lớp", "học phần", "miễn giảm", "chính sách",
    "hộp thư", "email", "học bổng", "tuyển sinh", "quy định", "thông báo", "quy chế", "đào tạo", "hiệu trưởng", "văn bằng",
    "thời hạn", "hạn nộp", "nộp", "bài thi", "toán học", "lệ phí", "chuẩn đầu ra", "xét tuyển",
)
SYNONYMS = (("tiền học", ("học phí",)), ("kỳ đầu", ("học kỳ 1", "học kỳ i")))
# --- fixed values: text scoring ------------------------------------------------------------------------------------
DIACRITICS = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđÀÁẢÃẠĂẰẮẲẴẶÂẦẤẨẪẬÈÉẺẼẸÊỀẾỂỄỆÌÍỈĨỊÒÓỎÕỌÔỒỐỔỖỘƠỜỚỞỠỢÙÚỦŨỤƯỪỨỬỮỰỲÝỶỸỴĐ"
SUSPICIOUS = r"~`^|\{\}\[\]\\_<>§¤¥¢©®™¶†‡•—–±≠≤≥√∞"
LEGAL_PATTERNS = (
    (r"\bĐiều\s+\d+\b", "Điều X"),
    (r"\bKhoản\s+\d+\b", "Khoản X"),
    (r"\bĐiểm\s+[a-zđ]\b", "Điểm X"),
    (r"\bCăn\s+cứ\b", "Căn cứ"),
    (r"\bQuyết\s+định\b", "Quyết định"),
    (r"\bThông\s+báo\b", "Thông báo"),
    (r"\bSố:\s*[\w\d\-/]+", "Số hiệu văn bản"),
    (r"\bngày\s+\d{1,2}\s+tháng\s+\d{1,2}\s+năm\s+\d{4}\b", "Ngày tháng năm"),
    (r"\b\d{1,2}/\d{1,2}/\d{4}\b", "Ngày dạng số DD/MM/YYYY"),
    (r"\b\d+([\.,]\d+)*\s*(đồng|đ|VNĐ|VND)\b", "Số tiền"),
    (r"\b\d+([,\.]\d+)?\s*%", "Phần trăm"),
    (r"\bhạn\s+(chót|nộp|cuối)\b", "Thời hạn"),
)
# --- fixed values: facts --------------------------------------------------------------------------------------------
TITLE_NUMBER = r"(?iuU)\b(\d{1,5}\s*/\s*(?:TB|QĐ|QD|HD|KH|TT|BC|CT|NQ)[0-9/\-A-Za-zĐđ_]*)\b"
POSTED_DATE = r"(?U)\b(\d{1,2}/\d{1,2}/\d{4}(?:\s+\d{1,2}:\d{1,2}(?::\d{1,2})?)?)\b"
ATTACHMENT_EXTENSION = r"(?i)\.(pdf|docx?|xlsx?|pptx?|zip|rar)($|\?|#)"
GENERIC_TITLES = ("tin tức", "thông báo", "trang chủ", "menu", "đăng nhập", "dashboard", "tra cứu thông tin", "tin tức thông báo", "văn bản thông báo")
NAVIGATION = ("sinh-vien-tin-tuc-thong-bao.html", "thong-bao.html", "dang-nhap.html", "dashboard.html", "tra-cuu", "dm-tin")
STATUSES = ("active", "deadline_passed", "expired", "replaced", "unverified", "unknown")
NO_CATEGORY = "Chưa phân loại"


@dataclass(frozen=True)
class Keywords:
    """Lists that keyword extraction and scoring use."""

    stopwords: tuple[str, ...] = STOPWORDS
    compounds: tuple[str, ...] = COMPOUNDS
    core_words: tuple[str, ...] = CORE_WORDS
    synonyms: tuple[tuple[str, tuple[str, ...]], ...] = SYNONYMS


@dataclass(frozen=True)
class CategoryRules:
    """(words, category, subcategory): the first rule with a word in the looked-at text decides."""

    rules: tuple[tuple[tuple[str, ...], str, str | None], ...]
    content_chars: int = 0
    default: str | None = None


# --- fixed values: the three profiles of category rules ------------------------------------------------------------
CATEGORIES = CategoryRules(
    (
        (("học phí", "bảo hiểm"), "Học phí", "Thu học phí & Bảo hiểm"),
        (("phúc khảo",), "Khảo thí", "Phúc khảo bài thi"),
        (("quy đổi", "chuẩn đầu ra"), "Chuẩn đầu ra", "Chứng chỉ ngoại ngữ - tin học"),
        (("khảo sát",), "Khảo sát", "Khảo sát sinh viên"),
    )
)


#: Rules for what is uploaded; none has a subcategory.
IMPORT_CATEGORIES = CategoryRules(
    (
        (("học phí", "bảo hiểm", "miễn giảm"), "Học phí", None),
        (("phúc khảo",), "Khảo thí", None),
        (("quy đổi", "chuẩn đầu ra"), "Chuẩn đầu ra", None),
        (("khảo sát",), "Khảo sát", None),
        (("tốt nghiệp", "xét tốt nghiệp"), "Đào tạo", None),
        (("học bổng",), "Học bổng", None),
    ),
    500,
)
#: Rules for pages that a crawl finds beyond its lists.
EXPANSION_CATEGORIES = CategoryRules(
    (
        (("học phí", "bảo hiểm", "học bổng", "công nợ"), "Học phí", None),
        (("phúc khảo", "điểm thi", "khảo thí"), "Khảo thí", None),
        (("quy đổi", "chuẩn đầu ra", "chứng chỉ"), "Chuẩn đầu ra", None),
        (("khảo sát",), "Khảo sát", None),
        (("tốt nghiệp", "xét tốt nghiệp", "đào tạo", "học phần"), "Đào tạo", None),
        (("tuyển dụng", "việc làm"), "Tuyển dụng", None),
        (("sinh viên", "hoạt động", "đoàn"), "Sinh viên", None),
        (("nghiên cứu", "khoa học"), "Khoa học công nghệ", None),
    ),
    600,
    "Thông báo",
)


@dataclass(frozen=True)
class Fusion:
    keyword_weight: float = 0.4
    semantic_weight: float = 0.6
    k: int = 4
    min_final: float = 20.0
    min_keyword: float = 15.0
    min_similarity: float = 0.65
    strong_keyword: float = 30.0
    page_score: str = "last"


@dataclass(frozen=True)
class UploadLimits:
    max_files: int = 100
    max_bytes: int = 20 * 1024 * 1024
    max_total_bytes: int = 500 * 1024 * 1024
    allowed: tuple[str, ...] = ("pdf", "docx", "html", "htm")


UNSAFE_EXTENSIONS = ("exe", "bat", "cmd", "ps1", "dll", "sh", "vbs", "js", "py", "bin", "com", "scr", "msi")
DEFAULT_KEYWORDS = Keywords()
