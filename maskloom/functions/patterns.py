"""Fixed values that must equal the original tool's for identical results.

Everything in this module is data, not logic: the detection registry, the
token grammar, the chunking and paragraph separators, the type templates and
the type aliases. They are stated plainly, in their natural order.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — detection registry (order = replacement order)
# ---------------------------------------------------------------------------
REGEX_REGISTRY: dict[str, str] = {
    "PHONE": r"(?<!\d)(?:(?:1[3-9]\d{9})|(?:0\d{2,3}-?\d{7,8}))(?!\d)",
    "ID": r"(?<!\d)\d{17}[0-9Xx](?!\d)",
    "BANK": r"(?<!\d)(?:\d{16}|\d{19})(?!\d)",
    "EMAIL": r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+",
    "IP": r"(?:\d{1,3}\.){3}\d{1,3}",
    "DATE": r"\d{4}[-/年]\d{1,2}[-/月]\d{1,2}[日]?",
    "TIME": r"\d{1,2}:\d{1,2}(:\d{1,2})?",
    "MONEY": r"\d+(\.\d+)?元|\d+(\.\d+)?万元|\d+(\.\d+)?亿元|\d+(\.\d+)?美元|\d+(\.\d+)?欧元",
}

# A decimal digit beyond U+FFFF (mathematical bold zero).
WIDE_DIGIT = "\U0001d7ce"

# Python's ``\d`` matches every Unicode decimal digit; Java needs (?U) for that.
JAVA_UNICODE_FLAG = "(?U)"

# ---------------------------------------------------------------------------
# FIXED VALUES — token grammar, chunking, paragraphs, sentence ends
# ---------------------------------------------------------------------------
TOKEN_PREFIX = "__MASKED_"
TOKEN_SUFFIX = "__"
TOKEN_HEX_LEN = 8
TOKEN_RE = r"__MASKED_(?:[a-z]+_)?[0-9a-f]{8}__"
CUSTOM_PREFIX = "__CUSTOM_"
SENTENCE_ENDS = "。！？；.!?;"
DEFAULT_CHUNK_SIZE = 450
DEFAULT_PROB = 0.95
PARAGRAPH_SEP_RE = r"\n\n|\r\n\r\n"
DEFAULT_REPLACEMENT = "***"
DEFAULT_HASH_LEN = 8

# ---------------------------------------------------------------------------
# FIXED VALUES — type templates (label per entity type, DEFAULT fallback)
# ---------------------------------------------------------------------------
TYPE_TEMPLATES: dict[str, str] = {
    "PER": "某人",
    "ORG": "某机构",
    "LOC": "某地点",
    "GPE": "某地区",
    "PHONE": "电话号码",
    "ID": "身份证号",
    "BANK": "银行卡号",
    "EMAIL": "电子邮箱",
    "IP": "IP地址",
    "DATE": "某日期",
    "TIME": "某时间",
    "MONEY": "某金额",
    "DEFAULT": "***",
}

# Types that get a running number in the context-aware strategies.
NUMBERED_TYPES: tuple[str, ...] = ("PER", "ORG", "LOC", "GPE")

# ---------------------------------------------------------------------------
# FIXED VALUES — model type names (Chinese prompt vocabulary) -> short types
# ---------------------------------------------------------------------------
TYPE_ALIASES: dict[str, str] = {
    "人名": "PER",
    "地名": "LOC",
    "机构名": "ORG",
    "手机号": "PHONE",
    "身份证号": "ID",
    "银行卡号": "BANK",
    "电子邮箱": "EMAIL",
    "IPv4地址": "IP",
    "时间": "TIME",
}

# ---------------------------------------------------------------------------
# FIXED VALUES — file handling
# ---------------------------------------------------------------------------
ADMITTED_EXTENSIONS: tuple[str, ...] = ("pdf", "doc", "docx", "txt", "md")
ROUTE_PROBE_ORDER: tuple[str, ...] = ("pdf", "doc", "docx", "ppt", "pptx", "xls", "xlsx", "txt", "md")
TEXT_EXTENSIONS: tuple[str, ...] = ("txt", "md")
PDF_EXTENSIONS: tuple[str, ...] = ("pdf",)
OFFICE_EXTENSIONS: tuple[str, ...] = ("doc", "docx", "ppt", "pptx", "xls", "xlsx")


# Faster forms with exactly the same matches, used at execution time.
# MONEY: the five alternatives differ only in the suffix; a digit part can
# only end right before a suffix (whose first characters 元 万 亿 美 欧 are
# distinct and are neither digits nor '.'), so the digits never need to be
# given back: match them once, possessively, then choose the suffix.
FASTER_EQUIVALENT: dict[str, str] = {
    REGEX_REGISTRY["MONEY"]: r"\d++(?:\.\d++)?+(?:元|万元|亿元|美元|欧元)",
}


def java_pattern(pattern: str) -> str:
    """Pattern with the Unicode-class flag Java needs to match Python's ``\\d``
    (and the faster equivalent form where one is known).

    Java looks behind by whole code points only where the pattern itself holds
    one beyond U+FFFF; a digit named twice makes it see such digits."""
    return JAVA_UNICODE_FLAG + FASTER_EQUIVALENT.get(pattern, pattern).replace(r"(?<!\d)", rf"(?<![\d{WIDE_DIGIT}])")


def chunk_pattern(max_chunk_size: int = DEFAULT_CHUNK_SIZE) -> str:
    """One regex that yields the greedy sentence-aware chunks of a text.

    A chunk is the whole rest when it fits, else the longest window prefix
    ending in a sentence mark, else a hard cut at ``max_chunk_size``.
    """
    n = int(max_chunk_size)
    if n < 1:
        raise ValueError("max_chunk_size must be positive")
    ends = "[" + SENTENCE_ENDS + "]"
    return rf"(?s).{{1,{n}}}\z|.{{0,{n - 1}}}{ends}|.{{{n}}}"
