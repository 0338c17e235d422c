"""Word lists and patterns that the rules refer to.

All are fixed values: results must follow them exactly.
"""

from __future__ import annotations

TIME_SENSITIVE = ("最新", "近况", "近期", "进展", "现在", "当前", "截至", "latest", "recent", "current", "progress", "as of")

CALCULATION = ("同比", "环比", "增长率", "增长", "毛利率", "净利率", "roe", "roa", "比例", "比率", "差额", "相差", "占比", "compare", "growth", "margin", "ratio")

ROUTE_TABLE = (
    "毛利率", "净利率", "roe", "roa", "eps", "pe", "pb", "营收", "收入", "成本", "利润", "资产", "负债", "现金流", "产能", "研发", "出货", "同比", "环比", "capex", "ebitda",
    "revenue", "gross margin", "operating profit margin", "utilisation", "utilization", "capacity", "shipments", "research and development", "r&d",
)
ROUTE_TEXT = ("什么是", "定义", "概念", "原理", "技术", "制程", "工艺", "架构")

#: Case matters for these.
COLLECTION_TABLE = ("营收", "毛利率", "净利", "资产", "负债", "现金流", "同比", "环比", "增长率", "比率", "ROE", "EPS", "收入", "成本", "费用", "利润", "亏损", "盈利")

EXPANSIONS = {
    "营收": ("revenue",),
    "同比": ("year-on-year", "YoY"),
    "毛利率": ("gross margin",),
    "营业利润率": ("operating profit margin",),
    "产能利用率": ("utilisation rate", "utilization rate"),
    "研发费用": ("research and development expenses", "R&D expenses"),
    "出货": ("shipments",),
    "产能": ("manufacturing capacity",),
    "晶圆营收": ("wafer revenue",),
    "先进制程": ("advanced technologies", "advanced process nodes"),
}

#: (what the question may say, what the passage must say)
CONCEPTS = (
    (("营收", "revenue"), ("revenue", "营收")),
    (("同比", "year-on-year", "yoy"), ("year-on-year", "yoy", "同比")),
    (("毛利率", "gross margin"), ("gross margin", "毛利率")),
    (("营业利润率", "operating profit margin"), ("operating profit margin", "营业利润率")),
    (("产能利用率", "utilisation rate", "utilization rate"), ("utilisation rate", "utilization rate", "产能利用率")),
    (("研发费用", "research and development expenses", "r&d expenses"), ("research and development expenses", "r&d expenses", "研发费用")),
    (("出货", "shipments"), ("shipments", "wafer shipment", "出货")),
    (("产能", "manufacturing capacity"), ("annual capacity", "manufacturing capacity", "monthly capacity", "产能")),
    (("先进制程", "advanced technologies", "advanced process"), ("advanced technologies", "advanced process", "7nm and more advanced", "先进制程")),
)

COMPANY_ALIASES = {
    "tsmc": ("台积电", "tsmc", "taiwan semiconductor manufacturing"),
    "smic": ("中芯国际", "smic", "semiconductor manufacturing international"),
}

OFFICIAL_DOMAINS = ("tsmc.com", "smic.com", "hkexnews.hk", "sec.gov", "intel.com", "samsung.com", "amd.com", "nvidia.com", "asml.com", "appliedmaterials.com", "lamresearch.com", "micron.com", "skhynix.com")
REPUTABLE_DOMAINS = ("reuters.com", "bloomberg.com", "ft.com", "wsj.com", "apnews.com", "bbc.com", "cnbc.com", "nikkei.com", "rfi.fr", "digitimes.com", "tomshardware.com", "trendforce.com")
QUERY_DOMAINS = {
    "tsmc": ("tsmc.com",),
    "台积电": ("tsmc.com",),
    "smic": ("smic.com", "hkexnews.hk"),
    "中芯国际": ("smic.com", "hkexnews.hk"),
    "nvidia": ("nvidia.com",),
    "英伟达": ("nvidia.com",),
    "amd": ("amd.com",),
    "intel": ("intel.com",),
    "英特尔": ("intel.com",),
}
FILING_MARKERS = ("官方", "财报", "年报", "季报", "公告", "results", "earnings", "annual report", "quarterly report", "filing", "investor relations")

ALL_QUARTERS = ("各季度", "所有季度", "逐季", "QUARTERS", "QUARTERLY")
CHINESE_DIGITS = ("一二三四", "1234")

TOOL_LIMITS = {"web_search": 2, "search_reports": 1, "lookup_terms": 1, "get_company_data": 2, "financial_calculator": 4}
MAX_TOOLS = 6
