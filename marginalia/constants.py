"""Fixed values. They must equal the published rules for results to agree."""

# --- fixed values: section heading aliases -------------------------------------
ZH_ALIASES = {
    "abstract": ["摘要", "摘 要", "内容摘要", "中文摘要"],
    "keywords": ["关键词", "关键 词", "关键字"],
    "introduction": ["引言", "绪论", "前言", "研究背景", "课题背景", "问题提出"],
    "related_work": ["相关工作", "国内外研究现状", "研究现状", "文献综述", "理论基础", "背景与相关工作", "相关研究"],
    "method": ["方法", "方法设计", "研究方法", "材料与方法", "实验材料与方法", "模型与方法", "算法设计", "算法原理",
               "模型构建", "模型设计", "网络结构", "系统设计", "方案设计", "技术路线", "本文方法", "方法实现"],
    "experiments": ["实验", "实验设计", "实验设置", "实验过程", "实验结果", "结果", "结果与分析", "实验结果与分析",
                    "性能分析", "对比实验", "消融实验", "评价指标", "数据集", "模型训练", "测试结果", "验证实验", "应用验证"],
    "discussion": ["讨论", "分析与讨论", "结果讨论", "误差分析", "局限性分析"],
    "conclusion": ["结论", "结语", "总结", "结束语", "结论与展望", "总结与展望", "研究结论", "展望"],
    "_references": ["参考文献", "文献"],
    "_acknowledgements": ["致谢", "鸣谢"],
    "_appendix": ["附录"],
}
EN_ALIASES = {
    "abstract": ["abstract"],
    "keywords": ["keywords", "index terms"],
    "introduction": ["introduction", "background"],
    "related_work": ["related work", "related works", "literature review", "background and related work", "prior work"],
    "method": ["method", "methods", "methodology", "proposed method", "approach", "our approach", "model", "framework",
               "architecture", "system design", "network architecture"],
    "experiments": ["experiments", "experiment", "experimental setup", "experimental results", "results",
                    "results and analysis", "evaluation", "ablation study", "implementation details", "dataset", "datasets"],
    "discussion": ["discussion", "analysis", "limitations"],
    "conclusion": ["conclusion", "conclusions", "future work", "conclusion and future work"],
    "_references": ["references", "bibliography"],
    "_acknowledgements": ["acknowledgements", "acknowledgments"],
    "_appendix": ["appendix", "supplementary material"],
}
BOUNDARY_SECTIONS = ["keywords", "discussion", "_references", "_acknowledgements", "_appendix"]
SECTION_KEYS = ["abstract", "introduction", "related_work", "method", "experiments", "conclusion"]
SHORT_SECTION_KEYS = ["introduction", "related_work", "method", "experiments", "conclusion"]
MIN_SECTION_LENGTH = 150
PLAIN_TITLE_SECTIONS = ["abstract", "keywords", "_references", "_acknowledgements", "_appendix"]

# --- fixed values: section quality ----------------------------------------------
DEFAULT_REQUIRED = ["abstract", "introduction", "method", "experiments", "conclusion"]
DEFAULT_OPTIONAL = ["related_work", "discussion"]
UNCLEAR_SECTION_VALUES = ["", "未明确提及", "unknown", "Unknown", "N/A", "无"]
ZH_MIN_LENGTHS = {"abstract": 30, "introduction": 100, "related_work": 80, "method": 150, "experiments": 150, "conclusion": 50}
EN_MIN_LENGTHS = {"abstract": 250, "introduction": 750, "related_work": 600, "method": 1000, "experiments": 1000, "conclusion": 400}
REFERENCE_PATTERNS = [r"参考文献", r"\bReferences\b", r"\bBibliography\b", r"\[\s*\d+\s*\]", r"\bdoi\b"]
HEADING_COUNT_PATTERNS = [
    r"^\s*(?:\d+(?:[.．]\d+)*(?:[.．、])?|第[一二三四五六七八九十百\d]+[章节]|[一二三四五六七八九十百]+[、.．])?\s*"
    r"(?:引言|绪论|相关工作|材料与方法|研究方法|实验|结果与分析|结论|参考文献)\s*$",
    r"^\s*(?:\d+(?:\.\d+)*\.?|[IVXLCDM]+\.?)?\s*"
    r"(?:Introduction|Related Work|Methodology|Method|Experiments|Experimental Results|Conclusion|References)\s*$",
]
KEYWORD_MARKERS = r"关键词|关键\s*词|\bKeywords\b|\bIndex Terms\b"
INTRO_MARKERS = r"引言|绪论|\bIntroduction\b"
CONCLUSION_MARKERS = r"参考文献|\bReferences\b|致谢|\bAcknowledgements?\b|附录|\bAppendix\b"
RESULT_TERMS = r"实验结果|结果与分析|对比实验|消融实验|性能分析|\bExperimental Results\b|\bResults\b|\bEvaluation\b|\bAblation\b"
METHOD_TERMS = r"方法|算法|模型结构|网络结构|模型构建|\bMethod\b|\bAlgorithm\b|\bArchitecture\b|\bFramework\b|\bModel\b"

# --- fixed values: document types -----------------------------------------------
# type -> (required, optional, structure type, focus)
DOC_TYPES = {
    "algorithm_paper": (["abstract", "introduction", "method", "experiments", "conclusion"], ["related_work", "discussion"],
                        "algorithm_research_paper",
                        ["problem_formulation", "model_architecture", "training_strategy", "experiments", "ablation"]),
    "experimental_research": (["abstract", "introduction", "method", "experiments", "conclusion"], ["related_work", "discussion"],
                              "zh_experimental_paper",
                              ["materials_and_methods", "experimental_design", "result_analysis", "limitations"]),
    "engineering_system": (["introduction", "method", "experiments", "conclusion"], ["abstract", "related_work", "discussion"],
                           "engineering_system_paper",
                           ["requirements", "system_design", "implementation", "testing", "deployment"]),
    "review": (["introduction", "related_work", "discussion", "conclusion"], ["abstract", "method", "experiments"],
               "review_or_survey", ["taxonomy", "research_progress", "challenges", "future_directions"]),
    "thesis_or_report": (["introduction", "method", "experiments", "conclusion"], ["abstract", "related_work", "discussion"],
                         "thesis_or_report",
                         ["chapter_structure", "theoretical_basis", "system_or_method", "experiments", "summary"]),
    "generic_research": (["abstract", "introduction", "method", "experiments", "conclusion"], ["related_work", "discussion"],
                         "generic_research_paper", ["research_problem", "method", "experiments", "conclusion"]),
}
PLAN_SECTIONS = ["abstract", "introduction", "related_work", "method", "experiments", "discussion", "conclusion"]
# (type, weight, pattern); case is ignored where the pattern starts with (?i)
TYPE_RULES = [
    ("review", 4, r"(?i)综述|研究进展|现状|挑战|展望|\breview\b|\bsurvey\b"),
    ("experimental_research", 5, r"材料与方法|实验材料与方法|结果与分析|分析与讨论|讨论"),
    ("engineering_system", 5, r"系统设计|系统实现|需求分析|系统测试|功能测试|平台|软件系统"),
    ("algorithm_paper", 5, r"(?i)related work|method|methodology|experiments|ablation|evaluation|dataset|architecture"),
    ("algorithm_paper", 3, r"(?i)目标检测|语义分割|深度学习|神经网络|transformer|yolo|llm|model|algorithm"),
    ("thesis_or_report", 4, r"第一章|第二章|第三章|第四章|第五章|绪论|理论基础"),
]

# --- fixed values: metadata -----------------------------------------------------
UNCLEAR_VALUES = ["", "未明确提及", "未知", "unknown", "Unknown", "N/A", "无", "暂无", "待识别论文标题"]
UNCLEAR_LOWER = ["unknown", "n/a", "none", "null"]
DEFAULT_TEXT = "未明确提及"
METADATA_FIELDS = ["title", "authors", "year", "venue", "abstract"]
DOI_PATTERN = r"\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b"
ARXIV_PATTERN = r"(?:arXiv[:\s]*)?(\d{4}\.\d{4,5}(?:v\d+)?)"
ARXIV_OLD_PATTERN = r"(?:arXiv[:\s]*)?([a-z-]+(?:\.[A-Z]{2})?/\d{7})"

# --- fixed values: markup headings ----------------------------------------------
ZH_BLOCK_HEADINGS = ["摘要", "关键词", "引言", "绪论", "研究背景", "相关工作", "材料与方法", "实验材料与方法", "方法",
                     "模型与方法", "实验", "实验设计", "结果", "结果与分析", "分析与讨论", "讨论", "结论", "结语", "致谢", "参考文献"]

# --- fixed values: page-layout word lists -----------------------------------------
TITLE_BLOCKLIST = ["摘要", "关键词", "abstract", "keywords", "引言", "基金项目", "作者简介", "doi", "中图分类号",
                   "文献标识码", "收稿日期", "通讯作者", "email", "http", "www"]
UNIT_WORDS = ["大学", "学院", "实验室", "研究所", "公司", "省", "市", "邮编", "基金", "通讯作者", "医院", "中心", "单位"]
STRONG_UNIT_WORDS = ["大学", "学院", "实验室", "研究所", "公司", "医院", "邮编"]
JOURNAL_WORDS = ["科技", "学报", "杂志", "期刊", "研究", "进展", "中国", "china", "journal", "science", "technology"]
SENTENCE_WORDS = ["本文", "本研究", "通过", "采用", "提出", "实现", "结果表明", "实验结果", "研究表明", "表明"]

# --- fixed values: redaction -----------------------------------------------------
SENSITIVE_KEY_PARTS = ["api_key", "apikey", "authorization", "secret", "token", "password", "credential"]
SECRET_NAMES = "(?:api[_ -]?key|authorization|secret|token|password|credential)"
# (pattern, replacement), applied in order: quoted values, bare values, bearer tokens, key-shaped strings.
REDACTIONS = [
    (f"(?i)([\"']?{SECRET_NAMES}[\"']?\\s*[:=]\\s*[\"'])(.*?)([\"'])", "$1<redacted>$3"),
    (f"(?i)([\"']?{SECRET_NAMES}[\"']?\\s*[:=]\\s*)([^\"'\\s,}}]+)", "$1<redacted>"),
    ("(?i)\\bbearer\\s+[a-z0-9._-]+", "Bearer <redacted>"),
    ("\\bsk-[a-zA-Z0-9_-]{8,}\\b", "<redacted-api-key>"),
]
# No pattern matches a text without one of these.
REDACTION_WORDS = ["apikey", "api key", "api_key", "api-key", "authorization", "secret", "token", "password", "credential", "bearer", "sk-"]

# --- fixed values: provider errors that mean too long a context ---------------------
OVERFLOW_PROVIDERS = ["deepseek", "openai_compatible"]
OVERFLOW_STATUS = [400, 413, 422]
OVERFLOW_CODES = ["context_length_exceeded", "context_window_exceeded", "input_tokens_exceeded"]
OVERFLOW_TYPES = ["context_length_exceeded", "context_window_exceeded"]
OVERFLOW_MESSAGE = (r"(?i)maximum context length.{0,100}(?:exceed|requested|resulted)|"
                    r"(?:exceed\w*.{0,60}(?:context (?:length|window)|input token limit))|"
                    r"(?:context (?:length|window)|input token limit).{0,60}exceed")

# --- fixed values: front matter of Chinese papers -----------------------------------
ZH_FRONT_END = r"Abstract|ABSTRACT|引言|1\s*引言|一[、.．]\s*引言"

# --- fixed values: retrieval and budgets -----------------------------------------
CHUNK_SIZE, CHUNK_OVERLAP, TOP_K, MAX_TOP_K, MAX_DOCS = 1200, 200, 3, 8, 8
PARSERS = ["grobid", "pymupdf"]
EVIDENCE_NAMES = ["paper_id", "parser", "cache_version", "chunk_id"]
RESULT_CAP, READ_CAP = 12000, 2000
WINDOW, MAX_OUTPUT, SAFETY = 65536, 4096, 1024
RECENT_RATIO = 0.16
HISTORY_MESSAGES = 20
TITLE_LENGTH = 40
NEW_SESSION_TITLE = "新对话"
SUMMARY_HEADINGS = ["用户目标与约束", "当前论文及比较对象", "已完成工作", "关键结论及证据引用", "用户纠正与已推翻判断", "未解决问题", "下一步"]
MEMORY_CATEGORIES = ["paper", "theme", "finding"]
PROFILE_SCALARS = ["university", "education", "identity"]
PROFILE_LISTS = ["research_interest", "technical_background", "preferences"]

# Notes that stand in a chat history for failed turns and unconfirmed calls.
FAILED_PREFIX = "失败旧轮次曾输出的文本（不是成功完成的回答）：\n"
UNCONFIRMED_PREFIX = "旧轮次中以下工具调用没有已保存的结果，执行状态未确认："
CLOSING_PREFIX = "该旧轮次已结束但失败/中断，未完成用户目标。工具结果仅表示当时已确认的执行事实。错误记录："
CLOSED_SHORT = "该旧轮次已结束但失败/中断，未完成用户目标。错误记录："
