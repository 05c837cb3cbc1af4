"""Constants that decide results, kept together and in natural order."""

# ---- engines -------------------------------------------------------------------------------
FREE_ENGINES = ["bing", "anysearch", "quark"]
PAID_ENGINES = ["exa", "tavily", "serpapi", "qianfan", "metaso", "tinyfish"]
ALL_ENGINES = sorted(FREE_ENGINES + PAID_ENGINES)
# Most rows one request may ask of an engine (None: the engine sets no limit).
ENGINE_LIMITS = {
    "anysearch": 10, "bing": 50, "exa": 100, "metaso": None, "qianfan": 50,
    "quark": 50, "serpapi": 100, "tavily": 20, "tinyfish": None,
}
PER_ENGINE_CAP = 15
ROUND_DEADLINE_SECONDS = 60

# ---- URL rules -----------------------------------------------------------------------------
TRACKING_MINIMAL = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id",
    "utm_name", "utm_reader", "utm_social", "utm_brand", "gclid", "gclsrc", "dclid",
    "fbclid", "msclkid", "yclid", "srsltid", "mc_cid", "mc_eid", "igshid", "wbraid",
    "gbraid", "_ga", "_gl", "vero_id", "wickedid",
]
TRACKING_EXTRA = ["spm", "from", "ref", "referrer", "referral", "share_token"]
TWO_LEVEL_SUFFIXES = [
    "com.cn", "net.cn", "org.cn", "gov.cn", "edu.cn", "ac.cn", "co.uk", "org.uk", "ac.uk",
    "co.jp", "ne.jp", "or.jp", "com.hk", "com.tw", "com.mo", "com.au", "co.kr", "com.sg",
]
SHELL_HOSTS = ["quark.cn", "sm.cn", "uc.cn"]
SHELL_SUFFIXES = [".quark.cn", ".sm.cn", ".uc.cn", ".ucweb.com"]
SHELL_TRACKING = [
    "uc_param_str", "uc_biz_str", "docexpbucketstr", "zuowentagstatus", "fp_from", "entry",
    "x_render_type", "sc_doc_level", "perf_format", "perf_exttype", "perf_doc_cls_v5",
    "bucket", "from", "sid",
]
MEDIA_TABS = ["picture", "video", "image"]
MEDIA_PATH_WORDS = [
    "video-page", "image-page", "picture-page", "audio-page", "video_", "pic-page",
    "gallery-page",
]
MEDIA_SOURCE_HOSTS = [
    "bilibili.com", "douyin.com", "v.qq.com", "youku.com", "iqiyi.com", "mgtv.com",
    "ixigua.com", "kuaishou.com", "xigua.com", "sohu.com/v", "user_auth_video",
    "video.quark.cn",
]
PUNISH_MARKER = "_____tmd_____/punish"
MIN_PAGE_BYTES = 4096

# ---- text rules ----------------------------------------------------------------------------
# Dropped from comparison text together with every Unicode white space character.
TEXT_NOISE = "-_|—–·,，。！!？?：:；;（）()[]【】\"'`"
TITLE_SEPARATORS = "|｜—–·_-"
SENTENCE_MARKS = "，。！？；：、,.;!?:\t\n"
SUFFIX_PASSES = 2
SUFFIX_MAX_CHARS = 12

# ---- near-duplicate decision ---------------------------------------------------------------
TITLE_MIN, SNIPPET_MIN, URL_MIN, NUMBERS_MIN = 0.90, 0.85, 0.70, 0.30
URL_GRAM, TITLE_GRAM, SNIPPET_GRAM = 4, 3, 3
REVIEW_MARGIN, NEAR_MISS_GAP = 0.05, 0.15

# ---- bucket coherence ----------------------------------------------------------------------
DECOY_BELOW, WITNESS_FROM, MIN_BUCKET_ROWS, MIN_REST_TERMS = 0.3, 0.5, 4, 2
BOOLEAN_WORDS = ["OR", "AND", "NOT", "|", "&"]
QUERY_OPERATORS = [
    "site", "filetype", "ext", "intitle", "allintitle", "inurl", "allinurl", "intext",
    "inbody", "inanchor", "lang", "language", "loc", "location", "before", "after", "feed",
    "contains", "ip", "prefer",
]
STOP_WORDS = (
    "a about an and are as at be been best by can could did do does for from get had has "
    "have how i if in into is it its me my new no not of on or our should so than that the "
    "their then there these they this to top up us use using vs was we were what when where "
    "which who why will with would you your"
).split()
STEM_SUFFIXES = ["ing", "ed", "es", "s"]
STEM_MIN_LETTERS = 4

# ---- vertical domains, in the order they are tried -----------------------------------------
DOMAIN_KEYWORDS = [
    ("resource", "资源 下载 资料 素材 模板 工具 pdf 文档"),
    ("social_media", "微博 小红书 抖音 快手 知乎 推特 x平台 社交 热搜 网红"),
    ("finance", "股票 基金 股市 财经 金融 汇率 期货 债券 理财 股价 上市公司 财报 a股 美股"),
    ("academic", "论文 期刊 学术 研究 文献 学报 doi 引文 课题 博士 硕士 科研"),
    ("legal", "法律 法规 律师 条款 合规 诉讼 判决 仲裁 知识产权法 刑法 民法"),
    ("health", "健康 医疗 疾病 药物 医生 症状 医院 疫苗 治疗 癌症 新冠 体检"),
    ("business", "公司 企业 商业 创业 融资 营收 利润 市场 行业 品牌 营销 管理"),
    ("security", "安全 漏洞 攻击 防护 防火墙 加密 黑客 勒索 病毒 网络战 cve"),
    ("ip", "专利 商标 版权 知识产权 发明 著作权 ip 外观设计"),
    ("code", "代码 编程 开发 函数 api python java javascript git 算法 调试 部署 开源 github 程序"),
    ("energy", "能源 电力 电池 石油 天然气 光伏 风电 核电 碳中和 储能"),
    ("environment", "环境 污染 生态 气候 环保 碳排放 温室 垃圾分类 绿色"),
    ("agriculture", "农业 种植 养殖 农产品 粮食 农药 化肥 农机 畜牧业"),
    ("travel", "旅游 旅行 景点 酒店 机票 签证 攻略 民宿 行程 自驾"),
    ("film", "电影 影视 票房 导演 演员 剧集 影评 预告片 奥斯卡 戛纳"),
    ("gaming", "游戏 电竞 玩家 手游 主机 steam ps5 xbox switch 游戏机 通关 外挂"),
]

# ---- page merging: key rule, page limit, stop rules ----------------------------------------
PAGING = {
    "quark": dict(key="shell", max_pages=3, stop_on_no_new=True, stop_on_empty=False),
    "bing": dict(key="redirect", max_pages=5, stop_on_no_new=False, stop_on_empty=False),
    "serpapi": dict(key="plain", max_pages=3, stop_on_no_new=False, stop_on_empty=True),
}
BING_ROWS_PER_PAGE = 10

# ---- words of the report, and of the errors that are recognised -----------------------------
ABANDONED = "已放弃（全局超时）"
REPORT_WORDS = {
    "query": "查询: ", "engines": "引擎: ", "elapsed": "耗时: ", "raw": "候选 ", "final": " → 去重后 ", "returned": " → 可达 ",
    "dedup": "去重: ", "mode": " 档（恒开，标题阈值 ", "mode_end": "）", "arrow": "→", "merged": "(合并", "merged_end": ")",
    "reach": "可达性预检: 探测 ", "reach_ok": " 个域名，可达 ", "dropped": "，剔除 ", "dropped_end": " 条", "nothing": "没有结果。",
    "title": "    标题: ", "hit_by": "    命中: ", "snippet": "    摘要: ", "alternative": "    备用: ", "quote": "  《", "quote_end": "》",
    "status": "引擎状态:", "rows": "条",
}
ERROR_PATTERNS = [
    ("missing_key", "缺少 API Key"), ("timeout", "超时|deadline|全局超时"), ("quota", "HTTP 429"), ("throttled", "限流"),
    ("short_page", "响应过短"), ("http_status", "HTTP [1-9][0-9]{2}"), ("bad_json", "非预期 JSON"), ("unknown_engine", "未实现的引擎"),
]
