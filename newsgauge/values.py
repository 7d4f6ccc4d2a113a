"""Fixed values.

Everything in this module is a value that decides results (word lists, patterns, lookup rows,
limits). Lists whose order matters are first-match-wins, so the order below is part of the value.
Larger tables (the outlet dictionary, the city list, the project list) are inputs, not code.
"""

# --- tiers, best first; the position is the rank used for sorting ---------------------------
TIERS = ("人民日报/央视", "央广", "中央级", "省部级", "地方", "行业", "个人账号", "微信公众号", "未分类")
UNKNOWN_TIER_RANK = 99
UNCLASSIFIED = "未分类"
PERSONAL = "个人账号"
INDUSTRY = "行业"
PROVINCIAL = "省部级"
LOCAL = "地方"
WECHAT_TIER = "微信公众号"
# tiers listed on the summary sheet, in sheet order
SUMMARY_TIERS = ("人民日报/央视", "央广", "中央级", "省部级", "地方", "行业", "微信公众号", "未分类")
# tiers an external label may name
LABEL_TIERS = ("人民日报/央视", "央广", "中央级", "省部级", "地方", "行业", "个人账号", "未分类")
DISPLAY_LABELS = {"未分类": "其他"}

# --- placeholder outlet names -----------------------------------------------------------------
UNKNOWN_OUTLET = "未知来源"
WECHAT_OUTLET = "微信公众号"
NO_TITLE = "无标题"
SOURCE_LABELS = {"news": "多源新闻", "wechat": "微信公众号"}

# --- rejection reasons --------------------------------------------------------------------------
REASON_OWN = "自身发布内容"
REASON_PRECISION = "未提到具体项目名"
REASON_DUPLICATE = "重复内容"
REASON_SCORE = "报道评分不足"
REASON_PERSONAL = "个人账号"

OWN_ACCOUNT_PATTERN = "八局|中建|中国建筑"
COMPANY_QUERY_PREFIX = "中建八局"

# (pattern, reason), first match wins
NOISE_RULES = (
    (r"专利", "专利公告"),
    (r"招聘|求职|招人|诚聘|年薪|五险一金|岗位|社招|校招|实习|管培生", "招聘求职"),
    (r"招标公告|中标候选人|中标公示|招标文件|采购公告|询价公告|竞争性磋商|比选公告", "招标中标"),
    (r"^(关于|关于做好|关于组织|关于开展|关于召开).*(通知|公告)$", "通知公告"),
    (r"股票|基金净值|A股|港股|涨停|跌停", "股票基金"),
    (r"广告|推广|促销|优惠|打折|免费领取", "广告推广"),
)

# --- report score -------------------------------------------------------------------------------
EVENT_WORDS = (
    "封顶", "竣工", "验收", "开工", "复工", "启用", "完工",
    "全面复工", "复工复产", "冲刺", "新进展", "最新进展",
    "突破", "落成", "开馆", "试运行", "启动", "传来最新消息",
    "又有新进展", "建设进入", "进入冲刺", "全力冲刺",
    "全面封顶", "圆满完成", "首座", "通过验收", "正式投用",
    "正式对外开放", "具备条件", "对外开放",
    "结构封顶", "主体完工", "交付", "投入使用", "投运",
    "贯通", "揭牌", "开工仪式", "通车", "合龙", "亮灯",
    "授牌", "签约", "奠基", "上线",
    "开幕", "启幕", "开业", "举办", "举行", "运营",
)
PROGRESS_WORDS = (
    "进展", "最新", "新进展", "进度", "进入",
    "按下加速键", "跑出加速度", "步入", "迎来",
    "即将", "预计", "计划", "顺利", "圆满",
    "全力", "全面", "有序", "积极",
)
EXCLUDE_PATTERNS = (
    r"招聘|求职|招人|诚聘|年薪|五险一金|岗位|社招|校招|实习|管培生|猎头|内推|急招|高薪",
    r"招标公告|中标候选|中标公示|招标文件|采购公告|询价公告|竞争性磋商|比选公告|流标|废标|中标结果|招投标|投标",
    r"股票|基金净值|A股|港股|涨停|跌停|收盘|开盘|K线|市盈率|市净率|分红",
    r"广告|推广|促销|优惠|限时|打折|免费领取|秒杀|团购|满减|狂欢|大促",
    r"^关于.*(通知|公告|公示|通告)$",
    r"(放假|调休|闭馆|闭园|暂停营业|停水|停电|停气).*(通知|公告)",
    r"述职|竞聘|绩效考核|考勤|周报|月报|日报|会议纪要|内部培训|员工手册",
)
LOW_QUALITY_PATTERNS = (
    r"快照|百度快照|网页快照|缓存",
    r"^\d{4}-\d{2}-\d{2}$",
)
EXCLUDE_SCORE = -100
LOW_QUALITY_SCORE = -50
KNOWN_NEWS_DOMAINS = (
    "xinhuanet.com", "people.com.cn", "cctv.com", "chinanews.com",
    "gmw.cn", "ce.cn", "huanqiu.com", "cnr.cn", "cri.cn",
    "thepaper.cn", "eastday.com", "youth.cn", "china.com.cn",
)
DETAIL_EXCLUDED = "绝对排除: "
DETAIL_LOW_QUALITY = "低质量源排除"
DETAIL_SHORT_TITLE = "标题过短(<5字)"
DETAIL_GOOD_TITLE = "标题长度优(10-29字)"
DETAIL_OK_TITLE = "标题长度正常"
DETAIL_EVENTS = ("多事件词命中(", "个)")
DETAIL_EVENT = "报道事件词命中"
DETAIL_PROGRESS = "进展描述+"
DETAIL_NEWS = "新闻源"
DETAIL_FORMAL = "正规媒体"
DETAIL_WECHAT = "微信+事件词"
DETAIL_GOV = "政府网站"
DETAIL_KNOWN = "知名媒体域名"

# --- outlet names ---------------------------------------------------------------------------------
PLATFORM_PREFIXES = (
    "百度百家号", "百家号", "搜狐", "网易", "腾讯", "QQ News", "新浪", "凤凰", "澎湃",
    "一点资讯", "今日头条", "头条号", "趣头条", "微信公众号", "未知来源",
)
RAW_DOMAIN_SUFFIXES = "com|cn|net|org|gov\\.cn|edu\\.cn|com\\.cn|cc|io|me"
UI_PHRASES = "查看更多|更多精彩|相关推荐|阅读原文|上一篇|下一篇|返回搜狐|扫码|关注我|点击查看"
NAME_LEAD = "^(官方|来自)?(账号|帐号|媒体|来源)[：:]?"
NAME_TAIL = "(官方)?(百家号|搜狐号|网易号|企鹅号|头条号|澎湃号|公众号|账号|帐号)$"
SOURCE_STOPS = (
    "责任编辑|审核|校对|编辑|作者|责编|声明|图片|摄影|版权|记者|文/|图/|综合整理|整理|供稿|原标题|素材来源"
)
BLOCK_PAGE_PATTERN = "百度安全验证|安全验证|请输入验证码"

# (fragment, outlet name), first match wins
DOMAIN_OUTLETS = (
    ("chinanews.com.cn", "中国新闻网"),
    ("nmgnews.com.cn", "内蒙古新闻网"),
    ("caacnews.com.cn", "中国民航网"),
    ("chinadaily.com.cn", "中国日报网"),
    ("legaldaily.com.cn", "法治日报"),
    ("mot.gov.cn", "交通运输部"),
    ("nmg.gov.cn", "内蒙古自治区人民政府"),
    ("huhhot.gov.cn", "呼和浩特市人民政府"),
    ("crecg.com", "中国中铁"),
    ("carnoc.com", "民航资源网"),
    ("xinhuanet.com", "新华网"),
    ("people.com.cn", "人民网"),
    ("jiemian.com", "界面新闻"),
    ("52hrtt.com", "华人头条"),
    ("workercn.cn", "工人日报"),
    ("qstheory.cn", "求是网"),
    ("thepaper.cn", "澎湃新闻"),
    ("eastday.com", "东方网"),
    ("yicai.com", "第一财经"),
    ("caixin.com", "财新"),
    ("huanqiu.com", "环球网"),
    ("cctv.com", "央视网"),
    ("china.com.cn", "中国网"),
    ("youth.cn", "中国青年网"),
    ("cri.cn", "国际在线"),
    ("cnr.cn", "央广网"),
    ("81.cn", "中国军网"),
    ("gmw.cn", "光明网"),
    ("ce.cn", "中国经济网"),
)
# (fragment, short name shown for a result link's host), first match wins
HOST_SHORT_NAMES = (
    ("baijiahao.baidu.com", "百度百家号"),
    ("m.thepaper.cn", "澎湃新闻"),
    ("thepaper.cn", "澎湃新闻"),
    ("sina.com.cn", "新浪"),
    ("finance.sina.com.cn", "新浪财经"),
    ("sohu.com", "搜狐"),
    ("163.com", "网易"),
    ("qq.com", "腾讯"),
    ("ifeng.com", "凤凰网"),
    ("xinhuanet.com", "新华网"),
    ("people.com.cn", "人民网"),
    ("cctv.com", "央视网"),
    ("chinanews.com", "中新网"),
    ("gmw.cn", "光明网"),
    ("youth.cn", "中国青年网"),
    ("ce.cn", "中国经济网"),
    ("huanqiu.com", "环球网"),
    ("cscec.com", "中国建筑"),
)
# (fragment, tier), first match wins
DOMAIN_TIERS = (
    ("gov.cn", "中央级"),
    ("people.com.cn", "人民日报/央视"),
    ("cctv.com", "人民日报/央视"),
    ("cntv.cn", "人民日报/央视"),
    ("cnr.cn", "央广"),
    ("xinhuanet.com", "中央级"),
    ("chinanews.com", "中央级"),
    ("chinadaily.com.cn", "中央级"),
    ("gmw.cn", "中央级"),
    ("ce.cn", "中央级"),
    ("youth.cn", "中央级"),
    ("cyol.com", "中央级"),
    ("81.cn", "中央级"),
    ("huanqiu.com", "中央级"),
    ("china.com.cn", "中央级"),
    ("cri.cn", "中央级"),
    ("qstheory.cn", "中央级"),
    ("eastday.com", "省部级"),
    ("thepaper.cn", "省部级"),
    ("yicai.com", "省部级"),
    ("caixin.com", "省部级"),
    ("ifeng.com", "省部级"),
    ("sina.com.cn", "省部级"),
    ("sohu.com", "省部级"),
    ("163.com", "省部级"),
    ("qq.com", "省部级"),
)
PAPER_WORDS = ("日报", "晚报", "都市报", "新闻网", "融媒体")
PROVINCES = (
    "北京", "上海", "天津", "重庆", "河北", "山西", "内蒙古", "辽宁", "吉林", "黑龙江", "江苏",
    "浙江", "安徽", "福建", "江西", "山东", "河南", "湖北", "湖南", "广东", "广西", "海南", "四川",
    "云南", "贵州", "西藏", "陕西", "甘肃", "青海", "宁夏", "新疆", "兵团",
)
INDUSTRY_WORDS = (
    "建筑", "工程", "建设", "施工", "设计", "监理", "造价", "建材", "勘察", "测绘", "交通", "铁路",
    "公路", "桥梁", "隧道", "轨道", "电力", "能源", "石油", "石化", "天然气", "煤矿", "水利", "环境",
    "通信", "钢铁", "冶金", "化工",
)

# --- links ------------------------------------------------------------------------------------------
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_content",
    "from", "source", "refer", "spm", "scm", "share_id",
)
REDIRECT_HOST = "news.google.com"
WECHAT_LINK_ROOT = "https://weixin.sogou.com"

# --- HTML entities, applied in this order -----------------------------------------------------------
URL_ENTITIES = (
    ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
)
RSS_TITLE_ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'))
RSS_SNIPPET_ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
API_ENTITIES = (
    ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
    ("&ldquo;", "“"), ("&rdquo;", "”"), ("&hellip;", "…"),
)
WECHAT_ENTITIES = (
    ("&ldquo;", "“"), ("&rdquo;", "”"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&mdash;", "—"),
    ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
    ("&quot;", '"'), ("&nbsp;", " "),
)
NAME_ENTITIES = (("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"))

# --- keywords ---------------------------------------------------------------------------------------
NEWS_WORDS = ("封顶", "竣工", "验收")
SUBJECT_TAIL = "(工程|项目|建设项目|工程总承包|施工总承包|项目工程)+$"
LEGAL_SUFFIX = "有限公司|股份有限公司|集团有限公司|集团|有限责任公司"
PROVINCE_LEAD = "^(.{2,4}?省)(.+)$"

# --- limits and thresholds --------------------------------------------------------------------------
SNIPPET_CHARS = 200
MIN_TITLE_CHARS = 4
RESULT_WINDOW_CHARS = 1500
SOURCE_LINE_CHARS = 900
SOURCE_TAIL_CHARS = 600
TITLE_SIMILARITY = 0.85
QUERIES_PER_SUBJECT = 8
QUERIES_USED = 3
LITERAL_QUERIES_USED = 4
MAX_PER_QUERY = 40
MAX_NEWS_PER_SUBJECT = 200
MAX_WECHAT_PER_SUBJECT = 80
FILTERED_SAMPLE = 150
MIN_REPORT_SCORE = 15
