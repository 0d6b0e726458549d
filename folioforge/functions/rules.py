"""Rule values of the cleaning operators. All are fixed values; Java and RE2 read the patterns alike unless a name says otherwise."""

from __future__ import annotations

# White space as the rules mean it (all Unicode white space).
WS = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CJK = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}"
WORD_END = r"(?:$|[^\p{L}\p{N}_])"

# Reading sites (key, aliases in match form, domain fragments, known by the short form).
SITES = (
    ("9xiaoxs", ("九霄小说网", "九霄小说", "9xiaoxs"), ("9xiaoxs",), True),
    ("biquge", ("新笔趣阁", "笔趣阁", "xbiquge", "biquge", "bqg"), ("xbiquge", "biquge", "bqg"), True),
    ("dingdian", ("顶点小说",), (), True),
    ("bixia", ("笔下文学",), (), True),
    ("yunxuange", ("云轩阁",), (), True),
    ("kuairead", ("快读",), (), False),
    ("balu", ("八路中文网",), (), True),
    ("shubao", ("书包网",), (), True),
    ("boluoxs", ("菠萝小说", "boluoxs"), ("boluoxs",), True),
    ("aiqu", ("爱去小说网",), (), True),
    ("soushu", ("搜书", "soushu"), ("soushu",), False),
    ("cihetxt", ("词河看书", "cihetxt"), ("cihetxt",), True),
    ("69shu", ("69书吧", "六九书吧"), ("69shu",), True),
    ("shuq", ("书趣阁",), (), True),
    ("00ks", ("零点看书", "00ks"), ("00ks",), True),
    ("piaotian", ("飘天文学", "piaotian"), ("piaotian",), True),
    ("uukanshu", ("uu看书", "uukanshu"), ("uukanshu",), True),
)

# Signal roles.
STRONG = ("url", "email", "contact", "download", "watermark", "reader_site")
SHORT = ("url", "email", "watermark")
NEIGHBOR = ("url", "email", "contact", "download", "reader_site", "domain")
LOCATOR = ("url", "email", "contact", "reader_site", "domain")

# The grammar of source markers.
_OBJECT = r"(?:本书|本文|全文|文章|内容|电子书|电子文本|TXT(?:电子书|文本)?|OCR(?:文本)?)"
_COMPOUND = r"(?:扫描版|手打版|整理版|校对版|制作版|校对组|整理组|扫描组|录入组|手打组|制作组)"
_ACTION = r"(?:手打|校对|整理|录入|扫描|制作)(?:制作|校对|整理|录入)?(?:版|组)?"
_ORIGIN = r"(?:网站|论坛|书库|公众号|博客|贴吧|社区|工作室|(?:校对|整理|扫描|录入|手打|制作)组|(?:小说|中文|文学|阅读)网)"
_PUNCTUATION = r"，。！？；：、,.!?;:\r\n“”‘’「」『』（）()【】\[\]{}《》<>—…"
_CLAUSE = rf"[^{_PUNCTUATION}]"
_END = rf"(?:$|[{_PUNCTUATION}])"
_START = rf"(?:^|[^{CJK}])"
SOURCE_MARKER = (
    rf"(?:{_OBJECT}(?:系?由|经){_CLAUSE}{{0,24}}?{_ACTION}{_END}"
    rf"|{_OBJECT}{_CLAUSE}{{0,6}}?{_COMPOUND}"
    rf"|{_OBJECT}(?:转自|转载自|来源于){_CLAUSE}{{1,24}}?{_ORIGIN}{_END}"
    rf"|{_OBJECT}(?:来源|出处)[:：]{_CLAUSE}{{1,24}}?{_ORIGIN}{_END}"
    rf"|{_START}(?:转自|转载自|来源于){_CLAUSE}{{1,24}}?{_ORIGIN}{_END}"
    rf"|{_START}(?:来源|出处)[:：]{_CLAUSE}{{1,24}}?{_ORIGIN}{_END}"
    rf"|{_START}{_COMPOUND}(?:$|[^{CJK}]))"
)
BARE_COPY_MARKER = r"(?i)(?:转自|手打|校对|整理|录入|扫描|制作)"

# Signals, in order, on match-folded text. Where only a hit matters, one character stands for a run of them: folded
# text has no spaces, and a run that is tried from each of its characters takes quadratic time.
SIGNALS = (
    ("url", rf"(?i)https?://|www\.|[A-Za-z0-9_-]\.(?:com|net|cn|org|cc|top|xyz|vip){WORD_END}"),
    ("email", r"(?i)[A-Za-z0-9._%+\-]@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"),
    ("contact", r"(?i)(?:QQ|QQ群|微信|VX|wx|公众号|书友群)[:：]?[A-Za-z0-9_\-]{4,}"),
    ("download", r"(?i)(?:txt下载|全本下载|电子书下载|免费下载|下载地址|本书下载)"),
    (
        "watermark",
        rf"(?i)(?:{SOURCE_MARKER}|仅供学习交流|手机用户请访问|请访问|转载请注明|在线阅读全文访问|免费.{{0,6}}阅读网站|优秀的在线阅读网站|欢迎.{{0,4}}[捧棒]场)",
    ),
    ("reader_site", r"(?i)(?:最新章节|更新最快|无弹窗|在线阅读|阅读网站|起点中文网首发)"),
    ("author_note", r"(?i)(?:作者的话|PS[:：]?|求收藏|求推荐|求月票|打赏)"),
    ("copy_marker", rf"(?i){SOURCE_MARKER}"),
)

# Promotion intents, in order, on match-folded text.
INTENTS = (
    ("visit", r"(?:请|欢迎|建议).{0,6}访问|站外(?:更新|阅读|获取)"),
    ("read", r"更新最快|无弹窗|在线阅读|阅读全文|最新章节|阅读网站"),
    ("download", r"TXT下载|下载地址|站外获取文件|获取文件"),
    ("contact", r"请联系|请加入|获取更新通知|加入(?:QQ|微信|VX|wx)"),
    ("source", r"仅供学习交流|来源水印|整理组|校对组|转载"),
    ("support", r"欢迎.{0,4}[捧棒]场|求收藏|求推荐|求打赏"),
)

# Visit cues and what binds them to a locator.
VISIT_CUE = r"(?:请|欢迎|建议).{0,6}访问"
VISIT_BRIDGE = r"(?:以下)?(?:地址|网址|网站|站点|本站)?[:：为是到至\-—]*"
VISIT_TAIL = r"^[,，:：;；\-—]*(?:获取(?:后续|更新|内容)|查看(?:最新)?章节|阅读(?:全文|最新章节)|更新(?:内容|章节|最快)|下载(?:全文|txt)?|无弹窗)"
#: A frame and what is between it and the cue have 32 characters at most.
VISIT_FRAME = r"(?:作者荐.{0,29}|(?:作者推荐|站外(?:更新|阅读|获取|提示)).{0,28}|喜欢小说的.{0,27})"
TLDS = r"(?:com|net|cn|org|cc|top|xyz|vip)"
DOMAIN_NAME = rf"[a-z0-9][a-z0-9_-]{{1,62}}\.{TLDS}"
#: Java only: with look-around, so that neighbouring domains are all found.
DOMAIN_JAVA = rf"(?i)(?<![a-z0-9_-])(?:www\.)?({DOMAIN_NAME})(?![a-z0-9_-])"
DOMAIN_RE2 = rf"(?i)(?:^|[^a-z0-9_-])(?:www\.)?({DOMAIN_NAME})(?:$|[^a-z0-9_-])"
EMAIL = r"(?i)[a-z0-9._%+\-]+@([a-z0-9.\-]+\.[a-z]{2,})"
EMAIL_HOST = r"(?i)[a-z0-9._%+\-]@([a-z0-9.\-]+\.[a-z]{2,})"

# Narrative mentions of outside things.
NARRATIVE = (
    r"(?:剧情|场景|线索|证物|调查记录|旧邮箱|旧日志|并非邀请|没有发出联系请求|封存|本地档案)|(?:没有|并未|未曾|从未).{0,16}(?:访问|联系|下载|加入|前往)",
    r"(?i)[“「『\"'][^”」』\"'\n]{0,320}(?:https?://|www\.|[A-Za-z0-9._%+\-]+@|请访问|联系|下载)[^”」』\"'\n]{0,320}[”」』\"']",
    r"(?:告示|纸条|便签|信(?:里|中)?|日记|记录).{0,16}(?:写着|写道|记着|记载|提到|显示)|(?:读完|看完|念完).{0,32}(?:折好|收进|放进|塞进|合上|递给|藏起|撕掉)",
)
NARRATIVE_WATERMARK = r"(?:运转自(?:身|己|如)|回转自(?:身|己)|圆转自如|扭转自己)"
TERM_STOPWORDS = ("小说", "章节", "正文", "作者", "读者", "系统", "世界", "大陆", "学院")
NOISY_NAME = r"(?i)(?:https?|www\.|\.com|\.net|\.cn|\.org|\.cc|\.vip|@|下载|全本|txt|epub|soushu|cihetxt|biquge|xbiquge|9xiaoxs)"
PROTECTED_NAME = r"(?i)(?:改版|修改|改[0-9]*|同人|二创|番外|外传|续写|衍生|魔改)"
NAME_NOISE = r"(?:小说|txt|epub|精校版|完结版|全本|下载)"
AUTHOR_PHRASE = r"作者(?:推荐|有话要说)|有话说|有事说|大声说|告诉你|说"

# Number characters and headings, in order: (pattern, label group, number group or 0, rest group).
CN_NUMBER = "0-9零〇一二两兩三四五六七八九十百千万萬壹貳贰叁參肆伍陸陆柒捌玖拾佰仟"
CN_DIGITS = {
    "零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "兩": 2, "壹": 1, "貳": 2, "贰": 2, "叁": 3, "參": 3, "肆": 4, "伍": 5, "陸": 6, "陆": 6,
    "柒": 7, "捌": 8, "玖": 9, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9,
}
CN_UNITS = {"十": 10, "拾": 10, "百": 100, "佰": 100, "千": 1000, "仟": 1000}
_W = WS[1:-1]
_TAIL = rf"[{_W}:：、.．-]*(.*?){WS}*$"
HEADINGS = (
    (rf"^{WS}*(?:正文{WS}*)?(第{WS}*([{CN_NUMBER}]+){WS}*[章节節卷集部篇回话話]){_TAIL}", 1, 2, 3),
    (rf"^{WS}*(卷{WS}*([{CN_NUMBER}]+)){_TAIL}", 1, 2, 3),
    (rf"^{WS}*(序|序章|序言|序文|序幕|楔子|引子|前言|后记|後記|尾声|尾聲|终章|終章|番外(?:篇)?(?:{WS}*[{CN_NUMBER}]+)?){_TAIL}", 1, 0, 2),
    (rf"(?i)^{WS}*(Chapter[{_W}-]*([0-9]+)){_TAIL}", 1, 2, 3),
    (rf"(?i)^{WS}*((?:Part|Volume|Book)[{_W}-]*([0-9]+)){_TAIL}", 1, 2, 3),
    (rf"(?i)^{WS}*(Prologue|Epilogue|Afterword|Foreword|Introduction){_TAIL}", 1, 0, 2),
    (rf"^{WS}*(([0-9]{{1,5}})[、.．]){WS}*(.+?){WS}*$", 1, 2, 3),
    (rf"^{WS}*(([0-9]{{1,4}})){WS}+([\x{{4e00}}-\x{{9fff}}A-Za-z][^。！？!?]{{0,40}}){WS}*$", 1, 2, 3),
)
SENTENCE_MARK = r"[。！？!?；;]"
CATALOG = r"(?:目录|章节目录|章节列表|最新章节|全部章节|返回目录|上一章|下一章|无弹窗|更新最快)"
OPENING_QUOTES = "“\"「『"

# Sizes.
HEADING_CHARS, HEADING_REST = 80, 45
BLOCK_CHARS = 500
NEAR_KEY = (20, 260)
L4_CHARS, L4_RADIUS, L2_RADIUS = 160, 299, 320
MAX_ANCHORS = 120
SIMHASH_DISTANCE, NEAR_JACCARD, FAMILY_JACCARD = 3, 0.7, 0.72
FALLBACK_TEXT, FALLBACK_CHUNK = 120_000, 50_000
DELETION_LIMIT = 0.08

# Brackets, masks and separators.
BRACKETS = ("（）", "()", "[]", "{}", "【】", "《》", "「」", "『』")
ZERO_WIDTH = "\ufeff\u200b\u200c\u200d\u2060"
