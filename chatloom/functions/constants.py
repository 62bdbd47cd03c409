"""Fixed values the results depend on: word lists, label shapes, limits and output phrases."""

# --- fixed values -----------------------------------------------------------------------------

STOP_WORDS = frozenset("""的 了 是 在 我 你 他 她 它 我们 你们 他们 好 很 也 都 和 与 及 或 有 没 不 这 那 就 还 要
会 可以 现在 今天 明天 昨天 一个 一些 什么 怎么 请 谢谢 没事 嗯 哦 哈 呵 啊 吧 吗 呢 啦 呀
的话 如果 但是 然后 所以 因为 而且 或者 这个 那个 上 下 里 中 到 去 来 说 看 做 用 对 从 被 把
时间 时候 地方 问题 东西 事情 情况 直接 知道 觉得 可能 应该 需要 开始 继续 已经 还是 就是
不是 没有 图片 语音 发送 收到 老板 老师 领导""".split())

SYSTEM_CHATS = ("微信团队", "订阅号消息", "文件传输助手", "腾讯文档", "微信支付", "微信豆包",
                "群聊", "折叠的群聊", "折叠的订阅号")

# Short Latin replies that are real messages although they look like screen scraps.
KEPT_REPLIES = ("ok", "okay", "no", "yes", "hi", "hello", "good", "fine")

SYSTEM_NOTICE = (r"^(以下为新消息|你已添加了|以上是打招呼的内容|收到了一条新消息|\[.*撤回.*\]"
                 r"|领了红包|收到了红包|发出了红包|拍了拍|以下为合并的消息"
                 r"|\d+条新消息|跳转到最新消息|查看更多消息|对方正在输入.*)$")
# White space around is part of the next patterns, so that no row is stripped just to be tested.
SCREEN_SCRAP = r"(?U)^\s*(?:\d+(?:\.\d+)?[KMGkmg]|[QO\d]{0,2}[:：]\d{1,2}|[A-Za-z]{1,3})\s*$"
BARE_NUMBER = r"(?U)^\s*[\d\s.]*[\d.][\d\s.]*$"
MEANINGFUL = (r"(?Us)^\s*(?:(?=.*[一-鿿])\S.*\S|[\d.\-:/]{6,}|[A-Za-z0-9.\-:_/]{4,})\s*$")

# Groups: year, month, day, recent day, week day, hour, minute, second.
LABEL_SHAPES = (r"(?U)^(?:(?:(\d{4})\s*年\s*)?(\d{1,2})\s*月\s*(\d{1,2})\s*日|(昨天|前天)"
                r"|(?:星期|周)([一二三四五六日天]))?\s*(?:(\d{1,2}):(\d{2})(?::(\d{2}))?)?\s*$")
# Seconds are allowed after a date or alone, not after a relative day.
TIME_LABEL = (r"(?U)^\s*(?:(?:\d{4}\s*年\s*)?\d{1,2}\s*月\s*\d{1,2}\s*日(?:\s*\d{1,2}:\d{2}(?::\d{2})?)?"
              r"|(?:昨天|前天|星期[一二三四五六日天]|周[一二三四五六日天])\s*\d{1,2}:\d{2}"
              r"|\d{1,2}:\d{2}(?::\d{2})?)\s*$")
VOICE_MARK = "(?U)^(\\d{1,2})\\s*['’”″\"]{1,2}\\s*$"
FIRST_YEAR = 2011

NAME_PUNCTUATION = r"(?U)[\s·.。:：()（）\[\]【】\-—_]+"
TIME_OR_BADGE = r"^(?:\d{1,2}:\d{2}|昨天|前天|(?:星期|周)[一二三四五六日天]|\[\d+条\]|\d+条新消息?)$"
PUNCTUATION_ONLY = r"(?U)^[\s·.。,，、()（）\[\]【】]{0,3}$"
SEARCH_BOX = "^[以QO]?搜[索茶系文]?$"
DATE_STAMP = r"^\d{1,2}-\d{1,2}$"
# Any of the four above (or nothing) between white space, as one test.
LAYOUT_SCRAP = r"(?U)^\s*(?:" + "|".join(
    p.replace("(?U)", "").strip("^$") for p in (PUNCTUATION_ONLY, TIME_OR_BADGE, SEARCH_BOX, DATE_STAMP)) + r")\s*$"
STAMP = (r"^(?:\d{1,2}:\d{2}|昨天|前天|(?:星期|周)[一二三四五六日天]"
         r"|(?:19|20)\d{2}[/.]\d{1,2}(?:[/.]\d{1,2})?|\d{1,2}[/-]\d{1,2}|\[\d+条\]|\d+条新消息?)$")
STAMP_AFTER_REPAIR = (r"^(?:\d{1,2}:\d{2}|(?:19|20)\d{2}[/.]\d{1,2}(?:[/.]\d{1,2})?"
                      r"|\d{1,2}[/.-]\d{1,2})$")
WITHIN_WEEK_STAMP = r"^(?:\d{1,2}[:：]\d{2}|昨天|前天|(?:星期|周)[一二三四五六日天])$"
YEAR_STAMP = r"^((?:19|20)\d{2})[/.-](\d{1,2})(?:[/.-](\d{1,2}))?"
MONTH_DAY_STAMP = r"^(\d{1,2})[/.-](\d{1,2})$"

FUSED_CLOCK = (r"(?U)[.。·…~～]{0,4}\s*(?:昨天|前天|(?:星期|周)[一二三四五六日天])?"
               r"\s*[QO\d]{0,2}\d{1,2}[:：]\d{2}\s*$")
FUSED_YEAR = r"((?:19|20)\d{2}/?\d{0,2})$"
FUSED_MONTH_DAY = r"(\d{1,2}/\d{1,2})$"
NAME_TAIL = r"[.。·…~～ ]+$"

NAME_FLOOR, STAMP_FLOOR = 0.4, 0.28
LINE_GAP, ITEM_GAP, TOP_BAND, RIGHT_SHARE = 10, 12, 22, 0.72
DEDUP_SCREENS = 3
FUZZY_RATIO, WINDOW_RATIO = 0.70, 0.80
CHUNK_CHARS, MAX_CHUNKS, CAPTIONED_IMAGES, EMBEDDED_IMAGES = 3500, 80, 12, 50
POINT_CHARS, TIMELINE_CHARS, TIMELINE_ROWS = 60000, 20000, 60
CATEGORIES = ("events", "decisions", "todos", "viewpoints", "problems", "facts")

SELF, OTHER = "我方", "其他"
TITLE_SUFFIX = {"work": "工作情况报告", "progress": "项目进展报告", "general": "综合分析报告"}
DEFAULT_TITLE_SUFFIX = "分析报告"
FALLBACK_HEADING = "一、聊天记录要点"
EXPORT_NOTE = "（视觉自动化截图 + OCR 提取，严格只读；语音仅记录时长）"
TEMPLATE_HINT = {
    "work": "这是一份工作情况报告：聚焦工作进展、成果、问题与下一步安排。",
    "progress": "这是一份项目进展报告：聚焦里程碑、完成情况、风险与对策。",
    "general": "这是一份综合分析报告：全面梳理有价值的内容、观点与结论。",
}
# --- end of fixed values ----------------------------------------------------------------------
