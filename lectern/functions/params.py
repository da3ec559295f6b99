"""Word lists, weights and patterns that results depend on. All are defaults of parameters."""

# Fixed values of query normalisation and expansion.
QUERY_STOPS = ("什么", "怎么", "如何", "为什么", "哪些", "是否", "请问", "一下", "作用", "主要", "含义", "介绍", "说明")
SYNONYMS = {
    "地址转换": ("页表", "tlb", "虚拟地址", "物理地址"),
    "缺页": ("缺页中断", "页面置换", "调页"),
    "调度": ("进程", "线程", "cpu"),
    "后进先出": ("栈", "lifo"),
    "先进先出": ("队列", "fifo"),
    "映射": ("地址转换", "页表"),
    "缓存": ("tlb", "高速缓存"),
    "后备缓冲": ("tlb", "缓存"),
}
ALIASES = {
    "后进先出": ("栈", "lifo"),
    "先进先出": ("队列", "fifo"),
    "地址变换": ("地址转换", "页表", "tlb"),
    "虚实地址": ("虚拟地址", "物理地址", "页表"),
    "缓存页表": ("tlb", "页表"),
    "递归调用": ("栈", "函数调用"),
    "广搜": ("队列", "广度优先搜索", "bfs"),
    "宽搜": ("队列", "广度优先搜索", "bfs"),
}
PREFERRED_TERMS = ("虚拟内存", "文件系统", "二叉搜索树", "平衡二叉树", "循环队列", "进程", "线程", "页表", "队列", "栈", "二叉树")
KEYWORD_STOPS = ("本课程", "示例资料", "本地课程", "参考要点")
DEFAULT_KEYWORD = "核心概念"

# Fixed values of material kinds, first match wins.
MATERIAL_TYPES = (
    ("practice", ("习题", "练习", "quiz", "作业", "exercise")),
    ("slides", ("课件", "slides", "ppt", "lecture")),
    ("textbook", ("教材", "book", "chapter", "讲义")),
    ("notes", ("笔记", "note")),
)

# Fixed values of extraction quality.
ERROR_PATTERNS = ("解析失败", "无法抽取文本", "文件未损坏", "缺少 pypdf", "no text extracted", "extract text failed", "parse failed")
IMAGE_PATTERNS = ("图片文件已保存", "[图片]", "[image]", "<image>", "image placeholder")
OCR_PATTERNS = ("ocr", "扫描件", "scan-only", "scanned pdf", "需要 ocr", "无法识别")

# Fixed values of claims and citations.
CITATION_STOP_CHARS = "的一是在和与或及了为把对中上下面里个种这那其有就都而被并"
HEDGES = ("可能", "也许", "大概", "或许", "不一定", "建议", "可以", "请", "复习时", "下一步", "如果", "当")
SUPPLEMENTS = ("补充知识", "通用知识", "资料未覆盖", "未找到课程资料依据")

# Fixed values of follow-up questions.
FOLLOW_UP_TERMS = ("这个", "这道", "这题", "这里", "上面", "前面", "刚才", "上一", "下面", "后面", "那个", "那道", "它", "其")
SHORT_FOLLOW_UP = r"^(怎么做|为什么|啥意思|什么意思|展开|继续|然后呢|答案呢|复杂度呢|证明呢)[？?。！!]*$"
QUESTION_REFERENCE = r"第\s*([一二三四五六七八九十\d]+)\s*[问题题小问步]"
MEMORY_STOPS = ("什么", "怎么", "如何", "为什么", "请问", "一下", "说明", "解释", "作用")
LIGHT_CHAT = r"(?i)^(?:你好|您好|嗨|hi|hello|hey|早上好|晚上好|好|好的|可以|收到|明白|谢谢|谢了|ok|yes|no)[。！!？?\s]*$"
ATTEMPT_MARKERS = ("我觉得", "我认为", "我算", "我试", "推导", "因为", "所以", "得到", "答案是", "卡在")
DISCLOSURE = ("直接.*答案", "完整.*(答案|解法|讲解)", "(告诉|给).*答案", "不要提示")

# Fixed values of web sources.
WEB_STOPS = (
    "一下", "什么", "怎么", "为什么", "这个", "那个", "课程", "内容", "总结", "解释", "说明", "帮我",
    "please", "about", "what", "with", "from", "search", "latest",
)

# Fixed values of query intents.
FRESHNESS = r"(?i)最新|现在|目前|今天|今年|近期|最近|联网|网上|20\d{2}\s*年?|web\s*search|current|latest|today|recent"
COURSE_EXPLAIN = r"(?i)讲一下|解释|说明|总结|概括|复习|知识点|课程内容|这节课|这个课程|帮我学|怎么理解|what is|explain|summari[sz]e"
WEB_INTENT = r"(?i)联网|网上|搜索|查一下|资料外|补充资料|外部资料|竞品|官网|论文|新闻|current|latest|web\s*search|search"

# Fixed values of study plans.
PLAN_FIRST = ("教材", "chapter", "lecture", "课件", "讲义")
PLAN_SECOND = ("习题", "练习", "quiz", "作业", "复习")
PLAN_PRACTICE = ("习题", "练习", "quiz", "作业")
PLAN_REVIEW = ("复习", "summary", "总结")
GENERATED_FOLDER = "AI生成"
SUMMARY_NAMES = ("摘要", "summary")
QUIZ_NAMES = ("练习", "习题", "quiz", "自测")

# Fixed values of file kinds.
TEXT_EXTENSIONS = (".md", ".markdown", ".txt")
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".webp", ".gif", ".bmp")
EXTENSIONS = (".pdf", ".docx", *TEXT_EXTENSIONS, *IMAGE_EXTENSIONS)

TOKENIZER_VERSION, SCHEMA_VERSION, VECTOR_VERSION = "zh_ngrams_v2", 2, 1
CHUNK_SIZE, CHUNK_OVERLAP = 520, 80
K1, B, RRF_K = 1.5, 0.75, 60
