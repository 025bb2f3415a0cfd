"""Word lists and regular expressions of the text rules. Order and spelling matter for the results."""

NOISE = [
    r"^(hello|hi|hey|greetings|good\s+(morning|afternoon|evening))[\s!.,?]*$",
    r"^(你好|嗨|早上好|下午好|晚上好|新的一天开始了)[\s!.,?！。？]*$",
    r"^HEARTBEAT[\s]*$",
    r"(I\s+don'?t\s+have\s+any\s+information|no\s+relevant\s+memories?\s+found|I\s+couldn'?t\s+find\s+any)",
    r"(I\s+don'?t\s+have\s+(?:specific\s+)?(?:details?|data|records?)\s+(?:about|on|for))",
    r"^(do\s+you\s+remember|what\s+do\s+you\s+know\s+about|can\s+you\s+recall)",
    r"(你还记得|你知道.*吗|你记得.*吗)",
    r"^(我没有相关的记忆|我没有.*的信息|没有找到相关)[\s]*",
    r"(query\s*->\s*none|no\s+explicit\s+solution|search\s+returned\s+0\s+results)",
    r"^(thanks|thank\s+you|ok|okay|sure|got\s+it|understood)[\s!.,?]*$",
    r"^(谢谢|好的|明白了|收到|了解)[\s!.,?！。？]*$",
    r"extracted \d+ facts",
    r"reconciliation complete",
    r"found \d+ matching",
    r"compression #\d+",
    r"dcp-message-id",
    r"system-reminder",
    r"background task",
    r"task_id.*bg_",
    r"session_id:\s*ses_",
    r"cargo (build|test|check)",
    r"npm (run|install|test)",
    r"HTTP \d{3}",
    r"status code \d+",
    r"docker (ps|run|exec|logs)",
    r"git (status|log|diff|add|commit|push)",
    r"lsp_diagnostics",
    r"ast_grep",
    r"semantic search",
    r"\d+ files? (changed|modified|created)",
    r"build (succeeded|failed)",
    r"test result: (ok|failed)",
    r"\d+ passed.*\d+ failed",
    r"compressed (conversation|block)",
    r"\[system-reminder\]",
    r"\[dcp-message-id\]",
    r"background task (launched|completed|error)",
    r"task_id.*session_id",
    r"cargo (check|build|test|run)",
    r"npm run (build|test|start)",
    r"git (commit|push|pull|add)",
    r"background_output",
    r"playwright_browser",
    r"Thinking自检",
    r"完成DCP压缩#\d+",
    r"移除-?[\d.]+K?数据",
    r"新增\+?[\d.]+K?摘要",
    r"compressed \d+ messages?",
    r"\d+[\d.]*K?\s*removed.*\+.*summary",
    r"Compression #\d+.*removed",
]
NOISE_CASED = [r"[▣▪]\s*DCP"]

# Parts of the patterns above and of META, lower-cased, of which every match holds one; a pattern without them is tried on every text.
MARKS = {
    NOISE[3]: ("don't", "dont", "couldn't", "couldnt", "relevant"),
    NOISE[4]: ("don't", "dont"),
    NOISE[6]: ("你还记得", "你知道", "你记得"),
    NOISE[8]: ("query", "explicit", "returned"),
    r"query\s*->\s*none": ("query",),
    r"search returned": ("search returned",),
    r"extracted \d+ facts": ("extracted ",),
    r"reconciliation complete": ("reconciliation complete",),
    r"found \d+ matching": ("matching",),
    r"compression #\d+": ("compression #",),
    r"dcp-message-id": ("dcp-message-id",),
    r"system-reminder": ("system-reminder",),
    r"<system-reminder>": ("<system-reminder>",),
    r"background task": ("background task",),
    r"task_id.*bg_": ("task_id",),
    r"session_id:\s*ses_": ("session_id:",),
    r"cargo (build|test|check)": ("cargo ",),
    r"cargo (build|test|check|run)": ("cargo ",),
    r"npm (run|install|test)": ("npm ",),
    r"HTTP \d{3}": ("http ",),
    r"status code \d+": ("status code ",),
    r"docker (ps|run|exec|logs)": ("docker ",),
    r"grep.*pattern": ("grep",),
    r"git (status|log|diff|add|commit|push)": ("git ",),
    r"git (status|log|diff|add|commit|push|pull)": ("git ",),
    r"lsp_diagnostics": ("lsp_diagnostics",),
    r"ast_grep": ("ast_grep",),
    r"semantic search": ("semantic search",),
    r"\d+ files? (changed|modified|created)": (" file ", " files "),
    r"build (succeeded|failed)": ("build ",),
    r"test result: (ok|failed)": ("test result: ",),
    r"\d+ passed.*\d+ failed": (" passed",),
    r"compressed (conversation|block)": ("compressed ",),
    r"\[system-reminder\]": ("[system-reminder]",),
    r"\[dcp-message-id\]": ("[dcp-message-id]",),
    r"background task (launched|completed|error)": ("background task ",),
    r"task_id.*session_id": ("task_id",),
    r"cargo (check|build|test|run)": ("cargo ",),
    r"npm run (build|test|start)": ("npm ",),
    r"git (commit|push|pull|add)": ("git ",),
    r"background_output": ("background_output",),
    r"playwright_browser": ("playwright_browser",),
    r"Thinking自检": ("自检",),
    r"完成DCP压缩#\d+": ("压缩#",),
    r"移除-?[\d.]+K?数据": ("移除",),
    r"新增\+?[\d.]+K?摘要": ("新增",),
    r"compressed \d+ messages?": ("compressed ",),
    r"\d+[\d.]*K?\s*removed.*\+.*summary": ("summary",),
    r"Compression #\d+.*removed": ("compression #",),
}

META = [
    r"search returned",
    r"found \d+ matching",
    r"query\s*->\s*none",
    r"extracted \d+ facts",
    r"reconciliation complete",
    r"compression #\d+",
    r"dcp-message-id",
    r"<system-reminder>",
    r"background task",
    r"task_id.*bg_",
    r"session_id:\s*ses_",
    r"cargo (build|test|check|run)",
    r"npm (run|install|test)",
    r"HTTP \d{3}",
    r"status code \d+",
    r"docker (ps|run|exec|logs)",
    r"grep.*pattern",
    r"ast_grep",
    r"lsp_diagnostics",
    r"git (status|log|diff|add|commit|push|pull)",
]
META_WORDS = [
    "compression #", "compressed conversation section", "[system-reminder]", "[dcp-message-id]", "background task",
    "tool call message", "cargo check", "cargo build", "npm run build", "git commit", "git push", "task_id",
    "session_id", "background_output",
]

# Any of the words, or all words of a pair.
ARTIFACT_WORDS = ["完成dcp压缩", "▣ dcp", "▪ dcp"]
ARTIFACT_PAIRS = [("removed", "summary"), ("移除", "数据"), ("新增", "摘要"), ("compressed", "messages")]

SENSITIVE = [
    r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    r"密码[是为：:]\s*\S+",
    r"password\s*[=:]\s*\S+",
    r"sk-[a-zA-Z0-9]{20,}",
    r"api[_-]?key\s*[=:]\s*\S+",
    r"token\s*[=:]\s*\S+",
    r"ssh-[a-z]{3,}\s+\S+",
    r"mysql://",
    r"postgres://",
    r"mongodb://",
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    r"1[3-9]\d{9}",
    r"\b\d{16,19}\b",
    r"\b\d{17}[\dXx]\b",
]

# (pattern, bonus) of the quality score.
QUALITY = [
    (r"[0-9]{4}", 0.1),
    (r"\d{1,2}[年日月周]", 0.05),
    (r"\d+\.[0-9]+|[0-9]+%|[0-9]+[ξ元美元]", 0.05),
    (r"因此|所以|结论是|决定是|方案是|由于|因为", 0.1),
    (r"[。！？]\s*[^。！？]{30,}", 0.05),
    (r"(?m)^\s*[-*#]\s+\S", 0.05),
    (r"[A-Z][a-z]+[A-Z]|[A-Z]{2,}", 0.05),
]

# Blocks removed from messages; the host's own blocks carry its product name and are added by parameter.
MESSAGE_TAGS = [
    "system-reminder", "auto-slash-command", "thinking", " omoc:", "analysis", "ultrawork-mode",
    "EXTREMELY_IMPORTANT", "SUBAGENT-STOP", "team_mode_status", "dcp_message",
]
HOST_TAGS = ["context", "profile", "fetch-policy"]
MESSAGE_PHRASES = [
    "[Compressed conversation section]",
    "[search-mode]",
    "[analyze-mode]",
    "MANDATORY delegate_task params",
    "[SYSTEM DIRECTIVE",
    "OH-MY-OPENCODE",
    "Incomplete tasks",
    "OMO_INTERNAL_INITIATOR",
    "[restore checkpointed session agent configuration after compaction]",
    "[session recovered - continuing previous task]",
    "<!-- OMO_INTERNAL_INITIATOR -->",
]
DROPPED_LINE_STARTS = [
    "<dcp", "</dcp", "<dcf", "</dcf", "<system-reminder", "</system-reminder", "<auto-slash-command",
    "</auto-slash-command",
]

ENVELOPE = [
    r"(?m)^(?:\w+:\s*)?System:\s*\[.*?\]\s*Channel.*$",
    r"(?s)Conversation info \(untrusted metadata\):\s*\{.*?\}",
    r"(?s)Sender \(untrusted metadata\):\s*\{.*?\}",
    r"(?s)<(?:dcp|acp)-(?:message-id|system-reminder)\b[^>]*>.*?</(?:dcp|acp)-(?:message-id|system-reminder)>",
    r"(?s)<!--.*?-->",
]
# Parts of which every match of the pattern at the same place holds one.
ENVELOPE_MARKS = [
    ("System:",), ("Conversation info (untrusted metadata):",), ("Sender (untrusted metadata):",), ("<dcp-", "<acp-"), ("<!--",),
]
ENVELOPE_HEADERS = ["[Compressed conversation section]", "[system-reminder]", "[Category+Skill Reminder]"]

ROLE_LINE = r"\n(?:user|User|assistant|Assistant|Human|human|AI|system):"

SAVE_WORDS = [
    "remember", "save this", "don't forget", "记住", "记一下", "保存", "记下来", "别忘了", "memory_store",
]
RECALL_WORDS = [
    "i remember", "i recall", "we discussed", "we talked about", "last time", "earlier we", "previously", "before we",
    "look up", "find that", "search for", "check what", "what did we", "do you remember", "from our previous",
    "as discussed",
    "我记得", "之前说过", "之前聊过", "上次说的", "之前讨论", "我记得之前", "查一下", "搜一下", "找一下", "之前提到",
    "记得吗", "你还记得", "回忆一下", "上次那个", "之前那个", "上次讨论", "上次做的", "之前记录", "之前保存", "上次决定",
    "之前约定", "memory_search", "memory_get",
]

INJECTED_STARTS = [
    r"<!--\s*OMO_INTERNAL_INITIATOR\s*-->",
    r"^\[SYSTEM DIRECTIVE:",
    r"^\[restore checkpointed",
    r"^\[session recovered",
    r"^<system-reminder>",
    r"^<EXTREMELY_IMPORTANT>",
    r"^\[CONTEXT\]",
    r"^\[GOAL\]",
    r"^## 任务[：:]",
    r"^## 改动",
    r"^Analyze the attached file",
    r"^Provide ONLY the extracted",
    r"^Called the Read tool",
    r"^MANDATORY delegate_task",
    r"^[▣▪]\s*DCP",
]

RECALL_STRONG = [
    r"(?:之前|上次|以前|过去|曾经|记得|忘了|忘记|回忆|想起|提到过|说过|讨论过|聊过)",
    r"(?:那个方案|之前的|上次说的|之前做的|上次的|那个问题|那个项目|那个决定|之前讨论|之前决定|之前选的|之前定的)",
    r"(?:密码|密钥|口令|凭证)",
    r"(?:查一下|找一下|翻一下|看一下|搜一下|调出来).{0,4}(?:之前的|上次的|以前的|历史的|过去的|记录|笔记|文档|方案)",
    r"(?i:remember|recall|previously|last\s+time|earlier|that\s+time|before\s+this|the\s+other\s+day|we\s+discussed|we\s+talked|we\s+decided|as\s+we\s+agreed|from\s+before)",
    r"(?i:that\s+(?:project|decision|approach|solution|issue|feature|module|component)|the\s+one\s+we|what\s+did\s+we|how\s+did\s+we|what\s+was\s+the)",
    r"(?i:\b(?:password|secret|credential|api\s*key|access\s*token|secret\s*key)\b)",
]
RECALL_MEDIUM = [
    r"(?:我喜欢|我习惯|我的偏好|我通常|我一般|我喜欢用|我倾向于|我的风格|我的习惯|偏好)",
    r"(?:这个项目|这个模块|这个组件|这个功能|这个服务|这个系统|这个架构|团队|同事|协作|代码规范|技术栈|项目结构)",
    r"(?:环境变量|配置文件|部署|上线|服务器|数据库连接|端口号|域名|证书)",
    r"(?:方案选择|技术选型|为什么用|为什么选|选型|决策|规范|标准|约定)",
    r"(?i:i\s+(?:prefer|like|usually|typically|normally|always|tend\s+to)|my\s+(?:preference|style|habit|setup))",
    r"(?i:in\s+this\s+(?:project|repo|codebase|team)|our\s+(?:project|team|codebase|architecture|stack|standard|convention)|how\s+(?:do\s+we|does\s+our))",
    r"(?i:deploy|deployment|production|staging|environment\s+var|infrastructure|ci.?cd|pipeline)",
]
RECALL_WEAK = [
    r"(?:怎么实现|如何实现|怎么处理|如何处理|怎么解决|如何解决).{0,10}(?:功能|模块|接口|方案|架构|系统|组件|服务|认证|授权|缓存|队列)",
    r"(?:遇到了|报错了|出bug|崩溃|异常).{0,10}(?:问题|错误|bug|异常|崩溃)",
    r"(?:优化|重构|迁移|升级|改造|适配).{0,10}(?:方案|架构|系统|模块|组件|服务)",
    r"(?i:how\s+(?:should|do|can|might|would)\s+we\s+(?:implement|handle|solve|approach|deal\s+with))",
    r"(?i:(?:refactor|migrat|upgrad|rewrit|redesign|port)\s+(?:this|the|our))",
]
# Signal -> (lowest score kept, quality gate).
RECALL_LEVELS = {"strong": (0.35, 0.35), "medium": (0.40, 0.40), "weak": (0.45, 0.42), "none": (0.50, 0.48)}


def any_of(patterns) -> str:
    """One alternation of all patterns."""
    return "|".join(f"(?:{p})" for p in patterns)
