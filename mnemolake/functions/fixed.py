"""Word lists, thresholds and formats whose results must stay as they are."""

# fixed values: lines of capture text
MIN_LINE_BYTES = 7
SNIPPET_CHARS = 220
GENERIC_LABELS = ["new tab", "home", "trending", "for you", "shorts", "explore", "discover", "notifications", "inbox", "starred", "settings", "untitled"]
GENERIC_TITLES = ["new tab", "untitled", "home", "settings", "preferences", "dashboard", "start page"]
BROWSER_APPS = ["chrome", "safari", "arc", "firefox", "edge"]
CODE_APPS = ["terminal", "iterm", "vscode", "code", "cursor"]
MAIL_APPS = ["gmail", "mail", "outlook", "superhuman"]
MAIL_HEADERS = ["from:", "to:", "subject:", "cc:", "bcc:"]
ANIMATION_LABELS = ["loading", "loading...", "please wait", "retry", "refresh", "updated just now"]
NOTIFICATION_PARTS = [" minutes ago", " hours ago", " liked this", " replied", "suggested for you"]
FEED_LABELS = ["watch now", "learn more", "follow", "share", "like"]
JSON_KEYS = ['"files"', '"path"', '"nodes"', '"items"']
PATH_ENDS = [".rs", ".ts", ".json", ".md"]
LOW_CONF = "[LOW_CONF]"
QUALITY_FLOOR = 0.36
BROWSER_SYMBOLS, OTHER_SYMBOLS = 0.38, 0.58

# fixed values: salient spans
MAX_SPANS = 64
CUE_WORDS = [
    "because", "however", "therefore", "should", "must", "todo", "next", "plan", "need to", "consider", "implement", "review", "fix", "blocker",
    "decided", "open question",
]
ACTION_ENDS = ["ed", "ing", "tion", "sion", "ment", "able", "ible"]

# fixed values: recognised text
OCR_DROP, OCR_LOW = 0.40, 0.65
OCR_MAX_LINES = 220
OCR_NOISE_PARTS = [
    "File Edit View Window Help", "Apple Inc.", "System Settings", "System Preferences", "Finder", "com.apple.", "com.google.", "com.microsoft.", "AM", "PM",
    "Version", "Build", "Copyright ©", "All Rights Reserved", "Sign in", "Sign up", "Log in", "Log out", "Forgot password", "Loading...", "Please wait", "OK",
    "Cancel",
]
OCR_UI_WORDS = [
    "close", "minimize", "maximize", "menu", "settings", "preferences", "about", "help", "quit", "exit", "new", "open", "save", "print", "copy", "paste",
    "cut", "undo", "redo", "search", "find",
]
OCR_DAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
OCR_MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
OCR_TIME = r"^\d{1,2}:\d{2}(\s*(AM|PM))?$"
OCR_SIZE = r"^\d+(\.\d+)?\s*(B|KB|MB|GB|TB)$"

# fixed values: search and evaluation
BM25_K1, BM25_B, BM25_IDF_FLOOR = 1.2, 0.75, 1e-6
DEFAULT_HITS, MAX_HITS, SNIPPET_TOKENS = 10, 50, 12
RECALL_AT, MRR_AT = 5, 10
GATE_EPSILON = 1e-9
RRF_K = 60  # published by Cormack et al., 2009

# fixed values: store
FLUSH_BATCH = 256
EMBEDDING_MODEL, EMBEDDING_DIM, FULL_DIM = "qwen768", 768, 1024
SCHEMA_VERSION = 2
LIFECYCLE = {0: "Captured", 1: "Pending", 2: "ReviewedLocal", 3: "ReviewedDaily", 4: "ReviewFailed"}
TASK_STATUS = {0: "Open", 1: "Done", 2: "Dismissed"}
RATE_CAP = 20
