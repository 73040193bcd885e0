"""Word lists, constants and defaults that must equal published behaviour.

Everything here is plain data in its natural order; no logic.
"""

# The sentence that stands for "no answer".
NOT_ENOUGH_DATA = "Not enough data to answer."

# Text encodings tried in this order; the last one accepts every byte.
TEXT_ENCODINGS = ("utf-8-sig", "utf-8", "cp1258", "cp1252", "latin-1")

# File extensions by modality.
TABLE_EXTENSIONS = (".csv", ".xlsx", ".xls", ".sql")
DOCUMENT_EXTENSIONS = (".pdf", ".docx", ".pptx", ".ppt", ".txt", ".md", ".html", ".htm", ".epub")
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp")
AUDIO_EXTENSIONS = (".m4a", ".mp3", ".wav", ".mp4")

# Document extensions that count as a file hint inside a question.
HINT_DOCUMENT_EXTENSIONS = (".pdf", ".docx", ".pptx", ".ppt", ".txt", ".md", ".html")

# Question words that never become keywords.
STOPWORDS = (
    "the", "and", "for", "from", "with", "that", "this", "what", "which",
    "where", "when", "how", "many", "much", "does", "did", "are", "is",
    "was", "were", "please", "answer", "file", "files",
    "hay", "cho", "toi", "cua", "cac", "nhung", "trong", "nao", "bao",
    "nhieu", "gi", "la", "va", "den", "tren",
)

# Words that ask for a computation (whole words in the current analyser).
COMPUTATION_TERMS = (
    "average", "mean", "sum", "total", "count", "how many", "bao nhieu",
    "percentage", "percent", "correlation", "median", "highest", "lowest",
    "max", "min", "rounded", "trung binh", "so luong", "ty le", "tong",
)
# The earlier analyser tests these as plain substrings.
COMPUTATION_SUBSTRINGS = (
    "average", "mean", "sum", "total", "count", "how many", "bao nhieu",
    "percentage", "percent", "correlation", "median", "highest", "lowest",
    "max", "min", "rounded", "trung binh", "so luong",
)

# Words that ask for several sources.
MULTI_SOURCE_TERMS = (
    "compare", "across", "all files", "which file", "shared", "common",
    "diem chung", "so sanh", "tat ca", "cross file", "both", "ca hai",
)
MULTI_SOURCE_SUBSTRINGS = (
    "compare", "across", "all files", "which file", "shared", "common",
    "diem chung", "so sanh", "tat ca", "cross file",
)

# Modality words of the current analyser (whole words).
IMAGE_WORDS = ("image", "picture", "photo", "ocr", "digit", "anh", "hinh")
AUDIO_WORDS = ("audio", "voice", "transcript", "recording", "ghi am")
TABLE_WORDS = ("csv", "xlsx", "table", "sheet", "sql", "bang")

# Modality words of the earlier analyser (substrings).
IMAGE_SUBSTRINGS = ("image", "picture", "photo", "ocr", "digit", "anh", "hinh", "hoc bong")
AUDIO_SUBSTRINGS = ("audio", "voice", "transcript", "workshop", "m4a")
DOCUMENT_SUBSTRINGS = ("axiom", "project core", "thanh vien", "member")
TABLE_SUBSTRINGS = ("csv", "xlsx", "table", "sheet", "sql", "average", "mean", "count", "correlation")

# Vietnamese letters and words used to tell the language of a question.
VIETNAMESE_LETTERS = "ăâđêôơưáàảãạấầẩẫậắằẳẵặéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ"
VIETNAMESE_WORDS = ("hay", "cho toi", "bao nhieu", "la gi")
VIETNAMESE_SUBSTRINGS = ("hay", "cho", "toi", "trong", "bao nhieu", "diem", "du an", "hoc bong")

# Counting-question terms; plain substrings, so "small" and "account" match too.
COUNTING_TERMS = ("how many", "bao nhieu", "count", "all", "tat ca")

# Solver routing.
CALCULATION_TERMS = (
    "correlation", "average", "mean", "sum", "count", "max", "min", "highest", "lowest",
    "rounded", "percentage", "median", "trung binh", "bao nhieu", "how many",
)
JOIN_CHAIN_TERMS = ("hyperactivated", "cnv", "endomet", "drug")

# Question families for error analysis, first match wins.
QUESTION_FAMILIES = (
    ("calculation", ("correlation", "average", "mean", "sum", "count", "how many", "bao nhieu", "trung binh")),
    ("image", ("image", "anh", "visible", "digit", "blue")),
    ("audio", ("audio", "meeting", "workshop")),
    ("yes_no", ("yes", "no", "did", "co phai")),
)

# Table operation words, first match wins.
OPERATION_TERMS = (
    ("correlation", ("correlation",)),
    ("mean", ("average", "mean", "trung binh")),
    ("sum", ("sum", "total", "tong")),
    ("median", ("median",)),
    ("count", ("count", "how many", "bao nhieu", "so luong")),
    ("min", ("lowest", "smallest", "minimum", "min")),
    ("max", ("highest", "largest", "maximum", "max")),
)
FILE_EXTREME_TERMS = ("highest", "largest", "max", "lowest", "smallest", "min")
LABEL_TERMS = ("which", "what", "who", "file", "name", "ten", "nhan")
ID_LIKE_TERMS = ("id", "index", "stt")
MEASURE_LIKE_TERMS = ("q2", "sales", "score", "diem", "acre", "cost", "price")
LABEL_COLUMN_TERMS = ("name", "label", "class", "file", "project", "student", "country")
MEASURE_ALIASES = (("toan", "math", "mathematics"),)

# Answer formatting.
YES_WORDS = ("yes", "y", "true", "co", "dung")
NO_WORDS = ("no", "n", "false", "khong", "sai")
YES_NO_OPENERS = ("did ", "do ", "does ", "is ", "are ", "was ", "were ")
NUMERIC_INTENT_TERMS = (
    "how many", "bao nhieu", "correlation", "average", "mean", "sum", "count",
    "percentage", "rounded", "number", "total",
)
TRUE_WORDS = ("true", "yes", "y", "1", "co")

# Broken-encoding digraphs; each counts 2, a C1 control 1, U+FFFD 3.
MOJIBAKE_PATTERN = "(Ã.|Â.|Ä.|Å.|Æ.|áº|á»|â€|â€™|â€œ|â€)"

# Regular expressions of the text rules.
TOKEN_PATTERN = "[\u4e00-\u9fff]{2,}|[a-z0-9_./*\\-]{2,}"
MATCH_KEY_DROP = "[^a-z0-9_./* \\-\u4e00-\u9fff]+"
SENTENCE_BOUNDARY = "(?<=[.!?;])\\s+|\\n+"

# Retrieval constants.
BM25_K1 = 1.5
BM25_B = 0.75
DIRECT_SCORE = 10.0
RARE_KEYWORD_BOOST = 3.0
CHUNKS_PER_FILE = 4
DOMINANCE = 1.3
SUMPOOL_DIRECT_SCORE = 5.0
SUMPOOL_WEIGHTS = (0.45, 0.55)
SUMPOOL_MODALITY_BONUS = 0.35
SUMPOOL_CROSS_FILE_BONUS = 0.1

# Evaluation cut-offs and parse-audit thresholds.
K_VALUES = (1, 3, 5, 8)
EMPTY_TEXT_CHARS = 30
SCANNED_PDF_CHARS = 200
LOW_OCR_CONFIDENCE = 40.0

# One-column headers that are labels, never list entries.
HEADER_WORDS = (
    "id", "gene", "name", "value", "count", "score", "type", "date", "label",
    "key", "item", "index", "no", "stt", "symbol", "sample", "peptide", "protein",
)

# Roster questions.
ROSTER_GROUP_TERMS = ("project", "du an")
ROSTER_SIZE_TERMS = ("thanh vien", "member")
ROSTER_MAX_TERMS = ("most", "highest", "largest")
ROSTER_MIN_TERMS = ("fewest", "least", "smallest", "lowest")
ROSTER_EXCLUDE_TERMS = ("sv moi", "new student", "moi tuyen")

# What a query text may consist of: parts of a parsed plan, expressions outside of Spark's expression package, and functions.
SQL_PLAN_PARTS = (
    "Project", "Filter", "Aggregate", "UnresolvedHaving", "Join", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Deduplicate", "Union", "Intersect", "Except",
    "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "WithWindowDefinition", "OneRowRelation", "UnresolvedOrdinal", "UnresolvedInlineTable",
)
SQL_EXPRESSIONS = (
    "UnresolvedAttribute", "UnresolvedStar", "UnresolvedAlias", "UnresolvedOrdinal", "UnresolvedExtractValue", "UnresolvedSubqueryColumnAliases", "UnresolvedWindowExpression",
)
SQL_SUBQUERIES = ("ScalarSubquery", "Exists", "ListQuery")
SQL_FUNCTIONS = frozenset(
    "abs and avg between bround case cast ceil ceiling char_length coalesce collect_list collect_set concat concat_ws contains corr count count_if cume_dist current_date date date_add date_diff date_format date_sub "
    "date_trunc datediff day dayofmonth dense_rank endswith extract first first_value floor format_number greatest hour if ifnull in initcap instr isnan isnotnull isnull lag last last_value lead least left "
    "length ln log log10 lower lpad ltrim max max_by mean median min min_by minute mod month nanvl not ntile nullif nvl or percent_rank percentile percentile_approx pow power quarter rank regexp_extract "
    "regexp_like regexp_replace replace right rlike round row_number rpad rtrim second sign size split sqrt startswith std stddev stddev_pop stddev_samp string_agg listagg substr substring sum "
    "to_date to_timestamp trim trunc try_cast try_divide upper var_pop var_samp variance weekday when year string int bigint double decimal boolean timestamp".split()
)
