"""Values that results depend on, kept together and in plain form."""

# Suffix of a file name, in lower case, to language.
LANGUAGES = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "tsx",
    ".go": "go",
    ".rs": "rust",
    ".java": "java",
    ".rb": "ruby",
    ".c": "c",
    ".h": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".hpp": "cpp",
    ".cs": "c_sharp",
    ".kt": "kotlin",
    ".swift": "swift",
}
# Suffixes of files whose content is not read.
BINARY_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".pdf", ".exe", ".pyc", ".o", ".a", ".so")
# Fixed value: what stands for the content of such a file.
BINARY_NOTICE = "（バイナリファイルのため解析をスキップしました）"

# Names that put a file or directory out of a scan.
IGNORED_NAMES = (".git", "__pycache__", "venv", ".venv", ".env", "node_modules", ".vscode", ".idea", "dist", "build", ".pytest_cache", ".serena", ".kelpie")
# The same for the coverage of sources by documents.
IGNORED_SOURCE_NAMES = (".git", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".venv", "venv", "node_modules", "dist", "build")
# Directories and lower-case file names left out of the tree.
TREE_IGNORED_NAMES = (".git", "node_modules", "__pycache__", "dist", "build", "venv", ".venv", ".pytest_cache", ".kelpie", ".serena", "target", "out", ".idea", ".vscode", ".mypy_cache", ".tox", "coverage", ".eggs", "htmlcov")
TREE_IGNORED_FILES = ("bun.lock", "cargo.lock", "composer.lock", "gemfile.lock", "package-lock.json", "pnpm-lock.yaml", "poetry.lock", "uv.lock", "yarn.lock")

# What decides the kind of a file.
TEST_DIRECTORIES = ("tests", "test")
HELPER_WORDS = ("helper", "util", "fixture", "mock", "stub")
CONFIG_NAMES = (
    "pyproject.toml", "requirements.txt", "package.json", "Makefile", "setup.py", "uv.lock", "Cargo.toml", "CMakeLists.txt",
    "go.mod", "go.sum", ".gitignore", "pnpm-lock.yaml", "yarn.lock", "Dockerfile", "docker-compose.yml", "compose.yml",
    "compose.yaml", ".dockerignore", ".editorconfig", "conftest.py", "__init__.py",
)
CONFIG_SUFFIXES = (".yaml", ".yml", ".json", ".toml", ".xml", ".ini", ".cfg")
DOC_DIRECTORIES = ("docs", "doc", "wiki")
DOC_SUFFIXES = (".md", ".rst", ".txt", ".pdf")

# Lower-case names and endings to the category of a node of the tree.
DIRECTORY_CATEGORIES = {
    "code": ("src", "lib", "app", "cmd", "pkg", "internal"),
    "test": ("test", "tests", "spec", "specs"),
    "doc": ("doc", "docs"),
    "config": ("config", "conf", ".github", ".vscode"),
    "ci": ("scripts", "ci", "ops"),
}
CODE_ENDINGS = (".py", ".js", ".ts", ".go", ".rs", ".java", ".c", ".cpp", ".h", ".hpp", ".rb")
DOC_ENDINGS = (".md", ".txt", ".rst", ".pdf")
CONFIG_ENDINGS = (".json", ".yaml", ".yml", ".toml", ".ini", ".conf", ".cfg")
CI_NAMES = ("dockerfile", "makefile", "build.gradle")

# Names of files that start a program.
MAIN_FILES = ("main.py", "app.py", "index.js", "main.go", "lib.rs")
# Fixed value: a mark in a source file.
MARKER = r"(?:TODO|FIXME)[:\s]+(.*)"
# Beginnings of modules that count as internal, and parts of those of other languages.
INTERNAL_PREFIXES = ("src",)

# Thresholds and caps.
LARGE_LINES, SMALL_BYTES, HIGH_FAN_IN, HIGH_FAN_OUT = 300, 50, 10, 15
READ_CHARS, READ_BYTES, MOST_HITS, MOST_CONTEXT = 2000, 2 * 1024 * 1024, 50, 1000
TREE_DEPTH, TREE_NODES, WORKLIST_FILES, IMPORT_LINES, DIAGRAM_NODES, STALE_SECONDS = 2, 500, 1000, 250, 50, 2.0
NAME_CHARS, DEPENDENCY_LINES, DEPENDENCY_SCAN, STATEMENT_CHARS = 255, 12, 200, 160

# What an analysis must and must not hold.
SUMMARY_SECTIONS = ("## Major directories", "## Important files", "## Relationships", "## Uncertainties")
WORKER_SECTIONS = ("## Responsibility", "## Main Functions / Classes", "## Inputs and Outputs", "## Dependencies", "## Caveats")
WEAK_MARKERS = ("analysis failed", "failed to analyze", "model_error", "budget_exceeded", "invalid analysis result")
SHALLOW_PHRASES = ("initial exploration", "exploration of the root directory", "exploration started", "root directory only")
FAILED_PHRASES = (
    "## child query fallback", "[directory name]", "[file path]", "[role]", "[description]", "[uncertainty 1]",
    "graph td\n  a --> b", "budget_exceeded", "execution_error", "invalid_code", "model_error",
    "this section was not separated in the model output", "予算制限により中断", "予算制限により中断された", "フォールバック情報",
    "具体的なプロジェクトの構造に関する情報は含まれていません", "コンテキスト内にディレクトリの情報は見当たりません", "解析失敗のため詳細不明",
    "明示的な依存関係のグラフは生成されませんでした", "定義された関係性は存在しません", "解析が中断されたため",
)
# Fixed value: what stands for a section that a summary lacks.
PLACEHOLDER = "- This section was not separated in the model output; review the surrounding summary for available evidence."
# Beginnings of lines that import, by language.
DEPENDENCY_PREFIXES = {
    "python": ("import ", "from "),
    "javascript": ("import ", "require("),
    "typescript": ("import ", "require("),
    "go": ("import ",),
    "rust": ("use ", "extern crate "),
    "java": ("import ",),
}
OTHER_DEPENDENCY_PREFIXES = ("import ", "from ", "use ", "#include")
# Names of helpers that generated code may not take.
RESERVED_HELPERS = (
    "list_dir", "read_text", "file_info", "search_text", "list_artifacts", "read_artifact", "read_artifact_json",
    "grep_artifacts", "extract_symbols", "llm_query", "finish", "path_exists", "is_dir", "read_json", "record_document",
)
# Beginnings of answers that are errors of a model.
MODEL_ERRORS = ("[Gemini Error:", "[Ollama Error:", "[Error:")

# Why an answer isn't run.
EMPTY_ANSWER = "Model returned an empty response."
NO_CODE = "No Python code remained after normalization."
IMPORTS_REFUSED = "Import statements are not allowed. Use sandbox helpers instead."
SUBSCRIPT_REFUSED = "globals and locals are functions, not dict variables. Do not write {0}[...]; call {0}() first."
ASSIGNMENT_REFUSED = "Assigning to helper names is not allowed. '{0}' is a reserved helper."
DEFINITION_REFUSED = "Defining functions or classes matching helper names is not allowed. '{0}' is a reserved helper."
