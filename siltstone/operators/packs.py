"""Packs of line rules with fixed ids, texts and severities, for layers.line_findings() and regex_findings()."""

from __future__ import annotations

from .layers import LineRule

# Ids, texts, severities and contexts of the logic rules.
LOGIC = [
    LineRule("LOGIC001", "panic!(", "error"),
    LineRule("LOGIC002", "todo!(", "warning"),
    LineRule("LOGIC003", "unimplemented!(", "info"),
    LineRule("LOGIC010", ".unwrap()", "warning", context="unguarded"),
    LineRule("LOGIC011", ".unwrap_err()", "warning"),
    LineRule("LOGIC020", '.expect("")', "warning"),
    LineRule("LOGIC021", '.expect("error")', "info"),
    LineRule("LOGIC030", "unsafe {", "warning", context="unexplained"),
    LineRule("LOGIC031", "unsafe fn ", "info", context="unexplained"),
    LineRule("LOGIC040", "== true", "info"),
    LineRule("LOGIC041", "== false", "info"),
    LineRule("LOGIC050", "TODO", "info", in_comments=True),
    LineRule("LOGIC051", "FIXME", "info", in_comments=True),
    LineRule("LOGIC060", ".clone()", "info"),
    LineRule("LOGIC061", ".clone()", "warning", context="in_loop"),
    LineRule("LOGIC061", ".to_string()", "info"),
    LineRule("LOGIC070", "Vec::new()", "hint"),
    LineRule("LOGIC071", "HashMap::new()", "hint"),
    LineRule("LOGIC080", "await ", "warning", context="in_loop"),
    LineRule("LOGIC081", "key=lambda", "warning"),
    LineRule("LOGIC082", "// ", "warning", "python"),
    LineRule("LOGIC083", "[send_", "warning"),
    LineRule("LOGIC084", "= open(", "warning"),
    LineRule("LOGIC090", ".partial_cmp(", "warning"),
    LineRule("LOGIC091", ".first().unwrap()", "warning"),
    LineRule("LOGIC092", ".last().unwrap()", "warning"),
    LineRule("LOGIC093", ".node_weight(", "warning"),
]

# Ids, texts and severities of the security rules.
SECURITY = [
    LineRule("SEC001", 'password = "', "error"),
    LineRule("SEC001", 'password="', "error"),
    LineRule("SEC002", 'api_key = "', "error"),
    LineRule("SEC003", 'secret_key = "', "error"),
    LineRule("SEC004", 'token = "', "error"),
    LineRule("SEC005", 'private_key = "', "error"),
    LineRule("SEC006", "BEGIN RSA PRIVATE KEY", "error"),
    LineRule("SEC006", "BEGIN PRIVATE KEY", "error"),
    LineRule("SEC011", "concat!(", "error"),
    LineRule("SEC012", "SELECT * FROM ", "warning"),
    LineRule("SEC013", "INSERT INTO ", "warning"),
    LineRule("SEC020", "std::process::Command", "warning"),
    LineRule("SEC020", "std::process::Command::new(", "warning"),
    LineRule("SEC021", ".args([", "warning"),
    LineRule("SEC030", '.."', "error"),
    LineRule("SEC030", "../", "error"),
    LineRule("SEC031", "std::fs::read(", "warning"),
    LineRule("SEC032", "std::fs::write(", "warning"),
    LineRule("SEC040", "md5::", "error"),
    LineRule("SEC041", "sha1::", "warning"),
    LineRule("SEC042", "DES", "error", whole_word=True),
    LineRule("SEC043", "RC4", "error", whole_word=True),
    LineRule("SEC050", "0.0.0.0", "warning"),
    LineRule("SEC051", "http://", "warning"),
    LineRule("SEC060", "std::mem::transmute", "error"),
    LineRule("SEC061", "std::hint::unreachable_unchecked", "error"),
    LineRule("SEC070", "debug_assert!", "info"),
    LineRule("SEC080", "password ==", "warning", context="no_enum"),
    LineRule("SEC080", "token ==", "warning", context="no_enum"),
    LineRule("SEC080", "secret ==", "warning", context="no_enum"),
    LineRule("SEC080", "api_key ==", "warning", context="no_enum"),
    LineRule("SEC090", "eval(", "error"),
    LineRule("SEC091", "exec(", "error", whole_word=True),
    LineRule("SEC092", "new Function(", "error"),
    LineRule("SEC100", "pickle.loads", "error"),
    LineRule("SEC100", "pickle.load", "error"),
    LineRule("SEC101", "marshal.loads", "error"),
    LineRule("SEC102", "yaml.load(", "error"),
    LineRule("SEC110", "Math.random()", "warning"),
    LineRule("SEC111", "random.randint", "warning"),
    LineRule("SEC111", "random.choice", "warning"),
    LineRule("SEC112", "rand::thread_rng()", "info"),
    LineRule("SEC120", ".innerHTML =", "error"),
    LineRule("SEC121", ".outerHTML =", "error"),
    LineRule("SEC122", "document.write(", "error"),
    LineRule("SEC130", "__proto__", "error"),
    LineRule("SEC131", "Object.assign(", "warning"),
    LineRule("SEC140", "new Buffer(", "warning"),
    LineRule("SEC150", "tempfile.mktemp", "warning"),
    LineRule("SEC151", "/tmp/", "info"),
    LineRule("SEC160", "Access-Control-Allow-Origin: *", "warning"),
    LineRule("SEC160", "cors({ origin: '*' })", "warning"),
    LineRule("SEC170", "verify=False", "error"),
    LineRule("SEC171", "CERT_NONE", "error"),
    LineRule("SEC172", "rejectUnauthorized: false", "error"),
    LineRule("SEC180", "shell=True", "error"),
    LineRule("SEC181", "os.system(", "error"),
    LineRule("SEC190", "debug=True", "error"),
    LineRule("SEC190", "DEBUG = True", "error"),
    LineRule("SEC200", "assert ", "warning"),
]

# Ids, expressions and severities of the rules for sources of unknown languages.
FALLBACK = [
    ("SEC001", r"password\s*=\s*[\"']", "error"),
    ("SEC002", r"api_key\s*=\s*[\"']", "error"),
    ("SEC003", r"secret_key\s*=\s*[\"']", "error"),
    ("SEC004", r"token\s*=\s*[\"']", "error"),
    ("SEC005", r"private_key\s*=\s*[\"']", "error"),
    ("SEC006", r"BEGIN (RSA )?PRIVATE KEY", "error"),
    ("SEC001", r"ADMIN_PASSWORD\s*=\s*[\"']", "error"),
    ("SEC002", r"API_KEY\s*=\s*[\"']", "error"),
    ("SEC010", r"SELECT\s+\*\s+FROM.*\$\{", "error"),
    ("SEC010", r"SELECT\s+\*\s+FROM.*#\{", "error"),
    ("SEC010", r"INSERT\s+INTO.*\$\{", "error"),
    ("SEC010", r"DELETE\s+FROM.*\$\{", "error"),
    ("SEC010", r"UPDATE\s+.*SET.*\$\{", "error"),
    ("SEC020", r"Runtime\.getRuntime\(\)\.exec\(", "error"),
    ("SEC020", r"system\s*\(\s*[\"']ls\s*\+", "error"),
    ("SEC021", r"`.*\$\{.*\}.*`", "error"),
    ("SEC180", r"subprocess.*shell\s*=\s*True", "error"),
    ("SEC181", r"os\.system\s*\(", "error"),
    ("SEC090", r"eval\s*\(\s*[\"']", "error"),
    ("SEC091", r"exec\s*\(\s*[\"']", "error"),
    ("SEC092", r"new\s+Function\s*\(", "error"),
    ("SEC030", r"\.\./", "warning"),
    ("SEC030", r"\.\.\\", "warning"),
    ("SEC080", r"if\s+\w+\s*==\s*\w+_PASSWORD", "warning"),
    ("SEC110", r"Math\.random\s*\(\s*\)", "warning"),
    ("SEC110", r"rand\s*\(\s*\)", "warning"),
]

# Kinds of items whose presence is reported, with their ids.
ITEMS = {"struct": "AST001", "enum": "AST002", "trait": "AST003", "impl": "AST004", "use": "AST005"}

# Folders that tell a layer, what a layer may depend on, and imports that a layer may not have.
LAYER_FOLDERS = {"ui": ["ui", "presentation", "handlers"], "application": ["application", "services", "usecases"], "domain": ["domain", "entities", "models"], "infrastructure": ["infrastructure", "persistence", "db"]}
LAYER_MAY_USE = {"ui": ["application", "domain"], "application": ["domain", "infrastructure"], "domain": [], "infrastructure": ["domain"]}
FORBIDDEN_IMPORTS = [("ui", "sqlx::"), ("ui", "diesel::"), ("domain", "actix_web"), ("domain", "rocket")]
