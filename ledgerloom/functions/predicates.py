"""Predicates that decide which items are looked at, and how they are dispatched."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import base_name, extension

# Extensions that are binary by name.
BINARY_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp", ".ico", ".svg", ".pdf", ".ipynb", ".zip", ".tar", ".gz", ".woff", ".woff2", ".ttf", ".otf", ".mp3", ".mp4", ".mov", ".wav")
# Commands whose output is worth condensing, and paths that always pass.
NOISY_COMMANDS = (r"\bcat\s", r"\bcurl\s", r"\btail\s+-n\s+\d{3,}", r"npm\s+(run\s+)?test", r"jest", r"pytest", r"go\s+test")
PASSTHROUGH_GLOBS = (
    "**/*.md", "**/go.mod", ".claude/**", "**/yarn.lock", "**/go.sum", "**/Cargo.lock", "**/Pipfile.lock", "**/pnpm-lock.yaml", "**/Gemfile.lock",
    "**/.env", "**/.env.*", "**/*.key", "**/*.pem", "**/*.p12", "**/*.pfx", "**/id_rsa", "**/id_ed25519", "**/id_ecdsa", "**/id_dsa",
)
LOCK_FILES = ("package-lock.json", "npm-shrinkwrap.json", "composer.lock", "Cargo.lock", ".terraform.lock.hcl")


def exceeds(lines: Column, size: Column, max_lines: int = 150, max_bytes: int = 60_000) -> Column:
    return (lines > max_lines) | (size > max_bytes)


def looks_binary(path: Column, content: Column) -> Column:
    """By extension, else by a NUL among the first 512 bytes."""
    return extension(path).isin(*BINARY_EXTENSIONS) | F.hex(F.substring(content, 1, 512)).rlike("^(..)*00")


def valid_patterns(patterns: list[str]) -> list[str]:
    """Patterns that compile; others are skipped."""
    out = []
    for p in patterns:
        try:
            re.compile(p)
        except re.error:
            continue
        out.append(p)
    return out


def first_match(x: Column, patterns: list[str]) -> Column:
    """The first pattern that is found in x, else null."""
    return F.coalesce(*[F.when(x.rlike(p), F.lit(p)) for p in valid_patterns(patterns)], F.lit(None).cast("string"))


def glob_regex(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i]))
            i += 1
    return f"(^|/){out}$"


def passes_through(path: Column, globs: list[str]) -> Column:
    """A glob fits the path or its last part."""
    found = F.lit(False)
    for g in globs:
        found = found | path.rlike(glob_regex(g)) | base_name(path).rlike(glob_regex(g))
    return found


def inactive_reason(active: Column, env_disabled: Column, disabled: Column, invalid: Column) -> Column:
    """Why nothing is intercepted, the first reason that holds; '' if all is active. invalid: the error, or ''."""
    return F.coalesce(
        F.when(active == "1", F.lit("recursion guard")), F.when(env_disabled == "1", F.lit("environment")), F.when(disabled, F.lit("config.disabled")),
        F.when(invalid != "", F.concat(F.lit("invalid config: "), invalid)), F.lit(""),
    )


def targeted_read(offset: Column, limit: Column) -> Column:
    return (F.coalesce(offset, F.lit(0)) != 0) | (F.coalesce(limit, F.lit(0)) != 0)


def grep_bypass(mode: Column, head_limit: Column, most: int = 60) -> Column:
    return F.coalesce(mode, F.lit("")).isin("", "count", "files_with_matches") | ((head_limit > 0) & (head_limit <= most))


def self_command(cmd: Column, own: str, verbs: tuple[str, ...] = ("run", "cat")) -> Column:
    """The command runs one of the tool's own verbs, the tool given by name, path or quoted path."""
    parts = F.split(F.trim(F.regexp_replace(cmd, r"\s+", " ")), " ")
    first = F.regexp_replace(F.get(parts, 0), "^['\"]+|['\"]+$", "")
    plain = (F.size(parts) >= 2) & ((first == own) | (base_name(first) == own.rsplit("/", 1)[-1])) & F.get(parts, 1).isin(*verbs)
    if not re.search(r"[ \t\n\r]", own):
        return plain
    for quoted in ("'" + own.replace("'", "'\\''") + "'", f'"{own}"'):
        plain = plain | (F.startswith(cmd, F.lit(quoted)) & F.regexp_extract(F.substr(cmd, F.lit(len(quoted) + 1)), r"^\s*(\S+)", 1).isin(*verbs))
    return plain


def shell_meta(cmd: Column) -> Column:
    return cmd.rlike(r"[|&;<>$`()\n\r]")


def shell_quote(x: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def redirect(cmd: Column, own: str, patterns: tuple[str, ...] = NOISY_COMMANDS) -> Column:
    """What to run instead of a noisy command; null for quiet commands and the tool's own. A command with shell signs is
    handed to a shell whole."""
    quoted = "'" + own.replace("'", "'\\''") + "'" if re.search(r"[\s'\"$`\\]", own) else own
    found = first_match(cmd, list(patterns))
    instead = F.when(shell_meta(cmd), F.concat(F.lit(f"{quoted} run -- sh -c "), shell_quote(cmd))).otherwise(F.concat(F.lit(f"{quoted} run -- "), cmd))
    text = F.concat(
        F.lit("this command tends to produce large output (matched /"), found, F.lit("/).\nRe-run it as follows so the full output is captured to a log and you get a digest:\n\n  "), instead, F.lit("\n"),
    )
    return F.when(~self_command(cmd, own), text)


def is_regular(exists: Column, is_dir: Column) -> Column:
    """A path that stands for a file."""
    return F.coalesce(exists & ~is_dir, F.lit(False))


def partial(seen_bytes: Column, all_bytes: Column) -> Column:
    return (all_bytes > 0) & (seen_bytes > 0) & (seen_bytes < all_bytes)


def valid_map(d: Column) -> Column:
    """A digest with a summary, entries, and line ranges of the form a or a-b."""
    return (F.length(F.trim(d["summary"])) > 0) & (F.size(d["map"]) > 0) & F.forall(d["map"], lambda e: e["lines"].rlike(r"^\d+(-\d+)?$"))


def valid_clusters(d: Column) -> Column:
    """A digest with a summary and clusters."""
    return F.coalesce((d["summary"] != "") & (F.size(d["clusters"]) > 0), F.lit(False))


def valid_run(d: Column) -> Column:
    return F.coalesce(d["summary"] != "", F.lit(False))


def escalates(raw: Column) -> Column:
    return F.coalesce(F.get_json_object(raw, "$.escalate") == "true", F.lit(False))


def is_lock_file(path: Column) -> Column:
    return base_name(path).isin(*LOCK_FILES)


def is_go_test(path: Column) -> Column:
    return F.endswith(path, F.lit("_test.go"))


def model_family(model: Column) -> Column:
    m = F.lower(model)
    return F.when(F.contains(m, F.lit("haiku")), "haiku").when(F.contains(m, F.lit("sonnet")), "sonnet").when(F.contains(m, F.lit("opus")), "opus").otherwise("")


# Parser by extension, then by name.
PARSERS = {
    "go": (".go",), "typescript": (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"), "python": (".py",), "rust": (".rs",), "json": (".json",), "yaml": (".yml", ".yaml"), "toml": (".toml",),
    "dockerfile": (".dockerfile",), "makefile": (".mk", ".make"), "shell": (".sh", ".bash", ".zsh", ".fish", ".ksh", ".dash"), "hcl": (".tf", ".hcl"), "proto": (".proto",), "sql": (".sql",),
    "graphql": (".graphql", ".gql", ".graphqls"), "ruby": (".rb", ".gemspec"), "kotlin": (".kt", ".kts"), "java": (".java",), "swift": (".swift",), "csharp": (".cs",),
    "cpp": (".c", ".cpp", ".cc", ".cxx", ".h", ".hpp", ".hh"), "scala": (".scala", ".sc"), "php": (".php",), "dart": (".dart",), "elixir": (".ex", ".exs"), "lua": (".lua",), "haskell": (".hs",),
    "r": (".r",), "ocaml": (".ml", ".mli"), "julia": (".jl",), "clojure": (".clj", ".cljs", ".cljc"), "fsharp": (".fs", ".fsx", ".fsi"), "erlang": (".erl", ".hrl"), "zig": (".zig",),
}
PARSER_NAMES = {"dockerfile": ("Dockerfile", "Containerfile"), "makefile": ("Makefile", "GNUmakefile", "makefile"), "shell": (".bashrc", ".zshrc", ".profile", ".bash_profile")}


def parser_of(path: Column) -> Column:
    """Name of the outline parser for a path; null where none applies (lock files, Go tests, unknown types)."""
    ext, base = extension(path), base_name(path)
    found = F.coalesce(*[F.when(ext.isin(*e), F.lit(p)) for p, e in PARSERS.items()], *[F.when(base.isin(*n), F.lit(p)) for p, n in PARSER_NAMES.items()])
    return F.when(~is_lock_file(path) & ~is_go_test(path), found)
