"""Structural outlines of configuration formats and Python: files to entries (path, ord, start_line, end_line, kind).

Header formats are line tables: a line that opens a section numbers it by a running count, a section's end is the line
before the next opening, and its members are collected in line order. Python's methods and decorators need the same
running counts only. No Python code runs; a file's lines stay in one window partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import base_name, explode_lines, line_range, trim_space

GENERATED = r"@generated|DO NOT EDIT|Code generated|autogenerated"


def _lines(files: DataFrame, text: str) -> DataFrame:
    out = explode_lines(files, text, ("path",))
    return out.withColumn("t", trim_space(F.col("raw")))


def _ordered(value: Column, when: Column) -> Column:
    """Values of a group's lines for which `when` holds, in line order."""
    return F.transform(F.sort_array(F.collect_list(F.when(when & value.isNotNull(), F.struct("line_no", value.alias("v"))))), lambda x: x["v"])


def _sections(lines: DataFrame, opens: Column, closes: Column | None = None) -> DataFrame:
    """Adds section (0 before the first) and the file's last line; a line that closes ends a section and belongs to none."""
    w = Window.partitionBy("path").orderBy("line_no")
    mark = opens if closes is None else opens | closes
    out = lines.withColumn("_open", F.coalesce(opens, F.lit(False))).withColumn("section", F.sum(F.coalesce(mark, F.lit(False)).cast("int")).over(w))
    return out.withColumn("last", F.max("line_no").over(Window.partitionBy("path")))


def _ends(sections: DataFrame) -> DataFrame:
    """end_line of each section: before the next start, else the file's last line."""
    w = Window.partitionBy("path").orderBy("section")
    return sections.withColumn("end_line", F.coalesce(F.lead("start_line").over(w) - 1, F.col("last")))


def _numbered(entries: DataFrame) -> DataFrame:
    w = Window.partitionBy("path").orderBy("start_line", "kind")
    return entries.select("path", F.row_number().over(w).alias("ord"), "start_line", "end_line", "kind", line_range(F.col("start_line"), F.col("end_line")).alias("lines"), "names")


def _more(items: Column, k: int, fmt: str) -> Column:
    return F.concat(F.array_join(F.slice(items, 1, k), ", "), F.when(F.size(items) > k, F.format_string(fmt, F.size(items) - k)).otherwise(""))


def yaml(files: DataFrame, text: str = "text") -> DataFrame:
    lines = _lines(files, text).where((F.col("t") != "") & ~F.col("raw").rlike(r"^\s*#"))
    key = r"^(\s*)([\w.\-/]+)\s*:"
    all_lines = explode_lines(files, text, ("path",)).groupBy("path").agg(F.max("line_no").alias("last"))
    indent, name = F.length(F.regexp_extract("raw", key, 1)), F.regexp_extract("raw", key, 2)
    lines = lines.withColumns({"is_key": F.col("raw").rlike(key), "indent": indent, "name": name})
    cut = F.col("raw").rlike("^---")
    s = _sections(lines, F.col("is_key") & (F.col("indent") == 0) & ~cut, cut).drop("last")
    item = ~F.col("is_key") & F.col("raw").rlike(r"^\s*-\s+")
    child = F.col("is_key") & (F.col("indent") > 0) & (F.col("indent") <= 4)
    g = s.groupBy("path", "section").agg(
        F.min("line_no").alias("start_line"), F.max("_open").alias("opened"), F.min_by("name", "line_no").alias("key"), F.slice(_ordered(F.col("name"), child), 1, 8).alias("children"), F.count_if(item).alias("items")
    )
    g = _ends(g.where("section > 0").join(all_lines, "path")).where("opened")
    braces = F.concat(F.col("key"), F.lit(": {"), F.array_join(F.slice("children", 1, 5), ", "), F.lit("}"), F.when(F.size("children") > 5, F.format_string(" (+%d more)", F.size("children") - 5)).otherwise(""))
    kind = F.when(F.size("children") > 0, braces).when(F.col("items") > 0, F.format_string("%s: list[%d]", "key", "items")).otherwise(F.col("key"))
    return _numbered(g.withColumn("kind", kind).withColumn("names", F.array("key")))


def yaml_summary(entries: DataFrame) -> DataFrame:
    """A line on what the document is, by its name and top-level keys."""
    keys = F.transform(F.sort_array(F.collect_list(F.struct("ord", F.regexp_extract("kind", r"^([\w.\-/]+)", 1).alias("k")))), lambda x: x["k"])
    g = entries.groupBy("path").agg(keys.alias("keys")).withColumn("base", F.lower(base_name(F.col("path"))))
    has = lambda *k: F.forall(F.array(*map(F.lit, k)), lambda x: F.array_contains("keys", x))
    any_of = lambda *k: F.exists(F.array(*map(F.lit, k)), lambda x: F.array_contains("keys", x))
    compose = "Docker Compose service definition"
    text = (
        F.when(F.col("base").isin("docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml"), compose).when(F.col("base").isin("action.yml", "action.yaml"), "GitHub Actions workflow")
        .when(has("apiVersion", "kind", "metadata"), "Kubernetes manifest").when(has("services") & any_of("version", "networks", "volumes"), compose).when(has("name", "on", "jobs"), "GitHub Actions workflow")
        .when(has("name", "version", "dependencies"), "package manifest (YAML)").otherwise(F.format_string("YAML document — %d top-level key(s)", F.least(F.size("keys"), F.lit(40))))
    )
    return g.select("path", text.alias("summary"))


def toml(files: DataFrame, text: str = "text") -> DataFrame:
    lines = _lines(files, text)
    header = r"^\[([^\[\]]+)\]$|^(\[\[[^\[\]]+\]\])$"
    live = (F.col("t") != "") & ~F.col("raw").rlike(r"^\s*#")
    opens = live & F.col("t").rlike(header)
    key = F.when(live & ~opens & F.col("t").rlike(r'^[A-Za-z0-9_\-."]+\s*='), F.regexp_replace(F.regexp_extract("t", r'^([A-Za-z0-9_\-."]+)\s*=', 1), '^"+|"+$', ""))
    s = _sections(lines.withColumn("key", key), opens)
    g = s.groupBy("path", "section").agg(F.min("line_no").alias("start_line"), F.max("last").alias("last"), F.min_by("t", "line_no").alias("head"), F.slice(_ordered(F.col("key"), F.col("key").isNotNull()), 1, 12).alias("keys"))
    g = _ends(g)
    root = F.concat(F.lit("root: "), F.array_join(F.slice("keys", 1, 6), ", "))
    named = F.when(F.size("keys") == 0, F.col("head")).otherwise(F.concat(F.col("head"), F.lit(" — "), _more(F.col("keys"), 6, " (+%d more)")))
    kind, names = F.when(F.col("section") == 0, root).otherwise(named), F.when(F.col("section") == 0, F.col("keys")).otherwise(F.array("head"))
    return _numbered(g.where("section > 0 or size(keys) > 0").withColumns({"kind": kind, "names": names}))


def dockerfile(files: DataFrame, text: str = "text") -> DataFrame:
    lines = _lines(files, text)
    head = r"(?i)^FROM\s+(?:--[a-zA-Z][^\s]*\s+)*(\S+)(?:\s+AS\s+(\S+))?"
    verbs = r"(?i)^(RUN|COPY|ADD|WORKDIR|ENV|ARG|EXPOSE|ENTRYPOINT|CMD|LABEL|USER|VOLUME|HEALTHCHECK|ONBUILD|STOPSIGNAL|SHELL)\s"
    live = (F.col("t") != "") & ~F.col("raw").rlike(r"^\s*#")
    s = _sections(lines.withColumn("verb", F.when(live & F.col("t").rlike(verbs), F.upper(F.regexp_extract("t", verbs, 1)))), live & F.col("t").rlike(head))
    g = s.groupBy("path", "section").agg(F.min("line_no").alias("start_line"), F.max("last").alias("last"), F.min_by("t", "line_no").alias("head"), F.slice(F.array_distinct(_ordered(F.col("verb"), F.col("verb").isNotNull())), 1, 4).alias("verbs"))
    g = _ends(g).where("section > 0")
    alias = F.regexp_extract("head", head, 2)
    kind = F.concat(F.lit("FROM "), F.regexp_extract("head", head, 1), F.when(alias != "", F.concat(F.lit(" AS "), alias)).otherwise(""), F.when(F.size("verbs") > 0, F.concat(F.lit(" — "), F.array_join("verbs", ", "))).otherwise(""))
    return _numbered(g.withColumn("kind", kind).withColumn("names", F.array("kind")))


def makefile(files: DataFrame, text: str = "text") -> DataFrame:
    """Targets with their first recipe line. A variable, or any other line, ends a target."""
    lines = _lines(files, text)
    target, variable, phony = r"^([A-Za-z0-9._/\-]+)\s*:(?:[^=]|$)", r"^[A-Za-z_][A-Za-z0-9_]*\s*[:?+!]?=", r"^\.PHONY\s*:(.*)$"
    recipe = F.col("raw").rlike("^\t")
    live = (F.col("t") != "") & ~F.col("raw").rlike(r"^\s*#") & ~recipe
    skipped = F.col("raw").rlike(phony) | F.col("raw").rlike(variable) | (F.col("raw").rlike(target) & F.startswith("raw", F.lit(".")))
    opens = live & ~skipped & F.col("raw").rlike(target)
    s = _sections(lines, opens, live & ~skipped & ~F.col("raw").rlike(target))
    first = F.when(recipe & (F.col("t") != "") & ~F.startswith("t", F.lit("#")), F.col("t"))
    g = s.groupBy("path", "section").agg(F.min("line_no").alias("start_line"), F.max("last").alias("last"), F.max("_open").alias("opened"), F.regexp_extract(F.min_by("raw", "line_no"), target, 1).alias("name"), F.get(_ordered(first, first.isNotNull()), 0).alias("recipe"))
    names = lines.where(F.col("raw").rlike(phony)).select("path", F.explode(F.split(trim_space(F.regexp_extract("raw", phony, 1)), r"\s+")).alias("name")).distinct().withColumn("phony", F.lit(True))
    g = _ends(g.where("section > 0")).where("opened").join(names, ["path", "name"], "left")
    shown = F.when(F.octet_length("recipe") > 60, F.concat(F.substring(F.col("recipe").cast("binary"), 1, 57).cast("string"), F.lit("..."))).otherwise(F.col("recipe"))
    kind = F.concat(F.col("name"), F.when(F.col("phony"), " (phony)").otherwise(""), F.when(F.col("recipe").isNotNull(), F.concat(F.lit(": "), shown)).otherwise(""))
    return _numbered(g.withColumn("kind", kind).withColumn("names", F.array("name")))


def python(files: DataFrame, text: str = "text") -> DataFrame:
    """Imports, classes with their methods, functions and the public list."""
    cls, fn, method = r"^class\s+(\w+)", r"^(?:async\s+)?def\s+(\w+)", r"^\s{4}(?:async\s+)?def\s+(\w+)"
    w = Window.partitionBy("path").orderBy("line_no")
    lines = _lines(files, text).withColumn("last", F.max("line_no").over(Window.partitionBy("path")))
    lines = lines.where((F.col("t") != "") & ~F.startswith("t", F.lit("#")))
    raw = F.col("raw")
    what = (
        F.when(raw.rlike(r"^@\w+"), "decorator").when(raw.rlike(r"^(?:import|from)\s+"), "import").when(raw.rlike(r"^__all__\s*="), "all").when(raw.rlike(cls), "class").when(raw.rlike(fn), "def")
        .when(raw.rlike(method), "method").when(raw.rlike(r"^[^ \t]"), "other").otherwise("body")
    )
    lines = lines.withColumn("what", what)
    # a run of decorators right before a declaration moves its start up; any other line in between forgets them
    lines = lines.withColumn("_run", F.sum((F.col("what") != "decorator").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    first = F.min(F.when(F.col("what") == "decorator", F.col("line_no"))).over(Window.partitionBy("path", F.coalesce("_run", F.lit(0))))
    lines = lines.withColumn("start_line", F.when(F.col("what").isin("class", "def"), F.coalesce(first, F.col("line_no"))).otherwise(F.col("line_no")))
    # a class ends before the next class, function or other top-level statement
    ends_class = F.col("what").isin("class", "def", "other")
    lines = lines.withColumn("_class", F.sum(ends_class.cast("int")).over(w))
    g = lines.groupBy("path", "_class").agg(F.min_by("what", "line_no").alias("what"), F.min("start_line").alias("start_line"), F.min("line_no").alias("line_no"), F.max("last").alias("last"), F.regexp_extract(F.min_by("raw", "line_no"), cls, 1).alias("name"), _ordered(F.regexp_extract("raw", method, 1), F.col("what") == "method").alias("methods"))
    g = g.withColumn("end_line", F.coalesce(F.lead("line_no").over(Window.partitionBy("path").orderBy("_class")) - 1, F.col("last"))).where((F.col("what") == "class") & (F.col("_class") > 0))
    label = F.concat(F.lit("class "), F.col("name"), F.when(F.size("methods") > 0, F.concat(F.lit(" — methods: "), _more(F.col("methods"), 5, " (+%d more)"))).otherwise(""))
    classes = g.select("path", "start_line", "end_line", label.alias("kind"), "last")
    imports = lines.where("what = 'import'").groupBy("path").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.lit("imports").alias("kind"), F.max("last").alias("last"))
    public = lines.where("what = 'all'").select("path", "start_line", F.col("line_no").alias("end_line"), F.lit("__all__ — public API declaration").alias("kind"), "last")
    defs = lines.where("what = 'def'").select("path", "start_line", F.col("start_line").alias("end_line"), F.concat(F.lit("def "), F.regexp_extract("raw", fn, 1)).alias("kind"), "last")
    every = imports.union(classes).union(public).union(defs)
    # a function reaches to the line before the next entry; one that starts on the last line doesn't count
    after = F.min("start_line").over(Window.partitionBy("path").orderBy("start_line").rangeBetween(1, Window.unboundedFollowing))
    end = F.when(F.col("kind").startswith("def "), F.when(after < F.col("last"), after - 1).otherwise(F.col("last"))).otherwise(F.col("end_line"))
    name = F.regexp_extract("kind", r"^(?:class |def )?(\w+)", 1)
    return _numbered(every.withColumns({"end_line": F.greatest(F.col("start_line"), end), "names": F.when(F.col("kind") == "imports", F.array().cast("array<string>")).otherwise(F.array(name))}))


#: Parser name (see predicates.parser_of) to outline.
OUTLINES = {"yaml": yaml, "toml": toml, "dockerfile": dockerfile, "makefile": makefile, "python": python}


def outline(files: DataFrame, parser: str, text: str = "text") -> DataFrame:
    return OUTLINES[parser](files, text)


def is_generated(text: Column, lines: int = 5, marks: str = GENERATED) -> Column:
    """A marker among the first lines says that the file is generated."""
    return F.substring_index(text, "\n", lines).rlike(marks)


def _toml_summary(base: Column, heads: Column) -> Column:
    full = F.transform(F.filter(heads, lambda h: F.startswith(h, F.lit("["))), lambda h: F.regexp_replace(h, r"^\[+|\]+$", ""))
    has = lambda x: F.exists(full, lambda h: (h == x) | F.startswith(h, F.lit(x + ".")))
    return (
        F.when(base == "cargo.toml", "Cargo package manifest").when(base == "pyproject.toml", "Python project config (pyproject.toml)").when(base == "poetry.toml", "Poetry config")
        .when(has("package") & (has("dependencies") | has("dev-dependencies")), "Cargo package manifest").when(has("tool") & has("build-system"), "Python project config (pyproject.toml)")
        .when(F.array_contains(full, "tool.poetry"), "Poetry project config").otherwise(F.format_string("TOML config — %d section(s)", F.col("n")))
    )


def described(files: DataFrame, parser: str, text: str = "text") -> DataFrame:
    """path, summary, symbols and notes of every file that has an outline."""
    entries = outline(files, parser, text)
    ordered = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ord", "names"))), lambda x: x["names"]))
    g = entries.groupBy("path").agg(F.count("*").alias("n"), ordered.alias("all")).join(files.select("path", F.col(text).alias("_text")), "path")
    base = F.lower(base_name(F.col("path")))
    names = F.array_distinct("all") if parser in ("python", "toml") else F.col("all")
    marks = GENERATED if parser in ("python", "toml", "yaml") else "@generated|DO NOT EDIT|autogenerated"
    noted = parser in ("python", "yaml")
    if parser == "yaml":
        g = g.join(yaml_summary(entries), "path")
        summary = F.col("summary")
    elif parser == "toml":
        summary = _toml_summary(base, F.col("all"))
    elif parser == "python":
        doc = F.regexp_extract("_text", r"""(?s)^(?:\s*#[^\n]*\n|\s)*(?:\"{3}|'{3})\s*([^\n]*?)\s*(?:\"{3}|'{3}|\n|$)""", 1)
        summary = F.when(doc != "", doc).otherwise("Python module")
    elif parser == "dockerfile":
        summary = F.format_string("Dockerfile — %d stage%s", F.col("n"), F.when(F.col("n") == 1, "").otherwise("s"))
    else:
        summary = F.format_string("Makefile — %d target(s)", F.col("n"))
    made = is_generated(F.col("_text"), marks=marks)
    suffix = F.when(made, " — generated file, do not edit directly" if noted else " — generated, do not edit directly").otherwise("")
    notes = F.when(made, "generated file — edit the generator, not this file").otherwise("") if noted else F.lit("")
    if parser == "makefile":
        notes = F.when(F.col("n") > 40, F.format_string("showing first 40 of %d targets", F.col("n"))).otherwise("")
    return g.select("path", F.concat(summary, suffix).alias("summary"), F.slice(names, 1, 40).alias("symbols"), notes.alias("notes"))
